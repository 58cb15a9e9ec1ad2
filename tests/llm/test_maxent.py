import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import maxent as mx
from riskloom.llm.common import text_bytes

SCHEMA = "doc_id long, text string"
WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words_in(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in WHITE.split(low) if w] + [None]


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) in plain Python."""
    count = Counter(w for d, t in rows if not is_held_out(d) for w in words_in(t))
    total, distinct = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        own = words_in(t)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        out.append((d, is_held_out(d), len(own), sum(count[w] > 0 for w in own), total, round(base, 6)))
    return sorted(out, key=repr)


def ours(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


def corpus(n=400):
    """Words that depend on the two before them, so that contexts tell something."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(n):
        text, a, b = [], 0, 0
        for _ in range(rng.randint(0, 60)):
            a, b = b, (a * 7 + b * 3 + rng.choice((0, 0, 0, 1, 5))) % len(words)
            text.append(words[b] if rng.random() > 0.05 else f"rare{rng.randrange(3000)}")
        rows.append((d, " ".join(text)))
    return rows


EDGE = [
    (None, None), (None, "w1 w2 NEVERSEEN w3"), (7001, None), (7002, ""), (7003, " \t\n "), (7004, "W1\x0bw2\x0cw3 É é"), (7004, "W1\x0bw2\x0cw3 É é"),
    (7004, "other text"), (7005, "long " * 60_000), (7006, "x" * 100_000), (7007, "nur\x85einmal\xa0da"),
]


def small_model(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", score double")
    made, words = mx.language_model(docs, ~mx.held_out(), **options)
    total = mx.F.lit(words.total).alias("train_tokens")
    return docs, made.select("doc_id", mx.held_out().alias("held_out"), "n_tokens", "n_known", total, "base_score", "score"), words


@pytest.mark.parametrize("hot_words", [1 << 17, 30, 0])
def test_counts_and_base_against_plain_python(spark, hot_words):
    rows = corpus(80) + EDGE
    _, made, _ = small_model(spark, rows, hot_words=hot_words)
    got = made.collect()
    assert ours(got) == brute_base(rows)
    assert all(r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id == 7004 and r.n_tokens == 6]
    assert len(same) == 2 and same[0] == same[1]


def test_score_does_not_depend_on_what_is_hot(spark):
    rows = corpus(120) + EDGE
    scores = [sorted((repr(r.doc_id), round(r.score, 5)) for r in small_model(spark, rows, hot_words=h)[1].collect()) for h in (1 << 17, 4100)]
    assert scores[0] == scores[1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mx.language_model(empty, ~mx.held_out())[0].collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    got = {r.doc_id: r for r in mx.language_model(docs, mx.F.lit(False))[0].collect()}
    assert got[1].n_known == 0 and got[1].n_tokens == 3 and got[1].base_score == pytest.approx(0.0)
    assert got[2].n_tokens == 1


def test_probabilities_add_up_to_one(spark):
    """Over all words of the model, all rarer ones and one never seen, in contexts of any kind."""
    rows = corpus()
    docs, _, words = small_model(spark, rows)
    weights = mx.train(docs.filter(~mx.held_out()), words)
    assert np.abs(weights.classes).max() > 0.1 and np.abs(weights.words).max() > 0.1
    count = Counter(w for d, t in rows if not is_held_out(d) for w in words_in(t))
    rare_share = sum(count[w] + 1 for w in sorted(count, key=lambda w: (-count[w], w or " "))[words.size :]) + 1
    assert rare_share == words.rare_total

    def ended(text):
        own = mx.tokens_of(*text_bytes(pa.array([text])), words)
        return np.exp(mx.log_probabilities(mx.events(own, words), words, weights))[-1]

    for before in ("", "w1", "w7 w30", "never seen w5", "w1 w2 w3 w4"):
        texts = [f"{before} {w}".strip() for w in count if w is not None] + [f"{before} unseen-word".strip()]
        made = mx.tokens_of(*text_bytes(pa.array(texts)), words)
        p = np.exp(mx.log_probabilities(mx.events(made, words), words, weights))
        at, number = made.first[1:] - 2, made.number[made.first[1:] - 2]
        rare = (number < 0) | (number >= words.size)
        total = p[at[~rare]].sum() + p[at[rare]][0] + ended(before)
        assert total == pytest.approx(1.0, abs=1e-4)


def test_sums_against_plain_loops(spark):
    rows = corpus(30)
    docs, _, words = small_model(spark, rows)
    made = mx.events(mx.tokens_of(*text_bytes(pa.array([t for _, t in rows])), words), words)
    weights = mx.no_weights()
    rng = np.random.default_rng(1)
    weights.classes[:], weights.words[:] = rng.normal(0, 0.3, weights.classes.shape), rng.normal(0, 0.3, weights.words.shape)
    seen, wanted = mx.no_weights(), mx.no_weights()
    several = np.bincount(words.owner, minlength=mx.CLASSES) > 1
    for k in range(len(made.kind)):
        logit = words.class_bias + weights.classes[made.class_rows[k]].sum(0)
        inner = words.word_bias[made.kind[k]] + weights.words[made.word_rows[k]].sum(0)
        for row, other in zip(made.class_rows[k], made.word_rows[k]):
            seen.classes[row, made.kind[k]] += 1
            wanted.classes[row] += np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
            if several[made.kind[k]]:
                seen.words[other, made.place[k]] += 1
                wanted.words[other] += np.exp(inner - inner.max()) / np.exp(inner - inner.max()).sum()
    for parts in (1, 5):
        for got, want in ((mx.summed(docs.repartition(parts), words, None), seen), (mx.summed(docs.repartition(parts), words, weights), wanted)):
            assert np.allclose(got.classes, want.classes, atol=1e-3) and np.allclose(got.words, want.words, atol=1e-3)


def test_contexts_that_come_back_are_worked_out_once(spark, monkeypatch):
    texts = ["w1 w2 w3 w4 w1 w2 w3 w4", "w1 w2 w3"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    words = mx.vocabulary(mx.word_counts(docs))
    weights = mx.no_weights()
    rng = np.random.default_rng(1)
    weights.classes[:], weights.words[:] = rng.normal(0, 0.3, weights.classes.shape), rng.normal(0, 0.3, weights.words.shape)
    made = mx.events(mx.tokens_of(*text_bytes(pa.array(texts)), words), words)
    # (start), w1, w1 w2, w2 w3, w3 w4, w4 w1: six contexts, and one more row for each class met in one of them.
    contexts, worked, logits = len(np.unique(made.context)), [], mx._logits
    monkeypatch.setattr(mx, "_logits", lambda bias, table, rows: worked.append(len(rows)) or logits(bias, table, rows))
    got = mx.log_probabilities(made, words, weights)
    assert contexts == 6 and sum(worked) <= 6 + 8
    wanted = mx.no_weights()
    worked.clear()
    mx.expected(mx.met(mx._numbered(made)), words, weights, wanted)
    assert sum(worked) <= 6 + 8
    monkeypatch.undo()
    assert wanted.classes.sum() == pytest.approx(mx.FEATURES * len(made.kind), rel=1e-5)
    alone = [mx.events(mx.tokens_of(*text_bytes(pa.array([t])), words), words) for t in texts]
    assert np.allclose(got, np.concatenate([mx.log_probabilities(a, words, weights) for a in alone]), atol=1e-5)
    parts = mx._together([mx.met(mx._numbered(a)) for a in alone])
    whole = mx.met(mx._numbered(made))
    assert (parts.number == whole.number).all() and (parts.count == whole.count).all()


def test_contexts_help_on_held_out_rows(spark):
    _, made, _ = small_model(spark, corpus(1500))
    held = [r for r in made.collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens > 0.3


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = mx.op12_lm_score(spark, small).collect()
    assert ours(got) == brute_base(rows)


def rare_pairs():
    """More words than the classes hold; the rarest come in pairs."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(4100)] * 8
    rng.shuffle(common)
    rows = [" ".join(common[k : k + 40]) for k in range(0, len(common), 40)]
    return rows + [f"a{k} b{k}" for k in range(300)] * 3


def test_rarer_words_are_told_apart_by_their_context(spark):
    """Words beyond those of the classes, also as context: who follows whom has been seen thrice."""
    rows = rare_pairs()
    asked = [f"a{k} b{(k + shift) % 300}" for shift in (0, 7, 50) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows + asked)), SCHEMA)
    for hot in (1 << 16, 4100):
        made, words = mx.language_model(docs, mx.F.col("doc_id") < len(rows), hot_words=hot)
        assert words.size < 4100
        score = {r.doc_id - len(rows): r.score for r in made.collect()}
        met, other, third = (sum(score[300 * s + k] for k in range(300)) / 300 for s in range(3))
        assert met - max(other, third) > 0.1


def test_rarer_words_and_one_never_seen_add_up_to_one(spark):
    rows = rare_pairs()
    docs = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    words = mx.vocabulary(mx.word_counts(docs))
    weights = mx.train(docs, words)
    assert np.abs(weights.sides).max() > 0.1
    count = Counter(w for t in rows for w in words_in(t))
    for before in ("", "a7 ", "c1 a9 ", "unseen b5 "):
        known = [w for w in count if w is not None]
        made = mx.tokens_of(*text_bytes(pa.array([*(before + w for w in known), before.strip()])), words)
        own = mx.events(made, words)
        p = mx.log_probabilities(own, words, weights)
        of_class = np.exp(p)
        some = mx.rarer(made, own, words)
        p[some.at] += mx.rarer_gains(some, words, weights) + np.log((words.counts[made.number[some.at]] + 1) / words.rare_total)
        at = made.first[1:-1] - 2
        rare = made.number[at] >= words.size
        total = np.exp(p[at]).sum() + np.exp(p[-1]) + of_class[at[rare][0]] / words.rare_total
        assert total == pytest.approx(1.0, abs=1e-4)
