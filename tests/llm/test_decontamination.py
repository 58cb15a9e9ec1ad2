import random

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import decontamination as dec
from riskloom.llm.common import text_bytes
from riskloom.llm.words import words_of

SCHEMA = "doc_id long, text string"


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and c.isalnum() or ord(c) > 127:
            word += c.lower()
        else:
            out += [word] if word else []
            word = ""
    return out


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_words():
    texts = ["One two", "", "three", "É! x2 é", " - ", "end"]
    got = words_of(*text_bytes(pa.array(texts)))
    assert np.diff(got.first).tolist() == [len(plain_words(t)) for t in texts]
    flat = [w for t in texts for w in plain_words(t)]
    assert [(a == b) for a in got.hashes for b in got.hashes] == [(a == b) for a in flat for b in flat]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 90))], [rng.randrange(6) for _ in range(rng.randrange(40))]
        places = {}
        for k, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << k
        assert dec.common_subsequence(places, len(a), b) == brute_lcs(a, b)


@pytest.mark.parametrize("sizes", [[0], [1], [32], [33], [48], [49, 0, 100]])
def test_windows_cover_all_words(sizes):
    first = np.r_[0, np.cumsum(sizes)]
    start, end, text = dec.windows(first)
    for k, size in enumerate(sizes):
        seen = {w for a, b, t in zip(start, end, text) if t == k for w in range(a, b)}
        assert seen == set(range(first[k], first[k + 1]))
    assert (end - start <= dec.WINDOW).all()


def corpus(rng):
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(3000)]
    common = ["the", "of", "and", "in", "to"]
    make = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(k, make(rng.randint(15, 60))) for k in range(20)]
    docs, truth = [], set()
    for d in range(90):
        words = make(rng.randint(5, 300))
        if d % 3 == 0:
            item, text = rng.choice(items)
            if d % 2:  # a paraphrase: some words replaced, the last ones left
                text = [w if rng.random() > 0.12 or k > len(text) - 5 else rng.choice(vocabulary) for k, w in enumerate(text)]
            at = rng.randrange(len(words))
            words[at:at] = text
            truth.add((d, item))
        docs.append((d, " ".join(words)))
    return items, docs, truth


def test_recall_and_precision_against_brute_force(spark):
    items, docs, truth = corpus(random.Random(6))
    brute = set()
    for d, text in docs:
        words = text.split()
        for k, item in items:
            span = len(item) + max(4, len(item) // 4)
            places = {}
            for n, word in enumerate(item):
                places[word] = places.get(word, 0) | 1 << n
            lengths = [dec.common_subsequence(places, len(item), words[a : a + span]) for a in range(0, len(words), 4)]
            if max(lengths) >= dec.SURE * len(item):
                brute.add((d, k))
    listed = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(spark.createDataFrame(docs, SCHEMA), listed).collect()}
    assert len(got & brute) >= 0.95 * len(brute)
    assert len(got & truth) >= 0.95 * len(truth)
    assert not got - truth
    blocks = dec.contaminated(spark.createDataFrame(docs, SCHEMA), listed, block=8)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got


def test_edge_rows(spark):
    item = "what is the name of the tallest mountain in all of europe mont blanc"
    items = spark.createDataFrame([(1, item, "Mont Blanc"), (2, None, None), (3, "", None), (1, item, None)], "item_id long, text string, answer string")
    filler = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (None, item), (4, filler + " " + item.upper() + "! " + filler), (5, filler), (4, "nothing here")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", item_id int")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, items).collect()}
    assert got == {(None, 1), (4, 1)}
    kept = dec.drop_contaminated(docs, items)
    assert kept.columns == ["doc_id", "text", "item_id"] and {(r.doc_id, r.text) for r in kept.collect()} == {(1, None), (2, ""), (4, "nothing here"), (5, filler)}
    assert dec.contaminated(docs, items.limit(0)).collect() == []
    assert dec.contaminated(docs.limit(0), items).collect() == []
    short = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dec.contaminated(docs.filter("text = ''"), short).collect() == []


def test_query_against_word_runs(spark, small):
    """Verbatim items, as all runs of five words tell them; nothing with few of these is reported."""
    items = {r.item_id: plain_words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    docs = {r.doc_id: plain_words(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = {d: grams(w) for d, w in docs.items()}
    share = {(d, k): len(grams(w) & own[d]) / max(1, len(grams(w))) for k, w in items.items() for d in docs}
    got = {(r.doc_id, r.item_id) for r in dec.op6_decontamination(spark, small).collect()}
    assert {p for p, s in share.items() if s >= 0.8} <= got
    assert all(share[p] >= 0.3 for p in got)


@pytest.mark.parametrize("share", [3, 1])
def test_recall_of_frequent_items(spark, share):
    """Short items in many rows, next to rare words that other items have as well."""
    rng = random.Random(share)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, [f"i{k}n{n}" for n in range(rng.randint(15, 46))]) for k in range(3)] + [(9, vocabulary)]
    docs, truth = [], set()
    for d in range(240):
        words = rng.sample(vocabulary, 60)
        if d % share == 0:
            for item, text in items[:3]:
                at = rng.randrange(len(words))
                while at and words[at][0] == words[at - 1][0] == "i":
                    at -= 1
                words[at:at] = text
                truth.add((d, item))
        docs.append((d, " ".join(words)))
    listed = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(spark.createDataFrame(docs, SCHEMA), listed).collect()}
    assert got == truth


def test_one_row_table(spark):
    item = "what is the name of the tallest mountain in all of europe mont blanc"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words before " + item + " and some after it")], SCHEMA)
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(docs, items).collect()] == [(1, 1)]


def test_clean_rows_of_a_contaminated_id_stay(spark):
    item = "what is the name of the tallest mountain in all of europe mont blanc"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "clean"), (4, item), (4, "clean as well"), (None, None)]
    kept = dec.drop_contaminated(spark.createDataFrame(rows, SCHEMA), items).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, "clean"), (4, "clean as well"), (None, None)}


def test_recall_beyond_the_rank(spark):
    """More passages than directions, hosts with paraphrases; brute force over all words."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(1500)]
    common = ["the", "of", "and", "in", "to", "is", "was", "for"]
    make = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(k, make(rng.randint(15, 60))) for k in range(260)]
    docs, truth = [], set()
    for d in range(400):
        words = make(rng.randint(20, 200))
        if d % 2:
            item, text = items[rng.randrange(len(items))]
            if d % 4 == 1:
                text = [w if rng.random() > 0.1 or k > len(text) - 5 else rng.choice(vocabulary) for k, w in enumerate(text)]
            at = rng.randrange(len(words))
            words[at:at] = text
            truth.add((d, item))
        docs.append((d, " ".join(words)))
    listed = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    passages = len(dec.windows(np.r_[0, np.cumsum([len(w) for _, w in items])])[0])
    assert passages > 1.5 * dec.RANK
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(spark.createDataFrame(docs, SCHEMA), listed).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and not got - truth


def test_shared_words_are_counted_once_each():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(1, 20))) for _ in range(12)]
    found = words_of(*text_bytes(pa.array(texts)))
    space = dec.Space(np.full(1 << 18, -1, np.int32), np.zeros((1, 4), np.float32))
    items = dec.prepared([{"item_id": k, "text": t, "answer": ""} for k, t in enumerate(texts[:4])], space)
    number = items.numbers.find(found.hashes).astype(np.int64)
    keep = number[(number >= 0)]
    low = rng.integers(0, len(keep) - 10, 40)
    high, item = low + rng.integers(0, 10, 40), rng.integers(0, 4, 40)
    got = dec.shared_words(keep, low, high, item, items)
    for a, b, k, n in zip(low, high, item, got):
        own = items.numbers.find(words_of(*text_bytes(pa.array([texts[k]]))).hashes).tolist()
        assert n == sum(min(own.count(x), keep[a:b].tolist().count(x)) for x in set(own))
