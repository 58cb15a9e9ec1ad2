import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import toxicity as tox
from riskloom.llm.common import text_bytes

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def grammar():
    return tox.Grammar([(0, h, 3.0) for h in tox.word_hashes("idiot moron").tolist()] + [(5, tox.word_hashes("loser").tolist()[0], 2.0)])


@pytest.mark.parametrize(
    "text,slots",
    [
        ("", (0, 0, 0, 0, 0)),
        ("a fine idiot here", (3, 0, 0, 0, 0)),
        ("You are an idiot.", (0, 3, 0, 0, 0)),
        ("the IDIOT, you know", (3, 0, 0, 0, 0)),
        ("you are not an idiot", (0, 0, 3, 0, 0)),
        ("not a word of all this idiot", (3, 0, 0, 0, 0)),
        ("he said idiot", (0, 0, 0, 3, 0)),
        ("loserville is far", (2, 0, 0, 0, 0)),
        ("lose it", (0, 0, 0, 0, 0)),
        ("we will kill you", (0, 0, 0, 0, 1)),
        ("we never kill you", (0, 0, 0, 0, 0)),
        ("kill the lights", (0, 0, 0, 0, 0)),
        ("idiot. moron\nmoron", (9, 0, 0, 0, 0)),
    ],
)
def test_patterns(grammar, text, slots):
    got = grammar.slots(*text_bytes(pa.array(["you.", text, "idiot"])))
    assert tuple(got[1, :5]) == slots
    assert got[0, :7].sum() == 0 and got[2, 0] == 3


def walked(parts, kinds, weights):
    """Every part on its own, word by word, each reading what the one before wrote."""
    states, found = [0] * len(parts), []
    for kind, weight in zip(kinds, weights):
        symbol = kind
        for k, part in enumerate(parts):
            if part.slot[symbol]:
                found.append((part.slot[symbol], weight * part.weight[states[k], symbol]))
            states[k], symbol = int(part.step[states[k], symbol]), int(part.write[states[k], symbol])
    out = [0.0] * 6
    for slot, weight in found:
        for part, state in zip(parts, states):
            slot = part.last[state, slot]
        out[slot] = max(out[slot], weight)
    return tuple(out[1:])


def told(kinds, weights):
    """What the grammar means, without automata."""
    out = dict.fromkeys(tox.SLOTS, 0.0)
    aimed = tox.TARGET in kinds
    for k, (kind, weight) in enumerate(zip(kinds, weights)):
        negated = tox.NEGATION in kinds[max(0, k - tox.NEGATION_REACH) : k]
        slot = None
        if kind == tox.INSULT:
            slot = "negated" if negated else "reported" if tox.REPORT in kinds[:k] else "aimed" if aimed else "plain"
        elif kind == tox.THREAT and not negated and aimed:
            slot = "threats"
        if slot:
            out[slot] = max(out[slot], weight)
    return tuple(out.values())


def test_composition_equals_its_parts_and_its_meaning():
    rng = np.random.default_rng(3)
    parts = (tox.negation(), tox.reported(), tox.insult(), tox.threat(), tox.target())
    for _ in range(400):
        kinds = rng.integers(0, 6, rng.integers(0, 12)).tolist()
        weights = rng.integers(1, 9, len(kinds)).astype(float).tolist()
        assert tox.clause_weights(kinds, weights) == walked(parts, kinds, weights) == told(kinds, weights)


def planted(n):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for d in range(n):
        toxic = int(d % 5 == 0)
        text = list(rng.choice(words, 60))
        if toxic:
            text[10], text[40] = rng.choice(["vexor", "vexorin"]), "grumpf"
        rows.append((d, " ".join(text)))
        labels.append((d, 1, toxic))
    return rows, labels


def test_learns_words_and_beginnings(spark):
    rows, labels = planted(600)
    edge = [(None, "grumpf"), (9001, None), (9002, ""), (9003, "x " * 50_000), (9003, "x " * 50_000), (9004, "grumpf vexorian")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + edge], SCHEMA + ", score double")
    table = spark.createDataFrame([*labels, (None, 1, 1), (7777, 1, 1), (9002, None, None), (9004, 1, 0)], "doc_id long, quality int, toxic int")
    grammar, curve = tox.learn(docs, table)
    got = tox.toxicity(docs, grammar, curve).collect()
    assert len(got) == len(docs.collect()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[d].predicted == toxic for d, _, toxic in labels)
    assert by_id[9004].predicted == 1 and by_id[9001].predicted == by_id[9002].predicted == by_id[9003].predicted == 0


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "you are an idiot"), (2, "you are here")], SCHEMA)
    got = {r.doc_id: r.predicted for r in tox.toxicity(docs, *tox.learn(docs, none)).collect()}
    assert got == {1: 1, 2: 0}
    empty = docs.limit(0)
    assert tox.toxicity(empty, *tox.learn(empty, none)).collect() == []


def test_query_on_held_out(spark):
    import os

    middle = "/root/testdata/sf0.1"
    if not os.path.isdir(middle):
        pytest.skip("test tables are not here")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    got = tox.op9_toxicity(spark, middle).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    caught = sum(p and t for p, t in held)
    # About a tenth of the labels sit on texts without any toxic wording.
    assert caught >= 0.85 * sum(t for _, t in held)
    assert caught >= 0.9 * sum(p for p, _ in held)
