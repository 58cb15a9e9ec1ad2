import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from riskloom.llm import ppm
from riskloom.llm.common import text_bytes
from riskloom.llm.language_id import keep_known_languages, learn, learning_sample, op2_language_id, predict

SCHEMA = "doc_id long, text string, lang string"


def brute_bits(train, text, order):
    """Code length by walking down from the longest context, with counts kept in dictionaries."""
    counts = {}
    for t in train:
        folded = [ppm.SPACE] * order + [int(ppm.FOLD[b]) for b in t.encode()]
        for i in range(order, len(folded)):
            for k in range(order + 1):
                context = tuple(folded[i - k : i])
                inner = counts.setdefault(context, {})
                inner[folded[i]] = inner.get(folded[i], 0) + 1
    folded = [ppm.SPACE] * order + [int(ppm.FOLD[b]) for b in text.encode()]
    bits = 0.0
    for i in range(order, len(folded)):
        for k in range(order, -1, -1):
            inner = counts.get(tuple(folded[i - k : i]))
            if not inner:
                continue
            total = sum(inner.values()) + len(inner)
            if folded[i] in inner:
                bits -= math.log2(inner[folded[i]] / total)
                break
            bits -= math.log2(len(inner) / total)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths(order):
    classes = [["the cat sat.", "a hat, 12 mats"], ["le chat était là", "élan"], ["zzz"]]
    merged = []
    for n in range(1, order + 2):
        per = [ppm.gram_counts(np.frombuffer(t.encode(), np.uint8), order + 1)[n - 1] for c in classes for t in c]
        owner = [k for k, c in enumerate(classes) for _ in c]
        codes = np.unique(np.concatenate([c for c, _ in per]))
        counts = np.zeros((len(codes), len(classes)))
        for k, (c, m) in zip(owner, per):
            counts[np.searchsorted(codes, c), k] += m
        merged.append((codes, counts))
    model = ppm.fit(merged)
    texts = ["the chat", "", "zzz zz", "é", "日本 xq#", "a", "  the cat sat on a hat", "élan 77"]
    got = model.bits(*text_bytes(pa.array(texts)))
    wanted = [[brute_bits(c, t, order) for c in classes] for t in texts]
    assert np.allclose(got, wanted, rtol=1e-4, atol=1e-3)


def test_edge_rows(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "that", "with"], "fr": ["été", "pour", "que", "avec"]}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(["en", "fr"] * 30)]
    rows += [(None, "the and", "xx"), (900, None, "en"), (901, "", "fr"), (902, "12 34 !?", None), (903, "que pour", None)]
    rows += [(904, "the and " * 20_000, None)] * 2
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", score double")
    langs, model = learn(docs)
    assert langs == ["en", "fr"]
    got = [tuple(r)[:3] for r in predict(docs, langs, model).collect()]
    preds = {(i, p) for i, p, _ in got}
    assert {(900, "und"), (901, "und"), (902, "und"), (903, "fr"), (904, "en"), (None, "en")} <= preds
    assert all(p == rows[i][2] for i, p, _ in got if i is not None and i < 60)
    assert all(0 <= s <= 1 and (s == 0) == (p == "und") for _, p, s in got)
    assert len(got) == len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert predict(empty, *learn(empty)).collect() == []
    unlabelled = spark.createDataFrame([(1, "the", None)], SCHEMA)
    assert [tuple(r)[:3] for r in predict(unlabelled, *learn(unlabelled)).collect()] == [(1, "und", 0.0)]


def test_only_disorder_is_rejected(spark):
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(0x3040, 0x9FFF)) for _ in range(2000))
    rows = [(i, "the cat and the hat sat with that", "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "12 34", "en"), (102, noise, "en"), (103, "see AKIA0QX9ZTR7W3KJ", None), (None, "the hat", None)]
    docs = spark.createDataFrame([(*r, True) for r in rows], SCHEMA + ", letters boolean")
    # Keep the noise out of what is learned.
    kept = keep_known_languages(docs.withColumn("lang", F.when(F.col("doc_id") != 102, F.col("lang"))))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(40), 103, None}


def test_sample_is_bounded(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de") for i in range(3000)]
    got = learning_sample(spark.createDataFrame(rows, SCHEMA), rows=40).collect()
    assert sorted(r.lang for r in got) == ["de"] * 40 + ["en"] * 40
    assert all(zlib.crc32(r.text[1:].encode()) % 3 != 1 for r in got)


def test_query_on_held_out(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op2_language_id(spark, small).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
