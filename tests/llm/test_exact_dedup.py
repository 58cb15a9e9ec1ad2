import re

import numpy as np
import pytest

from riskloom.llm import fuse
from riskloom.llm.exact_dedup import (
    build_snapshot,
    dedup_batch,
    digest,
    drop_copies,
    exact_dedup,
    group_batch,
    screen,
)
from riskloom.llm.common import stored
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_filter_holds_all_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    held = fuse.build(np.concatenate([keys, keys]))
    assert held.contains(keys).all()
    assert held.contains(rng.integers(-(2**63), 2**63 - 1, 10000)).mean() < 0.005


def brute(rows):
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep))
    return sorted(out, key=str)


CASES = [
    [],
    [(1, None), (2, ""), (3, " "), (4, "a  b"), (5, "a\n\tb"), (6, "a b"), (None, "a b"), (4, "a  b")],
    [(None, "x"), (None, "x")],
    [(i, "same") for i in range(50)] + [(100 + i, f"t{i % 7}" * 5000) for i in range(20)],
]


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(spark, rows):
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows)


def test_batches_after_one_another(spark):
    first = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a")], SCHEMA)
    second = spark.createDataFrame([(20, "a"), (5, "b"), (21, "c"), (22, "c")], SCHEMA)

    def groups(docs):
        return stored(group_batch(docs.select("doc_id", digest(F.col("text")).alias("text_sha256"))), "g")

    snapshot = build_snapshot(first, groups(first))
    passed = {r.text_sha256 for r in screen(snapshot, groups(second)).collect()}
    assert {r.text_sha256 for r in groups(first).collect()} <= passed
    batch, merged = dedup_batch(snapshot, second, groups(second))
    assert sorted((r.keep_id, r.group_size) for r in batch.collect()) == [(5, 2), (10, 3), (21, 2)]
    assert sorted((r.keep_id, r.group_size) for r in merged.collect()) == [(5, 2), (10, 3)]


def test_kept_rows_have_their_columns(spark):
    rows = [(1, "a", 7), (1, "a", 7), (2, "a ", 8), (3, "b", None), (2, "a ", 8)]
    kept = drop_copies(spark.createDataFrame(rows, SCHEMA + ", group_size int"))
    assert kept.columns == ["doc_id", "text", "group_size"]
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a", 7), (2, "a ", 8), (3, "b", None)]
