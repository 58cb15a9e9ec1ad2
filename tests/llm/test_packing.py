import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm.common import tokenizer_path
from riskloom.llm.packing import VOCABULARY, op3_best_fit_packing, pack, plan, ranked

LIBRARY = Tokenizer.from_file(tokenizer_path(VOCABULARY))
SCHEMA = "doc_id long, text string"


def layout(histogram, capacity):
    """Bins of a plan, checked: every rank once, nothing overlaps, no gaps before the end of a bin."""
    runs, bins = plan(histogram, capacity)
    seen, places = {}, {}
    for run in runs:
        for rank in range(run.rank_from, run.rank_to):
            assert rank not in seen.setdefault(run.size, set())
            seen[run.size].add(rank)
            step = rank - run.rank_from
            where = (run.bin_from + step // run.per_bin, run.offset_from + step % run.per_bin * run.size)
            places.setdefault(where[0], []).append((where[1], run.size))
    assert {s: set(range(n)) for s, n in histogram.items() if n} == seen
    assert sorted(places) == list(range(bins))
    for items in places.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(size > capacity // 3 for _, size in items) <= 2
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
def test_plan_is_valid(histogram):
    bins = layout(histogram, 60)
    assert bins >= -(-sum(s * n for s, n in histogram.items()) // 60)


def test_plan_is_tight():
    rng = random.Random(3)
    histogram = {}
    for _ in range(20_000):
        size = min(1024, max(1, int(rng.expovariate(1 / 300))))
        histogram[size] = histogram.get(size, 0) + 1
    low = -(-sum(s * n for s, n in histogram.items()) // 1024)
    assert layout(histogram, 1024) <= low * 1.005 + 1
    assert layout({1024: 7}, 1024) == 7 and layout({}, 1024) == 0 and layout({400: 3, 300: 2}, 1024) == 2
    assert len(plan({s: 10**9 for s in range(1, 1025)}, 1024)[0]) < 20_000


def expected_pieces(doc, text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % 1024 or 1024
    cuts = [0, len(ids)] if len(ids) <= 1024 else [0, *range(first, len(ids) + 1, 1024)]
    return [
        (doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]


def check_rows(got, rows):
    wanted = sorted((p for r in rows for p in expected_pieces(r[0], r[1])), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == wanted
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "hi"), (3, "hi"), (4, "x y " * 3000), (5, "a" * 1023 * 3), (6, "<|endoftext|> it's  \n\n end ")]
    rows += [(7, " the" * 1023), (8, " the" * 1024)]
    got = pack(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", length int"), tokenizer_path(VOCABULARY)).collect()
    check_rows(got, rows)
    assert pack(spark.createDataFrame([], SCHEMA), tokenizer_path(VOCABULARY)).collect() == []


def test_ranks_are_dense(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(500), 0, 0, rng.choice([5, 5, 5, 7]), 0) for _ in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    histogram = {5: sum(r[3] == 5 for r in rows), 7: sum(r[3] == 7 for r in rows)}
    got = ranked(df, histogram, bucket_rows=20).collect()
    for size, n in histogram.items():
        assert sorted(r["rank"] for r in got if r["length"] == size) == list(range(n))


def test_query_against_the_library(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    bins = check_rows(op3_best_fit_packing(spark, small).collect(), rows)
    assert bins <= 1 + 1.01 * sum(p[3] for r in rows for p in expected_pieces(*r)) / 1024
