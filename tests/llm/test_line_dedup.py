import random

import numpy as np
import pytest

from riskloom.llm.common import stored
from riskloom.llm.cuckoo import CuckooFilter
from riskloom.llm.line_dedup import apply_drops, create, delete, insert, line_dedup, postings, screen

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n", [0, 1, 5, 300, 20_000])
def test_filter_with_deletions(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
    held = CuckooFilter.of(keys)
    assert held.contains(keys).all()
    held = CuckooFilter(held.buckets, held.tobytes())
    held.delete(keys[::2])
    assert held.contains(keys[1::2]).all()
    assert held.contains(keys[::2]).mean() < 0.01 if n > 10 else True
    held.insert(keys[::2])
    assert held.contains(keys).all()
    assert held.contains(rng.integers(-(2**63), 2**63 - 1, 10_000)).mean() < 0.005


def brute(rows):
    white = " \t\n\x0b\x0c\r"
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t.strip(white))
    order = lambda i: float("inf") if i is None else i
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(low(line)) >= 10:
                holders.setdefault(low(line), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x) not in holders or order(i) == min(holders[low(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LINE = "this line is long enough"
ROWS = [
    (5, LINE), (3, f"  {LINE.upper()}\t\nown line of document three\n{LINE}"), (9, f"{LINE}\n\n\nshort\nshort"), (7, None), (8, ""),
    (None, LINE + "\nline nobody else has got"), (11, "ééééééééé\nêêêêêêêêêê"), (12, "ééééééééé\nêêêêêêêêêê"), (12, "ééééééééé\nêêêêêêêêêê"),
    (13, (LINE + "\n") * 5000), (14, "x" * 100_000), (15, "x" * 100_000 + "\x0b"),
]


def test_edge_rows(spark):
    got = line_dedup(spark.createDataFrame([(*r, 0) for r in ROWS], SCHEMA + ", first int"))
    assert rows_of(got) == brute(ROWS)
    assert rows_of(line_dedup(spark.createDataFrame([], SCHEMA))) == []


def test_insert_and_delete_are_reversible(spark):
    rng = random.Random(4)
    pool = [f"common line number {k}" for k in range(30)]
    rows = [(i, "\n".join([*rng.sample(pool, 3), f"line of document {i}"])) for i in range(60)]
    parts = [spark.createDataFrame(rows[a : a + 20], SCHEMA) for a in (0, 20, 40)]
    held = [stored(postings(p), "p") for p in parts]
    index = create(held[0], keys_per_shard=16)
    index = insert(insert(index, held[1]), held[2])
    everything = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(apply_drops(everything, index)) == brute(rows)
    out = [r for r in rows if r[0] % 3 == 0]
    left = [r for r in rows if r[0] % 3]
    smaller = delete(index, spark.createDataFrame(out, SCHEMA))
    assert rows_of(apply_drops(spark.createDataFrame(left, SCHEMA), smaller)) == brute(left)
    keys = smaller.counts.select("k1", "k2")
    assert screen(smaller, keys).count() == keys.count()
    dead = index.counts.join(keys, ["k1", "k2"], "left_anti")
    assert 0 < dead.count() and screen(smaller, dead).count() <= 1
    back = insert(smaller, stored(postings(spark.createDataFrame(out, SCHEMA)), "p"))
    assert rows_of(apply_drops(everything, back)) == brute(rows)


def test_rows_without_an_id_keep_lists_of_their_own(spark):
    """Many rows share no id or one id: each drops its own lines only."""
    own = [(None if k % 2 else 50, f"{LINE}\nthis is line number {k % 7} of seven\nonly row {k} has this line") for k in range(60)]
    rows = [(1, LINE), *own]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(line_dedup(docs)) == brute(rows)
