import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows_of
from riskloom.functions.chain import block_exits, greedy_chain, replay_block, walk_tables, whole_groups
from riskloom.functions.ordered import keyed_rows


def brute(pairs, gap, entry):
    kept = []
    for lo, hi in pairs:
        if lo >= entry:
            kept.append(lo)
            entry = hi + gap
    return kept


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 9), st.integers(0, 6)), max_size=80),
    st.integers(1, 40),
    st.integers(-5, 60),
    st.integers(5, 100),
)
def test_block_tables_match_a_plain_walk(steps, gap, entry, block):
    lo = np.unique(np.cumsum([s for s, _ in steps])) if steps else np.array([], dtype=np.int64)
    hi = np.maximum.accumulate(lo + np.array([w for _, w in steps][: len(lo)], dtype=np.int64)) if len(lo) else lo
    expected = brute(list(zip(lo.tolist(), hi.tolist())), gap, entry)

    blocks = [np.flatnonzero(lo // block == b) for b in np.unique(lo // block)]
    table_lo, table_exit, bounds = [], [], [0]
    for index in blocks:
        at, exits = block_exits(lo[index], hi[index], gap)
        table_lo += lo[index][at].tolist()
        table_exit += exits.tolist()
        bounds.append(len(table_lo))
    entries = walk_tables(np.array(table_lo), np.array(table_exit), bounds, entry)
    found = [int(lo[i][k]) for i, e in zip(blocks, entries) for k in replay_block(lo[i], hi[i], gap, e)]
    assert found == expected


def test_hot_key_takes_the_same_rows(spark):
    rng = np.random.default_rng(7)
    data = [("hot", int(t), f"h{i}") for i, t in enumerate(np.cumsum(rng.integers(0, 30, 600)))]
    data += [(f"k{i % 9}", int(t), f"c{i}") for i, t in enumerate(np.cumsum(rng.integers(0, 30, 120)))]
    df = spark.createDataFrame(data, "k string, t long, id string")
    plain = greedy_chain(keyed_rows(df, ["k"], ["t", "id"]), ["k"], "t", "t", 100)
    split = keyed_rows(df, ["k"], ["t", "id"], max_rows=50)
    assert split.chunked
    assert split.rows.filter("_chunk >= 0").select("_chunk").distinct().count() > 3
    hot = greedy_chain(split, ["k"], "t", "t", 100)
    assert rows_of(plain.result()) == rows_of(hot.result())
    times = [t for k, t, _ in sorted(data, key=lambda r: (r[1], r[2])) if k == "hot"]
    assert [r.t for r in hot.result().filter("k = 'hot'").orderBy("t").collect()] == brute(
        [(t, t) for t in times], 100, -1
    )


def test_many_hot_keys_are_taken_by_the_batch(spark):
    """As many keys as groups of a few rows: a task judges them together, also across batches and with null keys."""
    rng = np.random.default_rng(3)
    data = [(f"k{i % 400}" if i % 400 else None, int(i % 7), int(t), f"r{i}") for i, t in enumerate(rng.integers(0, 3_000_000, 12_000))]
    df = spark.createDataFrame(data, "k string, part long, t long, id string").repartition(3)
    plain = greedy_chain(keyed_rows(df, ["k"], ["t", "id"]), ["k", "part"], "t", "t", 20_000)
    split = keyed_rows(df, ["k"], ["t", "id"], max_rows=10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        hot = greedy_chain(split, ["k", "part"], "t", "t", 20_000)
        assert "FlatMapGroupsInPandas" not in hot.rows._jdf.queryExecution().toString()
        assert rows_of(plain.result()) == rows_of(hot.result())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_key_stores_what_the_chain_reads_and_no_more(spark, monkeypatch):
    data = [("hot", int(t % 5000), f"h{t}", "wide " * 20) for t in range(0, 20_000, 7)]
    df = spark.createDataFrame(data, "k string, t long, id string, payload string")
    plain = greedy_chain(keyed_rows(df, ["k"], ["t", "id"]), ["k"], "t", "t", 100)
    split = keyed_rows(df, ["k"], ["t", "id"], max_rows=50)
    stored, real = [], type(df).checkpoint

    def told(self, *args, **kwargs):
        stored.append(self.schema.simpleString())
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(df), "checkpoint", told)
    hot = greedy_chain(split, ["k"], "t", "t", 100)
    assert rows_of(hot.result()) == rows_of(plain.result())
    assert stored and not [s for s in stored if "payload" in s]


def test_groups_are_never_cut_by_a_batch():
    table = pa.table({"k": ["a", "a", None, None, None, "c", "d", "d"], "n": list(range(8))})
    for rows in (1, 2, 3, 5, 8):
        parts = list(whole_groups(table.to_batches(max_chunksize=rows), ["k"]))
        assert [n for p in parts for n in p["n"].to_pylist()] == list(range(8))
        seen = [k for p in parts for k in set(p["k"].to_pylist())]
        assert len(seen) == len(set(seen))
