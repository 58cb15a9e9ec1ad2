import random

from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.functions import ordered
from riskloom.functions.ordered import keyed_rows


def make(spark, n=400):
    rnd = random.Random(3)
    data = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(12)}"
        data.append((key, rnd.randrange(200), f"{i:04d}", rnd.choice([None, None, "a", "b", "c"]), rnd.randrange(5)))
    return data, spark.createDataFrame(data, "k string, t long, id string, v string, w int")


def expected(data, back):
    out = {}
    for key in {r[0] for r in data}:
        seen, total = [], 0
        rows = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        for _, _, row_id, v, w in rows:
            total += w
            out[row_id] = (seen[-1] if seen else None, seen[-back] if len(seen) >= back else None, total)
            if v is not None:
                seen.append(v)
        following = None
        for _, _, row_id, v, _ in reversed(rows):
            out[row_id] += (following,)
            following = v if v is not None else following
    return out


def test_history_matches_a_loop_with_and_without_chunks(spark):
    data, df = make(spark)
    want = expected(data, 7)
    for limit in (10_000, 60, 9):
        rows = keyed_rows(df, ["k"], ["t", "id"], max_rows=limit)
        assert rows.chunked == (limit < 10_000)
        rows = rows.history(
            lasts={"last_v": F.col("v")}, sums={"total": F.col("w")}, lags={"lag_v": (F.col("v"), 7)}
        ).history(lasts={"next_v": F.col("v")}, reverse=True)
        got = {r.id: (r.last_v, r.lag_v, r.total, r.next_v) for r in rows.result().collect()}
        assert got == want, limit


def test_rows_of_hot_keys_are_dealt_and_sorted_once(spark):
    """Looking back again and again reads the stored rows; it must not shuffle or sort all of them each time."""
    data, df = make(spark)
    rows = keyed_rows(df, ["k"], ["t", "id"], max_rows=40).history(lasts={"a": F.col("v")}, sums={"total": F.col("w")})
    rows = rows.staged().with_column("b", F.col("a")).history(lags={"c": (F.col("b"), 2)})
    plan = rows.rows._jdf.queryExecution().executedPlan().toString()
    assert rows.chunked and "Window" in plan
    assert "Exchange" not in plan and "Sort " not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_chunks_are_contiguous_and_bounded(spark):
    df = spark.range(5000).select(
        F.lit("hot").alias("k"), (F.col("id") % 997).alias("t"), F.col("id").cast("string").alias("id")
    )
    rows = keyed_rows(df, ["k"], ["t", "id"], max_rows=500).rows
    spans = rows.groupBy("_chunk").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")
    )
    chunks = spans.orderBy("_chunk").collect()
    assert max(c.n for c in chunks) < 1500 and len(chunks) >= 6
    assert all(a.hi < b.lo for a, b in zip(chunks, chunks[1:]))


def test_no_hot_key_leaves_the_rows_alone(spark):
    _, df = make(spark, 50)
    rows = keyed_rows(df, ["k"], ["t", "id"])
    assert not rows.chunked and rows_of(rows.result()) == rows_of(df)


def test_a_null_key_is_a_key_like_any_other(spark):
    data, _ = make(spark)
    data = [(None if r[0] == "hot" else r[0], *r[1:]) for r in data]
    df = spark.createDataFrame(data, "k string, t long, id string, v string, w int")
    want = {k: v[2] for k, v in expected(data, 3).items()}
    rows = keyed_rows(df, ["k"], ["t", "id"], max_rows=40).history(sums={"total": F.col("w")})
    assert rows.chunked
    assert {r.id: r.total for r in rows.result().collect()} == want


def test_a_key_of_many_chunks_meets_few_cuts_at_a_time(spark, monkeypatch):
    """The largest array of cuts a row is joined with does not grow with the key, and the numbers stay the same."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").alias("k"), (F.col("id") * 7 % 997).alias("t"), F.col("id").cast("string").alias("id")
    )
    want = sorted((r.id, r._chunk) for r in keyed_rows(df, ["k"], ["t", "id"], max_rows=10).rows.collect())
    assert max(chunk for _, chunk in want) >= 150
    monkeypatch.setattr(ordered, "SPLIT_FAN", 4)
    for sent in (ordered.MAX_SENT_SPLITS, 60, 0):
        monkeypatch.setattr(ordered, "MAX_SENT_SPLITS", sent)
        widest, create = [], type(spark).createDataFrame

        def watched(self, data, *args, **kwargs):
            widest.extend(len(r["_cuts"]) for r in data)
            return create(self, data, *args, **kwargs)

        monkeypatch.setattr(type(spark), "createDataFrame", watched)
        rows = keyed_rows(df, ["k"], ["t", "id"], max_rows=10).rows
        assert sorted((r.id, r._chunk) for r in rows.collect()) == want
        assert max(widest, default=0) <= 5
        monkeypatch.setattr(type(spark), "createDataFrame", create)
