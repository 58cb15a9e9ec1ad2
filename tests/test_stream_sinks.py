"""Late rows that change alerts, first-seen state with a beginning, and several sinks of one stream."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.config import DAY, HOUR, MINUTE, IndicatorConfig, ScoreConfig
from riskloom.operators.enrich import dedup_events, seen_before
from riskloom.operators.indicators import derive_indicators, identity_rows
from riskloom.operators.scoring import risk_alerts
from riskloom.operators.sequence import takeover_sequences
from riskloom.streaming import jobs
from riskloom.streaming.fanout import MARKS, read_sink, start_fan_out
from test_scoring import frame, random_events

INDICATORS = IndicatorConfig(profile_ttl=2 * HOUR, velocity_window=20 * MINUTE, api_count=6, api_window=HOUR)
SCORES = ScoreConfig(cooldown=4 * MINUTE, decay=3 * MINUTE)
KEYS = ["identity_key", "event_time", "event_id"]


def standing(revised, name):
    return jobs.drain_latest(revised, KEYS, name)


def revised_alerts(events, cuts, spread, delay, name):
    feed = jobs.replayed(events, "event_time", cuts, name, spread=spread)
    return jobs.stream_revised_alerts(feed, INDICATORS, SCORES, delay)


@pytest.mark.parametrize("seed", [11, 12])
def test_late_rows_are_scored_in_their_place(spark, seed):
    """Rows hours out of order, over micro-batches in which the watermark settles some and not others."""
    df = frame(spark, *random_events(seed, 250, 24 * HOUR))
    want = rows_of(risk_alerts(derive_indicators(identity_rows(df), INDICATORS), SCORES))
    cuts = [k * 4 * HOUR for k in range(1, 7)]
    last = standing(revised_alerts(df, cuts, 3 * HOUR, "3 hours", "t-revised"), "t-revised")
    kept = last.filter(~F.col("withdrawn"))
    assert want and rows_of(kept.drop("event_id", "revision", "withdrawn")) == want
    assert last.filter("revision > 0").count() > 0


def test_late_repeats_and_originals(spark):
    """An original that comes after its repeat takes its place, as in the batch run with the same keys."""
    df = frame(spark, *random_events(5, 250, 24 * HOUR))
    df = df.withColumn("dedup_key", F.when(F.col("event_id").substr(-1, 1) < "7", F.concat(F.lit("k"), F.pmod(F.xxhash64("event_id"), F.lit(40)))))
    marked = dedup_events(df, 6 * HOUR, keep_repeats=True)
    want = rows_of(risk_alerts(derive_indicators(identity_rows(marked), INDICATORS), SCORES))
    feed = jobs.replayed(df, "event_time", [k * 4 * HOUR for k in range(1, 7)], "t-repeats", spread=3 * HOUR)
    last = standing(jobs.stream_revised_alerts(feed, INDICATORS, SCORES, "3 hours", horizon=6 * HOUR), "t-repeats")
    assert marked.filter("repeated").count() > 0
    assert want and rows_of(last.filter(~F.col("withdrawn")).drop("event_id", "revision", "withdrawn")) == want


def test_an_alert_is_withdrawn(spark):
    """An explicit event alerts first; an earlier one that comes later alerts instead and starts the cooldown."""
    one = dict(source_table="login_events", identity_key="c", indicator="IMPOSSIBLE_TRAVEL")
    times = {"a": 10 * MINUTE, "b": 11 * MINUTE, "c": 9 * MINUTE, "d": 40 * MINUTE}
    events = frame(spark, *(dict(one, event_id=k, event_time=t) for k, t in times.items()))
    path = jobs.scratch(spark, "t-withdrawn")
    for part in (["a", "b"], ["c"], ["d"]):
        events.filter(F.col("event_id").isin(part)).coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    last = standing(jobs.stream_revised_alerts(feed, INDICATORS, ScoreConfig(decay=HOUR), "10 minutes"), "t-withdrawn")
    told = {r.event_id: (r.withdrawn, r.revision) for r in last.collect()}
    assert told == {"a": (False, 1), "b": (True, 1), "d": (False, 1)}
    batch = risk_alerts(derive_indicators(identity_rows(events), INDICATORS), ScoreConfig(decay=HOUR))
    want = {r.source_event_ids[0] for r in batch.collect()}
    assert {k for k, (gone, _) in told.items() if not gone} == want == {"a", "d"}


def test_settled_rows_leave_the_state(spark):
    """Only rows above the watermark are held, and a silent identity leaves nothing."""
    one = dict(source_table="transactions", amount=1.0)
    events = [dict(one, identity_key="p", event_id=f"{i:03d}", event_time=i * MINUTE) for i in range(200)]
    events += [dict(one, identity_key="q", event_id="q", event_time=5 * MINUTE)]
    events += [dict(one, identity_key="p", event_id=f"9{i}", event_time=9000 * MINUTE + i) for i in range(2)]
    df = frame(spark, *events)
    feed = jobs.replayed(df, "event_time", [100 * MINUTE, 9000 * MINUTE, 9000 * MINUTE + 1], "t-held")
    out = jobs.scratch(spark, "t-held")
    query = (
        jobs.stream_revised_alerts(feed, INDICATORS, SCORES, "1 minute", horizon=HOUR)
        .writeStream.option("checkpointLocation", f"{out}/state").outputMode("update").trigger(availableNow=True)
        .foreachBatch(lambda batch, epoch: batch.collect()).start()
    )
    query.awaitTermination()

    def state(name):
        rows = spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", name).load()
        return rows.select(F.col("key.identity_key")).collect()

    assert [r[0] for r in state("head")] == ["p"]
    assert len(state("held")) <= 2


def test_first_seen_begins_with_a_table(spark):
    rnd = random.Random(3)
    rows = [(f"{i:03d}", rnd.choice(["a", "b", "c", None]), rnd.randrange(10 * DAY)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id string, customer_id string, event_time long").withColumn("identity_key", F.col("customer_id"))
    history = df.filter(F.col("event_time") < 3 * DAY).unionByName(
        spark.createDataFrame([("n", None, 1, None), ("m", "b", None, "b")], df.schema)
    )
    live = df.filter(F.col("event_time") >= 3 * DAY)
    want = seen_before(live, df, beyond=DAY).select("event_id", "identity_key", "event_time", "seen_beyond_state_window")
    feed = jobs.replayed(live, "event_time", [5 * DAY, 8 * DAY], "t-first", spread=DAY)
    got = jobs.drain(jobs.stream_seen_before(feed, history), "t-first")
    assert rows_of(got) == rows_of(want)
    # Without a beginning the stream alone is the history.
    feed = jobs.replayed(live, "event_time", [5 * DAY, 8 * DAY], "t-alone", spread=DAY)
    alone = seen_before(live, live, beyond=DAY).select(*want.columns)
    assert rows_of(jobs.drain(jobs.stream_seen_before(feed), "t-alone")) == rows_of(alone) != rows_of(want)


def takeover_rows(spark):
    rnd = random.Random(4)
    kinds = ["LOGIN_FAILED", "LOGIN_FAILED", "BENEFICIARY_ADD", "TRANSFER"]
    data = [(rnd.choice("ab"), rnd.choice(kinds), 1000 * i, f"{i:04d}", float(i)) for i in range(240)]
    return spark.createDataFrame(data, "customer_id string, event_type string, event_time long, row_id string, amount double")


def test_sinks_become_visible_together(spark):
    """A run that dies between two sinks shows none of that micro-batch; the next run writes it once."""
    df = takeover_rows(spark)
    want = rows_of(takeover_sequences(df, within=9000))
    feed = jobs.replayed(df, "event_time", [80_000, 160_000], "t-sinks")
    root = jobs.scratch(spark, "t-sinks")
    log, runs = jobs.takeover_log(feed, within=9000), []

    def dies(batch, passed):
        runs.append(passed)
        if len(runs) == 2:
            raise RuntimeError("lost between two sinks")
        return jobs.TAKEOVER_SINKS["takeovers"](batch, passed)

    sinks = {"timeline": jobs.TAKEOVER_SINKS["timeline"], "takeovers": dies, "late": jobs.TAKEOVER_SINKS["late"]}
    with pytest.raises(StreamingQueryException):
        start_fan_out(log, "event_time", sinks, root, f"{root}/state", 5000).awaitTermination()
    assert spark.read.parquet(f"{root}/timeline").count() == 160
    assert read_sink(spark, root, "timeline").count() == 80
    early = rows_of(read_sink(spark, root, "takeovers"))
    assert early and set(early) < set(want)
    start_fan_out(log, "event_time", sinks, root, f"{root}/state", 5000).awaitTermination()
    assert rows_of(read_sink(spark, root, "timeline").select(*df.columns)) == rows_of(df)
    assert rows_of(read_sink(spark, root, "takeovers")) == want
    assert read_sink(spark, root, "late").isEmpty()


def test_late_sink_has_what_the_matcher_dropped(spark):
    """Timeline rows are all written; the matcher saw exactly those that are not late."""
    df = takeover_rows(spark)
    path = jobs.scratch(spark, "t-late")
    late = df.filter("event_time BETWEEN 20000 AND 40000 OR event_time = 234000")
    main = df.join(late.select("row_id"), "row_id", "left_anti").select(*df.columns)
    for part in (main.filter("event_time < 120000"), main.filter("event_time BETWEEN 120000 AND 180000"), late, main.filter("event_time > 180000")):
        part.coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    root = jobs.scratch(spark, "t-late-sinks")
    start_fan_out(jobs.takeover_log(feed, within=9000), "event_time", jobs.TAKEOVER_SINKS, root, f"{root}/state", 5000).awaitTermination()
    told = read_sink(spark, root, "late")
    assert rows_of(told.select("row_id")) == rows_of(late.filter("event_time <= 40000").select("row_id"))
    rest = df.join(told.select("row_id"), "row_id", "left_anti").filter("event_time <> 234000")
    seen = takeover_sequences(rest, within=9000)
    got = read_sink(spark, root, "takeovers")
    before = "exfiltration_transfer_time < 180000"
    assert rows_of(got.filter(before)) == rows_of(seen.filter(before))
    assert read_sink(spark, root, "timeline").count() == 240


def test_a_sink_cannot_take_the_place_of_the_marks(spark):
    with pytest.raises(ValueError):
        start_fan_out(takeover_rows(spark), "event_time", {MARKS: lambda b, p: b}, "x", "y", 0)
