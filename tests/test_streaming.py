"""Continuous forms over several micro-batches equal the batch operators."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.config import HOUR, MINUTE, IndicatorConfig, ScoreConfig
from riskloom.operators import incidents, metrics
from riskloom.operators.enrich import enrich_accounts
from riskloom.operators.indicators import derive_indicators, identity_rows
from riskloom.operators.scoring import risk_alerts
from riskloom.operators.sequence import takeover_sequences, unified_timeline
from riskloom.sources.readers import file_stream
from riskloom.streaming import jobs
from test_scoring import frame, random_events


@pytest.fixture
def replay(spark, tmp_path):
    """Write rows as files in event-time order and read them one file per micro-batch."""

    def build(df, time, parts=3, name="in"):
        path = str(tmp_path / name)
        lo, hi = df.agg(F.min(time), F.max(time)).first()
        width = (hi - lo) // parts + 1
        for i in range(parts):
            part = df.filter((F.col(time) >= lo + i * width) & (F.col(time) < lo + (i + 1) * width))
            part.coalesce(1).write.mode("append").parquet(path)
        return file_stream(spark, path, df.schema, files_per_trigger=1)

    return build


def test_alerts_over_micro_batches(spark, replay):
    indicators = IndicatorConfig(profile_ttl=2 * HOUR, velocity_window=20 * MINUTE, api_count=6, api_window=HOUR)
    scores = ScoreConfig(cooldown=4 * MINUTE, decay=3 * MINUTE)
    df = frame(spark, *random_events(11, 250, 24 * HOUR))
    batch = risk_alerts(derive_indicators(identity_rows(df), indicators), scores)
    stream = jobs.drain(jobs.stream_risk_alerts(replay(df, "event_time"), indicators, scores), "t-alerts")
    want = rows_of(batch)
    assert want and rows_of(stream.select(*batch.columns)) == want


def test_repeats_do_not_score(spark, replay):
    one = dict(source_table="transactions", amount=20_000.0, identity_key="c")
    events = [dict(one, event_time=1000 * i) for i in range(4)]
    df = frame(spark, *events).withColumn("dedup_key", F.lit("same"))
    out = jobs.drain(jobs.stream_risk_alerts(replay(df, "event_time", 2)), "t-repeat")
    assert out.isEmpty()


def test_takeovers_over_micro_batches(spark, replay):
    rnd = random.Random(4)
    kinds = ["LOGIN_FAILED", "LOGIN_FAILED", "BENEFICIARY_ADD", "TRANSFER"]
    data = [(rnd.choice("ab"), rnd.choice(kinds), 1000 * i, f"{i:04d}", float(i)) for i in range(240)]
    df = spark.createDataFrame(data, "customer_id string, event_type string, event_time long, row_id string, amount double")
    batch = takeover_sequences(df, within=9000)
    stream = jobs.drain(jobs.stream_takeovers(replay(df, "event_time"), within=9000, delay="60 seconds"), "t-ato")
    assert batch.count() > 5
    assert rows_of(stream.select(*batch.columns)) == rows_of(batch)


def test_incidents_close_when_the_gap_has_passed(spark, replay):
    rnd = random.Random(6)
    data = [(f"a{i:03d}", rnd.choice("xyz"), rnd.randrange(400) * MINUTE, float(i), "flink-primary") for i in range(80)]
    schema = "alert_id string, customer_id string, event_time long, cumulative_score double, engine_source string"
    last = [("end", "end", 10_000 * MINUTE, 1.0, "flink-primary")]
    df = incidents.resolve_alerts(spark.createDataFrame(data + last, schema))
    batch = incidents.roll_up_incidents(incidents.assign_incidents(df).result()).filter("identity_key <> 'end'")
    stream = jobs.drain(jobs.stream_incidents(replay(df, "event_time")), "t-incidents")
    assert rows_of(stream.select(*batch.columns)) == rows_of(batch)


def analyst_day(spark, seed, n=60):
    """Alerts and changes of three identities, all at different minutes."""
    rnd = random.Random(seed)
    minutes = rnd.sample(range(600), 2 * n)
    data = [(f"a{i:03d}", rnd.choice("xyz"), minutes[i] * MINUTE, float(i + 40), rnd.choice(["p", "q"])) for i in range(n)]
    schema = "alert_id string, customer_id string, event_time long, cumulative_score double, engine_source string"
    kinds = [("status", s, None) for s in ("CONFIRMED_FRAUD", "FALSE_POSITIVE", "OPEN")] + [("assign", None, "ann"), ("assign", None, "bob")]
    log = [(rnd.choice("xyzw"), f"c{i:03d}", minutes[n + i] * MINUTE, *rnd.choice(kinds)) for i in range(n)]
    shape = "identity_key string, change_id string, at long, kind string, new_status string, assigned_to string"
    return incidents.incident_timeline(incidents.resolve_alerts(spark.createDataFrame(data, schema)), spark.createDataFrame(log, shape))


@pytest.mark.parametrize("seed", [7, 8])
def test_incident_states_equal_the_batch(spark, replay, seed):
    """Several micro-batches, incidents closed, opened again and still open at the end."""
    df = analyst_day(spark, seed)
    batch = incidents.roll_up_lifecycle(incidents.incidents_with_closings(df).result())
    assert batch.filter("status = 'OPEN'").count() and batch.filter("status = 'CONFIRMED_FRAUD'").count()
    stream = jobs.stream_incident_states(replay(df, "at", parts=5))
    shown = jobs.drain_latest(stream, ["incident_id"], "t-states")
    assert rows_of(shown.select(*batch.columns)) == rows_of(batch)


def test_forgotten_incidents_start_anew(spark, replay):
    """State goes when nothing has touched an incident for as long as it is kept."""
    schema = "alert_id string, customer_id string, event_time long, cumulative_score double, engine_source string"
    alerts = incidents.resolve_alerts(spark.createDataFrame([("a", "x", MINUTE, 1.0, "p"), ("b", "y", 500 * MINUTE, 1.0, "p"), ("c", "z", 999 * MINUTE, 1.0, "p")], schema))
    shape = "identity_key string, change_id string, at long, kind string, new_status string, assigned_to string"
    late = spark.createDataFrame([("x", "c1", 998 * MINUTE, "status", "FALSE_POSITIVE", None)], shape)
    stream = jobs.stream_incident_states(replay(incidents.incident_timeline(alerts, late), "at", parts=3), keep=60 * MINUTE)
    got = {r.identity_key: r.status for r in jobs.drain_latest(stream, ["incident_id"], "t-keep").collect()}
    assert got == {"x": "OPEN", "y": "OPEN", "z": "OPEN"}


def test_rates_show_windows_that_are_not_final(spark, replay):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.choice("ab"), 1000 * rnd.randrange(3600)) for _ in range(300)], "method string, t long")
    timed = df.withColumn("ts", F.timestamp_millis("t"))
    batch = metrics.event_rate(timed, "ts", "method", "5 minutes", "1 minute")
    direct = metrics.event_rate(timed, "ts", "method", "5 minutes", "2 minutes")
    assert batch.agg(F.sum("n")).first()[0] == 5 * 300 and direct.agg(F.sum("n")).first()[0] > 2 * 300
    stream = jobs.stream_event_rate(replay(df, "t"), "t", "method", "5 minutes", "1 minute")
    shown = jobs.drain_latest(stream, ["window_start", "method"], "t-rate")
    assert rows_of(shown.select(*batch.columns)) == rows_of(batch)


def test_late_rows_are_put_aside(spark, tmp_path):
    path = str(tmp_path / "late")
    batches = [[("a", 100_000), ("b", 20_000)], [("c", 95_000), ("d", 40_000), ("e", 200_000)], [("f", 150_000), ("g", 99_000)]]
    for rows in batches:
        spark.createDataFrame(rows, "event_id string, event_time long").coalesce(1).write.mode("append").parquet(path)
    stream = file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    late = jobs.late_rows(stream, "event_time", 50_000)
    assert sorted(r.event_id for r in late.collect()) == ["d", "g"]


def test_dedup_within_watermark(spark, replay):
    data = [("c", "k1", 1000), ("c", "k1", 2000), ("d", "k1", 2500), ("c", None, 3000), ("c", None, 3000)]
    df = spark.createDataFrame(data, "identity_key string, dedup_key string, event_time long")
    out = jobs.drain(jobs.stream_dedup(replay(df, "event_time", 2)), "t-dedup")
    assert sorted((r.identity_key, str(r.dedup_key)) for r in out.collect()) == [("c", "None"), ("c", "None"), ("c", "k1"), ("d", "k1")]


def owner_log(spark, seed, n=120):
    """Changes and lookups of a few accounts, at times of their own but for some ties of a change and a lookup."""
    rnd = random.Random(seed)
    times = rnd.sample(range(1000), n)
    changes = [(rnd.choice("pqr"), rnd.choice(["c1", "c2", "c3"]), rnd.random() < 0.25, t * MINUTE) for t in times[: n // 3]]
    asks = [(f"e{i:03d}", None, rnd.choice("pqrs"), t * MINUTE) for i, t in enumerate(times[n // 3 :] + times[:9])]
    asks += [("known", "c9", "p", MINUTE), ("nobody", None, None, MINUTE)]
    updates = spark.createDataFrame(changes, "account_id string, customer_id string, deleted boolean, event_time long")
    events = spark.createDataFrame(asks, "event_id string, customer_id string, from_account_id string, event_time long")
    return events, updates


def as_of_batch(events, updates):
    account = F.concat(F.lit("acct:"), F.col("from_account_id"))
    asked = events.filter("customer_id IS NULL AND from_account_id IS NOT NULL")
    whole = asked.withColumns({"dedup_key": F.lit(None).cast("string"), "identity_key": account})
    return enrich_accounts(whole, updates).drop("dedup_key")


CUTS = [k * 200 * MINUTE for k in range(1, 5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_owners_as_of_the_event_out_of_order(spark, seed):
    """Answered early and revised, or once when the watermark has passed: both give the rows of the batch join."""
    events, updates = owner_log(spark, seed)
    want = as_of_batch(events, updates)
    feeds = [jobs.replayed(df, "event_time", CUTS, "t-owners", spread=300 * MINUTE) for df in (events, updates)]
    early = jobs.stream_account_enrichment(*feeds, delay="300 minutes", early=True)
    assert rows_of(jobs.drain_latest(early, ["event_id"], "t-early").select(*want.columns)) == rows_of(want)
    end = spark.createDataFrame([("end", None, "end", 9000 * MINUTE)], events.schema)
    feeds[0] = jobs.replayed(events.union(end), "event_time", CUTS, "t-owners", spread=300 * MINUTE)
    final = jobs.drain(jobs.stream_account_enrichment(*feeds, delay="300 minutes"), "t-final")
    assert rows_of(final.filter("event_id <> 'end'").select(*want.columns)) == rows_of(want)


def state_of(spark, out, name):
    """Rows of one state variable after the last micro-batch of the stream that wrote ``out``."""
    return spark.read.format("statestore").option("path", f"{os.path.dirname(out)}/state").option("stateVarName", name).load()


def test_owner_versions_below_the_watermark_go(spark):
    """Many versions of an account leave one in state, lookups that were answered none, a deleted account nothing."""
    changes = [("p", f"c{i}", False, i * MINUTE) for i in range(1, 300)] + [("q", "c", False, MINUTE), ("q", "c", True, 2 * MINUTE)]
    updates = spark.createDataFrame(changes, "account_id string, customer_id string, deleted boolean, event_time long")
    asks = [(f"e{i}", None, "p", i * MINUTE) for i in range(1, 301)] + [("end", None, "end", 9000 * MINUTE)]
    events = spark.createDataFrame(asks, "event_id string, customer_id string, from_account_id string, event_time long")
    feeds = [jobs.replayed(df, "event_time", [100 * MINUTE, 200 * MINUTE], "t-bound") for df in (events, updates)]
    out = jobs.run_available(jobs.stream_account_enrichment(*feeds, delay="1 minute"), "t-bound")
    assert spark.read.parquet(out).filter("event_id <> 'end'").count() == 300
    held = {r.key[0]: list(r.value["times"]) for r in state_of(spark, out, "versions").collect()}
    assert held == {"p": [299 * MINUTE], "end": []}
    assert [r.key[0] for r in state_of(spark, out, "asks").collect()] == ["end"]


def test_timeline_owners_of_any_age(spark):
    """Transfers meet owners years older, owners that come after them, several owners, and none."""
    year = 366 * 24 * HOUR
    late = 10 * year
    accounts = [("p", "c1", "c", 2), ("q", "c2", "r", 1), ("q", "c3", "c", late + 3 * HOUR), ("q", "c3", "r", late + 3 * HOUR), ("p", "cx", "u", 5), ("z", "c4", "c", 7)]
    owned = spark.createDataFrame(accounts, "account_id string, customer_id string, op string, t long")
    moves = [(f"t{i}", "pqs"[i % 3], float(i), late + i * 10 * MINUTE) for i in range(60)]
    moved = spark.createDataFrame(moves, "transaction_id string, from_account string, amount double, t long")
    logins = spark.createDataFrame([("l1", "c1", False, late), ("l2", "c1", True, late)], "event_id string, customer_id string, success boolean, t long")
    added = spark.createDataFrame([("b1", "c1", late)], "beneficiary_id string, customer_id string, t long")
    tables = (logins, added, moved, owned)
    want = unified_timeline(*tables)
    cuts = [year, late + 2 * HOUR, late + 6 * HOUR]
    out = jobs.run_available(jobs.stream_timeline(*(jobs.replayed(df, "t", cuts, "t-line") for df in tables), hold=4 * HOUR), "t-line")
    got = spark.read.parquet(out)
    assert want.count() == 82 and rows_of(got.select(*want.columns)) == rows_of(want)
    held = state_of(spark, out, "moved")
    times = held.select(F.explode("list_value.event_time") if "list_value" in held.columns else F.col("list_element.event_time")).collect()
    # The watermark has passed all but the transfers of the last four hours.
    assert times and min(r[0] for r in times) >= late + 590 * MINUTE - 5000 - 4 * HOUR
    assert state_of(spark, out, "owners").count() == 4
