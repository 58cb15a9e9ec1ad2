import random

import pytest
from pyspark.sql import functions as F

from riskloom.config import ACCUMULATOR_WEIGHTS, CLEARING_WEIGHTS, SECONDARY_WEIGHTS, SecondaryConfig, secondary_indicators
from riskloom.functions.ordered import keyed_rows
from riskloom.operators import scorers
from riskloom.operators.indicators import derive_indicators, identity_rows
from test_scoring import frame, random_events

LIMITS = (10_000, 25)


def labelled(spark, seed, n=300, span=4000):
    rnd = random.Random(seed)
    labels = [*ACCUMULATOR_WEIGHTS, "SUSPICIOUS_DEVICE", "IMPOSSIBLE_TRAVEL", "OTHER", None]
    rows = [
        (rnd.choice(["hot", "hot", "a", "b", None]), f"{i:04d}", rnd.randrange(span), 0, rnd.choice(labels)) for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "customer_id string, event_id string, event_time long, pos int, risk_indicator_type string")


def found(df):
    return sorted((r.customer_id, r.event_id, r.cumulative_score, tuple(r.contributing_indicators), r.action_required) for r in df.collect())


def test_inactivity_reset(spark):
    rows, df = labelled(spark, 5)
    want = []
    for c in ("hot", "a", "b"):
        score, names, last = 0, [], None
        for _, event, t, _, label in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            if label not in ACCUMULATOR_WEIGHTS:
                continue
            if last is not None and t - last > 40:
                score, names = 0, []
            score, names, last = score + ACCUMULATOR_WEIGHTS[label], [*names, label], t
            if score >= 80:
                want.append((c, event, score, tuple(names), "FREEZE_ACCOUNT" if score >= 100 else "REQUIRE_MFA"))
                score, names = 0, []
    assert want
    for limit in LIMITS:
        assert found(scorers.inactivity_reset_alerts(df, idle=40, max_rows=limit)) == sorted(want)


def test_threshold_clear(spark):
    rows, df = labelled(spark, 6)
    want = []
    for c in ("hot", "a", "b", None):
        score, names = 0, []
        for _, event, _, _, label in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            label = label or "UNKNOWN"
            score, names = score + CLEARING_WEIGHTS.get(label, 10), [*names, label]
            if score >= 80:
                want.append((c or "unknown_ip", event, score, tuple(names), "REQUIRE_MFA" if score < 100 else "LOCK_ACCOUNT"))
                score, names = 0, []
    for limit in LIMITS:
        assert found(scorers.threshold_clear_alerts(df, max_rows=limit)) == sorted(want)


def test_penalty_box(spark):
    rnd = random.Random(8)
    rows = [
        (f"{i:04d}", rnd.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2"]), rnd.choice(["/api/login", "/api/transfers/x", "/api/other"]), rnd.randrange(900))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "request_id string, ip_address string, endpoint string, t long")
    want = []
    for ip in ("1.1.1.1", "2.2.2.2"):
        hits, boxed = [], None
        for _, _, endpoint, t in sorted((r for r in rows if r[1] == ip), key=lambda r: (r[3], r[0])):
            if "other" in endpoint or (boxed is not None and t - boxed < 30):
                continue
            hits = [h for h in [*hits, t] if t - h <= 10]
            if len(hits) >= 3:
                want.append((ip, t))
                hits, boxed = [], t
    assert want
    for limit in LIMITS:
        got = scorers.ip_velocity_alerts(df, 3, 10, 30, max_rows=limit).collect()
        assert sorted((r.customer_id, r.timestamp) for r in got) == sorted(want)


@pytest.mark.parametrize("sent", [scorers.SENT_STATES, 2])
def test_secondary_engine(spark, monkeypatch, sent):
    """Whether the states of hot chunks are sent to all tasks or joined changes nothing."""
    monkeypatch.setattr(scorers, "SENT_STATES", sent)
    config = SecondaryConfig(decay=40, cooldown=60)
    indicators = secondary_indicators(velocity_window=30, failed_login_window=50, api_window=60, api_count=6, travel_window=20)
    events = random_events(9, 350, 3000)
    rows = derive_indicators(identity_rows(frame(spark, *events)), indicators)
    fired = {r.event_id: r.indicators for r in rows.result().collect()}
    want = []
    for identity in {e["identity_key"] for e in events}:
        score, clock, alerted, names = 0.0, None, None, []
        mine = sorted((e for e in events if e["identity_key"] == identity), key=lambda e: (e["event_time"], e["event_id"]))
        for e in mine:
            t = e["event_time"]
            clock = t if clock is None else clock
            halvings = min((t - clock) // 40, 10)
            if halvings > 0:
                score, clock = score / 2**halvings, t
            score += sum(SECONDARY_WEIGHTS.get(n, 0) for n in fired[e["event_id"]])
            names = (names + fired[e["event_id"]])[-8:]
            if score >= 80 and (alerted is None or t - alerted >= 60):
                want.append((identity, t, round(score, 2), tuple(names)))
                score, alerted, names = 0.0, t, []
    assert want
    for limit in LIMITS:
        rows = derive_indicators(identity_rows(frame(spark, *events), limit), indicators)
        assert rows.chunked == (limit == 25)
        got = scorers.secondary_risk_alerts(rows, config).collect()
        assert sorted((r.identity_key, r.event_time, r.cumulative_score, tuple(r.contributing_indicators)) for r in got) == sorted(want)


def test_secondary_identity_order(spark):
    df = spark.createDataFrame(
        [("c", "A", "1"), (None, "A", "1"), (None, "B", "1"), (None, None, "1"), (None, None, None)],
        "customer_id string, from_account_id string, ip_address string",
    )
    owners = spark.createDataFrame([("A", "owner")], "account_id string, customer_id string")
    got = [r.identity_key for r in scorers.secondary_identity(df, owners).collect()]
    assert sorted(map(str, got)) == sorted(["c", "owner", "acct:B", "ip:1", "None"])


def test_threshold_clear_walks_the_chain_once(spark, monkeypatch):
    """With a hot customer the accepted rows are read by two passes; the chain must not be walked for each."""
    walked = spark.sparkContext.accumulator(0)

    def told(value):
        walked.add(1)
        return value

    def chain(candidates, *args, real=scorers.greedy_chain, **options):
        assert not [c for c in candidates.rows.columns if c.startswith("_past")]
        return real(candidates, *args, **options).with_column("_sum", F.udf(told, "long")("_sum"))

    rows, df = labelled(spark, 9)
    want = found(scorers.threshold_clear_alerts(df, max_rows=10_000))
    monkeypatch.setattr(scorers, "greedy_chain", chain)
    assert found(scorers.threshold_clear_alerts(df, max_rows=25)) == want
    assert walked.value == len(want)


def test_events_are_derived_once_for_both_kinds_of_identity(spark):
    """Messages are parsed on the way here, so no branch and no later count of keys may derive the rows again."""
    derived = spark.sparkContext.accumulator(0)

    def told(value):
        derived.add(1)
        return value

    rows = [("c", "A", "1"), (None, "A", "1"), (None, "B", "1"), (None, None, "1")] * 5
    df = spark.createDataFrame(rows, "customer_id string, from_account_id string, ip_address string")
    df = df.withColumn("customer_id", F.udf(told)("customer_id"))
    owners = spark.createDataFrame([("A", "owner")], "account_id string, customer_id string")
    known = scorers.secondary_identity(df, owners)
    for _ in range(2):
        got = [r.identity_key for r in known.collect()]
        assert sorted(got) == sorted(["c", "owner", "acct:B", "ip:1"] * 5)
    assert derived.value == len(rows)


def test_login_success_fallback(spark):
    df = spark.createDataFrame([(None, "FAILED"), (None, "OK"), (None, None), (False, "OK")], "success boolean, status string")
    assert [r[0] for r in df.select(scorers.login_succeeded(F.col("success"), F.col("status"))).collect()] == [False, True, True, False]


def test_a_dense_identity_takes_no_rounds(spark, monkeypatch):
    """Every alert time hangs on the one before, so starts do not settle; the passes must not grow with the chunks."""
    at = F.col("id") * 40 + F.col("id") * F.col("id") % 37
    rows = spark.range(1200).select(
        F.concat(F.lit("ip:"), F.col("id") % 2).alias("identity_key"), at.alias("event_time"), F.col("id").cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("account_id"), F.array(F.lit("SUSPICIOUS_API_PATTERN")).alias("indicators"),
    )
    config, cuts = SecondaryConfig(decay=5000, cooldown=2500), []
    monkeypatch.setattr(scorers, "cut_lineage", lambda df, real=scorers.cut_lineage: cuts.append(1) or real(df))
    order = ["event_time", "event_id"]
    want = scorers.secondary_risk_alerts(keyed_rows(rows, ["identity_key"], order), config)
    got = scorers.secondary_risk_alerts(keyed_rows(rows, ["identity_key"], order, 20), config)
    assert len(cuts) <= 4
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
