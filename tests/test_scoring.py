import random

from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.config import HOUR, MINUTE, PRIMARY_WEIGHTS, IndicatorConfig, ScoreConfig
from riskloom.operators.indicators import derive_indicators, identity_rows
from riskloom.operators.scoring import alert_id, risk_alerts, score_events
from riskloom.streaming.profile import advance

SCHEMA = (
    "event_id string, identity_key string, event_time long, source_table string, customer_id string, account_id string, "
    "country string, device_id string, login_success boolean, amount double, to_account_id string, endpoint string, "
    "indicator string"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def frame(spark, *events):
    rows = []
    for i, e in enumerate(events):
        row = dict.fromkeys(NAMES) | {"event_id": f"{i:05d}", "identity_key": "c1", "event_time": 1_000_000 + i} | e
        rows.append(tuple(row[n] for n in NAMES))
    return spark.createDataFrame(rows, SCHEMA)


def fired(spark, *events, config=IndicatorConfig(), **kw):
    rows = derive_indicators(identity_rows(frame(spark, *events), **kw), config).result()
    return [r.indicators for r in rows.orderBy("event_id").collect()]


def login(**kw):
    return {"source_table": "login_events", **kw}


def transfer(**kw):
    return {"source_table": "transactions", **kw}


def test_weight_of_new_device():
    assert PRIMARY_WEIGHTS["NEW_DEVICE"] == 30


def test_new_country_and_first_login(spark):
    day = IndicatorConfig(travel_window=0)
    got = fired(spark, login(country="KE"), login(country=None), login(country="NG"), login(country="NG"), config=day)
    assert got == [[], [], ["NEW_COUNTRY"], []]


def test_only_the_last_device_is_remembered(spark):
    got = fired(spark, *[login(device_id=d) for d in ("a", "b", "a", None, "a")])
    assert got == [[], ["NEW_DEVICE"], ["NEW_DEVICE"], [], []]


def test_impossible_travel_window_is_inclusive(spark):
    for gap, expect in ((2 * HOUR, True), (2 * HOUR + 1, False)):
        got = fired(spark, login(country="KE", event_time=5), login(country="NG", event_time=5 + gap))
        assert ("IMPOSSIBLE_TRAVEL" in got[1]) is expect


def test_failed_logins_count_since_success(spark):
    flags = [False, False, False, True, False, None, False, False]
    got = fired(spark, *[login(login_success=f) for f in flags])
    assert [bool(g) for g in got] == [False, False, True, False, False, False, False, True]


def test_velocity_on_the_fourth_transfer(spark):
    assert fired(spark, *[transfer(amount=50.0)] * 5) == [[], [], [], ["VELOCITY_VIOLATION"], ["VELOCITY_VIOLATION"]]


def test_large_transfer_is_strict(spark):
    assert fired(spark, transfer(amount=10_000.0), transfer(amount=10_001.0)) == [[], ["LARGE_TRANSFER_AMOUNT"]]


def test_fifty_requests(spark):
    got = fired(spark, *[{"source_table": "api_requests"}] * 51)
    assert [i for i, g in enumerate(got) if g] == [49, 50]


def test_threshold_above_the_retained_stamps_never_fires(spark):
    config = IndicatorConfig(api_count=51)
    assert not any(fired(spark, *[{"source_table": "api_requests"}] * 60, config=config))


def test_explicit_indicator_overrides_and_leaves_history_alone(spark):
    got = fired(
        spark,
        login(device_id="a"),
        login(device_id="b", indicator="HIGH_RISK_RECIPIENT"),
        login(device_id="a"),
    )
    assert got == [[], ["HIGH_RISK_RECIPIENT"], []]


def test_high_risk_recipient_comes_last(spark):
    config = IndicatorConfig(high_risk_recipients=("X",))
    assert fired(spark, transfer(amount=20_000.0, to_account_id="X"), config=config) == [
        ["LARGE_TRANSFER_AMOUNT", "HIGH_RISK_RECIPIENT"]
    ]


def test_profile_is_forgotten_after_its_life(spark):
    day = 24 * HOUR
    got = fired(spark, login(device_id="a", event_time=1), login(device_id="b", event_time=1 + day))
    assert got == [[], []]
    got = fired(spark, login(device_id="a", event_time=1), login(device_id="b", event_time=day))
    assert got == [[], ["NEW_DEVICE"]]


def test_four_transfers_raise_one_critical_alert(spark):
    amounts = [100.0, 15_000.0, 15_000.0, 500.0]
    df = frame(spark, *[transfer(amount=a, event_time=10_000 + 2_000 * i) for i, a in enumerate(amounts)])
    rows = derive_indicators(identity_rows(df))
    scores = [r.score for r in score_events(rows).result().orderBy("event_id").collect()]
    assert scores == [0, 35, 70, 100]
    (alert,) = risk_alerts(rows).collect()
    assert (alert.severity, alert.action_required, alert.cumulative_score) == ("CRITICAL", "LOCK_ACCOUNT", 100)
    assert alert.trigger_reason == "VELOCITY_VIOLATION"
    assert alert.contributing_indicators == ["LARGE_TRANSFER_AMOUNT", "LARGE_TRANSFER_AMOUNT", "VELOCITY_VIOLATION"]


def test_list_keeps_eight(spark):
    df = frame(spark, *[login(indicator=f"I{i}") for i in range(12)])
    rows = score_events(derive_indicators(identity_rows(df)), listed=True).result()
    last = rows.orderBy(F.desc("event_id")).first()
    assert last.contributing == [f"I{i}" for i in range(4, 12)]


def test_alert_id_is_stable_inside_a_window(spark):
    df = spark.createDataFrame([("ip:1.2.3.4", 900_000), ("ip:1.2.3.4", 1_799_999)], "i string, t long")
    ids = {r[0] for r in df.select(alert_id("i", F.lit("CRITICAL"), "t", 15 * MINUTE)).collect()}
    assert ids == {"ip1234-critical-900000"}


def test_score_halves_on_the_grid_of_the_first_event(spark):
    step = 30 * MINUTE
    times = [0, 10, step - 1, step, 3 * step + 5, 40 * step]
    events = [login(indicator="NEW_DEVICE" if i < 3 else None, event_time=t) for i, t in enumerate(times)]
    config = IndicatorConfig(profile_ttl=0)
    rows = score_events(derive_indicators(identity_rows(frame(spark, *events)), config)).result()
    assert [r.score for r in rows.orderBy("event_id").collect()] == [30, 60, 90, 45, 11, 0]


def random_events(seed, n, span):
    rnd, out = random.Random(seed), []
    for i in range(n):
        table = rnd.choice(["login_events", "transactions", "api_requests", "sessions"])
        out.append(
            {
                "event_id": f"{i:05d}",
                "identity_key": rnd.choice(["hot", "hot", "hot", "c1", "c2", "ip:1"]),
                "event_time": rnd.randrange(span),
                "source_table": table,
                "customer_id": "c",
                "country": rnd.choice([None, "KE", "NG"]),
                "device_id": rnd.choice([None, "a", "b"]),
                "login_success": rnd.choice([None, True, False, False]),
                "amount": rnd.choice([None, 50.0, 20_000.0]),
                "to_account_id": rnd.choice(["X", "Y"]),
                "indicator": rnd.choice([None] * 9 + ["OTHER"]),
            }
        )
    return out


def loop(events, indicators, scores):
    """The same rules, event by event."""
    out = []
    for identity in {e["identity_key"] for e in events}:
        profile = None
        mine = [e for e in events if e["identity_key"] == identity]
        for e in sorted(mine, key=lambda e: (e["event_time"], e["event_id"])):
            profile, fired, alerts = advance(profile, e, indicators, scores)
            if alerts:
                out.append((identity, e["event_id"], profile.score, tuple(profile.listed)))
    return sorted(out)


def test_alerts_match_the_loop_with_and_without_hot_keys(spark):
    indicators = IndicatorConfig(
        profile_ttl=2 * HOUR, velocity_window=20 * MINUTE, failed_login_window=HOUR, api_window=HOUR, api_count=6,
        high_risk_recipients=("X",),
    )
    scores = ScoreConfig(cooldown=4 * MINUTE, decay=3 * MINUTE)
    for seed, span in ((1, 6 * HOUR), (2, 60 * HOUR)):
        events = random_events(seed, 400, span)
        want = loop(events, indicators, scores)
        assert want
        for limit in (10_000, 40):
            rows = derive_indicators(identity_rows(frame(spark, *events), limit), indicators)
            assert rows.chunked == (limit == 40)
            got = sorted(
                (r.identity_key, r.source_event_ids[0], r.cumulative_score, tuple(r.contributing_indicators))
                for r in risk_alerts(rows, scores).collect()
            )
            assert got == want


def test_chunked_scores_equal_plain_scores(spark, small):
    from riskloom.plans.queries import INDICATORS, SCORES
    from riskloom.sources import fixtures as fx

    events = fx.risk_events(spark, small)
    plain, split = (
        score_events(derive_indicators(identity_rows(events, limit), INDICATORS), SCORES).result() for limit in (10**6, 15)
    )
    assert rows_of(plain) == rows_of(split.select(*plain.columns))


def test_hot_identities_store_what_an_alert_is_made_of(spark, monkeypatch):
    """Chunks of a few rows, so that cells and segments go on from chunk to chunk, and neither wide nor all rows are dealt anew."""
    indicators, scores = IndicatorConfig(profile_ttl=2 * HOUR), ScoreConfig(cooldown=4 * MINUTE, decay=3 * MINUTE)
    df = frame(spark, *random_events(5, 300, 9 * HOUR))
    want = risk_alerts(derive_indicators(identity_rows(df), indicators), scores)
    rows = derive_indicators(identity_rows(df, 3), indicators)
    scored = score_events(rows, scores).rows
    plan = scored._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # By identity the cells, by chunk the states in which chunks begin.
    assert len(dealt) == 2, plan
    stored, real = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: stored.append(self.columns) or real(self, *a, **k))
    got = risk_alerts(rows, scores)
    assert want.count() > 10 and rows_of(got) == rows_of(want)
    assert stored and not [c for c in stored if "device_id" in c or "endpoint" in c]
