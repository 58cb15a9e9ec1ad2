import json

from riskloom.config import MINUTE
from riskloom.operators import incidents

ALERTS = "alert_id string, customer_id string, account_id string, event_time long, cumulative_score double, source_topic string"


def alerts(spark, *rows):
    return incidents.resolve_alerts(spark.createDataFrame([("a%d" % i, *r) for i, r in enumerate(rows)], ALERTS))


def test_defaults_and_engine_by_topic(spark):
    df = alerts(spark, (None, None, 0, None, "fraud_alerts_v2"), ("", "acc", 0, 5.0, "fraud_alerts"))
    got = [(r.identity_key, r.risk_score, r.indicator, r.engine_source) for r in df.orderBy("alert_id").collect()]
    assert got == [
        ("UNKNOWN", 50.0, "ANOMALY_DETECTED", "flink-primary"),
        ("acc", 5.0, "ANOMALY_DETECTED", "python-secondary"),
    ]


def test_indicator_falls_back_to_the_last_contributing(spark):
    df = spark.createDataFrame(
        [("x", ["A", "B"], ""), ("y", [], None), ("z", ["A"], "T")],
        "customer_id string, contributing_indicators array<string>, trigger_reason string",
    )
    assert [r.indicator for r in incidents.resolve_alerts(df).orderBy("customer_id").collect()] == ["B", "ANOMALY_DETECTED", "T"]


def test_gap_is_inclusive_and_engines_corroborate(spark):
    gap = 30 * MINUTE
    df = alerts(
        spark,
        ("c", None, 0, 40.0, "fraud_alerts_v2"),
        ("c", None, gap, 75.0, "fraud_alerts"),
        ("c", None, 2 * gap + 1, 95.0, "fraud_alerts"),
    )
    for limit in (1000, 1):
        assigned = incidents.assign_incidents(df, gap, max_rows=limit).result()
        got = incidents.roll_up_incidents(assigned).orderBy("first_alert_at").collect()
        assert [(r.alert_count, r.severity, r.corroborated, r.engine_sources) for r in got] == [
            (2, "HIGH", True, ["flink-primary", "python-secondary"]),
            (1, "CRITICAL", False, ["python-secondary"]),
        ]


def test_links_carry_the_payload(spark):
    df = alerts(spark, ("c", None, 0, 40.0, "fraud_alerts_v2"))
    assigned = incidents.assign_incidents(df).result()
    (link,) = incidents.incident_links(assigned).collect()
    payload = json.loads(link.raw_payload)
    assert (payload["engine_source"], payload["alert_id"], link.incident_id) == ("flink-primary", "a0", payload["incident_id"])


def test_changes_and_audit(spark):
    opened = spark.createDataFrame([("i", "OPEN", 0), ("j", "OPEN", 0)], "incident_id string, status string, created_at long")
    log = spark.createDataFrame(
        [
            ("i", "1", 10, "assign", None, "ann", "lead", None),
            ("i", "2", 20, "assign", None, "bob", "lead", None),
            ("i", "3", 30, "status", "OPEN", None, "bob", "reopened"),
            ("i", "4", 40, "assign", None, "cat", "lead", None),
            ("i", "5", 50, "status", "CONFIRMED_FRAUD", None, "cat", "sure"),
            ("i", "6", 60, "assign", None, "dan", "lead", None),
        ],
        "incident_id string, change_id string, at long, kind string, new_status string, assigned_to string, changed_by string, notes string",
    )
    for limit in (1000, 2):
        current, audits = incidents.apply_changes(opened, log, max_rows=limit)
        got = [(r.previous_status, r.new_status, r.at, r.changed_by) for r in audits.orderBy("at").collect()]
        assert got == [
            ("OPEN", "INVESTIGATING", 10, "lead"),
            ("INVESTIGATING", "OPEN", 30, "bob"),
            ("OPEN", "INVESTIGATING", 40, "lead"),
            ("INVESTIGATING", "CONFIRMED_FRAUD", 50, "cat"),
        ]
        state = {r.incident_id: (r.status, r.assigned_to, r.updated_at) for r in current.collect()}
        assert state == {"i": ("CONFIRMED_FRAUD", "dan", 50), "j": ("OPEN", None, 0)}


def test_detail_is_long_and_has_audits(spark):
    df = alerts(spark, ("c", None, 0, 40.0, "fraud_alerts_v2"), ("c", None, 5, 40.0, "fraud_alerts_v2"))
    assigned = incidents.assign_incidents(df).result()
    rolled = incidents.roll_up_incidents(assigned)
    audits = rolled.selectExpr("incident_id", "'OPEN' previous_status", "'INVESTIGATING' new_status", "'me' changed_by", "9L at")
    detail = incidents.incident_detail(rolled, incidents.incident_links(assigned), audits).collect()
    assert sorted((r.child, r.label) for r in detail) == [
        ("alert", "ANOMALY_DETECTED"),
        ("alert", "ANOMALY_DETECTED"),
        ("audit", "OPEN -> INVESTIGATING"),
    ]


def test_a_status_ends_the_incident_and_changes_prolong_it(spark):
    gap = 30 * MINUTE
    found = alerts(
        spark,
        ("c", None, 0, 95.0, "fraud_alerts_v2"),
        ("c", None, 50 * MINUTE, 40.0, "fraud_alerts"),  # kept alive by the assignment at 25
        ("c", None, 70 * MINUTE, 75.0, "fraud_alerts"),  # closed at 60
        ("c", None, 101 * MINUTE, 40.0, "fraud_alerts"),  # too late
        ("c", None, 140 * MINUTE, 40.0, "fraud_alerts"),  # opened again at 130
    )
    log = [
        ("c", "0", -5, "status", "OPEN", None),
        ("c", "1", 25 * MINUTE, "assign", None, "ann"),
        ("c", "2", 60 * MINUTE, "status", "FALSE_POSITIVE", None),
        ("c", "3", 110 * MINUTE, "status", "CONFIRMED_FRAUD", None),
        ("c", "4", 130 * MINUTE, "status", "OPEN", None),
        ("d", "5", 130 * MINUTE, "assign", None, "bob"),
        (None, "6", 0, "assign", None, "bob"),
    ]
    shape = "identity_key string, change_id string, at long, kind string, new_status string, assigned_to string"
    timeline = incidents.incident_timeline(found, spark.createDataFrame(log, shape))
    for limit in (1000, 1):
        tagged = incidents.incidents_with_closings(timeline, gap, max_rows=limit).result()
        got = incidents.roll_up_lifecycle(tagged).orderBy("first_alert_at").collect()
        assert [(r.alert_count, r.status, r.severity, r.assigned_to, r.updated_at // MINUTE) for r in got] == [
            (2, "FALSE_POSITIVE", "CRITICAL", "ann", 60),
            (1, "OPEN", "HIGH", None, 70),
            (2, "OPEN", "MEDIUM", None, 140),
        ]
