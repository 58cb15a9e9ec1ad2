import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.operators import metrics
from riskloom.sinks import alerts as sink
from riskloom.sinks import documents

INCIDENT = "incident_id long, status string, severity string, created_at long, updated_at long"


def test_metrics_without_resolved_cases(spark):
    df = spark.createDataFrame([(1, "OPEN", "LOW", 0, 5)], INCIDENT)
    row = metrics.case_metrics(df).first()
    assert (row.precision, row.false_positive_rate, row.avg_resolution_time_seconds, row.total_incidents) == (0.0, 0.0, None, 1)


def test_metrics_rates(spark):
    rows = [(i, s, "LOW", 0, 3000) for i, s in enumerate(["CONFIRMED_FRAUD", "FALSE_POSITIVE", "FALSE_POSITIVE", "RESOLVED_OTHER"])]
    row = metrics.case_metrics(spark.createDataFrame(rows, INCIDENT)).first()
    assert (row.precision, row.false_positive_rate, row.avg_resolution_time_seconds) == (0.3333, 0.6667, 3.0)


def test_queue_filters_and_pages(spark):
    df = spark.createDataFrame([(i, "OPEN" if i % 2 else "CLOSED", "LOW", 0, i // 2) for i in range(10)], INCIDENT)
    page = metrics.incident_queue(df, status="OPEN", limit=2, offset=1).collect()
    assert [r.incident_id for r in page] == [7, 5]
    with pytest.raises(ValueError):
        metrics.incident_queue(df, limit=500)


def test_endpoint_templates(spark):
    paths = ["/api/graph/entity/9", "/api/accounts/1/balance", "/api/accounts/1", "/api/sessions/x", "/api/login"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(metrics.endpoint_template(F.col("p"))).collect()]
    assert got == ["/api/graph/entity/{id}", "/api/accounts/{id}/balance", "/api/accounts/{id}", "/api/sessions/{id}", "/api/login"]


def test_self_transfer_shows_once(spark):
    df = spark.createDataFrame([("t", "A", "A", 1), ("u", "B", "A", 2)], "transaction_id string, from_account string, to_account string, t long")
    assert [r.transaction_id for r in metrics.account_statement(df, "A").collect()] == ["u", "t"]


def sample_alerts(spark):
    schema = (
        "alert_id string, identity_key string, customer_id string, account_id string, event_time long, severity string, "
        "cumulative_score long, threshold long, contributing_indicators array<string>, trigger_reason string, "
        "first_seen_ts long, latest_seen_ts long, source_event_ids array<string>, action_required string"
    )
    rows = [
        ("a", "c", "c", None, 1, "FRAUD", 85, 80, ["X"], "X", 1, 1, ["e"], "REQUIRE_MFA"),
        ("b", "c", "c", None, 2, "CRITICAL", 100, 80, ["X"], "X", 2, 2, ["e"], "LOCK_ACCOUNT"),
    ]
    return spark.createDataFrame(rows, schema)


def test_alert_messages(spark):
    got = sorted(sink.encode_json(sample_alerts(spark)).collect())
    assert [(r.topic, r.key) for r in got] == [("critical_alerts_v2", "c"), ("fraud_alerts_v2", "c")]
    assert tuple(json.loads(got[0].value)) == sink.WIRE_FIELDS


def test_retried_epoch_writes_once(spark, tmp_path):
    path, alerts = str(tmp_path / "alerts"), sample_alerts(spark)
    for epoch in (0, 1, 1):
        sink.write_epoch(alerts, path, epoch)
    stored = sink.read_alerts(spark, path)
    assert stored.count() == 2
    assert stored.filter("severity = 'FRAUD'").count() == 1


def test_documents_upsert(spark, tmp_path):
    def message(event, op, at, **after):
        body = {"event_id": event, "timestamp": at * 1000, **after} if op != "d" else None
        return (json.dumps({"after": body, "op": op, "ts_ms": at}),)

    batch = [
        message("e1", "c", 10, success=False, latitude=1.5, longitude=2.5),
        message("e1", "u", 20, success=True, latitude=1.5),
        message("e2", "d", 30),
        ("broken",),
        (json.dumps({"event_id": "plain", "timestamp": 40}),),
    ]
    docs = documents.index_documents(spark.createDataFrame(batch, "value string"), "login_events")
    path = str(tmp_path / "docs")
    for _ in range(2):
        documents.append_documents(docs, "login_events", path, epoch=3)
    stored = {r.event_id: r for r in documents.read_documents(spark, "login_events", path).collect()}
    assert set(stored) == {"e1", "plain"}
    assert stored["e1"].success is True and stored["e1"].geo_location is None
    assert stored["e1"].timestamp.timestamp() == 0.02
    first = {(r.event_id, r.success): r for r in docs.collect()}["e1", False]
    assert (first.geo_location.lat, first.geo_location.lon) == (1.5, 2.5)


def test_event_rate(spark):
    df = spark.createDataFrame([(0, "a"), (299_999, "a"), (300_000, "b")], "t long, label string")
    got = metrics.event_rate(df.withColumn("ts", F.timestamp_millis("t")), "ts", "label")
    assert rows_of(got.select("window_start", "label", "n")) == [("a", "2", "0"), ("b", "1", "300000")]
