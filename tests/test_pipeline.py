import json

from pyspark.sql import functions as F

from riskloom.operators import enrich, normalize
from riskloom.plans import pipeline
from riskloom.sources.readers import file_stream
from riskloom.streaming import jobs


def message(lsn, account, amount, at):
    after = {"from_account": account, "to_account": "B", "amount": amount}
    return json.dumps({"after": after, "source": {"lsn": lsn, "table": "public.transactions"}, "op": "c", "ts_ms": at}), at


def test_messages_to_alerts_and_incidents(spark, tmp_path):
    t = 1_700_000_000_000
    raw = [message(str(i), "A", a, t + 2000 * i) for i, a in enumerate([100.0, 15_000.0, 15_000.0, 500.0])]
    # A redelivery must not score; another account is not mapped.
    raw += [message("1", "A", 15_000.0, t + 2500), message("x", "Z", 15_000.0, t), ("broken", t)]
    messages = spark.createDataFrame(raw, "value string, ingest_time long")
    owners = spark.createDataFrame(
        [(json.dumps({"op": "c", "after": {"account_id": "A", "customer_id": "cust-1"}, "ts_ms": t - 5}),)], "value string"
    )
    for limit in (1000, 2):
        alerts = pipeline.batch_alerts(messages, owners, pipeline.Settings(max_rows=limit))
        (alert,) = alerts.collect()
        assert (alert.identity_key, alert.cumulative_score, alert.severity) == ("cust-1", 100, "CRITICAL")
    (incident,) = pipeline.batch_incidents(alerts).collect()
    assert (incident.identity_key, incident.severity, incident.alert_count) == ("cust-1", "CRITICAL", 1)

    path = str(tmp_path / "raw")
    messages.coalesce(1).write.parquet(path)
    snapshot = enrich.account_snapshot(normalize.parse_account_updates(owners))
    stream = pipeline.stream_alerts(file_stream(spark, path, messages.schema), snapshot)
    (live,) = jobs.drain(stream, "t-pipeline").collect()
    assert live.asDict() == alert.asDict()


def test_repeats_prolong_a_profile(spark):
    hour = 3_600_000
    rows = [("a", "k", 0), ("b", "k", 20 * hour), ("c", "m", 40 * hour)]
    events = spark.createDataFrame(rows, "event_id string, dedup_key string, event_time long").withColumns(
        {"identity_key": F.lit("c1"), "source_table": F.lit("login_events"), "device_id": F.when(F.col("event_id") == "c", "y").otherwise("x")}
    )
    for name, kind in (("country", "string"), ("login_success", "boolean"), ("amount", "double"), ("to_account_id", "string"), ("indicator", "string")):
        events = events.withColumn(name, F.lit(None).cast(kind))
    marked = enrich.dedup_events(events, keep_repeats=True)
    assert {r.event_id: r.repeated for r in marked.collect()} == {"a": False, "b": True, "c": False}
    from riskloom.operators.indicators import derive_indicators, identity_rows

    got = {r.event_id: r.indicators for r in derive_indicators(identity_rows(marked)).result().collect()}
    assert got == {"a": [], "b": [], "c": ["NEW_DEVICE"]}
    alone = derive_indicators(identity_rows(events.filter("event_id <> 'b'"))).result()
    assert all(not r.indicators for r in alone.collect())
