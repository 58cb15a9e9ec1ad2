import json

from riskloom.operators import normalize


def events(spark, *messages):
    df = spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m), 99) for m in messages], "value string, ingest_time long")
    return normalize.normalize_events(df).collect()


def envelope(after, table, op="c", lsn=None, **extra):
    source = {"table": table}
    if lsn is not None:
        source["lsn"] = lsn
    return {"after": after, "source": source, "op": op, "ts_ms": 1000, **extra}


def test_envelope_is_unwrapped(spark):
    (e,) = events(
        spark, envelope({"customer_id": "cust-123", "risk_indicator_type": "NEW_DEVICE"}, "public.login_events", "u", 1234)
    )
    assert (e.customer_id, e.indicator, e.source_operation, e.dedup_key) == ("cust-123", "NEW_DEVICE", "u", "1234")


def test_delete_and_broken_text_are_dropped(spark):
    assert events(spark, {"before": {"customer_id": "c"}, "after": None, "op": "d", "source": {}}, "not json", "") == []
    assert events(spark, envelope({"customer_id": "c"}, "t", "D")) == []


def test_delete_marker_without_envelope_fields_is_kept_only_outside_an_envelope(spark):
    (e,) = events(spark, {"customer_id": "c", "event_id": "e"})
    assert e.source_operation == "u" and e.dedup_key == "e" and e.event_time == 99


def test_dedup_key_without_lsn(spark):
    (e,) = events(spark, envelope({"event_id": "evt-001", "customer_id": "c"}, "public.transactions"))
    assert e.dedup_key == "transactions:evt-001"


def test_login_fields(spark):
    (e,) = events(
        spark,
        envelope({"customer_id": "c", "device_id": "dev-1", "country": "KE", "success": False}, "banking.public.login_events"),
    )
    assert (e.source_table, e.device_id, e.country, e.login_success, e.indicator) == ("login_events", "dev-1", "KE", False, None)


def test_success_is_three_valued(spark):
    got = [
        e.login_success
        for e in events(spark, *[envelope({"customer_id": "c", "success": s}, "login_events") for s in (True, "true", 1, 0, None)])
    ]
    assert got == [True, True, True, False, None]


def test_transaction_fields(spark):
    (e,) = events(spark, envelope({"from_account": "A", "to_account": "B", "amount": 15000.50, "beneficiary_id": "ben-1"}, "transactions"))
    assert (e.amount, e.beneficiary_id, e.to_account_id, e.account_id, e.identity_key) == (15000.5, "ben-1", "B", "A", "acct:A")


def test_telemetry_identity_is_the_address(spark):
    (e,) = events(spark, {"request_id": "r1", "ip_address": "10.0.0.5", "endpoint": "/api/x", "timestamp": 5})
    assert (e.source_table, e.identity_key, e.event_id, e.event_time) == ("api_requests", "ip:10.0.0.5", "r1", 5)


def test_blank_values_are_skipped(spark):
    (e,) = events(spark, {"customer_id": "  ", "ip_address": "1.1.1.1", "country": "", "login_country": "KE"})
    assert (e.customer_id, e.country, e.identity_key) == (None, "KE", "ip:1.1.1.1")


def test_malformed_side_output(spark):
    df = spark.createDataFrame([("not json", 1), ('{"a": 1}', 1)], "value string, ingest_time long")
    assert [r.value for r in normalize.malformed(df).collect()] == ["not json"]


def test_topic_rename(spark):
    df = spark.createDataFrame([("banking.public.accounts",), ("api_requests",)], "topic string")
    assert [r[0] for r in df.select(normalize.rename_topic(df.topic)).collect()] == ["banking.accounts", "api_requests"]


def accounts(spark, *messages):
    df = spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value string")
    return [(r.account_id, r.customer_id, r.deleted) for r in normalize.parse_account_updates(df).collect()]


def test_account_create_update_delete(spark):
    got = accounts(
        spark,
        {"op": "c", "after": {"account_id": "ACC-001", "customer_id": "cust-1"}},
        {"op": "u", "after": {"account_id": "ACC-002", "customer_id": "cust-2"}},
        {"op": "d", "before": {"account_id": "ACC-003", "customer_id": "cust-3"}, "after": None},
    )
    assert got == [("ACC-001", "cust-1", False), ("ACC-002", "cust-2", False), ("ACC-003", None, True)]


def test_account_without_ids_is_dropped(spark):
    assert accounts(spark, {"op": "c", "after": {"customer_id": "x"}}, {"op": "c", "after": {"account_id": "x"}}, "not json", {"op": "d"}) == []


TELEMETRY = {
    "request_id": "r1",
    "ip_address": "1.1.1.1",
    "user_agent": "ua",
    "endpoint": "/x",
    "method": "GET",
    "status_code": 200,
    "timestamp": 7,
}


def test_telemetry_contract(spark):
    text_status = {**TELEMETRY, "status_code": "TWO_HUNDRED"}
    untimed = {k: v for k, v in TELEMETRY.items() if k != "timestamp"}
    wide = {**TELEMETRY, "status_code": 2**40}
    short = {k: v for k, v in TELEMETRY.items() if k != "request_id"}
    values = [json.dumps(m) for m in (TELEMETRY, text_status, untimed, wide, short)] + ["broken"]
    df = spark.createDataFrame([(v, 50) for v in values], "value string, ingest_time long")
    valid, dead = normalize.split_telemetry(df)
    assert sorted((r.request_id, r.timestamp) for r in valid.collect()) == [("r1", 7), ("r1", 50)]
    dead = sorted((r.request_id, r.error_message.split(":")[0]) for r in dead.collect())
    assert dead == [
        ("UNKNOWN", "field request_id"),
        ("UNKNOWN", "not a JSON record"),
        ("r1", "field status_code"),
        ("r1", "field status_code"),
    ]


def test_binary_alerts_are_left_to_the_avro_reader(spark):
    df = spark.createDataFrame(
        [(bytearray(b"\x00\x00\x00\x00\x01abc"), "t"), (bytearray(b'{"alert_id": "a", "risk_score": 5}'), "t")],
        "value binary, source_topic string",
    )
    decoded, undecoded = normalize.decode_alerts(df)
    (row,) = decoded.collect()
    assert (row.alert_id, row.risk_score) == ("a", 5.0)
    (left,) = undecoded.collect()
    assert (bytes(left.value)[:1], left.source_topic, left.error) == (b"\x00", "t", "binary wire format")


def test_no_alert_message_gets_lost(spark):
    values = [b"\x00abc", b"", b"{", b"[1]", b'{"alert_id": "a"}', None, b"null"]
    df = spark.createDataFrame([(bytearray(v) if v is not None else None, k) for k, v in enumerate(values)], "value binary, n int")
    decoded, undecoded = normalize.decode_alerts(df)
    assert sorted([r.n for r in decoded.collect()] + [r.n for r in undecoded.collect()]) == list(range(len(values)))
    assert {r.n for r in decoded.collect()} == {4}


def test_the_payload_is_made_once_per_row(spark):
    """Not again for each field that a later filter asks for."""
    messages = spark.createDataFrame([('{"event_id": "1"}', 5)], "value string, ingest_time long")
    asked = normalize.normalize_events(messages).filter("endpoint = '/api/login' and customer_id is not null")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ELSE struct(event_id, ") == 1
