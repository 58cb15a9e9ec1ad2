"""Fixed schemas; nothing is inferred. All fields are nullable."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names on the wire.
PAYLOAD_FIELDS = (
    "event_id",
    "customer_id",
    "account_id",
    "from_account",
    "to_account",
    "ip_address",
    "risk_indicator_type",
    "indicator",
    "country",
    "login_country",
    "device_id",
    "success",
    "amount",
    "beneficiary_id",
    "request_id",
    "event_time",
    "timestamp",
    "source_event_id",
    "endpoint",
)
SOURCE_FIELDS = ("lsn", "txId", "table")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Scalars are read as text and cast afterwards: senders disagree on number versus text.
ENVELOPE = T.StructType(
    [
        *strings(*PAYLOAD_FIELDS).fields,
        T.StructField("before", strings("account_id", "customer_id")),
        T.StructField("after", strings(*PAYLOAD_FIELDS)),
        T.StructField("source", strings(*SOURCE_FIELDS)),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)

# The telemetry contract, field -> (contract type, accepted JSON type).
TELEMETRY_CONTRACT = {
    "request_id": ("string", "STRING"),
    "ip_address": ("string", "STRING"),
    "user_agent": ("string", "STRING"),
    "endpoint": ("string", "STRING"),
    "method": ("string", "STRING"),
    "status_code": ("int", "BIGINT"),
    "timestamp": ("long", "BIGINT"),
}

ALERT_JSON = T.StructType(
    [
        *strings("alert_id", "identity_key", "customer_id", "account_id").fields,
        T.StructField("event_time", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("cumulative_score", T.DoubleType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("threshold", T.LongType()),
        T.StructField("contributing_indicators", T.ArrayType(T.StringType())),
        *strings("trigger_reason", "rule_name").fields,
        T.StructField("first_seen_ts", T.LongType()),
        T.StructField("latest_seen_ts", T.LongType()),
        T.StructField("source_event_ids", T.ArrayType(T.StringType())),
        *strings("action_required", "engine_source").fields,
        T.StructField("_corrupt", T.StringType()),
    ]
)

# Document index -> (business key, field -> stored type).
INDEX_MAPPINGS = {
    "api_requests": (
        "request_id",
        {
            "timestamp": "timestamp",
            "request_id": "string",
            "ip_address": "string",
            "user_agent": "string",
            "endpoint": "string",
            "method": "string",
            "status_code": "int",
        },
    ),
    "login_events": (
        "event_id",
        {
            "timestamp": "timestamp",
            "event_id": "string",
            "customer_id": "string",
            "success": "boolean",
            "ip_address": "string",
            "country": "string",
            "device_id": "string",
            "latitude": "double",
            "longitude": "double",
        },
    ),
    "employee_actions": (
        "action_id",
        {
            "timestamp": "timestamp",
            "action_id": "string",
            "employee_id": "string",
            "customer_id": "string",
            "action_type": "string",
        },
    ),
    "alerts": (
        "alert_id",
        {
            "event_time": "timestamp",
            "alert_id": "string",
            "customer_id": "string",
            "account_id": "string",
            "severity": "string",
            "cumulative_score": "int",
            "threshold": "int",
            "contributing_indicators": "array<string>",
            "trigger_reason": "string",
            "action_required": "string",
        },
    ),
}

# Topic -> document index.
TOPIC_INDEX = {
    "api_requests": "api_requests",
    "banking.login_events": "login_events",
    "banking.employee_actions": "employee_actions",
    "fraud_alerts_v2": "alerts",
    "critical_alerts_v2": "alerts",
}
