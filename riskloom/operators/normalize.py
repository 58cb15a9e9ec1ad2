"""Change-data and telemetry messages to uniform risk events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.text import after_last_dot, evaluated_once, first_non_blank


def rename_topic(topic: Column) -> Column:
    """Capture topics carry the database schema; consumers use the short name."""
    return F.regexp_replace(topic, r"banking\.public\.(.*)", "banking.$1")


def _parse(messages: DataFrame, value: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return evaluated_once(messages, "m", F.from_json(value, schemas.ENVELOPE, options))


def malformed(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages that are not JSON, for a side output."""
    parsed = _parse(messages, value)
    return parsed.filter(F.col("m").isNull() | F.col("m._corrupt").isNotNull()).drop("m")


def normalize_events(messages: DataFrame, value: str = "value", ingest_time: str = "ingest_time") -> DataFrame:
    """One risk event per message; malformed messages and deletes are dropped.

    ``ingest_time`` (epoch ms) stands in where a message carries no time.
    """
    parsed = _parse(messages, value).filter(F.col("m").isNotNull() & F.col("m._corrupt").isNull())
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    envelope = F.array_contains(keys, "source") | F.array_contains(keys, "op")
    operation = F.coalesce(F.col("m.op"), F.lit("u"))
    live = parsed.filter(~(envelope & (F.lower(operation) == "d")))

    wrapped = F.col("m.after").isNotNull()
    payload = F.when(wrapped, F.col("m.after")).otherwise(F.struct(*[F.col(f"m.{n}") for n in schemas.PAYLOAD_FIELDS]))
    base = live.select(
        F.explode(F.array(payload)).alias("p"),  # once per row, not once for each of its fields
        F.col("m").alias("r"),
        envelope.alias("enveloped"),
        operation.alias("op"),
        F.col(ingest_time).alias("ingested"),
    )
    p, r = (lambda n: F.col(f"p.{n}")), (lambda n: F.col(f"r.{n}"))

    table = F.coalesce(
        after_last_dot(r("source.table")),
        F.when(~F.col("enveloped") & p("endpoint").isNotNull(), F.lit("api_requests")),
    )
    customer = first_non_blank(p("customer_id"), r("customer_id"))
    ip = first_non_blank(p("ip_address"), r("ip_address"))
    event_id = first_non_blank(r("event_id"), p("event_id"), p("request_id"), r("source.lsn"))
    event_time = F.coalesce(
        _long(r("ts_ms")), _long(p("event_time")), _long(p("timestamp")), F.col("ingested")
    )
    named = base.withColumns(
        {
            "event_id": event_id,
            "customer_id": customer,
            "ip_address": ip,
            "source_table": table,
            "event_time": event_time,
        }
    )
    dedup_key = first_non_blank(
        r("source.lsn"),
        r("source.txId"),
        p("source_event_id"),
        F.concat(F.col("source_table"), F.lit(":"), F.col("event_id")),
        F.col("event_id"),
    )
    return named.select(
        "event_id",
        "customer_id",
        F.coalesce(first_non_blank(p("account_id"), r("account_id")), p("from_account")).alias("account_id"),
        first_non_blank(p("risk_indicator_type"), p("indicator"), r("risk_indicator_type")).alias("indicator"),
        "event_time",
        "source_table",
        F.col("op").alias("source_operation"),
        dedup_key.alias("dedup_key"),
        first_non_blank(p("country"), p("login_country")).alias("country"),
        p("device_id").alias("device_id"),
        _truth(p("success")).alias("login_success"),
        F.when(p("amount").isNotNull(), F.coalesce(p("amount").try_cast("double"), F.lit(0.0))).alias("amount"),
        first_non_blank(p("beneficiary_id"), p("to_account")).alias("beneficiary_id"),
        "ip_address",
        p("from_account").alias("from_account_id"),
        p("to_account").alias("to_account_id"),
        F.coalesce(
            F.col("customer_id"),
            F.concat(F.lit("ip:"), F.col("ip_address")),
            F.concat(F.lit("acct:"), p("from_account")),
        ).alias("identity_key"),
        p("endpoint").alias("endpoint"),
    )


def _long(value: Column) -> Column:
    return value.try_cast("long")


def _truth(value: Column) -> Column:
    """Null stays null; text and numbers read as the sender meant them."""
    number = F.coalesce(value.try_cast("double") != 0, F.lit(False))
    return F.when(value.isNotNull(), F.when(F.trim(value) == "true", F.lit(True)).otherwise(number))


def parse_account_updates(messages: DataFrame, value: str = "value") -> DataFrame:
    """Account ownership changes: (account_id, customer_id, deleted, event_time)."""
    m = _parse(messages, value).filter(F.col("m").isNotNull() & F.col("m._corrupt").isNull())
    deleted = F.lower(F.coalesce(F.col("m.op"), F.lit("u"))) == "d"
    after = F.col("m.after").isNotNull()

    def live(name: str) -> Column:
        return F.when(after, F.col(f"m.after.{name}")).otherwise(F.col(f"m.{name}"))

    out = m.select(
        F.when(deleted, F.col("m.before.account_id")).otherwise(live("account_id")).alias("account_id"),
        F.when(~deleted, live("customer_id")).alias("customer_id"),
        deleted.alias("deleted"),
        _long(F.col("m.ts_ms")).alias("event_time"),
    )
    return out.filter(F.col("account_id").isNotNull() & (F.col("deleted") | F.col("customer_id").isNotNull()))


def check_telemetry(messages: DataFrame, value: str = "value", ingest_time: str = "ingest_time") -> DataFrame:
    """Add ``error_message`` (null on a valid record), ``request_id`` and ``timestamp``.

    The contract asks for seven typed fields; a missing timestamp is filled and
    not an error.
    """
    variant = evaluated_once(messages, "v", F.try_parse_json(value))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))

    problems = []
    for name, (wanted, accepted) in schemas.TELEMETRY_CONTRACT.items():
        found = F.coalesce(kind(name), F.lit("MISSING"))
        wrong = found != accepted
        if name == "timestamp":
            wrong = wrong & (found != "MISSING")
        if wanted == "int":
            wide = F.try_variant_get("v", f"$.{name}", "int").isNull()
            wrong = wrong | wide
        text = F.concat(F.lit(f"field {name}: expected {wanted}, found "), found)
        problems.append(F.when(wrong, text))
    error = F.when(F.col("v").isNull(), F.lit("not a JSON record")).otherwise(F.coalesce(*problems))
    return variant.select(
        F.coalesce(F.try_variant_get("v", "$.request_id", "string"), F.lit("UNKNOWN")).alias("request_id"),
        F.coalesce(F.try_variant_get("v", "$.timestamp", "long"), F.col(ingest_time)).alias("timestamp"),
        error.alias("error_message"),
        F.col(value).alias("raw_payload"),
        F.col(ingest_time).alias("failed_at"),
    )


def split_telemetry(messages: DataFrame, value: str = "value", ingest_time: str = "ingest_time"):
    """(valid records, dead letters) of one telemetry stream."""
    checked = check_telemetry(messages, value, ingest_time)
    valid = checked.filter(F.col("error_message").isNull()).select("request_id", "timestamp", "raw_payload")
    dead = checked.filter(F.col("error_message").isNotNull()).select(
        "request_id", "error_message", "failed_at", "raw_payload"
    )
    return valid, dead


def decode_alerts(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(alerts, undecoded messages) of both engines from JSON bytes or text.

    A leading zero byte marks the binary wire format, which needs ``from_avro`` and
    its package (see the readers). Nothing is dropped: every message is either an alert or an
    undecoded row with all its columns and the reason in ``error``.
    """
    text = F.coalesce(F.col(value).cast("string"), F.lit(""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = evaluated_once(messages, "a", F.from_json(text, schemas.ALERT_JSON, options))
    error = F.when(text.startswith("\x00"), F.lit("binary wire format")).when(
        F.col("a").isNull() | F.col("a._corrupt").isNotNull(), F.lit("not a JSON record")
    )
    bad = parsed.withColumn("error", error).filter(F.col("error").isNotNull()).drop("a")
    good = parsed.filter(error.isNull())
    names = [f.name for f in schemas.ALERT_JSON.fields if f.name != "_corrupt"]
    kept = [c for c in messages.columns if c != value]
    return good.select(*kept, *[F.col(f"a.{n}") for n in names]), bad
