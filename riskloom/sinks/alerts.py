"""Alert encoding, routing and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity -> topic.
SEVERITY_TOPIC = {"FRAUD": "fraud_alerts_v2", "CRITICAL": "critical_alerts_v2"}
SECONDARY_TOPIC = {"FRAUD": "fraud_alerts", "CRITICAL": "critical_alerts"}

# The wire record, in order.
WIRE_FIELDS = (
    "alert_id",
    "customer_id",
    "account_id",
    "event_time",
    "severity",
    "cumulative_score",
    "threshold",
    "contributing_indicators",
    "trigger_reason",
    "first_seen_ts",
    "latest_seen_ts",
    "source_event_ids",
    "action_required",
)


def route(alerts: DataFrame, topics: dict[str, str] | None = None) -> DataFrame:
    """Add ``topic`` by severity."""
    lookup = F.create_map(*[F.lit(x) for pair in (topics or SEVERITY_TOPIC).items() for x in pair])
    return alerts.withColumn("topic", F.element_at(lookup, F.col("severity")))


def wire_struct(alerts: DataFrame) -> Column:
    return F.struct(*WIRE_FIELDS, *(["engine_source"] if "engine_source" in alerts.columns else []))


def encode_json(alerts: DataFrame, topics: dict[str, str] | None = None) -> DataFrame:
    """(topic, key, value) messages; the key keeps an identity's alerts in order."""
    routed = route(alerts, topics)
    value = F.to_json(wire_struct(alerts), {"ignoreNullFields": "false"})
    return routed.select("topic", F.col("identity_key").alias("key"), value.alias("value"))


def encode_avro(alerts: DataFrame, schema_json: str, topics: dict[str, str] | None = None) -> DataFrame:
    """Same with an Avro body; needs the Avro package."""
    from pyspark.sql.avro.functions import to_avro

    routed = route(alerts, topics)
    return routed.select("topic", F.col("identity_key").alias("key"), to_avro(wire_struct(alerts), schema_json).alias("value"))


def write_by_severity(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """One pass over the alerts, one folder per severity."""
    alerts.write.mode(mode).partitionBy("severity").parquet(path)


def write_epoch(alerts: DataFrame, path: str, epoch: int) -> None:
    """Sink for ``foreachBatch``: a retried micro-batch overwrites its own folder only."""
    alerts.write.mode("overwrite").partitionBy("severity").parquet(f"{path}/epoch={epoch}")


def read_alerts(spark, path: str) -> DataFrame:
    """Alerts written by :func:`write_epoch`, one row per identity and alert id."""
    return spark.read.parquet(path).dropDuplicates(["identity_key", "alert_id"])


def kafka_writer(messages: DataFrame, servers: str, checkpoint: str):
    """Streaming writer for encoded messages; needs the Kafka package."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


def console_writer(df: DataFrame):
    """Debug print of any stream."""
    return df.writeStream.format("console").option("truncate", "false")
