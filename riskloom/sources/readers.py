"""Batch and streaming inputs. The connector formats are used where their package is present."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.normalize import rename_topic

# Topics of the primary engine's sources.
EVENT_TOPICS = ("banking.transactions", "banking.login_events", "banking.sessions", "api_requests")
ACCOUNT_TOPIC = "banking.accounts"


def kafka_messages(
    spark: SparkSession, servers: str, topics: Sequence[str] = EVENT_TOPICS, max_per_trigger: int | None = None, **options: str
) -> DataFrame:
    """Messages of several topics as (topic, value, ingest_time); needs the Kafka package.

    ``max_per_trigger`` bounds a micro-batch whatever one topic's backlog is.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(
        rename_topic(F.col("topic")).alias("topic"),
        F.col("value").cast("string").alias("value"),
        F.unix_millis("timestamp").alias("ingest_time"),
    )


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def json_messages(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Newline-delimited message files of one topic, unparsed."""
    return spark.read.text(path).select(
        F.lit(topic).alias("topic"), "value", F.unix_millis(F.col("_metadata.file_modification_time")).alias("ingest_time")
    )


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric key; filters are pushed down."""
    bounds = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **bounds, **options).load()


def decode_avro(value: Column, schema_json: str, framed: bool = True) -> Column:
    """Avro bytes to a struct, skipping the five framing bytes; needs the Avro package.

    An undecodable record becomes null and is filtered like a malformed one.
    """
    from pyspark.sql.avro.functions import from_avro

    body = F.substring(value, 6, 2_147_483_647) if framed else value
    return from_avro(body, schema_json, {"mode": "PERMISSIVE"})
