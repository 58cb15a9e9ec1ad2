"""Typed documents per index, kept as partitioned tables with upsert by business key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import evaluated_once
from riskloom.schemas import INDEX_MAPPINGS


def geo_point(latitude: Column, longitude: Column) -> Column:
    """``{lat, lon}`` only where both coordinates are there."""
    return F.when(
        latitude.isNotNull() & longitude.isNotNull(), F.struct(latitude.alias("lat"), longitude.alias("lon"))
    )


def _wire(kind: str) -> T.DataType:
    if kind == "timestamp":
        return T.LongType()
    return T._parse_datatype_string(kind)


def index_documents(messages: DataFrame, index: str, value: str = "value") -> DataFrame:
    """Change messages or plain records to documents of one index.

    Deletes are skipped. The envelope's own time replaces the row's column,
    which is in microseconds; times are stored as timestamps.
    """
    _, mapping = INDEX_MAPPINGS[index]
    body = T.StructType([T.StructField(n, _wire(k)) for n, k in mapping.items()])
    schema = T.StructType(
        [
            *body.fields,
            T.StructField("after", body),
            T.StructField("op", T.StringType()),
            T.StructField("ts_ms", T.LongType()),
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    m = evaluated_once(messages.select(value), "m", F.from_json(value, schema, options))
    live = m.filter(
        F.col("m").isNotNull() & F.col("m._corrupt").isNull() & (F.coalesce("m.op", F.lit("")) != "d")
    )
    wrapped = F.col("m.after").isNotNull()
    row = live.select(
        F.when(wrapped, F.col("m.after")).otherwise(F.struct(*[F.col(f"m.{n}") for n in mapping])).alias("d"),
        F.when(wrapped, F.col("m.ts_ms")).alias("ts_ms"),
    )

    def field(name: str, kind: str) -> Column:
        stored = F.col(f"d.{name}")
        if name == "timestamp":
            stored = F.coalesce("ts_ms", stored)
        return (F.timestamp_millis(stored) if kind == "timestamp" else stored).alias(name)

    docs = row.select(*[field(n, k) for n, k in mapping.items()])
    if "latitude" in mapping:
        docs = docs.withColumn("geo_location", geo_point(F.col("latitude"), F.col("longitude")))
    return docs


def latest_documents(docs: DataFrame, index: str) -> DataFrame:
    """One document per business key, the newest; combines map-side."""
    key, mapping = INDEX_MAPPINGS[index]
    time = next(n for n, k in mapping.items() if k == "timestamp")
    row = F.struct(*docs.columns)
    return docs.groupBy(key).agg(F.max_by(row, F.col(time)).alias("d")).select("d.*")


def append_documents(docs: DataFrame, index: str, path: str, epoch: int | None = None) -> None:
    """Write documents under ``path/index``, split by day.

    The table is a log of versions; :func:`read_documents` resolves them by
    business key. A repeated micro-batch overwrites its own folder, so retries
    change nothing.
    """
    _, mapping = INDEX_MAPPINGS[index]
    time = next(n for n, k in mapping.items() if k == "timestamp")
    target = f"{path}/{index}" + (f"/epoch={epoch}" if epoch is not None else "")
    mode = "append" if epoch is None else "overwrite"
    docs.withColumn("day", F.to_date(time)).write.mode(mode).partitionBy("day").parquet(target)


def read_documents(spark, index: str, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/{index}")
    return latest_documents(stored.drop("day", "epoch"), index)
