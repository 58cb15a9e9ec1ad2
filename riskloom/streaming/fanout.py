"""One stream, several sinks that become visible together.

Every micro-batch is worked out once and written to each sink under its own number; a marker, written last, makes
all of them visible. A micro-batch that is run again writes the same folders again, or nothing if its marker is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

MARKS, NUMBER = "marks", "sink_epoch"
# From a micro-batch, and the time up to which stateful operators dropped its rows, to the rows of one sink.
Sink = Callable[[DataFrame, int | None], DataFrame]


def _mark(spark: SparkSession, path: str, epoch: int):
    """(largest time up to this micro-batch, the same one micro-batch earlier); None without a finished marker."""
    try:
        return spark.read.schema("high long, before long").parquet(f"{path}/{MARKS}/{NUMBER}={epoch}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def start_fan_out(
    rows: DataFrame, time: str, sinks: dict[str, Sink], path: str, checkpoint: str, delay: int, interval: str | None = None
) -> StreamingQuery:
    """Write ``rows`` to every sink. ``path`` and ``checkpoint`` belong together.

    ``time`` is epoch milliseconds and may be null; ``delay`` is that of the stateful operators in the plan. They
    drop what is at or behind the watermark of the micro-batch before, that is, of the rows two and more back.
    Without ``interval`` the stream stops when everything available is written.
    """
    if MARKS in sinks:
        raise ValueError(f"a sink cannot be called {MARKS}")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if _mark(spark, path, epoch) is not None:
            return
        last = _mark(spark, path, epoch - 1)
        high, before = (None, None) if last is None else last
        passed = None if before is None else before - delay
        # Worked out once for all sinks; a lost block is worked out again from the state before the micro-batch.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            own = batch.agg(F.max(time)).first()[0]
            for name, sink in sinks.items():
                sink(batch, passed).write.mode("overwrite").parquet(f"{path}/{name}/{NUMBER}={epoch}")
        finally:
            batch.unpersist()
        tops = [v for v in (high, own) if v is not None]
        mark = spark.range(1).select(
            F.lit(max(tops, default=None)).cast("long").alias("high"), F.lit(high).cast("long").alias("before")
        )
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MARKS}/{NUMBER}={epoch}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_sink(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a sink, of finished micro-batches only."""
    marks = spark.read.schema(f"high long, before long, {NUMBER} long").parquet(f"{path}/{MARKS}")
    rows = spark.read.parquet(f"{path}/{name}")
    schema = T.StructType([f for f in rows.schema.fields if f.name != NUMBER] + [T.StructField(NUMBER, T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    return rows.join(marks.select(NUMBER), NUMBER, "left_semi").drop(NUMBER)
