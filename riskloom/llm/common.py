"""Small helpers the training-data operators share."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
WHITE = r"[\x20\x09-\x0D]"
BATCH_ROWS = 1000
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Rows handed to Python at a time: some texts are very long, so 10 000 of them are too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, and
    lets a later join deal out both sides anew, so that adaptive execution can split hot keys."""
    spark = df.sparkSession
    home = f"{checkpoint_dir(spark)}/riskloom-{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast a small object together with its classes, so that workers need not have the library."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> Any:
    return cloudpickle.loads(shared.value)


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps from task to task."""
    held = vars(sys.modules.setdefault("_riskloom_kept", types.ModuleType("_riskloom_kept")))
    if name not in held:
        held[name] = make()
    return held[name]


def tokenizer_path(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer text."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each size, end to end."""
    last = np.cumsum(size)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(first - last + size, size)


def spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each."""
    size = np.diff(offsets)
    out = np.full(len(data) + len(size), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(size) + 1), size)] = data
    return offsets + np.arange(len(offsets)), out


def text_digest() -> Column:
    """64 bits of a row's text; with doc_id the key by which decisions find their rows again."""
    return F.xxhash64("text")


def _row_key(doc_id: Column, digest: Column) -> Column:
    """Never null, so that rows without an id are dealt out by their text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), digest.cast("string"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose id and text are listed in ``gone`` (doc_id, digest)."""
    # Shuffled at every size: what goes grows with the table.
    gone = gone.select(_row_key(F.col("doc_id"), F.col("digest")).alias("__key")).distinct().hint("shuffle_hash")
    rows = docs.withColumn("__key", _row_key(F.col("doc_id"), text_digest()))
    return rows.join(gone, "__key", "left_anti").select(*docs.columns)
