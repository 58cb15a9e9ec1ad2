"""Reversible line dedup: cuckoo filters by shard over exact reference-count tables.

The index keeps the exact truth as tables: which document holds which line key (postings), and per key
the number of its documents. Per shard of keys a cuckoo filter says which keys exist. A new batch
is first grouped by key (a line in any number of documents is one row from there on); the
filters screen these keys; only those that may exist are joined to the reference counts. Deleting
documents takes their postings out and deletes from the filters the keys nobody holds any more, so later
inserts see the corpus as if the documents had never been there.

Keys are 128-bit digests of a line without the white space at its ends, A-Z in lower case.

Defined cases: a null text is one empty line; short keys never count; rows that repeat a doc_id
are one document as a holder and each its own row in the result; rows with a null doc_id are one document
that comes after all others; an empty batch changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, stored, table, text_bytes, text_digest
from riskloom.llm.cuckoo import CuckooFilter, Full

LEAST_KEY = 10
KEYS_PER_SHARD = 4096
KEY = ["k1", "k2"]
NO_ID = 2**63 - 1  # stands for a null doc_id


def line_key(line: bytes, least: int = LEAST_KEY) -> bytes | None:
    """Digest of a line's key, or None where the key is too short to count."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def postings(docs: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """k1, k2, doc, digest (of the row's text): each key once for each row that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            keys, sizes = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                found = {line_key(line, least) for line in raw[a:b].split(b"\n")}
                found.discard(None)
                keys.extend(found)
                sizes.append(len(found))
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                {
                    "k1": pa.array(pair[:, 0].copy(), pa.int64()),
                    "k2": pa.array(pair[:, 1].copy(), pa.int64()),
                    "doc": batch.column("doc").take(owner),
                    "digest": batch.column("digest").take(owner),
                }
            )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text", text_digest().alias("digest"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc long, digest long")


def key_counts(rows: DataFrame) -> DataFrame:
    """Reference counts of postings: per key the rows that hold it, the first and the last document."""
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("holders"), F.min("doc").alias("first"), F.max("doc").alias("last")
    )


@dataclass
class LineIndex:
    postings: list[DataFrame]  # stored parts
    counts: DataFrame  # stored, one row per key
    filters: DataFrame  # stored: shard, buckets, marks
    shards: int


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select(*KEY, F.pmod("k2", F.lit(shards)).cast("int").alias("shard"))


def _row(shard: int, held: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame([(shard, held.buckets, held.tobytes())], columns=["shard", "buckets", "marks"])


FILTER_ROW = "shard int, buckets int, marks binary"


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    def make(part: pd.DataFrame) -> pd.DataFrame:
        return _row(part["shard"].iloc[0], CuckooFilter.of(part["k1"].to_numpy()))

    return _sharded(counts, shards).groupBy("shard").applyInPandas(make, FILTER_ROW)


def create(docs_postings: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
    """Index of a first batch of stored postings."""
    counts = stored(key_counts(docs_postings), "line-counts")
    shards = max(1, math.ceil(counts.count() / keys_per_shard))
    return LineIndex([docs_postings], counts, stored(_filters(counts, shards), "line-filters"), shards)


def screen(index: LineIndex, keys: DataFrame) -> DataFrame:
    """The keys that the filters let pass; all others are new for certain."""

    def probe(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if part.empty or found.empty:
            return part.loc[[], KEY]
        held = CuckooFilter(int(found["buckets"].iloc[0]), bytes(found["marks"].iloc[0]))
        return part.loc[held.contains(part["k1"].to_numpy()), KEY]

    grouped = _sharded(keys, index.shards).groupBy("shard")
    return grouped.cogroup(index.filters.groupBy("shard")).applyInPandas(probe, "k1 long, k2 long")


def known_keys(index: LineIndex, batch_counts: DataFrame) -> DataFrame:
    """Keys of a batch that the index has too, with both counts put together."""
    theirs = index.counts.withColumnsRenamed({"holders": "h0", "first": "f0", "last": "l0"})
    return (
        screen(index, batch_counts)
        .join(theirs, KEY)
        .join(batch_counts, KEY)
        .select(
            *KEY,
            (F.col("h0") + F.col("holders")).alias("holders"),
            F.least("f0", "first").alias("first"),
            F.greatest("l0", "last").alias("last"),
        )
    )


def insert(index: LineIndex, batch: DataFrame) -> LineIndex:
    """Add stored postings of documents that are not in the index yet."""
    batch_counts = stored(key_counts(batch), "line-counts")
    known = stored(known_keys(index, batch_counts), "line-known")
    fresh = stored(batch_counts.join(known, KEY, "left_anti"), "line-fresh")
    counts = index.counts.join(known, KEY, "left_anti").unionByName(known).unionByName(fresh)

    def grow(shard: tuple, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return _row(shard[0], CuckooFilter.of(new["k1"].to_numpy()))
        grown = CuckooFilter(int(held["buckets"].iloc[0]), bytes(held["marks"].iloc[0]))
        try:
            grown.insert(new["k1"].to_numpy())
        except Full:
            return pd.DataFrame([(shard[0], 0, b"")], columns=["shard", "buckets", "marks"])
        return _row(shard[0], grown)

    counts = stored(counts, "line-counts")
    fresh_by = _sharded(fresh, index.shards).groupBy("shard")
    filters = stored(index.filters.groupBy("shard").cogroup(fresh_by).applyInPandas(grow, FILTER_ROW), "line-filters")
    return LineIndex([*index.postings, batch], counts, _refilled(filters, counts, index.shards), index.shards)


def _refilled(filters: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """Filters that ran full are built anew from the exact keys of their shards."""
    full = filters.filter("buckets = 0").select("shard")
    if full.isEmpty():
        return filters
    keys = counts.withColumn("shard", F.pmod("k2", F.lit(shards)).cast("int")).join(full, "shard", "left_semi")
    return stored(filters.filter("buckets > 0").unionByName(_filters(keys, shards)), "line-filters")


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """Take the documents ``ids`` (doc_id) out again, with all they held."""
    ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
    everything = reduce(DataFrame.unionByName, index.postings)
    gone = stored(everything.join(ids, "doc", "left_semi").select(*KEY).distinct(), "line-gone")
    left = stored(everything.join(ids, "doc", "left_anti"), "line-postings")
    recounted = stored(key_counts(left.join(gone, KEY, "left_semi")), "line-counts")
    counts = stored(index.counts.join(gone, KEY, "left_anti").unionByName(recounted), "line-counts")
    dead = gone.join(recounted, KEY, "left_anti")

    def shrink(held: pd.DataFrame, dropped: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return held
        left_over = CuckooFilter(int(held["buckets"].iloc[0]), bytes(held["marks"].iloc[0]))
        left_over.delete(dropped["k1"].to_numpy())
        return _row(held["shard"].iloc[0], left_over)

    dead_by = _sharded(dead, index.shards).groupBy("shard")
    filters = stored(index.filters.groupBy("shard").cogroup(dead_by).applyInPandas(shrink, FILTER_ROW), "line-filters")
    return LineIndex([left], counts, filters, index.shards)


def repeated(index: LineIndex) -> DataFrame:
    """Keys held by at least two documents, and the first of these."""
    return index.counts.filter("first < last").select(*KEY, "first")


def apply_drops(docs: DataFrame, index: LineIndex, least: int = LEAST_KEY) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of ``docs``, all of them in the index."""
    spare = stored(repeated(index), "line-repeated")
    # A line may be in a third of all documents: the rows are slim, and both sides are dealt
    # out anew here, so adaptive execution can split such a key.
    parts = [p.join(spare, KEY).filter("doc > first").select("doc", "digest", *KEY) for p in index.postings]
    # By row and not by document: any number of rows may have no id or the same one, and a list is
    # no longer than the lines of one text.
    drops = reduce(DataFrame.unionByName, parts).distinct().groupBy("doc", "digest")
    drops = stored(drops.agg(F.collect_list("k1").alias("d1"), F.collect_list("k2").alias("d2")), "line-drops")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("digest"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            lines, dropped, kept = [], [], []
            for a, b, d1, d2 in zip(at[:-1], at[1:], batch.column("d1"), batch.column("d2"), strict=True):
                own = raw[a:b].split(b"\n")
                lines.append(len(own))
                if d1.is_valid:
                    gone = np.stack([d1.values.to_numpy(), d2.values.to_numpy()], 1).astype("<i8").tobytes()
                    gone = {gone[k : k + 16] for k in range(0, len(gone), 16)}
                    own = [line for line in own if line_key(line, least) not in gone]
                dropped.append(lines[-1] - len(own))
                kept.append(b"\n".join(own))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_lines": pa.array(lines, pa.int64()),
                    "n_dropped": pa.array(dropped, pa.int64()),
                    "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    # Shuffled at every size: the lines to drop grow with the table, so they are never broadcast.
    joined = rows.join(drops.hint("shuffle_hash"), ["doc", "digest"], "left").select("doc_id", "text", "d1", "d2")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def line_dedup(docs: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """A whole table, inserted as two batches by doc_id, and its lines after dropping."""
    small_batches(docs.sparkSession)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else low + (high - low) // 2
    rows = stored(postings(docs, least), "line-postings")
    index = create(rows.filter(F.col("doc") <= middle))
    index = insert(index, rows.filter(F.col("doc") > middle))
    return apply_drops(docs, index, least)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an earlier document has too."""
    made = line_dedup(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = {
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, doc, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc,
               string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc) >= 2),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc > first, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
QUERIES = {"op8_line_dedup": op8_line_dedup}
