"""Exact dedup of incoming batches against immutable snapshots.

A snapshot holds one row per text (its digest, the smallest doc_id, the number of copies) and,
per shard of digests, a static binary-fuse filter. The digests of a new batch are first grouped
among themselves, so a text with any number of copies is one row from there on. The filters then
screen these rows: what they refuse is new for certain; what they let pass is joined to the
exact buckets of the snapshot and compared byte by byte. Snapshots never change: a batch and
a snapshot make the next one.

Defined cases: a null text is the empty text; texts are equal when identical after each run of
white space is one space; null ids come last, and where all ids of a group are null, keep_id is
null and all its rows count as kept; rows that repeat a doc_id and its text are one document and
share their decision; an empty batch or snapshot gives empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import fuse
from riskloom.llm.common import WHITE, small_batches, stored, table

KEYS_PER_SHARD = 2048


@dataclass
class Snapshot:
    docs: DataFrame  # doc_id, text: where the bytes are
    groups: DataFrame  # text_sha256, keep_id, group_size
    filters: DataFrame  # shard and the filter of its digests
    shards: int


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def group_batch(digests: DataFrame) -> DataFrame:
    """One row per digest; copies collapse before the shuffle."""
    return digests.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("text_sha256")
    return groups.select("text_sha256", key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard"))


def build_snapshot(docs: DataFrame, groups: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> Snapshot:
    """Filters over stored ``groups`` (see ``group_batch``) of the texts in ``docs``."""
    shards = max(1, math.ceil(groups.count() / keys_per_shard))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        made = fuse.build(part["key"].to_numpy())
        return pd.DataFrame([(part["shard"].iloc[0], *made)], columns=["shard", *made._fields])

    filters = (
        _sharded(groups, shards)
        .select("key", "shard")
        .groupBy("shard")
        .applyInPandas(make, "shard int, seed long, segment int, segments int, slots binary")
    )
    return Snapshot(docs, groups, stored(filters, "fuse-filters"), shards)


def screen(snapshot: Snapshot, groups: DataFrame) -> DataFrame:
    """Digests of a grouped batch that the filters let pass; the others are new for certain."""

    def probe(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if part.empty or found.empty:
            return pd.DataFrame({"text_sha256": pd.Series([], dtype=str)})
        row = found.iloc[0]
        held = fuse.FuseFilter(int(row["seed"]), int(row["segment"]), int(row["segments"]), bytes(row["slots"]))
        return part.loc[held.contains(part["key"].to_numpy()), ["text_sha256"]]

    return (
        _sharded(groups, snapshot.shards)
        .groupBy("shard")
        .cogroup(snapshot.filters.groupBy("shard"))
        .applyInPandas(probe, "text_sha256 string")
    )


def known_texts(snapshot: Snapshot, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of a batch whose text the snapshot has, byte for byte: digest and the snapshot's group.

    Only digests that pass the filters reach the exact buckets, and only one text of each
    side is fetched for the comparison.
    """
    pairs = stored(
        screen(snapshot, groups)
        .join(groups.withColumnsRenamed({"keep_id": "own_id", "group_size": "own_size"}), "text_sha256")
        .join(snapshot.groups, "text_sha256"),
        "fuse-positives",
    )

    def texts(rows: DataFrame, id_column: str, name: str) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(id_column), normalized(F.col("text")).alias(name))
        # Shuffled at every size: what is wanted grows with the table, so it is never broadcast.
        wanted = pairs.select("text_sha256", F.col(id_column).alias("wanted")).hint("shuffle_hash")
        return (
            rows.withColumn("sha", F.sha2(F.col(name).cast("binary"), 256))
            .join(wanted, (F.col("sha") == F.col("text_sha256")) & F.col(id_column).eqNullSafe(F.col("wanted")))
            .groupBy("text_sha256")
            .agg(F.first(name).alias(name))
        )

    same = (
        texts(docs, "own_id", "own_text")
        .join(texts(snapshot.docs, "keep_id", "kept_text"), "text_sha256")
        .filter(F.col("own_text") == F.col("kept_text"))
        .select("text_sha256")
    )
    return pairs.join(same, "text_sha256", "left_semi")


def dedup_batch(snapshot: Snapshot, docs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final groups of the batch and of the snapshot after it, each keyed by digest."""
    known = stored(known_texts(snapshot, docs, groups), "fuse-known")
    keep, size = F.least("keep_id", "own_id"), F.col("group_size") + F.col("own_size")
    merged = known.select("text_sha256", keep.alias("all_keep"), size.alias("all_size"))

    def after(side: DataFrame) -> DataFrame:
        return side.join(merged, "text_sha256", "left").select(
            "text_sha256",
            F.coalesce("all_keep", "keep_id").alias("keep_id"),
            F.coalesce("all_size", "group_size").alias("group_size"),
        )

    return after(groups), after(snapshot.groups)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Decisions for a whole table, taken as a snapshot (lower half of the ids) and a batch.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of ``docs``.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else low + (high - low) // 2
    is_old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    digests = stored(docs.select("doc_id", is_old.alias("old"), digest(F.col("text")).alias("text_sha256")), "digests")
    old_groups = stored(group_batch(digests.filter("old")), "groups-old")
    new_groups = stored(group_batch(digests.filter("not old")), "groups-new")
    snapshot = build_snapshot(docs.filter(is_old), old_groups)
    new_final, old_final = dedup_batch(snapshot, docs.filter(~is_old), new_groups)
    groups = stored(
        new_final.withColumn("old", F.lit(False)).unionByName(old_final.withColumn("old", F.lit(True))), "groups"
    )
    # A group may hold a third of all rows: both sides are dealt out anew here, so that
    # adaptive execution can split such a key; the rows are slim.
    return digests.join(groups, ["text_sha256", "old"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, all columns. Rows that repeat doc_id and text stay once."""

    def key(sha: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), sha)

    kept = exact_dedup(docs).filter("kept").select(key(F.col("text_sha256")).alias("__key"))
    kept = stored(kept.groupBy("__key").agg(F.count(F.lit(1)).alias("n")), "kept")
    rows = docs.withColumn("__key", key(digest(F.col("text"))))
    # Shuffled at every size: the rows that stay grow with the table.
    once = rows.join(kept.filter("n = 1").hint("shuffle_hash"), "__key", "left_semi")
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        once = once.unionByName(rows.join(repeated, "__key", "left_semi").dropDuplicates(["__key"]))
    return once.drop("__key")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents, whole texts."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
