"""Best-fit packing with large-item matching.

Documents become token ids and pieces of at most the capacity. Packing needs only how many pieces
there are of each length: a histogram no longer than the capacity, whatever the table. On it, pieces
above one third of the capacity are matched greedily, at most two to a bin, each largest piece with
the largest partner that fits; smaller pieces, from large to small, go to the smallest gap that
holds them. The outcome is a short list of runs: "ranks 0..n of length s lie in bins b.. at offset o". Each
piece then finds its rank among the pieces of its length, by a hashed bucket and a running count,
and reads its place from the runs.

Defined cases: a null text is the empty text (one piece, the end id); the piece that is shorter than
the capacity is the first one; equal rows are interchangeable and take different places; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import pretokens
from riskloom.llm.common import chunks, kept_in_worker, small_batches, stored, table, text_bytes, tokenizer_path

VOCABULARY, CAPACITY, END_ID = "byte_bpe_50k.json", 1024, 2
MEMO_WORDS, ENCODE_AT_ONCE = 1_000_000, 4096
BUCKET_ROWS = 1000


class Run(NamedTuple):
    """Pieces of one length, by rank: ``per_bin`` of them side by side in each of the bins."""

    size: int
    rank_from: int
    rank_to: int
    bin_from: int
    per_bin: int
    offset_from: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs for all pieces of ``histogram`` (length to number), and how many bins they take."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("piece lengths lie between 1 and the capacity")
    ranks: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap to (first bin, bins)
    runs: list[Run] = []
    bins = 0

    def place(size: int, count: int, first: int, per_bin: int, offset: int) -> None:
        runs.append(Run(size, ranks[size], ranks[size] + count, first, per_bin, offset))
        ranks[size] += count
        left[size] -= count

    def room(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps[gap].append((first, count))

    large = sorted((s for s in left if s > capacity // 3), reverse=True)
    for size in large:
        while left[size]:
            partner = next((t for t in large if t <= min(size, capacity - size) and left[t]), None)
            count = left[size] if partner is None else min(left[size], left[partner])
            if partner == size:
                count = left[size] // 2
                if count == 0:
                    partner, count = None, 1
            place(size, count, bins, 1, 0)
            if partner is not None:
                place(partner, count, bins, 1, size)
            room(capacity - size - (partner or 0), bins, count)
            bins += count
    for size in sorted((s for s in left if s <= capacity // 3), reverse=True):
        while left[size]:
            gap = min((g for g in gaps if g >= size and gaps[g]), default=None)
            if gap is None:
                gap = capacity
                gaps[gap].append((bins, -(-left[size] // (gap // size))))
                bins += gaps[gap][-1][1]
            first, count = gaps[gap].pop()
            per_bin = min(gap // size, left[size])
            used = min(count, left[size] // per_bin)
            place(size, used * per_bin, first, per_bin, capacity - gap)
            room(gap - per_bin * size, first, used)
            room(gap, first + used, count - used)
    return runs, bins


class Encoder:
    """Ids of whole texts by the tokenizer library; each distinct pre-token is encoded once."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.memo_words = Tokenizer.from_file(path), memo_words
        self._forget()

    def _forget(self) -> None:
        self.index = pretokens.WordIndex()
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _made(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of words end to end, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], []
        for k in range(0, len(words), ENCODE_AT_ONCE):
            texts = [w.decode("utf-8", "replace") for w in words[k : k + ENCODE_AT_ONCE]]
            made = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            sizes += map(len, made)
            ids.append(np.fromiter((x for own in made for x in own), np.uint32))
        return np.concatenate(ids), sizes

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self._made(words)
        self.index.add(hashes, words)
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(sizes)]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin."""
        if len(self.at) > self.memo_words:
            self._forget()
        spans = pretokens.pretokenize(offsets, data, pretokens.SPACED)
        hashes, flat = spans.hashes(), np.frombuffer(spans.data, np.uint8)
        where = self.index.find(flat, spans.starts, spans.ends, hashes)
        new, at = np.unique(hashes[where == -1], return_index=True)
        if len(new):
            self._learn(new, spans.words(np.flatnonzero(where == -1)[at]))
            left = np.flatnonzero(where == -1)
            where[left] = self.index.find(flat, spans.starts[left], spans.ends[left], hashes[left])
        source, first, size = self.ids, self.at[where], self.at[where + 1] - self.at[where]
        clash = np.flatnonzero(where < 0)
        if len(clash):
            own, sizes = self._made(spans.words(clash))
            first[clash], size[clash] = len(source) + np.cumsum(sizes) - sizes, sizes
            source = np.concatenate([source, own])
        total = np.r_[0, np.cumsum(size)]
        ids = source[np.arange(total[-1]) + np.repeat(first - total[:-1], size)]
        return ids, total[spans.first]


def encoder(path: str) -> Encoder:
    return kept_in_worker(f"encoder {path}", lambda: Encoder(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            owner, rows, row = [], [], 0
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                ids, at = make.encode(part - part[0], data[part[0] : part[-1]])
                ids, bounds = ids.astype("<u4"), at.tolist()
                for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                    whole = np.concatenate([ids[x:y], end])
                    cuts = [0, *range(len(whole) % capacity or min(capacity, len(whole)), len(whole) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        owner.append(row)
                        rows.append((k, i, j - i, zlib.crc32(whole[i:j])))
                    row += 1
            columns = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    "piece": pa.array(columns[:, 0].astype(np.int32)),
                    "start": pa.array(columns[:, 1]),
                    "length": pa.array(columns[:, 2]),
                    "ids_crc32": pa.array(columns[:, 3]),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, histogram: dict[int, int], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds each piece's rank among the pieces of its length.

    A length that many pieces share is spread over buckets, about as many as there are rows in
    one, so that neither a bucket nor the running count over buckets gets large.
    """
    if not histogram:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    buckets = {s: math.ceil(n / max(bucket_rows, math.isqrt(n))) for s, n in histogram.items()}
    spread = F.element_at(F.map_from_arrays(F.lit(list(buckets)), F.lit(list(buckets.values()))), F.col("length").cast("int"))
    shape = ["doc_id", "piece", "start", "ids_crc32"]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*shape), spread.cast("long")))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*shape))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    before = sizes.select("length", "bucket", upto.alias("before"))
    placed = rows.withColumn("inside", inside).join(before, ["length", "bucket"])
    return placed.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("bucket", "inside", "before")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All pieces of ``docs`` with sequence_id and offset, in few sequences of at most ``capacity`` ids."""
    spark = small_batches(docs.sparkSession)
    rows = stored(pieces(docs, path, capacity, end_id), "pieces")
    # At most one row per length up to the capacity reaches the driver.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    fields = "size long, rank_from long, rank_to long, bin_from long, per_bin long, offset_from long"
    # The runs follow from the lengths up to the capacity, not from the number of rows.
    listed = F.broadcast(spark.createDataFrame(runs, fields))
    step = F.col("rank") - F.col("rank_from")
    here = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return (
        ranked(rows, histogram)
        .join(listed, here)
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("bin_from") + F.floor(step / F.col("per_bin"))).cast("long").alias("sequence_id"),
            (F.col("offset_from") + F.pmod(step, F.col("per_bin")) * F.col("length")).alias("offset"),
        )
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
