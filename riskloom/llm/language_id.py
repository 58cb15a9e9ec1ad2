"""Language identification by prediction by partial matching.

For each language a byte context tree is learned from a bounded sample of labelled texts: at most
``SAMPLE_ROWS`` rows a language, whole texts, chosen by hash. Counts are summed by Spark; the trees
are frozen and every whole text is coded under each. The language of the shortest code wins; its score
is its posterior under equal priors. Language names, sources and ids are no input of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is everything
when nothing can be learned; equal code lengths go to the first name; rows with a null doc_id are
never learned from and count as held out; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import ppm
from riskloom.llm.common import chunks, received, sent, small_batches, table, text_bytes

ORDER = 4  # symbols of context
SAMPLE_ROWS = 400  # rows of each language a tree is learned from
RARE_FROM, RARE_COUNT = 4, 2  # grams of this length or more are left out below this total count
UNKNOWN = "und"
REJECT_BITS = 6.5  # a byte; about what bytes without any order cost
SPARE_BITS = 512  # on top, for a name, number or key in a short text
FOLDS, HELD_OUT = 3, 1


def held_out() -> Column:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def learning_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows of each language, smallest hash of the id first."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("doc_id", "lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("draw"))
    # One number per language; a hash threshold keeps about twice the rows wanted, ranking cuts the rest.
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * rows + 50) / F.col("n")) * float(2**63)
    drawn = usable.join(F.broadcast(counts.select("lang", share.alias("upto"))), "lang").filter("draw < upto")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= rows).select("lang", "text")


def learn(docs: DataFrame, order: int = ORDER, rows: int = SAMPLE_ROWS) -> tuple[list[str], ppm.Model | None]:
    """Languages and frozen model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            seen: dict[tuple[str, int], list] = {}
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                for n, made in enumerate(ppm.gram_counts(data[offsets[k] : offsets[k + 1]], order + 1), 1):
                    seen.setdefault((lang, n), []).append(made)
            for (lang, n), parts in seen.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([m for _, m in parts])).astype(np.int64)
                size = len(codes)
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang] * size, pa.string()),
                        "n": pa.array(np.full(size, n, np.int32)),
                        "code": pa.array(codes, pa.int64()),
                        "m": pa.array(sums, pa.int64()),
                    }
                )

    counted = learning_sample(docs, rows).mapInArrow(count, "lang string, n int, code long, m long")
    by_lang = counted.groupBy("n", "code", "lang").agg(F.sum("m").alias("m"))
    # The sample is bounded, and so is what its texts contain.
    frame = by_lang.toPandas()
    if frame.empty:
        return [], None
    langs = sorted(frame["lang"].unique())
    column = frame["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()
    grams = []
    for n in range(1, order + 2):
        rows_n = (frame["n"] == n).to_numpy()
        codes, at = np.unique(frame["code"].to_numpy()[rows_n], return_inverse=True)
        counts = np.zeros((len(codes), len(langs)))
        np.add.at(counts, (at, column[rows_n]), frame["m"].to_numpy()[rows_n])
        kept = counts.sum(1) >= (RARE_COUNT if n >= RARE_FROM else 1)
        grams.append((codes[kept], counts[kept]))
    return langs, ppm.fit(grams)


def predict(docs: DataFrame, langs: list[str], model: ppm.Model | None) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte (of the best language) of every row."""
    spark = small_batches(docs.sparkSession)
    shared = sent(spark, (langs, model))  # bounded by the sample it was learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, frozen = received(shared)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            size = np.diff(offsets)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if frozen is None:
                best, score, rate = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size))
                letters = np.zeros(len(size), bool)
            else:
                bits = [np.zeros((0, len(names)))]
                for a, b in chunks(offsets):
                    part = offsets[a : b + 1]
                    bits.append(frozen.bits(part - part[0], data[part[0] : part[-1]]))
                bits = np.concatenate(bits)
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                rate = low / np.maximum(size, 1)
            pred = np.array([*names, UNKNOWN], object)[np.where(letters, best, len(names))]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(pred, pa.string()),
                    "score": pa.array(np.where(letters, score, 0.0)),
                    "bits_per_byte": pa.array(np.where(letters, rate, 0.0)),
                }
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_known_languages(docs: DataFrame, most_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: texts without a letter go, and
    texts that the best tree codes no better than disorder, some such words allowed. Where nothing can be learned, all rows with a letter stay."""
    spark = small_batches(docs.sparkSession)
    langs, model = learn(docs)
    letters = docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return letters
    shared = sent(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = received(shared)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            bits = [np.zeros(0)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                bits.append(frozen.bits(part - part[0], data[part[0] : part[-1]]).min(1))
            yield batch.filter(pa.array(np.concatenate(bits) <= most_bits * np.diff(offsets) + SPARE_BITS))

    return letters.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, whole texts."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *learn(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
