"""Fill-in-the-middle transformation through a wavelet matrix over character classes.

Every code point of a batch gets a class (line end, sentence end, word end, white space, other), and
one wavelet matrix is built over all texts of the batch, end to end. A unit (line, sentence, word,
character) ends where one of its classes stands, so ranks, summed over these classes, count the
boundaries before any place, and bisection on the ranks finds the boundary of a given number: both
cuts of all texts are found at once. The two cuts, the form and whether a text is transformed at all
come from a digest of seed and id, so any run makes the same choice.

Defined cases: a null text is empty; empty texts, texts that hold a marker, and those that the rate leaves
out stay as they are (plain); the last unit of a text may have no boundary at its end; a null id
counts as the empty string in the digest; rows that repeat an id get the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, small_batches, table, text_bytes
from riskloom.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 7, 100, 50
OTHER, WHITE, LINE_END, WORD_END, SENTENCE_END = range(5)
LEVELS = 3
# What ends a unit. A word takes the white space before it, a sentence ends with its line at the latest.
UNITS = {
    "line": (LINE_END,),
    "sentence": (SENTENCE_END, LINE_END),
    "word": (WORD_END, SENTENCE_END),
    "char": (OTHER, WHITE, LINE_END, WORD_END, SENTENCE_END),
}


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that end at ``ends``."""
    white = (points == 0x20) | (points >= 0x09) & (points <= 0x0D)
    last = np.zeros(len(points) + 1, bool)
    last[ends] = True
    last = last[1:]  # the text ends behind this one
    after = np.ones(len(points), bool)
    after[:-1] = white[1:]
    word_end = ~white & (after | last)
    out = np.where(white, WHITE, np.where(word_end, WORD_END, OTHER)).astype(np.uint8)
    out[word_end & ((points == ord(".")) | (points == ord("!")) | (points == ord("?")))] = SENTENCE_END
    out[points == 0x0A] = LINE_END
    return out


class Cuts(NamedTuple):
    units: np.ndarray  # of each text
    first: np.ndarray  # code points of the prefix
    second: np.ndarray  # of prefix and middle


def cut(points: np.ndarray, bounds: np.ndarray, unit: str, one: np.ndarray, other: np.ndarray) -> Cuts:
    """Cuts of the texts [bounds[k], bounds[k + 1]) behind the smaller and the larger of two draws,
    each taken modulo the number of units plus one."""
    low, high = bounds[:-1], bounds[1:]
    matrix = WaveletMatrix(classes(points, high), LEVELS)
    ends = UNITS[unit]
    before = matrix.count(ends, low)
    inside = matrix.count(ends, high) - before
    # A last unit without its boundary: the last code point is in none of the classes.
    open_end = (high > low) & (matrix.count(ends, high) == matrix.count(ends, np.maximum(high - 1, low)))
    units = inside + open_end
    draws = np.sort(np.stack([one % (units + 1), other % (units + 1)]), axis=0)
    first, second = (np.where(d > 0, matrix.select(ends, before + d, low, high), low) - low for d in draws)
    return Cuts(units, first, second)


def transformed(text: str, form: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def draws(seed: int = SEED) -> list[Column]:
    """Four numbers from the digest of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """doc_id, n (units), form, first and second (code points before each cut, null if plain), output."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            h = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1] - offsets[a]
                raw = data[offsets[a] : offsets[b]]
                # Code points begin at bytes that continue none.
                begins = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                joined = raw.tobytes().decode("utf-8", "replace")
                points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
                bounds = begins[part]
                cuts = cut(points, bounds, unit, h[0][a:b], h[1][a:b])
                forms, outputs = [], []
                for k in range(b - a):
                    text = joined[bounds[k] : bounds[k + 1]]
                    held = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                    plain = not text or held or h[2][a + k] % 100 >= rate
                    forms.append("plain" if plain else "spm" if h[3][a + k] % 100 < spm_share else "psm")
                    outputs.append(transformed(text, forms[-1], int(cuts.first[k]), int(cuts.second[k])))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n": pa.array(cuts.units, pa.int64()),
                        "form": pa.array(forms, pa.string()),
                        "first": pa.array(cuts.first, pa.int64(), mask=plain),
                        "second": pa.array(cuts.second, pa.int64(), mask=plain),
                        "output": pa.array(outputs, pa.string()),
                    }
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, first long, second long, output string")


def restore(made: DataFrame) -> DataFrame:
    """``made`` (form and output) with the rebuilt text as a further column ``restored``."""
    head, middle = F.split_part("output", F.lit(MIDDLE), F.lit(1)), F.split_part("output", F.lit(MIDDLE), F.lit(2))
    psm = F.concat(F.substr(F.split_part(head, F.lit(SUFFIX), F.lit(1)), F.lit(len(PREFIX) + 1)), middle)
    psm = F.concat(psm, F.split_part(head, F.lit(SUFFIX), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(PREFIX), F.lit(2)), middle)
    spm = F.concat(spm, F.substr(F.split_part(head, F.lit(PREFIX), F.lit(1)), F.lit(len(SUFFIX) + 1)))
    rebuilt = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", psm).otherwise(spm)
    return made.withColumn("restored", rebuilt)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut between lines; digests of the output and of the text rebuilt from it."""
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("first").alias("prefix_chars"),
        (F.col("second") - F.col("first")).alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, h1 % (len(lines) + 1) AS x, h2 % (len(lines) + 1) AS y FROM u),
p AS (
  SELECT *, coalesce(array_to_string(lines[1:least(x, y)], ''), '') AS a,
         coalesce(array_to_string(lines[least(x, y) + 1:greatest(x, y)], ''), '') AS b,
         coalesce(array_to_string(lines[greatest(x, y) + 1:], ''), '') AS c,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
}
