"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words with TF-IDF weights over hashed words; document frequencies come from
all documents. A distributed randomised SVD of the benchmark's passages gives the latent space: Spark
sums, over all passages, what each power iteration needs, and only matrices of (hashed words) x
(rank) reach the driver. Document passages are folded in where they have as many words of the benchmark as
the check needs for its shortest item, and are searched by cosine against the benchmark's passages;
an item's passage that lies in a window counts whatever stands around it. Every candidate is then
checked on words: the longest common subsequence of the item and the text around the passage,
and, below the similarity that settles it, whether the item's answer is there as well.

Defined cases: items without words never match; a null text has no words; an empty benchmark or
table gives no rows; items that repeat in all columns are one item; rows that repeat a doc_id are
reported once per row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, received, sent, small_batches, stored, table, text_bytes, text_digest, without_rows
from riskloom.llm.pretokens import HashIndex
from riskloom.llm.words import Words, words_of

DIMENSION_BITS = 18  # hashed words
WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, POWER_ROUNDS = 128, 16, 2
LEAST_WEIGHT = 0.1  # of a hashed word, however many rows have it
LEAST_COSINE = 0.45  # or share of an item's passage that lies in the window
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8  # common subsequence alone; with the answer; words of the answer found
BLOCK_ITEMS = 20_000  # items searched in one scan of the documents


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end word of every passage, and its text; the last one ends with the text."""
    size = np.diff(first)
    number = np.where(size > WINDOW, 1 + -(-(size - WINDOW) // STRIDE), (size > 0).astype(np.int64))
    text = np.repeat(np.arange(len(size)), number)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = np.minimum(rank * STRIDE, np.maximum(size[text] - WINDOW, 0))
    return first[text] + start, first[text] + np.minimum(start + WINDOW, size[text]), text


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed word is found, over all rows; and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << DIMENSION_BITS, np.int64), 0
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            rows += len(offsets) - 1
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                found = words_of(part - part[0], data[part[0] : part[-1]])
                text = np.repeat(np.arange(b - a), np.diff(found.first))
                once = np.sort((text << DIMENSION_BITS) | features(found.hashes))
                once = once[np.r_[True, once[1:] != once[:-1]]] if len(once) else once
                seen += np.bincount(once & ((1 << DIMENSION_BITS) - 1), minlength=len(seen))
        some = np.flatnonzero(seen)
        columns = {"feature": np.r_[-1, some], "n": np.r_[rows, seen[some]]}
        yield pa.record_batch({k: pa.array(v.astype(np.int64)) for k, v in columns.items()})

    counted = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frame = counted.toPandas()  # a row per hashed word at most
    out = np.zeros(1 << DIMENSION_BITS, np.int64)
    words = frame[frame["feature"] >= 0]
    out[words["feature"].to_numpy()] = words["n"].to_numpy()
    return out, int(frame.loc[frame["feature"] < 0, "n"].sum())


class Space(NamedTuple):
    """Latent space: the row of each hashed word (-1 for none), and its direction times its weight."""

    row: np.ndarray
    directions: np.ndarray

    def project(self, feature: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and lengths of the passages [start, end), in order of their starts."""
        # Passages overlap: words are summed up once for every stretch between two borders.
        borders = np.unique(np.r_[start, end])
        row = self.row[feature[borders[0] : borders[-1]]]
        known = np.flatnonzero(row >= 0)
        row, place = row[known], np.searchsorted(known, borders - borders[0])
        sums = _summed(self.directions, row, place[:-1], place[1:])
        low, high = np.searchsorted(borders, start), np.searchsorted(borders, end)
        out = _summed(sums, np.arange(len(sums)), low, high)
        length = np.maximum(np.linalg.norm(out, axis=1), 1e-12)
        return out / length[:, None], length


def _summed(vectors: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of vectors[which[low:high]], a step for all ranges at a time."""
    out = np.zeros((len(low), vectors.shape[1]), np.float32)
    own = np.arange(len(low))
    for k in range(int((high - low).max())):
        own = own[low[own] + k < high[own]]
        out[own] += vectors[which[low[own] + k]]
    return out


def latent_space(items: DataFrame, df: np.ndarray, rows: int, rank: int = RANK) -> Space | None:
    """Randomised SVD of the TF-IDF matrix of the passages of ``items``, summed up by Spark."""
    spark = items.sparkSession
    weight = np.log((rows + 1) / (df + 1)).clip(min=LEAST_WEIGHT).astype(np.float32)
    weights = spark.sparkContext.broadcast(weight)

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, hashed word, weight) of one batch, passages of unit length."""
        found = words_of(*text_bytes(batch.column("text")))
        start, end, _ = windows(found.first)
        passage = np.repeat(np.arange(len(start)), end - start)
        word = np.arange(len(passage)) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
        feature = features(found.hashes)[np.repeat(start, end - start) + word]
        key, count = np.unique((passage << DIMENSION_BITS) | feature, return_counts=True)
        passage, feature = key >> DIMENSION_BITS, key & ((1 << DIMENSION_BITS) - 1)
        value = count * weights.value[feature].astype(np.float64)
        norm = np.sqrt(np.bincount(passage, value**2, minlength=len(start)))
        return passage, feature, value / np.maximum(norm[passage], 1e-12)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"feature": pa.array(np.unique(entries(batch)[1]), pa.int64())})

    texts = items.select("text")
    listed = texts.mapInArrow(present, "feature long").distinct().toPandas()["feature"].to_numpy()
    if not len(listed):
        return None
    held = np.sort(listed)
    row = np.full(1 << DIMENSION_BITS, -1, np.int32)
    row[held] = np.arange(len(held))
    width = min(rank + OVERSAMPLE, len(held))

    def summed(basis: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over all passages a of a (a basis), or of (a basis)' (a basis), by rows."""
        shared = spark.sparkContext.broadcast((row, basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows_of, omega = shared.value
            total = np.zeros((omega.shape[1] if gram else len(omega), omega.shape[1]))
            for batch in batches:
                passage, feature, value = entries(batch)
                if not len(passage):
                    continue
                at = rows_of[feature]
                first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                image = np.add.reduceat(value[:, None] * omega[at], first, axis=0)
                if gram:
                    total += image.T @ image
                else:
                    step = np.repeat(image, np.diff(np.r_[first, len(passage)]), axis=0)
                    np.add.at(total, at, value[:, None] * step)
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.record_batch(
                {
                    "block": pa.array(some // 256, pa.int64()),
                    "at": pa.array(some, pa.int64()),
                    "v": pa.array(list(total[some]), pa.list_(pa.float64())),
                }
            )

        def add(part: pd.DataFrame) -> pd.DataFrame:
            lines = part["at"].to_numpy()
            names, inverse = np.unique(lines, return_inverse=True)
            out = np.zeros((len(names), width))
            np.add.at(out, inverse, np.stack(part["v"].to_numpy()))
            return pd.DataFrame({"at": names, "v": list(out)})

        parts = texts.mapInArrow(run, "block long, at long, v array<double>")
        sums = parts.groupBy("block").applyInPandas(add, "at long, v array<double>").toPandas()
        out = np.zeros((width if gram else len(held), width))
        if len(sums):
            out[sums["at"].to_numpy()] = np.stack(sums["v"].to_numpy())
        return out

    basis = np.random.default_rng(7).standard_normal((len(held), width))
    for _ in range(POWER_ROUNDS):
        basis, _ = np.linalg.qr(summed(basis, gram=False))
    _, turn = np.linalg.eigh(summed(basis, gram=True))
    directions = (basis @ turn[:, ::-1])[:, :rank].astype(np.float32)
    return Space(row, directions * weight[held][:, None])


class Items(NamedTuple):
    """Benchmark items of one block, ready to search; words are numbered, those of items first."""

    ids: list[int]
    vectors: np.ndarray  # unit vector of each passage
    lengths: np.ndarray  # and what it was divided by
    owner: np.ndarray  # item of each passage
    sizes: np.ndarray  # words of each item
    patterns: list[dict[int, int]]  # per item, the places of each word as bits
    answers: list[set[int]]
    numbers: HashIndex  # hash of a word to its number
    item_words: int  # numbers below are of items
    counts: HashIndex  # (item, number) to how often the item has the word
    fewest: int  # words of the benchmark in some window of any text that passes the check


def fewest_known(size: int) -> int:
    """Words of an item of ``size`` words that some window has at least, where the check finds it."""
    span = size + max(4, size // 4)
    return -(-math.ceil(LIKELY * size) // -(-(span + STRIDE - 1) // WINDOW))


def answer_of(text: str) -> str:
    """Where no answer is given, the last sentence stands for it."""
    parts = [p for p in re.split(r"[.!?\n]+", text or "") if p.strip()]
    return parts[-1] if parts else ""


def _hashes(text: str | None) -> np.ndarray:
    return words_of(*text_bytes(pa.array([text or ""]))).hashes


def _numbers(hashes: np.ndarray, known: HashIndex) -> np.ndarray:
    return known.find(hashes).astype(np.int64)


def _pair(item: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One to one, and spread over the table."""
    key = ((item.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(32))


def prepared(rows: list, space: Space) -> Items:
    ids = [r["item_id"] for r in rows]
    answers = [r["answer"] if "answer" in r and r["answer"] is not None else answer_of(r["text"]) for r in rows]
    found = words_of(*text_bytes(pa.array([r["text"] for r in rows], pa.string())))
    start, end, owner = windows(found.first)
    nothing = np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
    vectors, lengths = space.project(features(found.hashes), start, end) if len(start) else nothing
    own, wanted = np.unique(found.hashes), [_hashes(a) for a in answers]
    others = np.setdiff1d(np.concatenate([np.zeros(0, np.uint64), *wanted]), own)
    numbers, counts = HashIndex(8), HashIndex(8)
    numbers.add(np.r_[own, others], np.arange(len(own) + len(others)))
    sizes = np.diff(found.first)
    words = _numbers(found.hashes, numbers)
    key, times = np.unique(_pair(np.repeat(np.arange(len(sizes)), sizes), words), return_counts=True)
    counts.add(key, times)
    patterns: list[dict[int, int]] = []
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        pattern: dict[int, int] = {}
        for k, word in enumerate(words[a:b].tolist()):
            pattern[word] = pattern.get(word, 0) | (1 << k)
        patterns.append(pattern)
    return Items(
        ids,
        vectors,
        lengths,
        owner,
        sizes,
        patterns,
        [set(_numbers(w, numbers).tolist()) for w in wanted],
        numbers,
        len(own),
        counts,
        min((fewest_known(n) for n in sizes.tolist() if n), default=1),
    )


def common_subsequence(pattern: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence; ``pattern`` has the places of each word as bits."""
    whole = (1 << size) - 1
    state = whole
    for word in text:
        hit = state & pattern.get(word, 0)
        state = ((state + hit) | (state - hit)) & whole
    return size - state.bit_count()


def checked(pattern: dict[int, int], size: int, answer: set[int], words: list[int]) -> tuple[float, float]:
    """Share of the item found in order in ``words`` (0 where it is sure to be below ``LIKELY``), and
    share of the answer there."""
    span, step = size + max(4, size // 4), max(1, size // 8)
    # No subsequence is longer than the words of the span that the item has: most spans end here.
    known = [0, *accumulate(word in pattern for word in words)]
    best, place = 0, 0
    for k in range(0, max(1, len(words) - span + step), step):
        if known[min(k + span, len(words))] - known[k] < max(LIKELY * size, best + 1):
            continue
        length = common_subsequence(pattern, size, words[k : k + span])
        if length > best:
            best, place = length, k
    near = set(words[place : place + span])
    return best / size, len(answer & near) / len(answer) if answer else 0.0


def shared_words(number: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """How many words the places [low, high) of a list of item words and an item share, each used once."""
    size = high - low
    last = np.cumsum(size)
    region = np.repeat(np.arange(len(low)), size)
    key = number[np.arange(last[-1]) + np.repeat(low - last + size, size)] | (region << 32)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times, region = np.diff(np.r_[first, len(key)]), key[first] >> 32
    held = items.counts.find(_pair(item[region], key[first] & 0xFFFFFFFF))
    return np.bincount(region, np.minimum(times, np.maximum(held, 0)), minlength=len(low))


class Candidate(NamedTuple):
    text: int
    item: int
    low: int  # words that the check reads
    high: int
    cosine: float


def candidates(found: Words, number: np.ndarray, space: Space, items: Items) -> Iterator[Candidate]:
    """Windows close to an item's passage whose surroundings share as many words with the item as the
    check needs: a common subsequence uses each word once, so no other can pass."""
    feature = features(found.hashes)
    of_items = (number >= 0) & (number < items.item_words)
    known, number = np.r_[0, np.cumsum(of_items)], number[of_items]
    start, end, text = windows(found.first)
    near = known[end] - known[start] >= items.fewest
    start, end, text = start[near], end[near], text[near]
    least_shared = np.ceil(LIKELY * items.sizes)
    for k in range(0, len(start), 2048):
        a, b, t = start[k : k + 2048], end[k : k + 2048], text[k : k + 2048]
        vectors, lengths = space.project(feature, a, b)
        cosine = vectors @ items.vectors.T
        # Divided by the shorter of both, the words around an item take nothing away.
        least = LEAST_COSINE * np.minimum(1, items.lengths / lengths[:, None])
        at, passage = np.nonzero(cosine >= least)
        item, value = items.owner[passage], cosine[at, passage]
        if not len(at):
            continue
        # Passages of one item in one window see the same words: one check does for them.
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (item[1:] != item[:-1])])
        value, at, item = np.maximum.reduceat(value, new), at[new], item[new]
        low = np.maximum(a[at] - items.sizes[item], found.first[t[at]])
        high = np.minimum(b[at] + items.sizes[item], found.first[t[at] + 1])
        wide = np.flatnonzero(known[high] - known[low] >= least_shared[item])
        for j in range(0, len(wide), 4096):
            part = wide[j : j + 4096]
            shared = shared_words(number, known[low[part]], known[high[part]], item[part], items)
            for i in part[shared >= least_shared[item[part]]]:
                yield Candidate(int(t[at[i]]), int(item[i]), int(low[i]), int(high[i]), float(value[i]))


FOUND = "doc_id long, item_id long, cosine double, common double, answer double, digest long"


def search(docs: DataFrame, space: Space, items: Items) -> DataFrame:
    """doc_id, item_id, cosine, common, answer of every pair that passes the check, and the text's digest."""
    shared = sent(docs.sparkSession, (space, items))  # bounded by the hashed words and the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, wanted = received(shared)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            doc, digest = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            out: list[tuple] = []
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                found = words_of(part - part[0], data[part[0] : part[-1]])
                number = _numbers(found.hashes, wanted.numbers)
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for text, item, low, high, cosine in candidates(found, number, latent, wanted):
                    common, answer = checked(
                        wanted.patterns[item], int(wanted.sizes[item]), wanted.answers[item], number[low:high].tolist()
                    )
                    if common >= SURE or common >= LIKELY and answer >= ANSWER:
                        best[text, item] = max(best.get((text, item), (-1.0, 0.0, 0.0)), (common, cosine, answer))
                out += [(doc[a + t], wanted.ids[i], c, m, s, digest[a + t]) for (t, i), (m, c, s) in best.items()]
            columns = [list(x) for x in zip(*out, strict=True)] if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            names = ("doc_id", "item_id", "cosine", "common", "answer", "digest")
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("digest"))
    return rows.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, items: DataFrame, rank: int = RANK, block: int = BLOCK_ITEMS) -> DataFrame:
    """All pairs of a row of ``docs`` and a benchmark item (item_id, text, perhaps answer) it contains."""
    return _contaminated(docs, items, rank, block).drop("digest")


def _contaminated(docs: DataFrame, items: DataFrame, rank: int = RANK, block: int = BLOCK_ITEMS) -> DataFrame:
    spark = small_batches(docs.sparkSession)
    frequencies, rows = document_frequencies(docs)
    columns = [c for c in ("item_id", "text", "answer") if c in items.columns]
    items = stored(items.select(*columns).distinct(), "items")
    space = latent_space(items, frequencies, rows, rank)
    empty = spark.createDataFrame([], FOUND)
    if space is None:
        return empty
    # A bounded number of items at a time; a larger benchmark takes more scans.
    number = items.count()
    found = empty
    blocks = -(-number // block)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks if blocks > 1 else 1))
    for k in range(2 * blocks if blocks > 1 else 1):
        listed = [r.asDict() for r in items.filter(part == k).collect()]
        if listed:
            found = found.unionByName(search(docs, space, prepared(listed, space)))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item was found."""
    bad = stored(_contaminated(docs, items).select("doc_id", "digest").distinct(), "contaminated")
    return without_rows(docs, bad)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, whole texts against all items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
SQL: dict[str, str] = {}
