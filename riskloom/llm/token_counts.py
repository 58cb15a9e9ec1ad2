"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie in one flat array of symbols. In every round each sequence
finds the lowest rank among its neighbouring pairs and merges all places of that pair at once;
sequences without a mergeable pair leave with the number of their symbols. Counts of known
pre-tokens are kept per worker, so each is merged about once.

Defined cases: a null text counts as empty and has 0 bytes and 0 tokens; special strings inside a
text are one token each; very long texts are cut between words for work only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import pretokens
from riskloom.llm.common import chunks, kept_in_worker, small_batches, table, text_bytes, tokenizer_path

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
MEMO_WORDS = 2_000_000
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class MergeTable:
    """Ranks of a merge list as arrays: pair of symbols to rank, rank to merged symbol."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int32)
        self.last = np.array([vocabulary[s + suffix] for s in symbols], np.int32)
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], np.uint64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.ranks = pretokens.HashIndex(18)
        self.ranks.add(_scramble(keys), np.arange(len(pairs)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = self.ranks.find(_scramble(keys))
        found[found < 0] = NO_RANK
        return found


def _scramble(keys: np.ndarray) -> np.ndarray:
    keys = keys * np.uint64(0x9E3779B97F4A7C15)  # one to one, so equal hashes mean equal pairs
    return keys ^ (keys >> np.uint64(32))


def merge_counts(words: list[bytes], merges: MergeTable) -> np.ndarray:
    """Number of symbols left of each word (none of them empty) after all merges."""
    counts = np.ones(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbols = merges.inner[flat]
    symbols[ends - 1] = merges.last[flat[ends - 1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    ranks = np.full(len(symbols), NO_RANK, np.int32)  # rank of the pair that begins here
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inside] = merges.rank(symbols[inside], symbols[inside + 1])
    while len(symbols):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, len(owner)])
        lowest = np.minimum.reduceat(ranks, first)
        done = lowest == NO_RANK
        if done.any():
            counts[owner[first[done]]] = size[done]
            stay = np.repeat(~done, size)
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            lowest, size = lowest[~done], size[~done]
            if not len(symbols):
                break
        at = np.flatnonzero(ranks == np.repeat(lowest, size))
        # In a run like "aaa" the places overlap: take every second one from the left.
        run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        symbols[at] = merges.merged[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # their places once the right halves are gone
        symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
        touched = np.unique(np.r_[moved, moved[moved > 0] - 1])
        ranks[touched] = NO_RANK
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[owner[touched] == owner[touched + 1]]
        ranks[touched] = merges.rank(symbols[touched], symbols[touched + 1])
    return counts


class TokenCounter:
    """Counts of whole texts; remembers the pre-tokens it has merged."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        self.merges, self.memo_words = MergeTable(path), memo_words
        self._forget()

    def _forget(self) -> None:
        self.index, self.counts = pretokens.WordIndex(), np.zeros(0, np.int64)

    def _merged(self, words: list[bytes]) -> np.ndarray:
        made = merge_counts(words, self.merges)
        made[[k for k, w in enumerate(words) if w in pretokens.WORDS.specials]] = 1
        return made

    def count(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        if len(self.counts) > self.memo_words:
            self._forget()
        spans = pretokens.pretokenize(offsets, data, pretokens.WORDS)
        hashes, flat = spans.hashes(), np.frombuffer(spans.data, np.uint8)
        where = self.index.find(flat, spans.starts, spans.ends, hashes)
        new, at = np.unique(hashes[where == -1], return_index=True)
        if len(new):
            words = spans.words(np.flatnonzero(where == -1)[at])
            self.index.add(new, words)
            self.counts = np.r_[self.counts, self._merged(words)]
            left = np.flatnonzero(where == -1)
            where[left] = self.index.find(flat, spans.starts[left], spans.ends[left], hashes[left])
        made = self.counts[where]
        clash = np.flatnonzero(where < 0)
        if len(clash):
            made[clash] = self._merged(spans.words(clash))
        return np.diff(np.r_[0, np.cumsum(made)][spans.first])


def counter(path: str) -> TokenCounter:
    return kept_in_worker(f"counter {path}", lambda: TokenCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            counts = [np.zeros(0, np.int64)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                counts.append(tokens.count(part - part[0], data[part[0] : part[-1]]))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                    "n_tokens": pa.array(np.concatenate(counts), pa.int64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, whole texts."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
