"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut a text at different bytes; where tokens of both end, a group closes, and tokens of one
group are linked. Byte ranges become fragments (open prefix, closed groups, open suffix) that compose in any
order: in a task over the ranges of a stretch without a safe cut, and for very long documents across Spark tasks,
as a tree over parts dealt out one by one.

Stretches between safe cuts (a single space between two visible characters, where both tokenizers
always end a token) are encoded and aligned once per worker and looked up by their bytes after that.
How many documents hold an id pair is counted over all rows: summed up per task, then by pair. Counts of
the most frequent pairs, a fixed number, go to all tasks; pairs beyond these are joined.

Defined cases: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no
tokens; rows that repeat an id or a text are documents of their own; a very long text is tokenized by parts
that end at safe cuts, or whole where it has none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.common import (
    chunks,
    kept_in_worker,
    ragged,
    received,
    sent,
    small_batches,
    spaced,
    stored,
    table,
    text_bytes,
    tokenizer_path,
)
from riskloom.llm.fragments import EMPTY, KEY_BITS, START, Fragment, Stream, added, common_ends, compose, composed, fragment, links, marked_ids
from riskloom.llm.pretokens import WordIndex, span_hashes
from riskloom.llm.token_counts import byte_symbols

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
LONG_BYTES, PART_BYTES, RANGE_BYTES, FAN_IN = 1 << 16, 1 << 15, 1 << 14, 8
MEMO_STRETCHES, HOT_PAIRS, PENDING = 300_000, 1 << 18, 1 << 21


# A stretch of bytes that begins and ends where safe cuts do (see ``safe_cuts``) and has no stand-in of a space.
JOINABLE = re.compile(
    rb"(?s)(?= [\x21-\x7E\xC3-\xDF\xE4-\xE9])(?!.*\xE2\x96\x81).*(?:[\x21-\x7E]|[\xC3-\xDF][\x80-\xBF]|[\xE4-\xE9][\x80-\xBF]{2})"
).fullmatch


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            described = json.load(file)
        byte = {s: k for k, s in enumerate(byte_symbols())}
        names = dict(described["model"]["vocab"]) | {t["content"]: t["id"] for t in described["added_tokens"]}
        self.bytes_a = [b""] * (1 + max(names.values()))
        for name, k in names.items():
            self.bytes_a[k] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(pieces)
        ]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with the space that the second tokenizer adds by itself."""
        ids_a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return ids_a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def gives_back(self, word: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        return b"".join([self.bytes_a[k] for k in ids_a]) == word == b"".join([self.bytes_b[k] for k in ids_b])


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between visible characters, as far as bytes tell these apart from
    white space: ASCII, U+00C0-U+07FF, U+4000-U+9FFF."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 2) & (at + 1 < len(data))]
    before, second, third, after = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
    inner, letters = (before & 0xC0) == 0x80, lambda x, low, high: (x >= low) & (x <= high)
    seen = letters(before, 0x21, 0x7E) | inner & letters(second, 0xC3, 0xDF) | inner & letters(third, 0xE4, 0xE9)
    return at[seen & (letters(after, 0x21, 0x7E) | letters(after, 0xC3, 0xDF) | letters(after, 0xE4, 0xE9))]


class Known:
    """Aligned stretches, by number: sizes, linked pairs, and the text of their groups."""

    def __init__(self) -> None:
        self.index = WordIndex()
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of both, groups, links, and 1 if not given back
        self.first = np.zeros(1, np.int64)
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts: list[bytes] = []

    def add(self, numbers: np.ndarray, size: np.ndarray, keys: np.ndarray, times: np.ndarray, texts: list) -> None:
        self.numbers = np.concatenate([self.numbers, numbers])
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(size)]
        self.keys, self.times = np.r_[self.keys, keys], np.r_[self.times, times]
        self.texts += texts


class Aligner:
    """Aligns whole texts; remembers the stretches it has met."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO_STRETCHES) -> None:
        self.pair, self.memo, self.known = Pair(path_a, path_b), memo, Known()

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers for all words, end to end, and how many each word has."""
        if all(map(JOINABLE, words)):
            # Both end a token between such words, so they can be encoded as one text.
            joined = b"".join(words)
            (ids_a,), (ids_b,) = self.pair.encode([joined.decode("utf-8", "replace")])
            if self.pair.gives_back(joined, ids_a, ids_b):
                a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
                ends = np.cumsum(list(map(len, words)))
                n_a, n_b = (
                    np.diff(np.r_[0, np.searchsorted(np.cumsum(size[x]), ends, side="right")])
                    for size, x in ((self.pair.size_a, a), (self.pair.size_b, b))
                )
                return a, b, n_a, n_b
        made = self.pair.encode([w.decode("utf-8", "replace") for w in words])
        flat = [np.fromiter((i for own in x for i in own), np.int64) for x in made]
        return *flat, *(np.fromiter(map(len, x), np.int64, len(words)) for x in made)

    def _learn(self, words: list[bytes]) -> None:
        """New stretches: those that can be joined in one go, the others one by one."""
        easy = np.array([bool(JOINABLE(w)) for w in words], bool)
        order = np.r_[np.flatnonzero(easy), np.flatnonzero(~easy)]
        parts = [self._encoded([words[k] for k in x.tolist()]) for x in (np.flatnonzero(easy), np.flatnonzero(~easy)) if len(x)]
        a, b, n_a, n_b = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = np.array([len(words[k]) for k in order.tolist()])
        at_a, at_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        bad, long = np.zeros(len(words), bool), size > RANGE_BYTES
        for k in np.flatnonzero(~easy[order] | long).tolist():
            bad[k] = not self.pair.gives_back(words[order[k]], a[at_a[k] : at_a[k + 1]].tolist(), b[at_b[k] : at_b[k + 1]].tolist())
        long &= ~bad
        numbers = np.zeros((len(words), 5), np.int64)
        numbers[bad, 4] = 1
        texts: list[bytes] = [b""] * len(words)
        plain = ~bad & ~long
        which = np.flatnonzero(plain)
        # All of them lie end to end, so all byte ends differ and every stretch closes its last group.
        flat_a, flat_b = a[np.repeat(plain, n_a)], b[np.repeat(plain, n_b)]
        ends_a, ends_b = np.cumsum(self.pair.size_a[flat_a]), np.cumsum(self.pair.size_b[flat_b])
        common = common_ends(ends_a, ends_b)
        size_a = np.diff(np.r_[0, np.searchsorted(ends_a, common, side="right")])
        size_b = np.diff(np.r_[0, np.searchsorted(ends_b, common, side="right")])
        owner = which[np.searchsorted(np.cumsum(size[which]), common)]
        group, keys, times = links(flat_a, flat_b, size_a, size_b)
        stretch = owner[group]
        numbers[which, 0], numbers[which, 1] = n_a[which], n_b[which]
        numbers[:, 2] = np.bincount(owner, minlength=len(words))
        numbers[:, 3] = np.bincount(owner, size_a * size_b, minlength=len(words)).astype(np.int64)
        marked = marked_ids(flat_a, flat_b, size_a, size_b)
        at = np.cumsum(n_a[which] + n_b[which]).tolist()
        for k, low, high in zip(which.tolist(), [0, *at], at, strict=False):
            texts[k] = "".join(marked[low:high])[1:].encode()
        parts = [(stretch, keys, times)]
        for k in np.flatnonzero(long).tolist():
            ids_a, ids_b = a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]]
            whole = compose(START, by_ranges(self.pair, ids_a, ids_b, int(size[k])))
            numbers[k, :4], texts[k] = (whole.n_a, whole.n_b, whole.groups, whole.links), whole.text
            parts.append((np.full(len(whole.keys), k), whole.keys, whole.times))
        stretch, keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Back to the order in which the words came.
        both, times = added((order[stretch] << (2 * KEY_BITS)) | keys, times)
        size = np.bincount(both >> (2 * KEY_BITS), minlength=len(words))
        back = np.argsort(order)
        texts = [texts[k] for k in back.tolist()]
        self.known.add(numbers[back], size, both & ((1 << (2 * KEY_BITS)) - 1), times, texts)

    def stretches(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known stretches of texts with their space, end to end, and where each text's begin."""
        if len(self.known.texts) > self.memo:
            self.known = Known()
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]], begins[safe_cuts(data)] = True, True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], offsets[-1]]
        hashes = span_hashes(data, starts, ends)
        index = self.known.index
        where = index.find(data, starts, ends, hashes)
        words_at = lambda k: [data[a:b].tobytes() for a, b in zip(starts[k].tolist(), ends[k].tolist())]  # noqa: E731, B905
        new, at = np.unique(hashes[where == -1], return_index=True)
        if len(new):
            words = words_at(np.flatnonzero(where == -1)[at])
            index.add(new, words)
            self._learn(words)
            where = index.find(data, starts, ends, hashes)
        clash = np.flatnonzero(where < 0)
        if len(clash):
            # Another string has the hash: aligned without a place in the index, so nothing after this chunk
            # may find what follows under a wrong number.
            where[clash] = len(self.known.texts) + np.arange(len(clash))
            self._learn(words_at(clash))
        return where, np.searchsorted(starts, offsets)

    def drop_clashes(self) -> None:
        if len(self.known.texts) > len(self.known.index):
            self.known = Known()

    def rows(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
        """Per text: tokens of both, groups, links, text of the groups, pairs and their times."""
        empty = np.diff(offsets) == 0
        where, first = self.stretches(*spaced(offsets, data))
        known = self.known
        total = np.zeros((len(where) + 1, 5), np.int64)
        np.cumsum(known.numbers[where], axis=0, out=total[1:])
        numbers = total[first[1:]] - total[first[:-1]]
        none = empty | (numbers[:, 4] > 0)
        numbers[none] = 0
        text = np.repeat(np.arange(len(empty)), np.diff(first))
        used = ~none[text]
        begin, size = known.first[where[used]], known.first[where[used] + 1] - known.first[where[used]]
        at = ragged(begin, size)
        keys, times = added((np.repeat(text[used], size) << (2 * KEY_BITS)) | known.keys[at], known.times[at])
        bounds = np.searchsorted(keys >> (2 * KEY_BITS), np.arange(len(empty) + 1))
        keys &= (1 << (2 * KEY_BITS)) - 1
        for k in range(len(empty)):
            groups = None if none[k] else b";".join([known.texts[w] for w in where[first[k] : first[k + 1]].tolist()])
            a, b = bounds[k], bounds[k + 1]
            yield (*numbers[k, :4].tolist(), groups, keys[a:b], times[a:b])
        self.drop_clashes()


def by_ranges(pair: Pair, ids_a: list[int] | np.ndarray, ids_b: list[int] | np.ndarray, size: int) -> Fragment:
    """The fragment of a whole stretch, from fragments of its byte ranges."""
    a, b = np.asarray(ids_a, np.int64), np.asarray(ids_b, np.int64)
    ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    cuts = np.arange(RANGE_BYTES, size + RANGE_BYTES, RANGE_BYTES)
    at_a, at_b = (np.r_[0, np.searchsorted(e, cuts, side="right")] for e in (ends_a, ends_b))
    parts = []
    for k in range(len(cuts)):
        x, y = slice(at_a[k], at_a[k + 1]), slice(at_b[k], at_b[k + 1])
        parts.append(fragment(Stream(a[x], ends_a[x]), Stream(b[y], ends_b[y])))
    return composed(parts)


def aligner(path_a: str, path_b: str) -> Aligner:
    return kept_in_worker(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))


SIZES = "n_a long, n_b long, n_groups long, n_links long"
ALIGNED = f"doc_id long, {SIZES}, groups_sha256 string, keys array<long>, times array<long>"
IDS = ("keys", "times", "head_a", "head_b", "tail_a", "tail_b")
FRAGMENT = f"key string, seq long, given_back boolean, closed boolean, {SIZES}, groups binary, " + ", ".join(f"{c} array<long>" for c in IDS)
_LISTS = pa.list_(pa.int64())


def _sha(groups: bytes | None) -> str:
    return "" if groups is None else hashlib.sha256(groups).hexdigest()


def _short(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                made = list(both.rows(part - part[0], data[part[0] : part[-1]]))
                columns = list(zip(*made, strict=True))
                arrays = [batch.column("doc_id").slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns[:4])]
                arrays += [pa.array(map(_sha, columns[4]), pa.string()), pa.array(columns[5], _LISTS), pa.array(columns[6], _LISTS)]
                yield pa.record_batch(arrays, names=[c.split()[0] for c in ALIGNED.split(", ")])

    return rows.mapInArrow(run, ALIGNED)


def part_borders(data: np.ndarray, size: int) -> list[int]:
    """Cuts of one text at safe places about ``size`` bytes apart."""
    cuts, at = safe_cuts(data), [0]
    while len(cuts) and at[-1] + size < len(data):
        k = int(np.searchsorted(cuts, at[-1] + size))
        if k == len(cuts):
            break
        at.append(int(cuts[k]))
    return [*at, len(data)]


def _parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """key, seq, part of each text, cut at safe places; a later part begins with its space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            keys = batch.column("key").to_pylist()
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                at = part_borders(data[a:b], part_bytes)
                parts = [data[a + x : a + y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                seq = pa.array(range(len(parts)), pa.int64())
                names = pa.array([keys[k]] * len(parts), pa.string())
                yield pa.record_batch({"key": names, "seq": seq, "part": pa.array(parts, pa.binary()).cast(pa.string())})

    return rows.mapInArrow(run, "key string, seq long, part string")


def _row(key: str, seq: int, given_back: bool, f: Fragment) -> dict:
    sizes = {"n_a": f.n_a, "n_b": f.n_b, "n_groups": f.groups, "n_links": f.links}
    row = {"key": key, "seq": seq, "given_back": given_back, "closed": f.closed, **sizes, "groups": f.text}
    return row | {c: getattr(f, c) for c in IDS}


def _fragments(parts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The fragment of each part, composed of its byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(path_a, path_b).pair
        for batch in batches:
            for row in batch.to_pylist():
                # The space before the first part is added, that of a later one is its first byte.
                text = row["part"] if row["seq"] else " " + row["part"]
                (ids_a,), (ids_b,) = pair.encode([text])
                word = text.encode()
                back = pair.gives_back(word, ids_a, ids_b)
                made = by_ranges(pair, ids_a, ids_b, len(word)) if back else EMPTY
                values = _row(row["key"], row["seq"], back, made)
                arrays = {c: pa.array([v], _LISTS) if c in IDS else pa.array([v]) for c, v in values.items()}
                arrays["groups"] = pa.array([made.text], pa.binary())
                yield pa.record_batch(arrays)

    return parts.mapInArrow(run, FRAGMENT)


def _round(fragments: DataFrame) -> DataFrame:
    """One level of the tree: every ``FAN_IN`` neighbours become one fragment."""

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        made = composed(
            [
                Fragment(r.closed, *(np.asarray(x, np.int64) for x in (r.head_a, r.head_b)), r.groups, r.n_groups, r.n_links,
                         *(np.asarray(x, np.int64) for x in (r.keys, r.times, r.tail_a, r.tail_b)), r.n_a, r.n_b)
                for r in part.itertuples()
            ]
        )
        return pd.DataFrame([_row(part["key"].iloc[0], int(part["seq"].iloc[0]) // FAN_IN, bool(part["given_back"].all()), made)])

    near = fragments.withColumn("near", F.expr(f"seq div {FAN_IN}"))
    return near.groupBy("key", "near").applyInPandas(lambda part: join(part.drop(columns="near")), FRAGMENT)


def _long(rows: DataFrame, path_a: str, path_b: str, part_bytes: int) -> DataFrame:
    """Very long documents: parts dealt out to tasks, their fragments composed level by level. Equal texts
    are aligned once."""
    rows = rows.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    # A part is little longer than part_bytes, unless the text has no safe cut there.
    parts = _parts(rows.select("key", "text"), part_bytes).dropDuplicates(["key", "seq"])
    tree = stored(_fragments(parts, path_a, path_b), "fragments")
    most = tree.agg(F.max("seq")).first()[0] or 0
    while most:
        tree, most = stored(_round(tree), "fragments"), most // FAN_IN

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = {c: np.array(r[c], np.int64) for c in IDS}
                whole = Fragment(r["closed"], ids["head_a"], ids["head_b"], r["groups"], r["n_groups"], r["n_links"],
                                 ids["keys"], ids["times"], ids["tail_a"], ids["tail_b"], r["n_a"], r["n_b"])
                whole = compose(START, whole) if r["given_back"] else EMPTY
                groups = whole.text if r["given_back"] else None
                numbers = whole.n_a, whole.n_b, whole.groups, whole.links
                arrays = [pa.array([r["key"]]), *(pa.array([n], pa.int64()) for n in numbers), pa.array([_sha(groups)])]
                arrays += [pa.array([whole.keys], _LISTS), pa.array([whole.times], _LISTS)]
                yield pa.record_batch(arrays, names=["key", *(c.split()[0] for c in ALIGNED.split(", ")[1:])])

    whole = tree.mapInArrow(finish, ALIGNED.replace("doc_id long", "key string"))
    return rows.select("doc_id", "key").join(whole, "key").drop("key")


def aligned(
    docs: DataFrame, path_a: str, path_b: str, long_bytes: int = LONG_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """doc_id, sizes, digest of the groups, and linked id pairs with their times, of every row; stored."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    made = _short(rows.filter(~long), path_a, path_b).unionByName(_long(rows.filter(long), path_a, path_b, part_bytes))
    return stored(made, "aligned")


def pair_counts(made: DataFrame) -> DataFrame:
    """key, n: how many documents hold each pair linked; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"key": pa.array(keys[0], pa.int64()), "n": pa.array(n[0], pa.int64())})

        for batch in batches:
            own = batch.column("keys").flatten().to_numpy()
            keys, n, held = [*keys, own], [*n, np.ones(len(own), np.int64)], held + len(own)
            if held > PENDING:
                total = added(np.concatenate(keys), np.concatenate(n))
                keys, n, held = [total[0]], [total[1]], len(total[0])
                if held > PENDING // 2:
                    yield out()
                    keys, n, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        total = added(np.concatenate(keys), np.concatenate(n))
        keys, n = [total[0]], [total[1]]
        yield out()

    partial = made.select("keys").mapInArrow(run, "key long, n long")
    return stored(partial.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")


def cross_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    long_bytes: int = LONG_BYTES,
    part_bytes: int = PART_BYTES,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """doc_id, sizes, digest, n_best and count_sum of every row."""
    spark = docs.sparkSession
    made = aligned(docs, path_a, path_b, long_bytes, part_bytes)
    counts = pair_counts(made)
    # No longer than the first vocabulary, and a fixed number of pairs.
    first = F.shiftright("key", KEY_BITS).alias("a")
    best = counts.groupBy(first).agg(F.max("n").alias("best")).toPandas()
    hot = counts.orderBy(F.col("n").desc(), "key").limit(hot_pairs).toPandas().sort_values("key")
    most = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    most[best["a"].to_numpy(np.int64)] = best["best"].to_numpy(np.int64)
    shared = sent(spark, (most, hot["key"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, known, number = received(shared)
        for batch in batches:
            size = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            keys, times = (batch.column(c).flatten().to_numpy() for c in ("keys", "times"))
            at = np.searchsorted(known, keys)
            held = np.zeros(len(keys), bool)
            inside = at < len(known)
            held[inside] = known[at[inside]] == keys[inside]
            n = np.zeros(len(keys), np.int64)
            n[held] = number[at[held]]
            total = np.zeros(len(size), np.int64)
            np.add.at(total, row, n * times)
            wins = np.zeros(len(size), np.int64)
            np.add.at(wins, row, times * (held & (n == top[keys >> KEY_BITS])))
            bounds = np.r_[0, np.cumsum(np.bincount(row[~held], minlength=len(size)))]
            rest = pa.StructArray.from_arrays([pa.array(keys[~held]), pa.array(times[~held])], ["key", "m"])
            rest = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rest)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("keys", "times")}
            yield pa.record_batch({**columns, "n_best": pa.array(wins), "count_sum": pa.array(total), "rest": rest})

    shape = f"doc_id long, {SIZES}, groups_sha256 string, n_best long, count_sum long, rest array<struct<key:long,m:long>>"
    scored = stored(made.mapInArrow(run, shape), "scored-pairs")
    # Pairs beyond the hot ones: once for equal groups, joined to their counts.
    asked = scored.filter(F.size("rest") > 0).select("groups_sha256", "rest").dropDuplicates(["groups_sha256"])
    asked = asked.select("groups_sha256", F.inline("rest"))
    ranked = counts.withColumn("a", F.shiftright("key", KEY_BITS)).join(
        F.broadcast(spark.createDataFrame(best, "a long, best long")), "a"  # bounded by the vocabulary
    )
    more = asked.join(ranked.hint("shuffle_hash"), "key").groupBy("groups_sha256")
    more = more.agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("m")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("m")).alias("more_sum"),
    )
    joined = scored.drop("rest").join(stored(more, "rest-pairs"), "groups_sha256", "left")
    for name, more in (("n_best", "more_best"), ("count_sum", "more_sum")):
        joined = joined.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return joined.drop("more_best", "more_sum")


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    docs = table(spark, sf_dir, "documents")
    made = cross_tokens(docs, tokenizer_path(VOCABULARY_A), tokenizer_path(VOCABULARY_B))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_cross_tokens": op11_cross_tokens}
SQL: dict[str, str] = {}
