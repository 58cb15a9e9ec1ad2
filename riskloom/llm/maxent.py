"""Language model scoring: hashed maximum entropy with a class-factored softmax.

A token is one of the most frequent words, a fixed number of which have places in classes, or a rarer word; the
probability of its class given the context is a softmax over classes, that of the word given class and context
one over the class's words. Features are the word before, the two words before, and the second word before by
itself (a skip); a hashed feature picks a row of weights. All rarer words are of the last class. The bits of a word's hash
lead it down a binary tree, whose every fork asks the context; words that end in one leaf share its probability by their
counts. One share is left for words never seen, so all probabilities add up to one. A rarer word before a token is
itself for the forks, and one of "all rarer words" for the two softmaxes.

Training sums over all learned tokens, task by task and then row by row, how often each feature goes with
each outcome and how often the model expects it to; their difference is the gradient, and a step moves each weight by the
logarithm of their ratio, damped. Before the first step the model is that of word counts alone,
whose expectations follow from the row sums. A softmax depends on the context alone (that of words on context and class),
so it is worked out once for each distinct one and weighted by its tokens, or looked up by them.
The weights are as many as the parameters say; counts of words are tables.

Defined cases: a null text is empty and has the end token only; rows with a null id are held out; rows that repeat an
id are texts of their own; without learned rows every word is unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import (
    WHITE,
    chunks,
    ragged,
    received,
    sent,
    small_batches,
    stored,
    table,
    text_bytes,
    text_digest,
)
from riskloom.llm.pretokens import WordIndex, span_hashes

FOLDS, HELD_OUT = 7, 2
END = " "  # no word has white space in it
CLASSES, MEMBERS = 64, 64  # the last class is that of rarer words
DEPTH = 16  # forks on the way to a rarer word
HOT_WORDS = 1 << 16  # counts of so many words go to all tasks; other words are joined
CLASS_ROWS, WORD_ROWS = 1 << 12, 1 << 14  # hashed features of both softmaxes
FORK_ROWS, FORK_BLOCK = 1 << 16, 1 << 15  # hashed features of forks, and tokens that meet them at a time
STEPS, FIRST_STEP, STEP, PRIOR = 2, 0.4, 0.25, 4.0
BLOCK, SUM_BLOCK = 1 << 12, 1 << 16
HELD_CONTEXTS = 1 << 20  # distinct contexts and classes a task gathers before it works out what the model expects
CONTEXT_BITS, CLASS_BITS = 20, 6  # of a word of the model, and of a class, in the number of a context
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
FEATURES = len(MIX)
NONE = np.zeros(0, np.int64)


def held_out() -> Column:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c of all rows, the end token of each row included; stored."""
    words = docs.select(F.explode(F.split(lowered(F.col("text")), f"{WHITE}+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    ends = docs.agg(F.count(F.lit(1)).alias("c")).filter("c > 0").select(F.lit(END).alias("word"), "c")
    return stored(counts.unionByName(ends), "word-counts")


class Words(NamedTuple):
    """The hot words by number, most frequent first, with their counts; numbers below ``size`` are in the model."""

    index: WordIndex
    counts: np.ndarray
    end: int  # number of the end token
    total: int  # tokens and distinct words in all
    distinct: int
    size: int
    owner: np.ndarray  # class and place in it, of each word of the model
    place: np.ndarray
    rare_total: float  # what the shares of rarer words are taken of
    class_bias: np.ndarray
    word_bias: np.ndarray
    odds: np.ndarray  # of each fork of the tree of rarer words, by counts: logarithm of right to left
    forks: np.ndarray  # whether there are words on both sides
    by_leaf: np.ndarray  # logarithm of each leaf's part of all rarer words, by counts


def leaves_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - DEPTH)).astype(np.int64)


def leaf_totals(counts: DataFrame) -> np.ndarray:
    """Counts of all words, and one for each word, by leaf; as many numbers as there are leaves."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("word"))
            leaf = leaves_of(span_hashes(data[: offsets[-1]], offsets[:-1], offsets[1:]))
            yield pa.record_batch({"leaf": pa.array(leaf), "c": batch.column("c")})

    by_leaf = counts.select("word", "c").mapInArrow(told, "leaf long, c long").groupBy("leaf").agg(F.sum(F.col("c") + 1).alias("n"))
    total = np.zeros(1 << DEPTH)
    for r in by_leaf.toLocalIterator():
        total[r["leaf"]] = r["n"]
    return total


def forked(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``odds`` and ``forks`` by the number of the fork: 1 is the root, 2n and 2n + 1 follow n; and ``by_leaf``."""
    size = len(leaves)
    below = np.zeros(2 * size)
    below[size:] = leaves
    for first in (1 << d for d in range(size.bit_length() - 2, -1, -1)):
        below[first : 2 * first] = below[2 * first : 4 * first : 2] + below[2 * first + 1 : 4 * first : 2]
    left, right = below[::2], below[1::2]
    forks = (left > 0) & (right > 0)
    forks[0] = False
    odds = np.zeros(size, np.float32)
    odds[forks] = np.log(right[forks] / left[forks])
    return odds, forks, np.log(np.maximum(leaves, 1) / max(leaves.sum(), 1))


def classed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place of the most frequent words: classes of about equal sums of square roots of counts."""
    root = np.sqrt(counts[: (CLASSES - 1) * MEMBERS])
    goal = root.sum() / (CLASSES - 1)
    owner, place, kind, member, mass = [], [], 0, 0, 0.0
    for value in root.tolist():
        if member and (mass + value / 2 > goal * (kind + 1) or member == MEMBERS):
            kind, member = kind + 1, 0
        if kind == CLASSES - 1:
            break
        owner.append(kind)
        place.append(member)
        member, mass = member + 1, mass + value
    return np.array(owner, np.int64), np.array(place, np.int64)


def vocabulary(counts: DataFrame, hot_words: int = HOT_WORDS) -> Words:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = counts.filter(F.col("word") != END).orderBy(F.col("c").desc(), "word").limit(hot_words)
    # A fixed number of rows, the end token always among them.
    hot = hot.unionByName(counts.filter(F.col("word") == END)).collect()
    hot.sort(key=lambda r: (-r["c"], r["word"]))
    words, number = [r["word"].encode() for r in hot], np.array([r["c"] for r in hot], np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), np.r_[0, ends[:-1]][: len(words)], ends)
    # Of words with one hash the most frequent is hot; the others are joined like any word beyond.
    _, first = np.unique(hashes, return_index=True)
    keep = np.sort(first)
    index = WordIndex()
    index.add(hashes[keep], [words[k] for k in keep.tolist()])
    number = number[keep]
    end = next((k for k, at in enumerate(keep.tolist()) if words[at] == END.encode()), -1)
    owner, place = classed(number)
    size = len(owner)
    mass = np.zeros((CLASSES, MEMBERS))
    mass[owner, place] = number[:size] + 1
    rare = float(total - number[:size].sum() + distinct - size + 1)
    by_class = mass.sum(1)
    by_class[CLASSES - 1] = rare
    with np.errstate(divide="ignore", invalid="ignore"):
        class_bias = np.log(by_class / by_class.sum())
        word_bias = np.log(mass / by_class[:, None])
    word_bias[np.isnan(word_bias)] = -np.inf
    biases = (np.maximum(x, -1e30).astype(np.float32) for x in (class_bias, word_bias))
    leaves = leaf_totals(counts)
    np.subtract.at(leaves, leaves_of(hashes[keep][:size]), number[:size] + 1)
    return Words(index, number, end, total, distinct, size, owner, place, rare, *biases, *forked(leaves))


class Tokens(NamedTuple):
    """Tokens of many texts end to end, the end token of each included."""

    number: np.ndarray  # of hot words, -1 for others
    first: np.ndarray  # per text, its first token; one more at the end
    data: np.ndarray
    starts: np.ndarray  # bytes of each token, none for end tokens
    ends: np.ndarray
    hashes: np.ndarray


def tokens_of(offsets: np.ndarray, data: np.ndarray, words: Words) -> Tokens:
    data = data + ((data - np.uint8(0x41)) < 26).view(np.uint8) * np.uint8(0x20)
    inside = (data != 0x20) & ((data - np.uint8(0x09)) > 4)
    begins, last_of = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    last_of[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begins[borders] = inside[borders]  # a text ends its last word
    last_of[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last_of) + 1
    found = span_hashes(data, starts, ends)
    number = words.index.find(data, starts, ends, found)
    begin = np.searchsorted(starts, offsets)
    texts = len(offsets) - 1
    first = begin + np.arange(texts + 1)
    last = first[1:] - 1
    out = np.full(len(starts) + texts, words.end, np.int64)
    low, high = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    at = np.ones(len(out), bool)
    at[last] = False
    out[at], low[at], high[at] = np.maximum(number, -1), starts, ends
    hashes = np.full(len(out), span_hashes(np.frombuffer(END.encode(), np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))[0])
    hashes[at] = found
    return Tokens(out, first, data, low, high, hashes)


class Events(NamedTuple):
    """Per token: its class and place, and the number of its context."""

    kind: np.ndarray
    place: np.ndarray
    context: np.ndarray

    @property
    def class_rows(self) -> np.ndarray:
        """Rows of the features of a context in the table of classes."""
        return _rows(_mixed(self.context), CLASS_ROWS)

    @property
    def word_rows(self) -> np.ndarray:
        """Rows of the features of a context and a class in the table of words."""
        with_class = _mixed(self.context) + self.kind.astype(np.uint64)[:, None] * np.uint64(0xBF58476D1CE4E5B9)
        return _rows(with_class * np.uint64(0x94D049BB133111EB), WORD_ROWS)

    def take(self, which: np.ndarray) -> Events:
        return Events(self.kind[which], self.place[which], self.context[which])


def events(tokens: Tokens, words: Words) -> Events:
    """Contexts reach back to the start of the text."""
    known = (tokens.number >= 0) & (tokens.number < words.size)
    model = np.where(known, tokens.number, words.size)
    kind = np.full(len(model), CLASSES - 1, np.int64)
    kind[known] = words.owner[model[known]]
    place = np.zeros(len(model), np.int64)
    place[known] = words.place[model[known]]
    return Events(kind, place, _contexts(model, tokens, words))


def _contexts(name: np.ndarray, tokens: Tokens, words: Words) -> np.ndarray:
    """Number of the context of each token, from the numbers of the two before."""
    since = np.arange(len(name)) - np.repeat(tokens.first[:-1], np.diff(tokens.first))
    back = []
    for k in range(1, 3):
        before = np.full(len(name), words.size + 1, np.uint64)
        before[k:] = name[:-k]
        before[since < k] = words.size + 1
        back.append(before)
    one, two = back
    return (one << np.uint64(CONTEXT_BITS)) | two


def _mixed(context: np.ndarray) -> np.ndarray:
    one, two = context >> np.uint64(CONTEXT_BITS), context & np.uint64((1 << CONTEXT_BITS) - 1)
    mixed = (np.stack([one, context, two], 1) + np.arange(1, FEATURES + 1, dtype=np.uint64)) * MIX
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _rows(mixed: np.ndarray, rows: int) -> np.ndarray:
    return ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - (rows - 1).bit_length())).astype(np.int64)


class Weights(NamedTuple):
    """A row for each hashed feature, a column for each class, place in a class, or side of a fork."""

    classes: np.ndarray
    words: np.ndarray
    sides: np.ndarray


def no_weights() -> Weights:
    return Weights(*(np.zeros(shape, np.float32) for shape in ((CLASS_ROWS, CLASSES), (WORD_ROWS, MEMBERS), (FORK_ROWS, 2))))


def _logits(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all outcomes of each row of features, less their largest, and the largest."""
    logit = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        logit += table.take(rows[:, k], axis=0)
    logit += bias
    top = logit.max(1, keepdims=True)
    logit -= top
    return logit, top


def _softmax(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of all outcomes of each row of features."""
    logit, _ = _logits(bias, table, rows)
    np.exp(logit, out=logit)
    logit /= logit.sum(1, keepdims=True)
    return logit


def _log_softmax(
    bias: np.ndarray, table: np.ndarray, rows: np.ndarray, of: np.ndarray | None, back: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """Logarithms of the probabilities of outcomes ``at``, of which each has the features in row ``back``.

    The sum over all outcomes is taken once for each row of features. ``of`` tells the row of ``bias``, if there are several.
    """
    total = np.empty(len(rows), np.float32)
    for k in range(0, len(rows), BLOCK):
        part = slice(k, k + BLOCK)
        logit, top = _logits(bias if of is None else bias[of[part]], table, rows[part])
        total[part] = top[:, 0] + np.log(np.exp(logit, out=logit).sum(1))
    flat = table.reshape(-1)
    own = flat[rows[back, 0] * table.shape[1] + at]
    for k in range(1, rows.shape[1]):
        own += flat[rows[back, k] * table.shape[1] + at]
    own += bias[at] if of is None else bias[of[back], at]
    return own - total[back]


def in_large_classes(kind: np.ndarray, words: Words) -> np.ndarray:
    return np.flatnonzero((np.bincount(words.owner, minlength=CLASSES) > 1)[kind])


def log_probabilities(made: Events, words: Words, weights: Weights) -> np.ndarray:
    """Natural logarithm of each token's probability; of rarer words, that of their class."""
    contexts, back = np.unique(made.context, return_inverse=True)
    rows = Events(NONE, NONE, contexts).class_rows
    out = _log_softmax(words.class_bias, weights.classes, rows, None, back, made.kind).astype(np.float64)
    which = in_large_classes(made.kind, words)
    numbers, back = np.unique(_numbered(made.take(which)), return_inverse=True)
    some = _of_numbers(numbers)
    out[which] += _log_softmax(words.word_bias, weights.words, some.word_rows, some.kind, back, made.place[which])
    return out


def _numbered(made: Events) -> np.ndarray:
    """One number for a context with a class."""
    return (made.context << np.uint64(CLASS_BITS)) | made.kind.astype(np.uint64)


def _of_numbers(numbers: np.ndarray) -> Events:
    return Events((numbers & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64), NONE, numbers >> np.uint64(CLASS_BITS))


def observed(made: Events, words: Words, total: Weights) -> None:
    """Adds how often each feature goes with each outcome."""
    which = in_large_classes(made.kind, words)
    class_rows, word_rows = made.class_rows, made.take(which).word_rows
    for k in range(FEATURES):
        np.add.at(total.classes.reshape(-1), class_rows[:, k] * CLASSES + made.kind, np.float32(1))
        np.add.at(total.words.reshape(-1), word_rows[:, k] * MEMBERS + made.place[which], np.float32(1))


class Met(NamedTuple):
    """Contexts with a class, by number and in order, and how many tokens have each."""

    number: np.ndarray
    count: np.ndarray


def met(number: np.ndarray, count: np.ndarray | None = None) -> Met:
    if count is None:
        return Met(*np.unique(number, return_counts=True))
    distinct, back = np.unique(number, return_inverse=True)
    return Met(distinct, np.bincount(back, count, len(distinct)))


def expected(found: Met, words: Words, weights: Weights, total: Weights) -> None:
    """Adds how often the model expects each outcome with each feature, once for each context and weighted by its tokens."""
    contexts = met(found.number >> np.uint64(CLASS_BITS), found.count)
    own = _of_numbers(found.number)
    which = in_large_classes(own.kind, words)
    inner = _of_numbers(found.number[which])
    for sums, table, rows, kind, count in (
        (total.classes, weights.classes, Events(NONE, NONE, contexts.number).class_rows, None, contexts.count),
        (total.words, weights.words, inner.word_rows, inner.kind, found.count[which]),
    ):
        lines = np.zeros((table.shape[1], len(sums)))
        for k in range(0, len(rows), SUM_BLOCK):
            own = rows[k : k + SUM_BLOCK]
            p = np.empty((table.shape[1], len(own)))  # a line for each outcome
            for j in range(0, len(own), BLOCK):
                part = slice(k + j, min(k + j + BLOCK, k + len(own)))
                bias = words.class_bias if kind is None else words.word_bias[kind[part]]
                np.multiply(_softmax(bias, table, rows[part]).T, count[part], out=p[:, j : j + BLOCK])
            places = [np.ascontiguousarray(own[:, f]) for f in range(FEATURES)]
            for outcome, line in enumerate(p):
                for place in places:
                    lines[outcome] += np.bincount(place, line, minlength=len(sums))
        sums += lines.T


class Rarer(NamedTuple):
    """Tokens of rarer words: their positions, leaves and contexts, in which every word has a number of its own."""

    at: np.ndarray
    leaf: np.ndarray
    context: np.ndarray


def rarer(tokens: Tokens, made: Events, words: Words) -> Rarer:
    at = np.flatnonzero(made.kind == CLASSES - 1)
    beyond = np.uint64((1 << CONTEXT_BITS) - words.size - 2)
    known = (tokens.number >= 0) & (tokens.number < words.size)
    name = np.where(known, tokens.number.astype(np.uint64), np.uint64(words.size + 2) + tokens.hashes % beyond)
    return Rarer(at, leaves_of(tokens.hashes[at]), _contexts(name, tokens, words)[at])


def _met_forks(some: Rarer, words: Words) -> Iterator[tuple[slice | np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens with a fork on their way, its number, the rows of each of its features, and whether they go right."""
    for k in range(0, len(some.at), FORK_BLOCK):
        leaf = some.leaf[k : k + FORK_BLOCK]
        mixed = np.ascontiguousarray((_mixed(some.context[k : k + FORK_BLOCK]) >> np.uint64(32)).astype(np.uint32).T)
        for d in range(DEPTH):
            fork, right = (1 << d) | (leaf >> (DEPTH - d)), (leaf >> (DEPTH - 1 - d)) & 1
            on, own, open_ = slice(k, k + len(leaf)), mixed, words.forks[fork]
            if not open_.all():
                on = np.flatnonzero(open_)
                fork, right, own, on = fork[on], right[on], mixed[:, on], on + k
            rows = (own ^ (fork.astype(np.uint32) * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)
            rows ^= rows >> np.uint32(15)
            rows *= np.uint32(0xC2B2AE35)
            yield on, fork, rows >> np.uint32(32 - (FORK_ROWS - 1).bit_length()), right


def rarer_gains(some: Rarer, words: Words, weights: Weights) -> np.ndarray:
    """What the context adds to the logarithm of the probability that counts give to each rarer word seen."""
    inverse = np.ones(len(some.at))  # of the probability of the way so far; a factor is below exp(40)
    lean = weights.sides[:, 1] - weights.sides[:, 0]
    for on, fork, rows, right in _met_forks(some, words):
        odds = words.odds[fork] + lean[rows].sum(0)
        odds *= 1 - 2 * right.astype(np.float32)
        inverse[on] *= 1 + np.exp(np.clip(odds, -40, 40, out=odds), dtype=np.float64)
    return -np.log(inverse) - words.by_leaf[some.leaf]


def sides(some: Rarer, words: Words, weights: Weights | None, total: Weights) -> None:
    """Adds how often each feature goes with each side of a fork, or how often the model expects it to."""
    met_sides = np.zeros((FORK_ROWS, 2))
    by_counts = 1 / (1 + np.exp(-words.odds))
    lean = None if weights is None or not weights.sides.any() else weights.sides[:, 1] - weights.sides[:, 0]
    for _, fork, rows, right in _met_forks(some, words):
        if weights is None:
            taken = (2 * rows + right.astype(np.uint32)).astype(np.int64).ravel()
            met_sides += np.bincount(taken, minlength=2 * FORK_ROWS).reshape(-1, 2)
            continue
        p = by_counts[fork] if lean is None else 1 / (1 + np.exp(-(words.odds[fork] + lean[rows].sum(0))))
        rows = rows.astype(np.int64).ravel()
        rights = np.bincount(rows, np.tile(p, FEATURES), FORK_ROWS)
        met_sides[:, 0] += np.bincount(rows, minlength=FORK_ROWS) - rights
        met_sides[:, 1] += rights
    total.sides[:] += met_sides


def summed(docs: DataFrame, words: Words, weights: Weights | None) -> Weights:
    """Observed (without weights) or expected sums over all tokens of ``docs``."""
    spark = docs.sparkSession
    shared = sent(spark, (words, weights))  # hot words and weights: as large as the parameters say

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = received(shared)
        total = no_weights()
        held: list[Met] = []  # contexts that come back are worked out once
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                tokens = tokens_of(part - part[0], data[part[0] : part[-1]], known)
                made = events(tokens, known)
                sides(rarer(tokens, made, known), known, model, total)
                if model is None:
                    observed(made, known, total)
                    continue
                held.append(met(_numbered(made)))
                if sum(len(h.number) for h in held) > HELD_CONTEXTS:
                    expected(_together(held), known, model, total)
                    held.clear()
        if held:
            expected(_together(held), known, model, total)
        yield from _filled(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of all tasks stream through; only the sums of this partition's rows are held.
        place: dict[int, int] = {}
        sums = np.zeros((1024, max(CLASSES, MEMBERS)))
        for batch in batches:
            for row, v in zip(batch.column("row").to_pylist(), batch.column("v").to_pylist(), strict=True):
                at = place.setdefault(row, len(place))
                if at == len(sums):
                    sums = np.concatenate([sums, np.zeros_like(sums)])
                sums[at] += np.frombuffer(v, np.float32)
        made = sums[: len(place)].astype(np.float32)
        yield pa.record_batch({"row": pa.array(list(place), pa.int64()), "v": pa.array([v.tobytes() for v in made], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "row long, v binary")
    width = max(CLASSES, MEMBERS)
    out = np.zeros((CLASS_ROWS + WORD_ROWS + FORK_ROWS * 2 // width, width), np.float32)
    for r in parts.repartition("row").mapInArrow(add, "row long, v binary").toLocalIterator():
        out[r["row"]] = np.frombuffer(r["v"], np.float32)
    by_class, by_word, by_side = np.split(out, [CLASS_ROWS, CLASS_ROWS + WORD_ROWS])
    return Weights(by_class[:, :CLASSES], by_word[:, :MEMBERS], by_side.reshape(FORK_ROWS, 2))


def _together(held: list[Met]) -> Met:
    return met(np.concatenate([h.number for h in held]), np.concatenate([h.count for h in held]))


def _filled(total: Weights) -> Iterator[pa.RecordBatch]:
    width = max(CLASSES, MEMBERS)
    for base, values in ((0, total.classes), (CLASS_ROWS, total.words), (CLASS_ROWS + WORD_ROWS, total.sides.reshape(-1, width))):
        some = np.flatnonzero(values.any(1))
        padded = np.zeros((len(some), width), np.float32)
        padded[:, : values.shape[1]] = values[some]
        for k in range(0, len(some), 4096):
            v = pa.array([x.tobytes() for x in padded[k : k + 4096]], pa.binary())
            yield pa.record_batch({"row": pa.array(base + some[k : k + 4096], pa.int64()), "v": v})


def _step(weights: np.ndarray, seen: np.ndarray, wanted: np.ndarray, prior: np.ndarray, step: float) -> np.ndarray:
    return (weights + step * np.log((seen + prior) / (wanted + prior))).astype(np.float32)


def train(docs: DataFrame, words: Words, steps: int = STEPS) -> Weights:
    """Weights after ``steps`` passes over all rows of ``docs``."""
    if not words.size:
        return no_weights()
    seen = summed(docs, words, None)
    p = np.exp(words.class_bias)
    # A place of a class is as likely as its words are on the whole; rows of words meet many classes.
    q = np.bincount(words.place, words.counts[: words.size] + 1.0, minlength=MEMBERS) / (words.counts[: words.size] + 1.0).sum()
    prior = [(PRIOR * np.maximum(x, 1e-4)).astype(np.float32) for x in (p, q, np.full(2, 0.5))]  # some classes and places may be empty
    weights = no_weights()
    # Without weights the model expects each class as often as its row is met.
    wanted = seen.classes.sum(1, keepdims=True) * p
    weights = weights._replace(classes=_step(weights.classes, seen.classes, wanted, prior[0], FIRST_STEP))
    for _ in range(1, steps):
        wanted = summed(docs, words, weights)
        weights = Weights(*(_step(*x, STEP) for x in zip(weights, seen, wanted, prior, strict=True)))
    return weights


def score(docs: DataFrame, learned: Column, counts: DataFrame, words: Words, weights: Weights) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row; ``learned`` tells the rows that were counted."""
    spark = small_batches(docs.sparkSession)
    shared = sent(spark, (words, weights))  # as large as the parameters say
    base_total = float(words.total + words.distinct + 1)
    shape = "doc_id long, digest long, learned boolean, n_tokens long, n_known long, base_score double, score double, rest array<string>, gains array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = received(shared)
        # A number of -1 is a word that is not hot: as if never seen, so far.
        base = np.log10((np.r_[known.counts, 0] + 1) / base_total)
        share = np.log10((np.r_[known.counts, 0] + 1) / known.rare_total)
        share[: known.size] = 0.0
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                made = tokens_of(part - part[0], data[part[0] : part[-1]], known)
                own = events(made, known)
                log = log_probabilities(own, known, model) / math.log(10) + share[made.number]
                # What the context tells of a rarer word holds for words seen; of others that is not known here.
                some = rarer(made, own, known)
                gain = np.zeros(len(log))
                gain[some.at] = rarer_gains(some, known, model) / math.log(10)
                seen = pc.fill_null(batch.column("learned").slice(a, b - a), False).to_numpy(zero_copy_only=False)
                seen = np.repeat(seen, np.diff(made.first)) | (made.number >= 0)
                log += np.where(seen, gain, 0)
                hit, low, high = (np.add.reduceat(x, made.first[:-1]) for x in (made.number >= 0, base[made.number], log))
                rest = np.flatnonzero((made.number < 0) & (made.ends > made.starts))
                size = made.ends[rest] - made.starts[rest]
                flat = made.data[ragged(made.starts[rest], size)]
                at = np.r_[0, np.cumsum(size)].astype(np.int64)
                strings = pa.Array.from_buffers(pa.large_string(), len(rest), [None, pa.py_buffer(at), pa.py_buffer(flat.tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, made.first), pa.int32()), strings.cast(pa.string()))
                kept = pa.array(np.where(seen[rest], 0, gain[rest]).astype(np.float32))
                columns = {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "digest", "learned")}
                columns["n_tokens"] = pa.array(np.diff(made.first), pa.int64())
                columns["n_known"] = pa.array(hit.astype(np.int64))
                yield pa.record_batch({**columns, "base_score": pa.array(low), "score": pa.array(high), "rest": lists, "gains": pa.ListArray.from_arrays(lists.offsets, kept)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("digest"), learned.alias("learned"))
    scored = stored(rows.mapInArrow(run, shape), "scored-texts")
    # A word of a learned row has been counted once at least; what a word adds beyond that is joined, once for
    # each id and text.
    once = F.when(F.col("learned"), F.size("rest")).otherwise(0)
    asked = scored.filter(F.size("rest") > 0).dropDuplicates(["doc_id", "digest"])
    asked = asked.select("doc_id", "digest", "learned", F.inline(F.arrays_zip(F.col("rest").alias("word"), F.col("gains").alias("gain"))))
    more = asked.join(counts.hint("shuffle_hash"), "word").filter((F.col("c") > 1) | ~F.col("learned"))
    more = more.groupBy("doc_id", "digest").agg(
        F.sum(F.when(F.col("learned"), 0).otherwise(1)).alias("more_known"),
        F.sum(F.log10((F.col("c") + 1) / F.when(F.col("learned"), 2.0).otherwise(1.0))).alias("more_log"),
        F.sum(F.col("gain").cast("double")).alias("more_gain"),
    )
    more = stored(more, "rest-words")
    same = scored["doc_id"].eqNullSafe(more["doc_id"]) & (scored["digest"] == more["digest"])
    added = once * math.log10(2) + F.coalesce("more_log", F.lit(0.0))
    return scored.join(more.hint("shuffle_hash"), same, "left").select(
        scored["doc_id"],
        "n_tokens",
        (F.col("n_known") + once + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + added).alias("base_score"),
        (F.col("score") + added + F.coalesce("more_gain", F.lit(0.0))).alias("score"),
    )


def language_model(docs: DataFrame, learned: Column, steps: int = STEPS, hot_words: int = HOT_WORDS) -> tuple[DataFrame, Words]:
    """Scores of ``docs`` by a model of its rows for which ``learned`` holds, and the model's words."""
    small_batches(docs.sparkSession)
    own = docs.filter(learned)
    counts = word_counts(own)
    words = vocabulary(counts, hot_words)
    return score(docs, learned, counts, words, train(own, words, steps)), words


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those not held out."""
    docs = table(spark, sf_dir, "documents")
    made, words = language_model(docs, ~held_out())
    return made.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


QUERIES = {"op12_lm_score": op12_lm_score}
SQL: dict[str, str] = {}
