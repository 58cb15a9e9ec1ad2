"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read a clause word by word, each what the one before wrote: negation and reported
speech rewrite insults and threats in their reach, insult and threat write a slot and carry the word's
weight (learned from labels), and target rewrites the slots at the clause's end. They are composed into
one weighted transducer over word classes; a clause weighs on each slot what its heaviest arc does:
an insult counts more with a target, hardly when negated or reported; a threat counts only with a
target. Isolated words outside a matched clause count nothing. A text's matched clauses give a handful of numbers, and a logistic curve
over these, fitted on the same labels, gives the score.

Learned from a bounded sample: at most ``SAMPLE_ROWS`` texts of each label, by hash of the id. The
insult lexicon holds whole words and word beginnings that are found in many toxic texts and in hardly
any other. Language, source and id are no input of a score.

Defined cases: a null or empty text has no clause and gets the base score; without labels the
lexicon is the seed words and the curve a fixed one; labels of rows with a null id are never used;
rows that repeat a doc_id are scored each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, received, sent, small_batches, stored, table, text_bytes
from riskloom.llm.pretokens import HashIndex, lower_latin, running_hash, span_hashes
from riskloom.llm.words import words_of

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SAMPLE_ROWS = 3000  # texts of each label
STEMS = (4, 5, 6, 8)  # bytes of a word's beginning, besides the whole word
LEAST_TEXTS, LEAST_RATE, CANDIDATES = 3, 0.95, 5000  # to be a candidate of the lexicon
COVER, LEAST_GAIN = 2, 3  # a word enters for so many toxic texts not covered twice, whatever the sample's size
NEGATION_REACH = 3  # words a negation covers

# Seed words of the grammar.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown"
THREATS = "kill hurt destroy shoot stab burn beat attack töten schlagen tuer frapper matar golpear"
TARGETS = "you your yours they them he she him her these those dich dir ihr euch sie du tu vous toi tú usted ustedes"
NEGATIONS = "not no never neither nor isn aren wasn don doesn nicht kein keine keinen nie pas jamais aucun nunca ningún tampoco"
REPORTS = "said says say wrote writes called calls quoted quote claimed alleged reportedly sagte schrieb nannte dit écrit appelé dijo escribió llamó"

# Word classes, what is written for them, and the slots of the result.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED = range(8)
CLASSES, SYMBOLS = 6, 8
NOTHING, PLAIN, AIMED, DENIED, QUOTED, THREATENED = range(6)
SLOTS = ("plain", "aimed", "negated", "reported", "threats")  # of PLAIN, AIMED, ...
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n()|"]] = True


class Transducer(NamedTuple):
    """States 0..n-1, start 0; by state and symbol read: the next state, the symbol written, and the
    share of the word's weight that the arc carries. ``slot`` (if the machine writes slots) and ``last``
    (what becomes of a slot when the clause ends in a state) are by symbol and by state and slot."""

    step: np.ndarray
    write: np.ndarray
    weight: np.ndarray
    slot: np.ndarray
    last: np.ndarray


def machine(states: int) -> Transducer:
    """Reads anything, changes nothing."""
    stay = np.repeat(np.arange(states)[:, None], SYMBOLS, 1)
    same = np.repeat(np.arange(SYMBOLS)[None, :], states, 0)
    slots = np.repeat(np.arange(len(SLOTS) + 1)[None, :], states, 0)
    return Transducer(stay, same, np.zeros((states, SYMBOLS)), np.zeros(SYMBOLS, int), slots)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """State n: a negation covers the next n words; it is used up as words pass, not by other negations."""
    made = machine(reach + 1)
    made.step[:] = np.maximum(0, made.step - 1)
    made.step[:, NEGATION] = reach
    made.write[1:, INSULT], made.write[1:, THREAT] = NEGATED, OTHER
    return made


def reported() -> Transducer:
    made = machine(2)
    made.step[0, REPORT] = 1
    made.write[1, INSULT] = REPORTED
    return made


def insult() -> Transducer:
    made = machine(1)
    for symbol, slot in ((INSULT, PLAIN), (NEGATED, DENIED), (REPORTED, QUOTED)):
        made.slot[symbol], made.weight[0, symbol] = slot, 1.0
    return made


def threat() -> Transducer:
    made = machine(1)
    made.slot[THREAT], made.weight[0, THREAT] = THREATENED, 1.0
    return made


def target() -> Transducer:
    """The target may come before or after what is aimed at it."""
    made = machine(2)
    made.step[0, TARGET] = 1
    made.last[1, PLAIN], made.last[0, THREATENED] = AIMED, NOTHING
    return made


class Composed(NamedTuple):
    """By state and word class: next state, slot written, share of the weight; by state and slot: the
    slot at the end. ``states`` has the states of the parts."""

    step: np.ndarray
    slot: np.ndarray
    weight: np.ndarray
    last: np.ndarray
    states: list[tuple[int, ...]]


def compose(*parts: Transducer) -> Composed:
    """Each part reads what the one before wrote."""
    states = list(product(*(range(len(p.step)) for p in parts)))
    number = {s: k for k, s in enumerate(states)}
    step, slot = np.zeros((len(states), CLASSES), int), np.zeros((len(states), CLASSES), int)
    weight, last = np.zeros((len(states), CLASSES)), np.zeros((len(states), len(SLOTS) + 1), int)
    for own, at in number.items():
        for kind in range(CLASSES):
            symbol, after = kind, []
            for part, state in zip(parts, own, strict=True):
                after.append(int(part.step[state, symbol]))
                slot[at, kind] = max(slot[at, kind], part.slot[symbol])
                weight[at, kind] += part.weight[state, symbol]
                symbol = int(part.write[state, symbol])
            step[at, kind] = number[tuple(after)]
        for first in range(len(SLOTS) + 1):
            end = first
            for part, state in zip(parts, own, strict=True):
                end = int(part.last[state, end])
            last[at, first] = end
    return Composed(step, slot, weight, last, states)


GRAMMAR = compose(negation(), reported(), insult(), threat(), target())
_STEP, _SLOT, _SHARE, _LAST = (x.tolist() for x in GRAMMAR[:4])


def clause_weights(kinds: list[int], weights: list[float]) -> tuple[float, ...]:
    """Weight of a clause on each slot: that of its heaviest arc."""
    state, found = 0, [0.0] * (len(SLOTS) + 1)
    for kind, weight in zip(kinds, weights, strict=True):
        slot = _SLOT[state][kind]
        found[slot] = max(found[slot], weight * _SHARE[state][kind])
        state = _STEP[state][kind]
    out = [0.0] * (len(SLOTS) + 1)
    for slot, end in enumerate(_LAST[state]):
        out[end] = max(out[end], found[slot])
    return tuple(out[1:])


class Grammar:
    """Word classes by hash, whole words before word beginnings."""

    def __init__(self, lexicon: list[tuple[int, int, float]]) -> None:
        """``lexicon``: (bytes of the beginning or 0 for whole words, hash, weight) of insults."""
        self.weights = np.ones(1)
        self.tables: dict[int, HashIndex] = {}
        learned: dict[int, dict[int, float]] = {}
        for size, word, weight in lexicon:
            learned.setdefault(size, {})[word] = weight
        self.kinds = np.array([OTHER], np.int8)
        fixed = {}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            fixed |= dict.fromkeys(word_hashes(words).tolist(), kind)
        for size in sorted({0, *learned}):
            entries = {h: (INSULT, w) for h, w in learned.get(size, {}).items()}
            if size == 0:
                entries = {h: (k, 1.0) for h, k in fixed.items()} | entries
            index = HashIndex(8)
            base = len(self.kinds)
            index.add(np.array(list(entries), np.uint64), base + np.arange(len(entries)))
            self.kinds = np.r_[self.kinds, np.array([k for k, _ in entries.values()], np.int8)]
            self.weights = np.r_[self.weights, np.array([w for _, w in entries.values()])]
            self.tables[size] = index

    def slots(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """(texts, 8): sum over matched clauses of each slot, largest effective weight, matched
        clauses, and all words."""
        out = np.zeros((len(offsets) - 1, 8))
        words = words_of(offsets, data)
        out[:, 7] = np.diff(words.first)
        if not len(words.hashes):
            return out
        entry = np.maximum(self.tables[0].find(words.hashes), 0)
        size = words.ends - words.starts
        low = lower_latin(data)
        total = running_hash(low)
        for stem, index in self.tables.items():
            if stem:
                longer = np.flatnonzero((size > stem) & (entry == 0))
                hashes = span_hashes(low, words.starts[longer], words.starts[longer] + stem, total)
                entry[longer] = np.maximum(index.find(hashes), 0)
        kind = self.kinds[entry]
        hit = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(hit):
            return out
        breaks = np.unique(np.r_[np.flatnonzero(BREAKS[data]), offsets])
        clause = np.unique(np.searchsorted(breaks, words.starts[hit], side="right"))
        edges = np.r_[breaks, len(data)]
        first, last = np.searchsorted(words.starts, edges[clause - 1]), np.searchsorted(words.starts, edges[clause])
        text = np.searchsorted(words.first, first, side="right") - 1
        for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True):
            made = clause_weights(kind[a:b].tolist(), self.weights[entry[a:b]].tolist())
            if any(made):
                out[t, :5] += made
                out[t, 5] = max(out[t, 5], made[0], made[1], made[4])
                out[t, 6] += 1
        return out


def word_hashes(words: str) -> np.ndarray:
    return words_of(*text_bytes(pa.array([words]))).hashes


def curve_inputs(slots: np.ndarray) -> np.ndarray:
    dense = (slots[:, 0] + slots[:, 1]) / np.log2(slots[:, 7] + 8)
    return np.column_stack([np.ones(len(slots)), np.log1p(slots[:, :7]), np.log1p(dense)])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        beta += np.clip(move, -5, 5)
    return beta


def held_out() -> Column:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def learning_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of at most ``rows`` labelled texts of each label, equal texts once, and how
    many rows have each label in all."""
    usable = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    number = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    share = F.when(F.col("toxic") == 1, F.lit((2.0 * rows + 50) / max(1, number.get(1, 0))))
    share = share.otherwise(F.lit((2.0 * rows + 50) / max(1, number.get(0, 0))))
    drawn = usable.withColumn("draw", draw).filter(F.col("draw") < F.least(F.lit(1.0), share) * float(2**63))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "doc_id"))
    picked = drawn.withColumn("rank", rank).filter(F.col("rank") <= rows).select("doc_id", "toxic")
    # At most ``rows`` slim rows of each label are broadcast.
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return texts.dropDuplicates(["text", "toxic"]).select("text", "toxic"), number


def _stems(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of beginning (0: whole words), the hash and the text of every word."""
    offsets, data = text_bytes(batch.column("text"))
    words = words_of(offsets, data)
    low = lower_latin(data)
    total = running_hash(low)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    size = words.ends - words.starts
    for stem in (0, *STEMS):
        at = np.flatnonzero(size > stem)
        if len(at):
            starts = words.starts[at]
            yield stem, span_hashes(low, starts, starts + stem, total) if stem else words.hashes[at], text[at]


def learn_lexicon(sample: DataFrame) -> list[tuple[int, int, float]]:
    """Words and word beginnings of insults with their weights (log odds).

    Candidates are those that many toxic texts and hardly any others have. Of these a word enters
    while it is found in enough toxic texts that chosen ones do not cover yet: words that only
    keep company with insults add nothing and stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for stem, hashes, text in _stems(batch):
                order = np.lexsort((text, hashes))
                h, t = hashes[order], text[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]
                h, t = h[once], t[once]
                names, where = np.unique(h, return_inverse=True)
                yield pa.record_batch(
                    {
                        "stem": pa.array(np.full(len(names), stem, np.int32)),
                        "hash": pa.array(names.view(np.int64)),
                        "texts": pa.array(np.bincount(where).astype(np.int64)),
                        "bad": pa.array(np.bincount(where, toxic[t]).astype(np.int64)),
                    }
                )

    counted = sample.mapInArrow(run, "stem int, hash long, texts long, bad long")
    counted = counted.groupBy("stem", "hash").agg(F.sum("texts").alias("texts"), F.sum("bad").alias("bad"))
    found = counted.filter((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= LEAST_RATE * F.col("texts")))
    rows = found.orderBy(F.col("bad").desc(), "texts", "stem", "hash").limit(CANDIDATES).collect()
    number = {(r["stem"], r["hash"] % 2**64): k for k, r in enumerate(rows)}

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for stem in (0, *STEMS):
            own = {h: k for (s, h), k in number.items() if s == stem}
            held[stem] = HashIndex(8)
            held[stem].add(np.array(list(own), np.uint64), np.array(list(own.values()), np.int64))
        for batch in batches:
            size = batch.num_rows
            parts = [np.zeros(0, np.int64)]
            for stem, hashes, text in _stems(batch):
                which = held[stem].find(hashes)
                parts.append(np.unique(text[which >= 0] * len(number) + which[which >= 0]))
            keys = np.sort(np.concatenate(parts))
            texts = np.split(keys % max(1, len(number)), np.searchsorted(keys, np.arange(1, size) * len(number)))
            yield pa.record_batch({"has": pa.array(texts[:size], pa.list_(pa.int64()))})

    # At most the sampled toxic texts, each with the candidates it has.
    lists = sample.filter("toxic = 1").mapInArrow(having, "has array<long>").toPandas()["has"] if rows else []
    has = np.zeros((len(lists), len(rows)), bool)
    for k, own in enumerate(lists):
        has[k, np.asarray(own, np.int64)] = True
    covered, chosen = np.zeros(len(has), np.int64), []
    while has.size:
        gain = has[covered < COVER].sum(0)
        best = int(gain.argmax())
        if gain[best] < LEAST_GAIN:
            break
        chosen.append(rows[best])
        covered += has[:, best]
        has[:, best] = False
    return [
        (r["stem"], r["hash"] % 2**64, float(np.log((r["bad"] + 0.5) / (r["texts"] - r["bad"] + 0.5)))) for r in chosen
    ]


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Grammar, np.ndarray]:
    """Grammar and curve."""
    small_batches(docs.sparkSession)
    sample, number = learning_sample(docs, labels, rows)
    sample = stored(sample, "toxic-sample")
    lexicon = learn_lexicon(sample)
    if not lexicon:
        lexicon = [(0, h, 3.0) for h in word_hashes(INSULTS).tolist()]
    grammar = Grammar(lexicon)
    shared = sent(docs.sparkSession, grammar)  # bounded by the lexicon's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = received(shared)
        for batch in batches:
            made = patterns.slots(*text_bytes(batch.column("text")))
            yield pa.record_batch({"toxic": batch.column("toxic"), "slots": pa.array(list(made), pa.list_(pa.float64()))})

    frame = sample.mapInArrow(run, "toxic int, slots array<double>").toPandas()  # a bounded number of rows
    if frame["toxic"].nunique() < 2:
        return grammar, np.array([-2.5, *([1.0] * 2), 0.0, 0.0, 1.0, 1.0, 0.5, 0.0])
    y = frame["toxic"].to_numpy(float)
    # Labels are drawn at unlike rates; weigh them back to how often they are.
    seen = np.bincount(y.astype(int), minlength=2)
    weight = np.array([number.get(k, 0) / max(1, seen[k]) for k in (0, 1)])[y.astype(int)]
    weight *= len(y) / weight.sum()
    return grammar, fit_curve(curve_inputs(np.stack(frame["slots"].to_numpy())), y, weight)


def toxicity(docs: DataFrame, grammar: Grammar, curve: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, matched_clauses of every row."""
    spark = small_batches(docs.sparkSession)
    shared = sent(spark, (grammar, curve))  # bounded by the lexicon's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, beta = received(shared)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            made = [np.zeros((0, 8))]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                made.append(patterns.slots(part - part[0], data[part[0] : part[-1]]))
            made = np.concatenate(made)
            score = 1 / (1 + np.exp(-np.clip(curve_inputs(made) @ beta, -30, 30)))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(score),
                    "predicted": pa.array((score >= threshold).astype(np.int32)),
                    "matched_clauses": pa.array(made[:, 6].astype(np.int64)),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, matched_clauses long")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, whole texts."""
    docs = table(spark, sf_dir, "documents")
    made = toxicity(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", held_out().alias("held_out"), "score", "predicted", "matched_clauses")


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
