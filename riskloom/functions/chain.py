"""Greedy chains: accept a row, skip what is too close to it, accept the next.

Alert cooldown, penalty boxes, dedup horizons, accumulate-and-clear scores and
"skip past last row" are all this one rule on some axis (time or running sum):
accept the first candidate whose ``lo`` reaches the current entry point, then
move the entry point to its ``hi + gap``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.ordered import CHUNK, KeyedRows, any_null
from riskloom.session import dealt

_NEVER = -(1 << 62)
# A block spans this many gaps, so a jump table has one entry per distinct
# position inside one gap at most, whatever the block holds.
_GAPS_PER_BLOCK = 64
_MIN_BLOCK = 1 << 20
_FOLD_BLOCK = 128


def greedy_chain(
    candidates: KeyedRows,
    key: Sequence[str],
    lo: str,
    hi: str,
    gap: int,
    start: int | None = None,
) -> KeyedRows:
    """Rows of ``candidates`` accepted by the greedy rule, per ``key``.

    ``lo`` and ``hi`` are non-decreasing in the order of ``candidates``;
    ``gap`` > 0; ``start`` is the first entry point (default: accept the first
    candidate). Cold keys fold in the JVM; a hot key goes through jump tables
    built block by block in parallel.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    entry = _NEVER if start is None else start
    accepted = _fold(candidates.cold(), key, candidates.order, lo, hi, gap, entry)
    if candidates.chunked:
        hot = _jump(candidates.hot(), key, candidates.order, lo, hi, gap, entry)
        accepted = accepted.unionByName(hot)
    return replace(candidates, rows=accepted, dealt=False)


def _fold(df: DataFrame, key, order, lo, hi, gap, entry) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    first = [*order, *[c for c in rest if c not in order]]
    row = F.struct(*first)
    grouped = df.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    row_type = df.select(row.alias("r")).schema["r"].dataType

    # Appending to the result copies it, so a long array is walked in blocks:
    # first only the entry point runs through them, then each block keeps its rows.
    starts_at = F.sequence(F.lit(1), F.size("_rows"), F.lit(_FOLD_BLOCK))
    blocks = F.transform(starts_at, lambda i: F.slice("_rows", i, F.lit(_FOLD_BLOCK)))

    def jump(at: Column, x: Column) -> Column:
        return F.when(x[lo] >= at, x[hi].cast("long") + F.lit(gap)).otherwise(at)

    walked = F.aggregate(
        "_blocks",
        F.struct(F.lit(entry).cast("long").alias("at"), F.array().cast("array<bigint>").alias("entries")),
        lambda acc, block: F.struct(
            F.aggregate(block, acc["at"], jump).alias("at"),
            F.concat(acc["entries"], F.array(acc["at"])).alias("entries"),
        ),
        lambda acc: acc["entries"],
    )

    def keep(acc: Column, x: Column) -> Column:
        taken = F.struct(
            (x[hi].cast("long") + F.lit(gap)).alias("at"), F.concat(acc["kept"], F.array(x)).alias("kept")
        )
        return F.when(x[lo] >= acc["at"], taken).otherwise(acc)

    kept = F.aggregate(
        F.col("_block.rows"),
        F.struct(F.col("_block.entry").alias("at"), F.array().cast(T.ArrayType(row_type)).alias("kept")),
        keep,
        lambda acc: acc["kept"],
    )
    zipped = F.arrays_zip(F.col("_blocks").alias("rows"), walked.alias("entry"))
    per_block = (
        grouped.withColumn("_blocks", blocks).select(*key, F.explode(zipped).alias("_block"))
    )
    return per_block.select(*key, F.inline(kept)).select(*df.columns)


def _jump(df: DataFrame, key, order, lo, hi, gap, entry) -> DataFrame:
    """Exact parallel form for hot keys.

    1. Rows that share a ``lo`` collapse to the first of them, in each chunk before any row moves; only what
       the chain reads is dealt out and stored, by block.
    2. Each block of the axis becomes a jump table: entry point -> exit point.
    3. The small tables of a key are walked in block order.
    4. Each block replays from its now known entry point.

    There may be as many keys as rows, so a task takes its sorted rows by the
    batch, many blocks or keys at once.
    """
    key = list(key)
    block_len = max(_GAPS_PER_BLOCK * gap, _MIN_BLOCK)
    payload = F.struct(*df.columns)
    position = F.struct(*order)
    block = [*key, "_block"]
    axis = F.col(lo).cast("long")
    named = df.withColumns({"_lo": axis, "_block": F.floor(axis / F.lit(block_len)).cast("long")})
    here = F.struct(position.alias("at"), F.col(hi).cast("long").alias("hi"))
    first = named.groupBy(*key, CHUNK, "_block", "_lo").agg(F.min(here).alias("_first"))

    def collapsed(rows: DataFrame) -> DataFrame:
        of_all = F.min(F.struct("_first.at", "_first.hi", F.col(CHUNK).alias("chunk"))).alias("_first")
        one = rows.groupBy(*block, "_lo").agg(of_all)
        return one.select(*block, "_lo", F.col("_first.hi").alias("_hi"), F.col("_first.chunk").alias(CHUNK))

    slim = dealt(first, block, ["_lo"], collapsed)
    nulls = not slim.filter(any_null(key)).isEmpty()
    keys = T.StructType([f for f in df.schema.fields if f.name in key])
    table_type = T.StructType([*keys, *(T.StructField(n, T.LongType()) for n in ("_block", "_lo", "_exit"))])
    entry_type = T.StructType([*keys, *(T.StructField(n, T.LongType()) for n in ("_block", "_entry"))])
    kept_type = T.StructType([*keys, T.StructField(CHUNK, T.IntegerType()), T.StructField("_lo", T.LongType())])

    def jump_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, block):
            at, exits = block_exits(_longs(rows, "_lo"), _longs(rows, "_hi"), gap, _group_ids(rows, block))
            found = rows.select([*block, "_lo"]).take(pa.array(at))
            yield from _as_batches(found.append_column("_exit", pa.array(exits, pa.int64())), table_type)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, key):
            lows, exits = _longs(rows, "_lo"), _longs(rows, "_exit")
            blocks, entries = _starts(rows, block), []
            ends = [*np.searchsorted(blocks, _starts(rows, key)), len(blocks)]
            bounds = [*blocks.tolist(), rows.num_rows]
            for begin, end in zip(ends[:-1], ends[1:]):
                entries += walk_tables(lows, exits, bounds[begin : end + 1], entry)
            found = rows.select(block).take(pa.array(blocks))
            yield from _as_batches(found.append_column("_entry", pa.array(entries, pa.int64())), entry_type)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, block):
            lows, highs, entries = (_longs(rows, n) for n in ("_lo", "_hi", "_entry"))
            bounds, kept = [*_starts(rows, block).tolist(), rows.num_rows], []
            for begin, end in zip(bounds[:-1], bounds[1:]):
                kept += [begin + i for i in replay_block(lows[begin:end], highs[begin:end], gap, int(entries[begin]))]
            yield from _as_batches(rows.select([*key, CHUNK, "_lo"]).take(pa.array(kept, pa.int64())), kept_type)

    tables = _in_groups(slim.drop(CHUNK), block, ["_lo"]).mapInArrow(jump_tables, table_type)
    entries = _in_groups(tables, key, ["_block", "_lo"]).mapInArrow(walk, entry_type)
    begun = _in_groups(_join(slim, entries, block, nulls), block, ["_lo"])
    kept = begun.mapInArrow(replay, kept_type)
    # The accepted rows by themselves; of those that share a ``lo`` and a chunk, the first.
    found = _join(named, kept, [*key, CHUNK, "_lo"], nulls)
    rows = found.groupBy(*key, CHUNK, "_lo").agg(F.min_by(payload, position).alias("_row"))
    return rows.select("_row.*").select(*df.columns)


def _in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of one group next to each other and in order; a task has many groups. Rows dealt so stay where they are."""
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def _starts(rows: pa.Table, group: Sequence[str]) -> np.ndarray:
    """Positions at which a group begins; a null is a value."""
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = False
    for name in group:
        column = rows.column(name)
        here, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        other = pc.fill_null(pc.not_equal(here, before), False).to_numpy()
        new[1:] |= other | (pc.is_null(here).to_numpy() != pc.is_null(before).to_numpy())
    return np.flatnonzero(new)


def _group_ids(rows: pa.Table, group: Sequence[str]) -> np.ndarray:
    begins = np.zeros(rows.num_rows, dtype=np.int64)
    begins[_starts(rows, group)] = 1
    return np.cumsum(begins)


def whole_groups(batches: Iterable[pa.RecordBatch], group: Sequence[str]) -> Iterator[pa.Table]:
    """Batches regrouped so that no group is in two of them; the rows of a group are neighbours."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        # With the last row held, so that a group may begin at the first row of this batch.
        joined = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), part]) if held else part
        begins = _starts(joined, group)[1:] - len(joined) + len(part)
        if len(begins):
            cut = int(begins[-1])
            yield pa.concat_tables([*held, part.slice(0, cut)])
            held = [part.slice(cut)]
        else:
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _longs(rows: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(rows.column(name), 0).to_numpy()


def _as_batches(rows: pa.Table, schema: T.StructType) -> list[pa.RecordBatch]:
    return rows.select(schema.names).to_batches()


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], nulls: bool) -> DataFrame:
    """Join that leaves ``left`` as it lies, unless a key may be null; a null key is a key."""
    names = {c: f"_r_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) if nulls else F.col(c) == F.col(n) for c, n in names.items()]
    return left.join(right if nulls else right.hint("shuffle_hash"), same).drop(*names.values())


def block_exits(
    lo: np.ndarray, hi: np.ndarray, gap: int, group: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Where the chain leaves a block, for every entry that makes a difference.

    Returns row positions and exit points: entering at or before ``lo[at]`` (and
    after the previous position) leaves at ``exit``. ``group`` numbers the blocks
    of rows that lie one after the other, if there are several.
    """
    n = len(lo)
    group = np.zeros(n, dtype=np.int64) if group is None else group
    # Ranks instead of positions: blocks side by side on one axis that cannot overflow.
    rank = np.unique(np.concatenate([lo, hi + gap]), return_inverse=True)[1].ravel()
    side = group * (2 * n + 1)
    following = np.searchsorted(side + rank[:n], side + rank[n:], side="left")
    leaves = np.append(group, -1)[following] != group
    last = np.where(leaves, np.arange(n), following)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    exits = hi[last] + gap
    at = np.flatnonzero(np.append((exits[1:] != exits[:-1]) | (group[1:] != group[:-1]), True)[:n])
    return at, exits[at]


def walk_tables(lo: np.ndarray, exits: np.ndarray, bounds: Sequence[int], entry: int) -> list[int]:
    """Entry point of every block, walking the jump tables in block order."""
    entries = []
    for begin, end in zip(bounds[:-1], bounds[1:]):
        entries.append(entry)
        i = begin + int(np.searchsorted(lo[begin:end], entry, side="left"))
        if i < end:
            entry = int(exits[i])
    return entries


def replay_block(lo: np.ndarray, hi: np.ndarray, gap: int, entry: int) -> list[int]:
    kept, i = [], int(np.searchsorted(lo, entry, side="left"))
    while i < len(lo):
        kept.append(i)
        i = int(np.searchsorted(lo, hi[i] + gap, side="left"))
    return kept
