"""Per-key ordered history that survives a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a
key with more than ``max_rows`` rows is cut into contiguous chunks of its own
order, so windows run per (key, chunk), and what a chunk needs to know about
the chunks before it travels in a small carry table. Keys below the limit, that
is nearly all keys, keep the plain window and pay nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_as_dealt, cut_lineage, dealt

CHUNK = "_chunk"
COLD = -1
DEFAULT_MAX_ROWS = 250_000
# Up to this many split points of all hot keys together are sent to every task; beyond it
# they stay a table and are joined.
MAX_SENT_SPLITS = 100_000
# A row is joined with so many split points of its key at a time.
SPLIT_FAN = 256
_SAMPLES_PER_CHUNK = 64


@dataclass(frozen=True)
class KeyedRows:
    """Rows with a key and a total order inside each key.

    ``chunked`` tells that some key is hot; the rows then carry ``_chunk``:
    -1 on a cold key, the chunk number on a hot one. ``dealt`` tells that they are
    stored by key and chunk, so that history moves none of them. ``nulls`` tells
    that a hot key may be null, for which joins have to move them after all.
    """

    rows: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool = False
    dealt: bool = False
    nulls: bool = True

    def with_rows(self, rows: DataFrame) -> KeyedRows:
        return replace(self, rows=rows)

    def with_column(self, name: str, value: Column) -> KeyedRows:
        return self.with_rows(self.rows.withColumn(name, value))

    def filter(self, condition: Column) -> KeyedRows:
        return self.with_rows(self.rows.filter(condition))

    def staged(self, always: bool = False) -> KeyedRows:
        """Store the rows if a key is hot, or in any case; several passes over them follow."""
        if self.chunked or always:
            return self.with_rows((cut_as_dealt if self.dealt else cut_lineage)(self.rows))
        return self

    def cold(self) -> DataFrame:
        return self.rows.filter(F.col(CHUNK) == COLD) if self.chunked else self.rows

    def hot(self) -> DataFrame:
        return self.rows.filter(F.col(CHUNK) >= 0)

    def result(self) -> DataFrame:
        return self.rows.drop(CHUNK)

    def history(
        self,
        lasts: Mapping[str, Column] | None = None,
        sums: Mapping[str, Column] | None = None,
        lags: Mapping[str, tuple[Column, int]] | None = None,
        reverse: bool = False,
    ) -> KeyedRows:
        """Add columns that look back over the rows of the same key.

        lasts: latest non-null value strictly before the row.
        sums:  running sum up to and including the row.
        lags:  the n-th latest non-null value strictly before the row; lags of the same
               column object share their input, their count and what chunks carry.
        reverse: look forward instead of back (``lasts`` only).
        """
        lasts, sums, lags = dict(lasts or {}), dict(sums or {}), dict(lags or {})
        if reverse and (sums or lags):
            raise ValueError("reverse supports lasts only")
        if not (lasts or sums or lags):
            return self

        inputs = {f"_in_{n}": e for n, e in lasts.items()}
        inputs |= {f"_in_{n}": e for n, e in sums.items()}
        same: dict[int, str] = {}
        source = {n: same.setdefault(id(e), n) for n, (e, _) in lags.items()}  # the first lag of the same column
        inputs |= {f"_in_{n}": lags[n][0] for n in same.values()}
        rows = self.rows.withColumns(inputs)

        parts = [*self.key, CHUNK] if self.chunked else list(self.key)
        ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        window = Window.partitionBy(*parts).orderBy(*ordering)
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        upto = window.rowsBetween(Window.unboundedPreceding, 0)

        local = {n: F.last(f"_in_{n}", ignorenulls=True).over(before) for n in lasts}
        local |= {n: F.sum(f"_in_{n}").over(upto) for n in sums}
        over = f"over (partition by {', '.join(parts)} order by {', '.join(self.order)})"
        for n, (_, back) in lags.items():
            local[n] = F.expr(f"lag(`_in_{source[n]}`, {back}) ignore nulls {over}")
        if self.chunked:
            local |= {f"_seen_{n}": F.count(f"_in_{n}").over(before) for n in same.values()}
        out = rows.withColumns(local)
        if self.chunked:
            out = self._add_carry(rows, out, lasts, sums, lags, source, reverse)
        return self.with_rows(out.drop(*inputs))

    def _add_carry(self, rows, out, lasts, sums, lags, source, reverse) -> DataFrame:
        # One row per chunk of a hot key. Stored, so that a sequence of history() calls reads the
        # rows once per call and not once more for every later call.
        widest = {s: max(back for n, (_, back) in lags.items() if source[n] == s) for s in source.values()}
        carry = self._carry(rows.filter(F.col(CHUNK) >= 0), lasts, sums, widest, reverse)
        # The rows lie by key and chunk and in order, and this join leaves them so.
        carry = dealt(carry, [*self.key, CHUNK], []) if self.dealt else cut_lineage(carry)
        out = _join_on(out, carry.hint("shuffle_hash"), [*self.key, CHUNK], "left", False, self.nulls)
        merged = {n: F.coalesce(F.col(n), F.col(f"_carry_{n}")) for n in lasts}
        merged |= {
            n: F.when(F.col(f"_carry_{n}").isNull(), F.col(n)).otherwise(
                F.coalesce(F.col(n), F.lit(0)) + F.col(f"_carry_{n}")
            )
            for n in sums
        }
        for n, (_, back) in lags.items():
            missing = F.lit(back) - F.col(f"_seen_{source[n]}")
            past = F.col(f"_carry_{source[n]}")
            merged[n] = F.when(missing <= 0, F.col(n)).when(
                F.size(past) >= missing, F.get(past, (F.size(past) - missing).cast("int"))
            )
        names = [*lasts, *sums, *widest]
        return out.withColumns(merged).drop(*[f"_carry_{n}" for n in names], *[f"_seen_{n}" for n in widest])

    def _carry(self, hot, lasts, sums, lags, reverse) -> DataFrame:
        parts = [*self.key, CHUNK]
        position = F.struct(*self.order)
        pick = F.min_by if reverse else F.max_by
        # Values still to come, as total minus running count: a frame that only
        # ends at the last row would be aggregated anew for every row.
        ordered = Window.partitionBy(*parts).orderBy(*self.order)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        for n, back in lags.items():
            to_come = F.count(f"_in_{n}").over(whole) - F.count(f"_in_{n}").over(upto)
            hot = hot.withColumn(
                f"_tail_{n}",
                F.when(
                    F.col(f"_in_{n}").isNotNull() & (to_come < back),
                    F.struct(position.alias("p"), F.col(f"_in_{n}").alias("v")),
                ),
            )
        aggs = [
            pick(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_carry_{n}") for n in lasts
        ]
        aggs += [F.sum(f"_in_{n}").alias(f"_carry_{n}") for n in sums]
        aggs += [
            F.transform(F.sort_array(F.collect_list(f"_tail_{n}")), lambda x: x["v"]).alias(f"_tail_{n}")
            for n in lags
        ]
        per_chunk = hot.groupBy(*parts).agg(*aggs)

        chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
        earlier = (
            Window.partitionBy(*self.key).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
        )
        shifted = {f"_carry_{n}": F.last(f"_carry_{n}", ignorenulls=True).over(earlier) for n in lasts}
        shifted |= {f"_carry_{n}": F.sum(f"_carry_{n}").over(earlier) for n in sums}
        per_chunk = per_chunk.withColumns(shifted)
        so_far = Window.partitionBy(*self.key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
        for n, back in lags.items():
            # Number the chunks that hold a value; the last `back` of them
            # hold at least `back` values, so the frame stays small.
            own = F.when(F.size(f"_tail_{n}") > 0, F.col(f"_tail_{n}"))
            per_chunk = per_chunk.withColumn(f"_own_{n}", own)
            per_chunk = per_chunk.withColumn(f"_filled_{n}", F.count(f"_own_{n}").over(so_far))
            frame = Window.partitionBy(*self.key).orderBy(f"_filled_{n}").rangeBetween(-back, 0)
            gathered = F.flatten(F.collect_list(f"_own_{n}").over(frame))
            per_chunk = per_chunk.withColumn(f"_all_{n}", gathered)
            size_before = F.size(f"_all_{n}") - F.size(f"_tail_{n}")
            per_chunk = per_chunk.withColumn(f"_carry_{n}", F.slice(f"_all_{n}", F.lit(1), size_before))
        return per_chunk.select(*parts, *[f"_carry_{n}" for n in [*lasts, *sums, *lags]])


def any_null(key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])


def _join_on(rows: DataFrame, table: DataFrame, key: Sequence[str], how: str, send: bool, nulls: bool) -> DataFrame:
    """Join with a table of this module, sent to every task where it is known to be small.

    A null key is a key; only if the table has one (``nulls``) the join has to compare in the way that takes
    rows out of their deal.
    """
    names = {k: f"_k_{k}" for k in key}
    table = table.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) if nulls else F.col(k) == F.col(n) for k, n in names.items()]
    return rows.join(F.broadcast(table) if send else table, same, how).drop(*names.values())


def keyed_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], max_rows: int = DEFAULT_MAX_ROWS
) -> KeyedRows:
    """Find hot keys (one narrow, map-side combined count) and cut them into chunks.

    Split points come from a hash sample of the hot keys' order columns, so
    chunks hold about ``max_rows`` rows whatever the distribution in time; the
    sample only places the cuts and never decides a result.
    """
    key, order = tuple(key), tuple(order)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    found = counts.agg(
        F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("n"), F.max("_n").alias("most"), F.max(any_null(key)).alias("nulls")
    ).first()
    if not found["keys"]:
        return KeyedRows(df, key, order)

    per_split = min(_SAMPLES_PER_CHUNK, max_rows)
    splits, most = math.ceil(found["n"] / max_rows), math.ceil(found["most"] / max_rows)
    hot = counts.select(*key)
    sampled = (
        _join_on(df, hot, key, "left_semi", splits <= MAX_SENT_SPLITS, found["nulls"])
        .filter(F.pmod(F.xxhash64(*order), F.lit(max_rows // per_split)) == 0)
        .select(*key, *order)
    )
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    cuts = (
        sampled.withColumn("_rank", rank)
        .filter(F.col("_rank") % per_split == 0)
        .select(*key, F.struct(*order).alias("_cut"), (F.col("_rank") / per_split - 1).cast("int").alias("_at"))
    )
    if most > SPLIT_FAN:
        cuts = cut_lineage(cuts)  # read once for each level
    # Several passes over the numbered rows follow, each by key and chunk: they are dealt and sorted once for all.
    rows = _numbered(df, cuts, key, order, most, splits, found["nulls"])
    return KeyedRows(dealt(rows, [*key, CHUNK], order), key, order, chunked=True, dealt=True, nulls=found["nulls"])


def _numbered(
    df: DataFrame, cuts: DataFrame, key: Sequence[str], order: Sequence[str], most: int, splits: int, nulls: bool
) -> DataFrame:
    """Add the chunk number: how many cuts of the key lie at or before the row.

    A row meets at most ``SPLIT_FAN`` cuts at once. A key with more has levels: every ``SPLIT_FAN``-th cut
    gives the piece of the key the row is in, and the row meets the cuts of that piece only.
    ``most`` and ``splits`` are about the cuts of the largest key and of all keys.
    """
    on, piece = list(key), F.lit(0)
    if most > SPLIT_FAN:
        at = F.col("_at")
        upper = cuts.filter((at > 0) & (at % SPLIT_FAN == 0)).withColumn("_at", (at / SPLIT_FAN - 1).cast("int"))
        df = _numbered(df, upper, key, order, most // SPLIT_FAN, splits // SPLIT_FAN, nulls)
        df, on = df.withColumn("_piece", F.greatest(F.col(CHUNK), F.lit(0))).drop(CHUNK), [*key, "_piece"]
        cuts = cuts.withColumn("_piece", F.floor(at / SPLIT_FAN).cast("int"))
        piece = F.col("_piece")
    table = cuts.groupBy(*on).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    # Few enough points are sent; more stay a stored table, and adaptive execution splits the hot keys of that join.
    send = splits <= MAX_SENT_SPLITS
    table = df.sparkSession.createDataFrame(table.collect(), table.schema) if send else cut_lineage(table)
    longest = table.agg(F.max(F.size("_cuts"))).first()[0] or 0
    inside = _locate("_cuts", order, max(longest.bit_length(), 1))  # a step of the search for each bit
    number = F.when(F.col("_cuts").isNull(), F.lit(COLD)).otherwise(piece * SPLIT_FAN + inside)
    return _join_on(df, table, on, "left", send, nulls).withColumn(CHUNK, number).drop("_cuts", "_piece")


def _locate(cuts: str, order: Sequence[str], bits: int) -> Column:
    """Number of cut points, fewer than 2 ** ``bits``, at or before the row, by binary search inside the JVM."""
    here = F.struct(*order)
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])

    def advance(found: Column, step: Column) -> Column:
        reached = F.get(F.col(cuts), found + step - 1)
        return F.when(reached <= here, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), advance)
