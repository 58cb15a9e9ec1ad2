"""Chat formatting of reply trees.

Rows are replies: tree, node, the node replied to, role, text, score. Self-joins of the reply table with
doubling reach give every node its depth and the score of its path from the root, in as many
rounds as the depth has binary digits; the same tables, applied from the longest reach to the
shortest, list the nodes of the chosen root-to-leaf paths. Branches are ranked by score; each chosen
path is written as one conversation with a loss mask over what the assistant says.

A turn is ``### role: text</turn>`` and a line end. Inside texts a backslash goes before every
backslash and control string, so that any text comes back unchanged.

Defined cases: a null text or role is empty; a reply to itself or to a node that is not there
starts a tree; rows in a cycle have no root and are left out; of rows that repeat a tree and node the
smallest stays; a null tree is a tree like any other, and a null node one node of its tree, to which nothing
can reply; equal scores go to the smallest leaf, a null one last. A conversation is one row of the result, so its
turns meet in one task at the end; nothing else does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, stored, table

OPEN, CLOSE, ASSISTANT = "###", "</turn>", "assistant"
SALTS = 64
CONTROL = regex.compile(r"\\|###|</turn>")
ROLE_CONTROL = regex.compile(r"\\|###|</turn>|:")
ESCAPED = regex.compile(r"\\(\\|###|</turn>|:)")
TURN = regex.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")


def escaped(text: str, control: regex.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]], assistant: str = ASSISTANT) -> tuple[str, list[tuple[int, int]]]:
    """One conversation as text, and the code-point ranges the loss is taken over."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN} {escaped(role, ROLE_CONTROL)}: ", escaped(text)
        if role == assistant:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE + "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def _key(name: str) -> Column:
    """A column as a key that is never null, so that plain joins find null trees and nodes as well."""
    return F.struct(F.col(name).isNull().alias("none"), F.coalesce(F.col(name), F.lit(0)).alias("value")).alias(name)


def _bare(name: str) -> Column:
    return F.when(~F.col(f"{name}.none"), F.col(f"{name}.value")).alias(name)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with keys for tree, node and parent; no parent stays null."""
    parent = F.when(F.col("parent").isNotNull(), _key("parent"))
    return rows.withColumns({"parent": parent, "tree": _key("tree"), "node": _key("node")})


def reaches(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of reach 1, 2, 4 ... and, per node, its depth and path score.

    ``nodes`` has tree, node, parent, score; every tree and node once.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    step = nodes.join(known, ["tree", "parent"], "left").select(
        "tree",
        "node",
        F.when(F.col("there") & (F.col("parent") != F.col("node")), F.col("parent")).alias("up"),
        F.coalesce("score", F.lit(0.0)).alias("total"),
        F.lit(1).cast("long").alias("depth"),
    )
    step = stored(step, "replies")
    levels, parts, open_before = [], [], None
    while True:
        # Rows that have reached their root take no part in later rounds but as a place to arrive at.
        still_open = step.filter("up is not null")
        parts.append(step.filter("up is null"))
        levels.append(still_open.select("tree", "node", "up"))
        number = still_open.count()
        # In a tree fewer nodes are open after each round; a number that stays is cycles.
        if number == 0 or number == open_before:
            done = reduce(DataFrame.unionByName, parts)
            return levels, done.select("tree", "node", "total", "depth")
        open_before = number
        above = reduce(DataFrame.unionByName, [*parts, still_open]).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2")
        )
        step = still_open.join(above, ["tree", "up"]).select(
            "tree",
            "node",
            F.col("up2").alias("up"),
            (F.col("total") + F.col("t2")).alias("total"),
            (F.col("depth") + F.col("d2")).alias("depth"),
        )
        step = stored(step, "replies")


def best_branches(ranked: DataFrame, first_level: DataFrame, branches: int) -> DataFrame:
    """tree, leaf, rank of the ``branches`` best leaves of each tree by mean score of the path."""
    inner = first_level.select("tree", F.col("up").alias("node")).distinct()
    leaves = ranked.join(inner, ["tree", "node"], "left_anti").withColumn("score", F.col("total") / F.col("depth"))
    order = [F.col("score").desc(), F.col("node")]
    # A tree may hold a third of all rows: rank in salted parts first, then the best of the parts.
    salted = Window.partitionBy("tree", F.pmod(F.xxhash64("node"), F.lit(SALTS))).orderBy(*order)
    some = leaves.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= branches)
    ranks = some.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    return ranks.filter(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, node, depth: the nodes of each chosen root-to-leaf path."""
    return _paths(_keyed(nodes), branches).select(_bare("tree"), _bare("leaf"), "rank", _bare("node"), "depth")


def _paths(nodes: DataFrame, branches: int) -> DataFrame:
    levels, ranked = reaches(nodes)
    paths = best_branches(ranked, levels[0], branches).withColumn("node", F.col("leaf"))
    paths = stored(paths, "paths")
    for level in reversed(levels):
        up = paths.join(level, ["tree", "node"]).drop("node").withColumnRenamed("up", "node")
        paths = stored(paths.unionByName(up), "paths")
    return paths.join(ranked.select("tree", "node", "depth"), ["tree", "node"])


def format_trees(rows: DataFrame, branches: int = 1, assistant: str = ASSISTANT) -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans of every chosen path.

    ``rows`` has tree, node, parent (long), role, text (string) and score (double).
    """
    small_batches(rows.sparkSession)
    rows = rows.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    rows = stored(
        _keyed(rows).groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("r")).select("tree", "node", "r.*"),
        "tree-rows",
    )
    paths = _paths(rows.select("tree", "node", "parent", "score"), branches)
    turns = (
        paths.join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
        .groupBy("tree", "leaf", "rank")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
        .select(_bare("tree"), _bare("leaf"), "rank", "turns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                format_turns([(t["role"], t["text"]) for t in turns], assistant)
                for turns in batch.column("turns").to_pylist()
            ]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch(
                {
                    **{c: batch.column(c) for c in ("tree", "leaf", "rank")},
                    "formatted": pa.array([f for f, _ in made], pa.string()),
                    "loss_spans": pa.array(spans, kind),
                }
            )

    shape = "tree long, leaf long, rank int, formatted string, loss_spans array<struct<start: long, end: long>>"
    return turns.mapInArrow(run, shape)


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply rows: each turn answers the one before. Longer texts score higher."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").cast("long").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.col("role"),
        F.col("text"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("double").alias("score"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds in them, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = read_turns(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns).encode()
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                digests = (hashlib.sha256(whole).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
                out.append((len(turns), digests[0], len(loss), digests[1], len(text)))
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            made = {n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)}
            yield pa.record_batch({"conv_id": batch.column("tree"), **made})

    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, shape)


PROBE = "\\### Assistant: </turn> ok"  # a text that looks like the template's own control strings


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe (-7), formatted and read back."""
    columns = ["conv_id", "turn", "role", "text"]
    probe = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    return read_back(format_trees(linear_replies(rows)))


QUERIES = {"op1_chat_format": op1_chat_format}
_ESCAPE = r"regexp_replace({0}, '(\\|###|</turn>)', '\\\1', 'g')"
SQL = {
    "op1_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || replace({_ESCAPE.format("role")}, ':', '\\:') || ': ' || {_ESCAPE.format("text")} || '</turn>' || chr(10)))
            AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
