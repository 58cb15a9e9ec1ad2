"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Equal
fingerprints collapse first, so exact copies cost nothing further. Fingerprints at distance two or
less agree in at least two of four 16-bit blocks: these shared masked patterns are the upper nodes
of the index, six per fingerprint. A node with many members is factored again: 32 bits are left,
in four blocks of 8, of which a close pair again shares two. After that at most 65 536 members are
possible, whatever the table. Inside a node the members are sorted by Gray rank and searched as a
tree that drops whole groups of pairs by accumulated differences; each node sends on links that span
what it found, never all pairs, and the components of these links are the result.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of the whole sequence; repeated shingles count as often as they occur;
rows that repeat a doc_id are kept as rows; a null doc_id belongs to its component but names it only
when no other member has an id (component_id is then null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, small_batches, stored, table, text_bytes, text_digest, without_rows
from riskloom.llm.components import components
from riskloom.llm.gray_index import link_groups

SHINGLE, SEED, DISTANCE = 3, 42, 2
NODE_LIMIT = 2048  # members of an upper node before it is factored again
GROUPS_A_TASK = 1 << 16
SHINGLE_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority fingerprint of one UTF-8 text, words lower-cased in A-Z and split at white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLE_BLOCK):
        spans = zip(first[at : at + SHINGLE_BLOCK], last[at : at + SHINGLE_BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = np.packbits(votes * 2 > len(first), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and digest of the text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            made = [fingerprint(raw[a:b], shingle, seed) for a, b in zip(at[:-1], at[1:], strict=True)]
            fps = np.array(made, np.uint64).view(np.int64)
            columns = {"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64())}
            yield pa.record_batch({**columns, "digest": batch.column("digest")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("digest"))
    return rows.mapInArrow(run, "doc_id long, fp long, digest long")


def _block_pairs(value, width: int):
    """All pairs of the four ``width``-bit blocks of a column: (pair number, blocks in place)."""
    for number, pair in enumerate(combinations(range(4), 2)):
        mask = sum(((1 << width) - 1) << (width * block) for block in pair)
        mask -= (mask >> 63) << 64
        yield F.struct(F.lit(number).alias("n"), value.bitwiseAND(F.lit(mask)).alias("bits"))


def upper_nodes(fps: DataFrame) -> DataFrame:
    """Six rows (n, bits, fp) per distinct fingerprint."""
    nodes = F.explode(F.array(*_block_pairs(F.col("fp"), 16))).alias("node")
    return fps.select("fp", nodes).select("node.n", "node.bits", "fp")


def _refined(rows: DataFrame) -> DataFrame:
    """Members of crowded nodes once more: the 32 free bits in four blocks of 8, two of them shared."""
    choices = []
    for number, pair in enumerate(combinations(range(4), 2)):
        free = [16 * b for b in range(4) if b not in pair]
        blocks = [base + half for base in free for half in (0, 8)]
        for second, (x, y) in enumerate(combinations(blocks, 2)):
            mask = (0xFF << x) | (0xFF << y)
            mask -= (mask >> 63) << 64
            own = F.struct(
                F.lit(6 + 6 * number + second).alias("n"),
                F.col("bits").bitwiseOR(F.col("fp").bitwiseAND(F.lit(mask))).alias("bits"),
            )
            choices.append((number, own))
    picked = F.array(*(F.when(F.col("n") == n, own) for n, own in choices))
    nodes = F.explode(F.filter(picked, lambda x: x.isNotNull())).alias("node")
    return rows.select("fp", nodes).select("node.n", "node.bits", "fp")


def close_links(fps: DataFrame, distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``distance`` (2 at most) of each other."""
    if not 0 <= distance <= 2:
        raise ValueError("the block pairs find distances up to 2")
    rows = upper_nodes(fps)
    sizes = rows.groupBy("n", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    rows = stored(rows.join(stored(sizes, "node-sizes"), ["n", "bits"]), "node-members")
    plain = rows.filter(F.col("members") <= node_limit).select("n", "bits", "fp")
    members = plain.unionByName(_refined(rows.filter(F.col("members") > node_limit)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive sorted by node; a node cut by a batch border waits for the next batch.
        held = [np.zeros(0, np.int64)] * 3
        for batch in _with_end(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "bits", "fp")]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            n, bits, fp = held
            if not len(n):
                continue
            change = np.r_[True, (n[1:] != n[:-1]) | (bits[1:] != bits[:-1])]
            cut = len(n) if batch is None else int(np.flatnonzero(change)[-1])
            if batch is not None and cut < GROUPS_A_TASK and len(n) < 4 * GROUPS_A_TASK:
                continue
            a, b = link_groups(np.cumsum(change)[:cut], fp[:cut].view(np.uint64), distance)
            held = [x[cut:] for x in held]
            yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return (
        members.repartition("n", "bits")
        .sortWithinPartitions("n", "bits")
        .mapInArrow(search, "a long, b long")
        .distinct()
    )


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _rooted(marked: DataFrame, distance: int) -> DataFrame:
    """fp, first_id, root of every distinct fingerprint."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fp")
    roots = components(close_links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = distinct.join(stored(roots, "roots"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stored(rooted, "rooted")


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    small_batches(docs.sparkSession)
    marked = stored(fingerprints(docs, shingle).drop("digest"), "fingerprints")
    rooted = _rooted(marked, distance)
    names = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-names")
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs``, all columns, with one of each group of ``members`` (doc_id, digest, root): the smallest id,
    then the smallest digest; a null id comes last. Rows not in ``members`` stay, and rows that repeat
    id and text go or stay together."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    kept = stored(members.groupBy("root").agg(F.min(own).alias("kept")), "kept-of-each")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest"))
    return without_rows(docs, stored(members.join(kept, "root").filter(~stays).select("doc_id", "digest"), "not-kept"))


def one_per_group(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that name their component, all columns; others go."""
    small_batches(docs.sparkSession)
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    members = marked.join(_rooted(marked, distance).select("fp", "root"), "fp")
    return one_of_each(docs, members.select("doc_id", "digest", "root"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents, whole texts."""
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash_dedup": op5_simhash_dedup}
SQL: dict[str, str] = {}
