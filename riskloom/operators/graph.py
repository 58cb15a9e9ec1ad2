"""Entity graph, circular-transfer rings, shared infrastructure, ego networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import non_blank, prefixed, short_hash
from riskloom.session import cut_lineage


def customer_node(value: Column) -> Column:
    return F.concat(F.lit("CUST-"), value)


def account_node(value: Column) -> Column:
    return prefixed(value, "ACCT-", "ACC-", prefix="ACCT-")


def device_node(value: Column) -> Column:
    return prefixed(value, "DEV-", prefix="DEV-")


def ip_node(value: Column) -> Column:
    return F.concat(F.lit("IP-"), value)


def build_edges(
    accounts: DataFrame,
    transfers: DataFrame,
    devices: DataFrame,
    logins: DataFrame,
    as_of: int,
    lookback: int,
) -> DataFrame:
    """One edge per source row; only transfers and logins are cut to the lookback.

    ``t`` is derived from the tables' own time columns, so to spare the scan the callers cut
    these first.
    """
    since = as_of - lookback
    none = F.lit(None)

    def edge(src, dst, relationship, amount=none, t=none, detail=none, status=none):
        return [
            src.alias("src"),
            dst.alias("dst"),
            F.lit(relationship).alias("relationship"),
            amount.cast("double").alias("amount"),
            t.cast("long").alias("t"),
            detail.cast("string").alias("detail"),
            status.cast("string").alias("status"),
        ]

    customer = customer_node(F.col("customer_id"))
    owns = accounts.select(*edge(customer, account_node(F.col("account_id")), "OWNS"))
    moved = transfers.filter(F.col("t") >= since).select(
        *edge(
            account_node(F.col("from_account")),
            account_node(F.col("to_account")),
            "TRANSFERRED_TO",
            F.coalesce("amount", F.lit(0.0)),
            F.col("t"),
            F.col("transaction_id"),
        )
    )
    used = devices.select(
        *edge(customer, device_node(F.col("device_id")), "USED_DEVICE", detail=F.col("device_type"))
    )
    status = F.when(F.coalesce("success", F.lit(True)), "SUCCESS").otherwise("FAILED")
    seen = logins.filter((F.col("t") >= since) & non_blank(F.col("ip_address")).isNotNull()).select(
        *edge(customer, ip_node(F.col("ip_address")), "LOGGED_IN_FROM", t=F.col("t"), status=status)
    )
    return owns.unionByName(moved).unionByName(used).unionByName(seen)


# Label of the node at either end of an edge.
SRC_LABEL = {"OWNS": "CUSTOMER", "TRANSFERRED_TO": "ACCOUNT", "USED_DEVICE": "CUSTOMER", "LOGGED_IN_FROM": "CUSTOMER"}
DST_LABEL = {"OWNS": "ACCOUNT", "TRANSFERRED_TO": "ACCOUNT", "USED_DEVICE": "DEVICE", "LOGGED_IN_FROM": "IP"}


def _label(labels: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.element_at(lookup, F.col("relationship"))


def build_nodes(edges: DataFrame) -> DataFrame:
    """A node exists if any edge mentions it."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), _label(SRC_LABEL).alias("label")),
        F.struct(F.col("dst").alias("id"), _label(DST_LABEL).alias("label")),
    )
    return edges.select(F.inline(ends)).groupBy("id").agg(F.min("label").alias("label"))


def scan_counts(edges: DataFrame) -> DataFrame:
    """How many nodes and edges a graph search scans."""
    nodes = build_nodes(edges).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n")
    return nodes.unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


def transfer_edges(edges: DataFrame) -> DataFrame:
    """Total amount and count per directed account pair; sums are exact decimals."""
    return (
        edges.filter(F.col("relationship") == "TRANSFERRED_TO")
        .groupBy("src", "dst")
        .agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("total_amount"), F.count(F.lit(1)).alias("transfers"))
    )


def circular_rings(rolled: DataFrame, max_hops: int = 6, min_hops: int = 3, prune_rounds: int = 3) -> DataFrame:
    """Simple directed cycles of ``min_hops``..``max_hops`` accounts.

    Every cycle is grown from its busiest account: a path only extends to
    accounts ranking lower (by degree, then id) than where it started. So each
    cycle is found once, and a hub with a large share of the edges is only ever
    a start and never in the middle of a path, where it would multiply in-edges
    by out-edges.
    """
    if not 3 <= min_hops <= max_hops <= 10:
        raise ValueError("hops must satisfy 3 <= min_hops <= max_hops <= 10")
    edges = rolled.filter(F.col("src") != F.col("dst")).select("src", "dst", F.col("total_amount").alias("amount"))
    for _ in range(prune_rounds):
        # An account on a cycle both sends and receives.
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = cut_lineage(edges.select("src", "dst", "amount"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    rank = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = F.struct("degree", "id")
    src_rank = rank.select(F.col("id").alias("src"), ranked.alias("a"))
    dst_rank = rank.select(F.col("id").alias("dst"), ranked.alias("b"))
    edges = cut_lineage(edges.join(src_rank, "src").join(dst_rank, "dst").select("a", "b", "amount"))

    down = edges.filter(F.col("b") < F.col("a"))
    step = edges.select(F.col("a").alias("tail"), F.col("b").alias("next"), F.col("amount").alias("step"))
    volume = F.col("volume") + F.col("step")
    wide = "decimal(28,2)"
    paths = down.select(
        F.col("a").alias("start"),
        F.col("b").alias("tail"),
        F.array(F.col("a.id"), F.col("b.id")).alias("members"),
        F.col("amount").cast(wide).alias("volume"),
    )
    rings = None
    for hops in range(2, max_hops + 1):
        # `paths` holds simple paths of hops-1 edges over `hops` accounts.
        if hops >= min_hops:
            closing = step.select("tail", F.col("next").alias("start"), "step")
            closed = paths.join(closing, ["tail", "start"]).select(
                "members", F.lit(hops).cast("long").alias("hop_count"), volume.cast(wide).alias("volume")
            )
            rings = closed if rings is None else rings.unionByName(closed)
        if hops < max_hops:
            grown = paths.join(step, "tail").filter(
                (F.col("next") < F.col("start")) & ~F.array_contains("members", F.col("next.id"))
            )
            paths = cut_lineage(
                grown.select(
                    "start",
                    F.col("next").alias("tail"),
                    F.concat("members", F.array("next.id")).alias("members"),
                    volume.cast(wide).alias("volume"),
                )
            )
    smallest = F.array_position("members", F.array_min("members"))
    rotated = F.concat(
        F.slice("members", smallest, F.size("members")), F.slice("members", F.lit(1), smallest - 1)
    )
    text = F.array_join("members", " -> ")
    total = F.format_number(F.col("volume"), 2)
    return rings.withColumn("members", rotated).select(
        F.concat(F.lit("RING-CIRCULAR-"), short_hash(text, length=8)).alias("ring_id"),
        F.lit("CIRCULAR_TRANSFER_RING").alias("ring_type"),
        "members",
        "hop_count",
        F.col("volume").cast("double").alias("total_volume"),
        F.when(F.col("volume") > 10000, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.concat(
            F.lit("Money moves in a circle of "),
            F.col("hop_count").cast("string"),
            F.lit(" accounts ("),
            text,
            F.lit(" -> "),
            F.get("members", F.lit(0)),
            F.lit("), in all "),
            total,
        ).alias("description"),
    )


def _customer_links(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("relationship").isin("USED_DEVICE", "LOGGED_IN_FROM")).select(
        F.col("dst").alias("node_id"),
        F.col("src").alias("customer"),
        _label(DST_LABEL).alias("node_label"),
    )


def shared_infrastructure(edges: DataFrame, min_customers: int = 3) -> DataFrame:
    """Devices and addresses used by several customers.

    Distinct customers are counted in two shuffled steps (pair, then node), so
    a node shared by millions never meets in one task. Members are in
    ``shared_members``: one row each, not one list per node.
    """
    pairs = _customer_links(edges).distinct()
    counted = pairs.groupBy("node_id", "node_label").agg(F.count(F.lit(1)).alias("customers"))
    flagged = counted.filter(F.col("customers") >= min_customers)
    kind = F.when(F.col("node_label") == "DEVICE", "Device Fingerprint").otherwise("IP Address")
    return flagged.select(
        F.concat(F.lit("RING-INFRA-"), short_hash(F.col("node_id"), length=8)).alias("ring_id"),
        F.lit("SHARED_INFRASTRUCTURE_CLUSTER").alias("ring_type"),
        F.col("node_id").alias("shared_entity_id"),
        F.lit(2).cast("long").alias("hop_count"),
        "customers",
        F.when(F.col("customers") >= 5, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.concat(
            F.lit("Shared by several customers: "),
            kind,
            F.lit(" '"),
            F.col("node_id"),
            F.lit("' belongs to "),
            F.col("customers").cast("string"),
            F.lit(" customers"),
        ).alias("description"),
    )


def shared_members(edges: DataFrame, min_customers: int = 3) -> DataFrame:
    """Members of every shared node, one row per member; the node is one of them."""
    shared = shared_infrastructure(edges, min_customers).select("ring_id", F.col("shared_entity_id").alias("node_id"))
    customers = _customer_links(edges).select("node_id", F.col("customer").alias("member")).distinct()
    members = customers.join(shared, "node_id").select("ring_id", "member")
    return members.unionByName(shared.select("ring_id", F.col("node_id").alias("member")))


def ego_nodes(edges: DataFrame, center: str, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` undirected hops of ``center`` with their distance."""
    if not 1 <= depth <= 4:
        raise ValueError("depth must be 1..4")
    # Both directions from one pass over the edges.
    src, dst = F.col("src"), F.col("dst")
    both = F.array(F.struct(src.alias("a"), dst.alias("b")), F.struct(dst.alias("a"), src.alias("b")))
    # Slim and written once: every hop reads it.
    links = cut_lineage(edges.select(F.inline(both)))
    frontier = edges.sparkSession.createDataFrame([(center,)], "id string")
    reached = frontier.withColumn("distance", F.lit(0).cast("long"))
    for hop in range(1, depth + 1):
        # distinct() after the semi join: a hub's many edges never multiply.
        nearby = links.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        frontier = cut_lineage(nearby.distinct().join(reached.select("id"), "id", "left_anti"))
        reached = cut_lineage(reached.unionByName(frontier.withColumn("distance", F.lit(hop).cast("long"))))
    return reached


def ego_network(edges: DataFrame, center: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the subgraph induced by the nodes near ``center``; edges are derived once."""
    edges = cut_lineage(edges)
    near = ego_nodes(edges, center, depth)
    inside = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(
        near.select(F.col("id").alias("dst")), "dst", "left_semi"
    )
    nodes = build_nodes(inside).join(near, "id")
    return nodes, inside
