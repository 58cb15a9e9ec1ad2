import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph


def rolled(spark, pairs):
    df = spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, dst string, amount double")
    return graph.transfer_edges(df.withColumn("relationship", F.lit("TRANSFERRED_TO")))


def brute_cycles(pairs, low, high):
    edges, out = {(a, b) for a, b, _ in pairs if a != b}, set()
    nodes = sorted({x for e in edges for x in e})

    def grow(path):
        if len(path) >= low and (path[-1], path[0]) in edges:
            out.add(tuple(path))
        if len(path) < high:
            for n in nodes:
                if n > path[0] and n not in path and (path[-1], n) in edges:
                    grow([*path, n])

    for n in nodes:
        grow([n])
    return out


def test_rings_match_brute_force_without_rotations(spark):
    rnd = random.Random(2)
    nodes = [f"ACC-{i}" for i in range(9)]
    pairs = [(a, b, rnd.randrange(1, 5000)) for a, b in itertools.product(nodes, nodes) if rnd.random() < 0.3]
    pairs += pairs[:5] + [("ACC-0", n, 10) for n in nodes] + [(n, "ACC-0", 10) for n in nodes]
    want = brute_cycles(pairs, 3, 5)
    totals = {}
    for a, b, w in pairs:
        totals[a, b] = totals.get((a, b), 0) + w
    rings = graph.circular_rings(rolled(spark, pairs), max_hops=5).collect()
    assert {tuple(r.members) for r in rings} == want and len(rings) == len(want)
    for r in rings:
        volume = sum(totals[e] for e in zip(r.members, [*r.members[1:], r.members[0]]))
        assert r.total_volume == volume and r.hop_count == len(r.members)
        assert r.severity == ("CRITICAL" if volume > 10_000 else "HIGH")


def test_hop_limits(spark):
    with pytest.raises(ValueError):
        graph.circular_rings(rolled(spark, [("a", "b", 1)]), max_hops=11)


def sample_edges(spark):
    accounts = spark.createDataFrame([("7", "c1"), ("ACC-8", "c2")], "account_id string, customer_id string")
    transfers = spark.createDataFrame(
        [("t1", "7", "9", 5.0, 100), ("t2", "ACC-8", "7", None, 10)],
        "transaction_id string, from_account string, to_account string, amount double, t long",
    )
    devices = spark.createDataFrame(
        [("d1", "c1", "x"), ("DEV-d1", "c2", "x"), ("d1", "c3", "x")], "device_id string, customer_id string, device_type string"
    )
    logins = spark.createDataFrame(
        [("c1", "1.1.1.1", True, 100), ("c2", "1.1.1.1", False, 5), ("c4", " ", True, 100)],
        "customer_id string, ip_address string, success boolean, t long",
    )
    return graph.build_edges(accounts, transfers, devices, logins, as_of=100, lookback=50)


def test_edges_nodes_and_lookback(spark):
    edges = sample_edges(spark)
    got = sorted((r.src, r.dst, r.relationship) for r in edges.collect())
    assert got == [
        ("ACCT-7", "ACCT-9", "TRANSFERRED_TO"),
        ("CUST-c1", "ACCT-7", "OWNS"),
        ("CUST-c1", "DEV-d1", "USED_DEVICE"),
        ("CUST-c1", "IP-1.1.1.1", "LOGGED_IN_FROM"),
        ("CUST-c2", "ACC-8", "OWNS"),
        ("CUST-c2", "DEV-d1", "USED_DEVICE"),
        ("CUST-c3", "DEV-d1", "USED_DEVICE"),
    ]
    labels = {r.id: r.label for r in graph.build_nodes(edges).collect()}
    assert labels["ACCT-9"] == "ACCOUNT" and labels["IP-1.1.1.1"] == "IP" and len(labels) == 8


def test_shared_infrastructure(spark):
    edges = sample_edges(spark)
    (ring,) = graph.shared_infrastructure(edges).collect()
    assert (ring.shared_entity_id, ring.customers, ring.severity, ring.hop_count) == ("DEV-d1", 3, "HIGH", 2)
    members = graph.shared_members(edges).collect()
    assert {r.member for r in members} == {"CUST-c1", "CUST-c2", "CUST-c3", "DEV-d1"} and len(members) == 4


def test_ego_network(spark):
    edges = sample_edges(spark)
    nodes, inside = graph.ego_network(edges, "ACCT-7", depth=2)
    assert {(r.id, r.distance) for r in nodes.collect()} == {
        ("ACCT-7", 0), ("ACCT-9", 1), ("CUST-c1", 1), ("DEV-d1", 2), ("IP-1.1.1.1", 2)
    }
    assert inside.count() == 4
    nodes, inside = graph.ego_network(edges, "nobody", depth=2)
    assert nodes.isEmpty() and inside.isEmpty()
