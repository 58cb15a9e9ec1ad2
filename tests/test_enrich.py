import random

from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.operators import enrich

EVENT = "event_id string, dedup_key string, customer_id string, from_account_id string, identity_key string, event_time long"
UPDATE = "account_id string, customer_id string, deleted boolean, event_time long"


def test_owner_as_of_the_event(spark):
    updates = spark.createDataFrame(
        [("A", "c1", False, 10), ("A", "c2", False, 20), ("A", None, True, 30), ("A", "c3", False, 40)], UPDATE
    )
    times = [5, 10, 15, 20, 30, 35, 45]
    events = [(f"e{t}", None, None, "A", "acct:A", t) for t in times]
    events += [("u", None, None, "B", "acct:B", 50), ("own", None, "x", "A", "x", 15), ("ip", None, None, None, "ip:1", 15)]
    df = spark.createDataFrame(events, EVENT)
    for limit in (1000, 2):
        got = {r.event_id: (r.customer_id, r.identity_key) for r in enrich.enrich_accounts(df, updates, limit).collect()}
        assert got == {
            "e5": (None, "acct:A"), "e10": ("c1", "c1"), "e15": ("c1", "c1"), "e20": ("c2", "c2"),
            "e30": (None, "acct:A"), "e35": (None, "acct:A"), "e45": ("c3", "c3"),
            "u": (None, "acct:B"), "own": ("x", "x"), "ip": (None, "ip:1"),
        }


def test_generated_account_resolves_and_unmapped_keeps_its_account(spark):
    updates = spark.createDataFrame([("ACC-GEN00007", "cust_gen_7", False, 1)], UPDATE)
    df = spark.createDataFrame(
        [("t", None, None, "ACC-GEN00007", "acct:ACC-GEN00007", 2), ("v", None, None, "ACC-UNKNOWN-999", "acct:ACC-UNKNOWN-999", 2)],
        EVENT,
    )
    got = sorted((r.customer_id or "", r.identity_key) for r in enrich.enrich_accounts(df, updates).collect())
    assert got == [("", "acct:ACC-UNKNOWN-999"), ("cust_gen_7", "cust_gen_7")]


def test_snapshot_drops_deleted(spark):
    updates = spark.createDataFrame(
        [("A", "c1", False, 1), ("A", None, True, 2), ("B", "c1", False, 1), ("B", "c2", False, 3)], UPDATE
    )
    assert [(r.account_id, r.customer_id) for r in enrich.account_snapshot(updates).collect()] == [("B", "c2")]


def test_dedup_against_a_loop_and_idempotent(spark):
    rnd = random.Random(1)
    data = [
        (f"{i:04d}", rnd.choice(["k", "k", "k", "m", None]), None, None, rnd.choice("ab"), rnd.randrange(1500)) for i in range(300)
    ]
    df = spark.createDataFrame(data, EVENT)
    want, last = [r[0] for r in data if r[1] is None], {}
    for row_id, key, _, _, identity, t in sorted((r for r in data if r[1]), key=lambda r: (r[5], r[0])):
        if (identity, key) not in last or t - last[identity, key] > 50:
            want.append(row_id)
            last[identity, key] = t
    for limit in (1000, 20):
        once = enrich.dedup_events(df, 50, limit)
        assert sorted(r.event_id for r in once.collect()) == sorted(want)
    assert rows_of(enrich.dedup_events(once, 50)) == rows_of(once)


def test_seen_before(spark):
    day = 86_400_000
    logins = spark.createDataFrame([("c", 0)], "customer_id string, event_time long")
    events = spark.createDataFrame([("c", day), ("c", day + 1), ("d", 9), (None, 9)], "identity_key string, event_time long")
    got = sorted((str(r.identity_key), r.event_time, r.seen_beyond_state_window) for r in enrich.seen_before(events, logins).collect())
    assert got == [("None", 9, None), ("c", day, False), ("c", day + 1, True), ("d", 9, False)]


def test_provisional_customer_defaults(spark):
    ids = spark.createDataFrame([("new-user",)], "customer_id string")
    row = enrich.provisional_customer(ids, F.lit("KE")).first().asDict()
    assert row == {
        "customer_id": "new-user", "first_name": "Auto", "last_name": "Provisioned",
        "email": "new-user@auto-generated.io", "country": "KE", "risk_level": "LOW",
    }


def test_provisional_accounts(spark):
    moved = spark.createDataFrame([("A", "B", "me"), ("C", "A", "me")], "from_account string, to_account string, requested_by string")
    known = spark.createDataFrame([("C", "x")], "account_id string, customer_id string")
    got = {r.account_id: r.customer_id for r in enrich.provisional_accounts(moved, known).collect()}
    assert got == {"A": "me", "B": enrich.EXTERNAL_PAYEE}
