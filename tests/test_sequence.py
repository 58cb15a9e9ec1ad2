import random

from riskloom.operators.sequence import takeover_sequences, unified_timeline


def brute(rows, within):
    out, i = [], 0
    while i < len(rows):
        match = None
        if rows[i][1] == "LOGIN_FAILED":
            b = next((j for j in range(i + 1, len(rows)) if rows[j][1] == "BENEFICIARY_ADD"), None)
            t = None if b is None else next((j for j in range(b + 1, len(rows)) if rows[j][1] == "TRANSFER"), None)
            if t is not None and rows[t][2] - rows[i][2] < within:
                match = (rows[i][0], rows[i][2], rows[b][2], rows[t][2], rows[t][4])
                out.append(match)
                i = t + 1
        if match is None:
            i += 1
    return out


def test_matches_equal_a_scan_and_skip_matcher(spark):
    rnd = random.Random(4)
    kinds = ["LOGIN_FAILED", "LOGIN_FAILED", "BENEFICIARY_ADD", "TRANSFER"]
    data = [
        (rnd.choice(["hot", "hot", "a", "b"]), rnd.choice(kinds), rnd.randrange(2000), f"{i:04d}", float(i)) for i in range(400)
    ]
    df = spark.createDataFrame(data, "customer_id string, event_type string, event_time long, row_id string, amount double")
    want = []
    for c in ("hot", "a", "b"):
        want += brute(sorted((r for r in data if r[0] == c), key=lambda r: (r[2], r[3])), 45)
    assert len(want) >= 20
    for limit in (10_000, 30):
        got = takeover_sequences(df, within=45, max_rows=limit).collect()
        got = [(r.customer_id, r.initial_failed_login, r.beneficiary_added_time, r.exfiltration_transfer_time, r.stolen_funds) for r in got]
        assert sorted(got) == sorted(want)


def test_timeline_takes_inserts_only_and_every_account_row(spark):
    logins = spark.createDataFrame(
        [("e1", "c", False, 1, "c"), ("e2", "c", True, 1, "c"), ("e3", "c", False, 1, "u")],
        "event_id string, customer_id string, success boolean, t long, op string",
    )
    added = spark.createDataFrame([("b1", "c", 2, "r")], "beneficiary_id string, customer_id string, t long, op string")
    moved = spark.createDataFrame(
        [("t1", "A", 5.0, 3, "c"), ("t2", "Z", 5.0, 3, "c")], "transaction_id string, from_account string, amount double, t long, op string"
    )
    accounts = spark.createDataFrame(
        [("A", "c", "r"), ("A", "c", "c"), ("A", "d", "u")], "account_id string, customer_id string, op string"
    )
    rows = unified_timeline(logins, added, moved, accounts).collect()
    assert sorted((r.row_id, r.event_type, r.customer_id) for r in rows) == [
        ("b1", "BENEFICIARY_ADD", "c"),
        ("e1", "LOGIN_FAILED", "c"),
        ("t1", "TRANSFER", "c"),
        ("t1", "TRANSFER", "c"),
    ]
