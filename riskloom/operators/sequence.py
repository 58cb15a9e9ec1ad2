"""Account-takeover sequences: failed login, then beneficiary, then transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import HOUR
from riskloom.functions.chain import greedy_chain
from riskloom.functions.ordered import DEFAULT_MAX_ROWS, keyed_rows

FAILED, ADDED, MOVED = "LOGIN_FAILED", "BENEFICIARY_ADD", "TRANSFER"


def unified_timeline(logins: DataFrame, beneficiaries: DataFrame, transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Failed logins, added beneficiaries and transfers (with their owner) as one stream.

    Inputs may carry ``op``; only created and snapshot rows count. Every
    matching account row joins.
    """

    def inserted(df: DataFrame) -> DataFrame:
        return df.filter(F.col("op").isin("c", "r")) if "op" in df.columns else df

    def rows(df: DataFrame, kind: str, row_id: str, amount) -> DataFrame:
        return df.select(
            "customer_id",
            F.lit(kind).alias("event_type"),
            F.col("t").alias("event_time"),
            F.col(row_id).alias("row_id"),
            amount.alias("amount"),
        )

    none = F.lit(0.0)
    owners = inserted(accounts).select(F.col("account_id").alias("from_account"), "customer_id")
    owned = inserted(transfers).join(owners, "from_account")
    return (
        rows(inserted(logins).filter(~F.col("success")), FAILED, "event_id", none)
        .unionByName(rows(inserted(beneficiaries), ADDED, "beneficiary_id", none))
        .unionByName(rows(owned, MOVED, "transaction_id", F.col("amount").cast("double")))
    )


def takeover_sequences(timeline: DataFrame, within: int = HOUR, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """One row per match of ``F any*? B any*? T`` inside ``within``, per customer.

    The lazy pattern means: the first B after F, then the first T after that B.
    Both are a look forward over the ordered rows. Matches may not overlap,
    which leaves a greedy choice over the candidates: the next match starts
    after the transfer that ended the last one.
    """
    kind, t = F.col("event_type"), F.col("event_time")
    rows = keyed_rows(timeline, ["customer_id"], ["event_time", "row_id"], max_rows)
    rows = rows.history(sums={"_pos": F.lit(1).cast("long")})
    transfer = F.when(kind == MOVED, F.struct(t.alias("t"), "amount", F.col("_pos").alias("pos")))
    rows = rows.history(lasts={"_moved": transfer}, reverse=True)
    added = F.when(kind == ADDED, F.struct(t.alias("t"), F.col("_moved").alias("moved")))
    rows = rows.history(lasts={"_added": added}, reverse=True)
    end = F.col("_added.moved")
    found = rows.filter((kind == FAILED) & end.isNotNull() & (end["t"] - t < within))
    found = found.with_column("_end", end["pos"]).staged()
    matches = greedy_chain(found, ["customer_id"], "_pos", "_end", 1).result()
    return matches.select(
        "customer_id",
        F.lit("CEP_ATO_MATCH").alias("risk_indicator_type"),
        t.alias("initial_failed_login"),
        F.col("_added.t").alias("beneficiary_added_time"),
        F.col("_added.moved.t").alias("exfiltration_transfer_time"),
        F.col("_added.moved.amount").alias("stolen_funds"),
    )
