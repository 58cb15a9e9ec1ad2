"""Owners, first sightings and missing dimension rows looked up for events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import DAY
from riskloom.functions.chain import greedy_chain
from riskloom.functions.ordered import DEFAULT_MAX_ROWS, keyed_rows


def account_snapshot(updates: DataFrame) -> DataFrame:
    """Latest owner per account; an account whose last change is a delete is gone."""
    state = F.struct("customer_id", "deleted")
    # Several changes can share a time; live beats deleted, then the larger owner.
    order = F.struct("event_time", ~F.col("deleted"), "customer_id")
    return (
        updates.groupBy("account_id")
        .agg(F.max_by(state, order).alias("s"), F.max("event_time").alias("as_of"))
        .filter(~F.col("s.deleted"))
        .select("account_id", F.col("s.customer_id").alias("customer_id"), "as_of")
    )


def enrich_accounts(events: DataFrame, updates: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Owner of the paying account as of the event (temporal lookup with deletes).

    Changes and events are put in one ordered stream per account and the last
    change is carried forward: one shuffle, no range join, safe for a hot account.
    Only events without a customer but with a paying account are looked up.
    """
    asks = F.col("customer_id").isNull() & F.col("from_account_id").isNotNull()
    names = events.columns
    changes = updates.select(
        F.col("account_id").alias("_account"),
        F.col("event_time").alias("_t"),
        F.lit(0).alias("_kind"),
        F.coalesce("customer_id", F.lit("")).alias("_tie"),
        F.struct(F.when(~F.col("deleted"), F.col("customer_id")).alias("owner")).alias("_change"),
    )
    change_type = changes.schema["_change"].dataType
    lookups = events.filter(asks).select(
        F.col("from_account_id").alias("_account"),
        F.col("event_time").alias("_t"),
        F.lit(1).alias("_kind"),
        F.coalesce("event_id", "dedup_key", F.lit("")).alias("_tie"),
        F.lit(None).cast(change_type).alias("_change"),
        F.struct(*names).alias("_event"),
    )
    stream = changes.unionByName(lookups, allowMissingColumns=True)
    rows = keyed_rows(stream, ["_account"], ["_t", "_kind", "_tie"], max_rows).history(
        lasts={"_last": F.col("_change")}
    )
    owner = F.col("_last.owner")
    event = F.col("_event")
    found = (
        rows.rows.filter(F.col("_kind") == 1)
        .select(event.alias("_event"), owner.alias("_owner"))
        .select("_event.*", "_owner")
        .withColumns(
            {
                "customer_id": F.coalesce("_owner", "customer_id"),
                "identity_key": F.coalesce("_owner", "identity_key"),
            }
        )
        .drop("_owner")
    )
    return found.unionByName(events.filter(~asks))


def seen_before(events: DataFrame, history: DataFrame, beyond: int = DAY) -> DataFrame:
    """Add ``seen_beyond_state_window``: a login older than ``beyond`` exists.

    Any earlier login exists exactly if the first one is earlier, so one
    minimum per customer replaces a lookup per event. Null without identity.
    """
    first = history.groupBy(F.col("customer_id").alias("identity_key")).agg(F.min("event_time").alias("_first"))
    joined = events.join(first, "identity_key", "left")
    seen = F.coalesce(F.col("_first") < F.col("event_time") - beyond, F.lit(False))
    return joined.withColumn(
        "seen_beyond_state_window", F.when(F.col("identity_key").isNotNull(), seen)
    ).drop("_first")


# Fixed value: the customer that provisional payee accounts belong to.
EXTERNAL_PAYEE = "cust_external_mule"


def provisional_accounts(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts that transfers mention and no account row defines, with defaults.

    A missing payer is provisioned for the customer behind the request, a
    missing payee for one collecting customer, both at high risk.
    """
    payers = transfers.select(
        F.col("from_account").alias("account_id"), F.lit(0).alias("side"), F.col("requested_by").alias("customer_id")
    )
    payees = transfers.select(
        F.col("to_account").alias("account_id"), F.lit(1).alias("side"), F.lit(EXTERNAL_PAYEE).alias("customer_id")
    )
    mentioned = (
        payers.unionByName(payees)
        .groupBy("account_id")
        .agg(F.min(F.struct("side", "customer_id")).alias("first"))
    )
    missing = mentioned.join(accounts.select("account_id"), "account_id", "left_anti")
    return missing.select(
        "account_id",
        F.col("first.customer_id").alias("customer_id"),
        F.lit(15000.0).alias("balance"),
        F.lit("USD").alias("currency"),
        F.lit("ACTIVE").alias("status"),
    )


def provisional_customers(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers named by provisional accounts that no customer row defines."""
    ids = accounts.select("customer_id").distinct().join(customers.select("customer_id"), "customer_id", "left_anti")
    return provisional_customer(ids, F.lit("UNKNOWN"), F.lit("HIGH"))


def provisional_customer(ids: DataFrame, country=None, risk_level=None) -> DataFrame:
    country = F.lit("US") if country is None else country
    return ids.select(
        "customer_id",
        F.lit("Auto").alias("first_name"),
        F.lit("Provisioned").alias("last_name"),
        F.concat(F.col("customer_id"), F.lit("@auto-generated.io")).alias("email"),
        F.coalesce(country, F.lit("US")).alias("country"),
        (F.lit("LOW") if risk_level is None else risk_level).alias("risk_level"),
    )


def dedup_events(
    events: DataFrame, horizon: int = DAY, max_rows: int = DEFAULT_MAX_ROWS, keep_repeats: bool = False
) -> DataFrame:
    """Drop repeats of a dedup key inside ``horizon`` of the occurrence that was kept.

    ``keep_repeats`` keeps them, marked in ``repeated``: scoring ignores marked
    rows but lets them prolong a profile.

    Events without a key are never repeats and skip the shuffle. Runs of
    occurrences at most ``horizon`` apart are handled by their own start; only
    runs longer than the horizon, which are rare, need the exact greedy walk.
    """
    can_repeat = F.col("dedup_key").isNotNull() & F.col("identity_key").isNotNull()
    t = F.col("event_time")
    key, order = ("identity_key", "dedup_key"), ("event_time", "event_id")
    rows = keyed_rows(events.filter(can_repeat), key, order, max_rows).history(lasts={"_prev": t})
    begins = F.col("_prev").isNull() | (t - F.col("_prev") > horizon)
    rows = rows.with_column("_begins", F.when(begins, t)).history(lasts={"_open": F.col("_begins")})
    # Several branches below read these rows: derive them once.
    rows = rows.staged(always=True)
    first = F.col("_begins").isNotNull()
    rows = rows.with_column("_run", F.coalesce("_begins", "_open"))
    near = t - F.col("_run") <= horizon
    late = rows.filter(~first & ~near)
    again = greedy_chain(late, [*key, "_run"], "event_time", "event_time", horizon + 1).result()

    def marked(df: DataFrame, repeated: bool) -> DataFrame:
        return df.select(*events.columns, F.lit(repeated).alias("repeated"))

    kept = marked(rows.filter(first).result(), False).unionByName(marked(again, False))
    out = kept.unionByName(marked(events.filter(~can_repeat), False))
    if not keep_repeats:
        return out.drop("repeated")
    missed = late.result().join(again.select(*key, *order), [*key, *order], "left_anti")
    return out.unionByName(marked(rows.filter(~first & near).result(), True)).unionByName(marked(missed, True))
