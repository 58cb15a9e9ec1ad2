"""Behavioural indicators per identity, as ordered history over its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import IndicatorConfig
from riskloom.functions.ordered import DEFAULT_MAX_ROWS, KeyedRows, keyed_rows

# Order inside one event: the order in which the rules are tested.
INDICATOR_ORDER = (
    "NEW_DEVICE",
    "NEW_COUNTRY",
    "IMPOSSIBLE_TRAVEL",
    "MULTIPLE_FAILED_LOGINS",
    "LARGE_TRANSFER_AMOUNT",
    "VELOCITY_VIOLATION",
    "HIGH_RISK_RECIPIENT",
    "SUSPICIOUS_API_PATTERN",
)


def identity_rows(events: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> KeyedRows:
    """Events of known identities, ordered by (event_time, event_id) in each."""
    known = events.filter(F.col("identity_key").isNotNull())
    return keyed_rows(known, ["identity_key"], ["event_time", "event_id"], max_rows)


def profile_segments(rows: KeyedRows, ttl: int) -> KeyedRows:
    """Add ``segment``: start time of the row's profile life.

    A profile is forgotten once the identity was silent for ``ttl``; every
    history value below is only used inside its own segment. ttl 0: never.
    """
    t = F.col("event_time")
    rows = rows.history(lasts={"_prev_t": t})
    begins = F.col("_prev_t").isNull()
    if ttl:
        begins = begins | (t - F.col("_prev_t") >= ttl)
    rows = rows.with_column("_begins", F.when(begins, t)).history(lasts={"_open": F.col("_begins")})
    segment = F.coalesce(F.col("_begins"), F.col("_open"))
    return rows.with_rows(rows.rows.withColumn("segment", segment).drop("_prev_t", "_begins", "_open"))


def derive_indicators(rows: KeyedRows, config: IndicatorConfig = IndicatorConfig()) -> KeyedRows:
    """Add ``segment`` and ``indicators`` (array of names, empty when none fires).

    Rows marked ``repeated`` prolong the profile and do nothing else.
    """
    c = config
    rows = profile_segments(rows, c.profile_ttl)
    t, segment, table = F.col("event_time"), F.col("segment"), F.col("source_table")

    fresh = ~F.col("repeated") if "repeated" in rows.rows.columns else F.lit(True)
    derives = fresh & (F.col("indicator").isNull() if c.honour_explicit else F.lit(True))
    login = derives & (table == "login_events")
    transfer = derives & (table == "transactions")
    request = derives & (table == "api_requests")
    failed = login & (F.col("login_success") == F.lit(False))
    cleared = login & F.col("login_success")

    def tagged(condition: Column, value: Column) -> Column:
        return F.when(condition & value.isNotNull(), F.struct(segment.alias("s"), value.alias("v")))

    def seen(name: str) -> Column:
        return F.when(F.col(name)["s"] == segment, F.col(name)["v"])

    def back(count: int) -> int:
        return max(count - 1, 1)

    rows = rows.history(
        lasts={
            "_device": tagged(login, F.col("device_id")),
            "_country": tagged(login, F.col("country")),
            "_login": tagged(login, t),
            "_success": tagged(cleared, F.struct(t, F.col("event_id"))),
        },
        lags={
            "_failure": (tagged(failed, F.struct(t, F.col("event_id"))), back(c.failed_login_count)),
            "_transfer": (tagged(transfer, t), back(c.velocity_count)),
            "_request": (tagged(request, t), back(c.api_count)),
        },
    )

    def burst(condition: Column, earliest: Column, count: int, window: int) -> Column:
        # `count` events inside the window: the (count-1)-th earlier one is recent
        # enough. Counters keep a limited number of stamps, so more never fires.
        if count > c.retained_stamps:
            return F.lit(False)
        return condition if count <= 1 else condition & (t - earliest <= window)

    new_country = login & (seen("_country") != F.col("country"))
    since_login = t - seen("_login")
    quick = since_login <= c.travel_window if c.travel_inclusive else since_login < c.travel_window
    failure = seen("_failure")
    failing = burst(failed, failure["event_time"], c.failed_login_count, c.failed_login_window)
    if c.success_clears_failures and c.failed_login_count > 1:
        failing = failing & F.coalesce(failure > seen("_success"), F.lit(True))

    fired = {
        "NEW_DEVICE": login & (seen("_device") != F.col("device_id")),
        "NEW_COUNTRY": new_country,
        "IMPOSSIBLE_TRAVEL": new_country & quick,
        "MULTIPLE_FAILED_LOGINS": failing,
        "LARGE_TRANSFER_AMOUNT": transfer & (F.col("amount") > c.large_transfer),
        "VELOCITY_VIOLATION": burst(transfer, seen("_transfer"), c.velocity_count, c.velocity_window),
        "HIGH_RISK_RECIPIENT": transfer & F.col("to_account_id").isin(*c.high_risk_recipients)
        if c.high_risk_recipients
        else F.lit(False),
        "SUSPICIOUS_API_PATTERN": burst(request, seen("_request"), c.api_count, c.api_window),
    }
    derived = F.array_compact(F.array(*[F.when(fired[name], F.lit(name)) for name in INDICATOR_ORDER]))
    if c.honour_explicit:
        derived = F.when(fresh & F.col("indicator").isNotNull(), F.array("indicator")).otherwise(derived)
    helpers = ["_device", "_country", "_login", "_success", "_failure", "_transfer", "_request"]
    return rows.with_rows(rows.rows.withColumn("indicators", derived).drop(*helpers))


def weight_of(indicators: str, weights: dict[str, int], unknown: int) -> Column:
    """Sum of the weights of an event's indicators, inside the expression."""
    lookup = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(
        indicators,
        F.lit(0).cast("long"),
        lambda total, name: total + F.coalesce(F.try_element_at(lookup, name), F.lit(unknown)),
    )


def indicator_counts(rows: DataFrame) -> DataFrame:
    """How often each indicator fired per identity."""
    return (
        rows.select("identity_key", F.explode("indicators").alias("indicator"))
        .groupBy("identity_key", "indicator")
        .agg(F.count(F.lit(1)).alias("n"))
    )
