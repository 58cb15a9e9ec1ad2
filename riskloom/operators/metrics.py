"""Case metrics, rollups and listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_metrics(incidents: DataFrame) -> DataFrame:
    """One row: counts by status, precision, false-positive rate, mean resolution time."""
    status = F.col("status")

    def count_of(name: str) -> Column:
        return F.count(F.when(status == name, 1))

    closed = status.isin("CONFIRMED_FRAUD", "FALSE_POSITIVE")
    seconds = F.when(closed, (F.col("updated_at") - F.col("created_at")) / 1000)
    counted = incidents.agg(
        F.count(F.when(status.isNotNull(), 1)).alias("total_incidents"),
        count_of("OPEN").alias("open_count"),
        count_of("INVESTIGATING").alias("investigating_count"),
        count_of("CONFIRMED_FRAUD").alias("confirmed_fraud_count"),
        count_of("FALSE_POSITIVE").alias("false_positive_count"),
        F.round(F.avg(seconds), 2).alias("avg_resolution_time_seconds"),
    )
    resolved = F.col("confirmed_fraud_count") + F.col("false_positive_count")

    def share(name: str) -> Column:
        return F.when(resolved > 0, F.round(F.col(name) / resolved, 4)).otherwise(F.lit(0.0))

    return counted.withColumns(
        {"precision": share("confirmed_fraud_count"), "false_positive_rate": share("false_positive_count")}
    )


def severity_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def incident_queue(
    incidents: DataFrame,
    status: str | None = None,
    severity: str | None = None,
    identity_key: str | None = None,
    corroborated: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of incidents, most recently updated first."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset non-negative")
    wanted = {"status": status, "severity": severity, "identity_key": identity_key, "corroborated": corroborated}
    page = listing(incidents, **wanted)
    return page.orderBy(F.col("updated_at").desc(), F.col("incident_id").asc()).offset(offset).limit(limit)


def listing(df: DataFrame, **equal) -> DataFrame:
    """Rows equal on every filter that is set; serves all plain listings."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def account_statement(transfers: DataFrame, account_id: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Newest transfers an account sent or received; a self-transfer shows once."""
    sent = transfers.filter(F.col("from_account") == account_id)
    received = transfers.filter(
        (F.col("to_account") == account_id) & (F.col("from_account") != account_id)
    )
    both = sent.unionByName(received)
    return both.orderBy(F.col("t").desc(), F.col("transaction_id").asc()).offset(skip).limit(limit)


def account_balances(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """Opening balance minus debits plus credits, as exact decimals.

    Movements are summed per account before they meet the accounts.
    """
    amount = F.col("amount").cast("decimal(18,2)")
    moves = transfers.select(F.col("from_account").alias("account_id"), (-amount).alias("delta")).unionByName(
        transfers.select(F.col("to_account").alias("account_id"), amount.alias("delta"))
    )
    net = moves.groupBy("account_id").agg(F.sum("delta").alias("net"), F.count(F.lit(1)).alias("movements"))
    opening = F.col("balance").cast("decimal(18,2)")
    return accounts.join(net, "account_id", "left").select(
        "account_id",
        (opening + F.coalesce("net", F.lit(0).cast("decimal(28,2)"))).alias("balance"),
        F.coalesce("movements", F.lit(0)).alias("movements"),
    )


def employee_mass_access(actions: DataFrame, at_least: int, approximate: bool = False) -> DataFrame:
    """Employees who touched many distinct customers."""
    distinct = (
        F.approx_count_distinct("customer_id") if approximate else F.count_distinct("customer_id")
    )
    return (
        actions.groupBy("employee_id")
        .agg(distinct.alias("distinct_customers"), F.count(F.lit(1)).alias("actions"))
        .filter(F.col("distinct_customers") >= at_least)
    )


def failed_login_geo(logins: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Failed logins with coordinates, counted per grid cell and country."""
    located = ~F.col("success") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()

    def cell(name: str) -> Column:
        return (F.floor(F.col(name) / degrees) * degrees).cast("double")

    return (
        logins.filter(located)
        .groupBy(cell("latitude").alias("lat_cell"), cell("longitude").alias("lon_cell"), "country")
        .agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("customer_id").alias("customers"))
    )


def endpoint_template(endpoint: Column) -> Column:
    """Collapse the ids in a path, so a counter has few label values."""
    account = endpoint.startswith("/api/accounts/")
    return (
        F.when(endpoint.startswith("/api/graph/entity/"), "/api/graph/entity/{id}")
        .when(account & endpoint.contains("/balance"), "/api/accounts/{id}/balance")
        .when(account, "/api/accounts/{id}")
        .when(endpoint.startswith("/api/sessions/"), "/api/sessions/{id}")
        .otherwise(endpoint)
    )


def api_request_rollup(requests: DataFrame) -> DataFrame:
    return requests.groupBy(
        "method", endpoint_template(F.col("endpoint")).alias("endpoint"), F.col("status_code").cast("long").alias("status_code")
    ).agg(F.count(F.lit(1)).alias("requests"))


def event_rate(events: DataFrame, time: str, label: str, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events per second by label over (sliding) windows; ``time`` is a timestamp.

    Sliding windows are put together from counts per slide, so that counts and not events are
    copied to the windows they belong to. A stream counts per window at once, as its state is kept by window.
    """
    counted = events.withColumn("_n", F.lit(1))
    if slide and not events.isStreaming and _milliseconds(events, size) % _milliseconds(events, slide) == 0:
        steps = events.groupBy(F.window(time, slide).alias("step"), label).agg(F.count(F.lit(1)).alias("_n"))
        counted, time = steps.withColumn("_start", F.col("step.start")), "_start"
    window = F.window(time, size, slide) if slide else F.window(time, size)
    seconds = (F.unix_millis(F.col("window.end")) - F.unix_millis(F.col("window.start"))) / 1000
    return (
        counted.groupBy(window.alias("window"), label)
        .agg(F.sum("_n").cast("long").alias("n"))
        .select(
            F.unix_millis(F.col("window.start")).alias("window_start"),
            label,
            "n",
            F.round(F.col("n") / seconds, 6).alias("per_second"),
        )
    )


def _milliseconds(df: DataFrame, interval: str) -> int:
    end = F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {interval})")
    return df.sparkSession.range(1).select(end).first()[0]


def identities_tracked(events: DataFrame, approximate: bool = False, prefix: str | None = None) -> DataFrame:
    """Distinct identities, in all and (optionally) those with a given prefix."""
    identity = F.col("identity_key")
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [distinct(identity).alias("identities")]
    if prefix is not None:
        aggs.append(distinct(F.when(identity.startswith(prefix), identity)).alias("with_prefix"))
    return events.agg(*aggs)
