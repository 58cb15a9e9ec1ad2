"""Banking-shaped views over the given star-schema tables (see FIXTURES.md).

Every view is a narrow projection, so scans read only the columns used.
Event times are epoch milliseconds (``t``), as in the event record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(col: str) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def since_time(df: DataFrame, column: str, since: int | None) -> DataFrame:
    """Rows from ``since`` (milliseconds) on, compared on the bare column, so that it reaches the scan."""
    if since is None:
        return df
    bound = F.timestamp_millis(F.lit(since)).cast(df.schema[column].dataType)
    return df.filter(F.col(column) >= bound)


def _events(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    return since_time(table(spark, sf_dir, "events"), "ts", since).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("event_no"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        millis("ts").alias("t"),
    )


def _customer() -> Column:
    return F.concat(F.lit("cust_"), F.col("user_id"))


def logins(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    countries = F.array(*[F.lit(c) for c in ("US", "CA", "KE", "RU", "CN")])
    return (
        _events(spark, sf_dir, since)
        .filter(F.col("event_type").isin("click", "view", "error"))
        .select(
            "event_id",
            _customer().alias("customer_id"),
            F.concat(F.lit("dev_"), F.col("event_no") % 7).alias("device_id"),
            F.get(countries, F.col("k") % 5).alias("country"),
            F.concat(F.lit("10.0.0."), F.col("k")).alias("ip_address"),
            (F.col("event_type") != "error").alias("success"),
            "t",
        )
    )


def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type") == "signup")
        .select(F.col("event_id").alias("beneficiary_id"), _customer().alias("customer_id"), "t")
    )


def transfers(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    to_no = (F.col("user_id") * 7 + F.col("event_no") * 3) % 200
    return (
        _events(spark, sf_dir, since)
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("transaction_id"),
            F.concat(F.lit("ACC-"), F.col("user_id")).alias("from_account"),
            F.concat(F.lit("ACC-"), to_no).alias("to_account"),
            F.col("value").alias("amount"),
            "t",
        )
    )


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = F.concat(F.lit("/api/accounts/ACC-"), F.col("user_id"))
    kind = F.col("event_type")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("10.0.0."), F.col("k")).alias("ip_address"),
        F.when(kind == "click", account)
        .when(kind == "view", F.concat(account, F.lit("/balance")))
        .when(kind == "error", F.lit("/api/login"))
        .when(kind == "purchase", F.lit("/api/transfers"))
        .otherwise(F.lit("/api/beneficiaries"))
        .alias("endpoint"),
        F.when(kind.isin("click", "view"), "GET").otherwise("POST").alias("method"),
        F.when(kind == "error", 401).otherwise(200).alias("status_code"),
        "t",
    )


def account_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changelog rows: created, re-owned and deleted accounts."""
    key = F.col("c_custkey")

    def day(text: str) -> Column:
        return F.unix_millis(F.lit(text).cast("timestamp"))

    owner = F.concat(F.lit("cust_"), key)
    next_owner = F.concat(F.lit("cust_"), key + 1)
    none = F.lit(None).cast("string")
    changes = F.array(
        F.struct(F.lit("c").alias("op"), owner.alias("customer_id"), day("2024-01-01").alias("t")),
        F.when(
            key % 10 == 3,
            F.struct(F.lit("u").alias("op"), next_owner.alias("customer_id"), day("2024-01-15").alias("t")),
        ),
        F.when(
            key % 17 == 5,
            F.struct(F.lit("d").alias("op"), none.alias("customer_id"), day("2024-01-20").alias("t")),
        ),
    )
    return (
        table(spark, sf_dir, "customer")
        .filter(key % 13 != 0)
        .select(F.concat(F.lit("ACC-"), key).alias("account_id"), F.explode(F.array_compact(changes)).alias("x"))
        .select("account_id", "x.op", "x.customer_id", "x.t")
    )


def account_graph_transfers(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    def padded(number: Column) -> Column:
        return F.concat(F.lit("ACC-"), F.lpad(number.cast("string"), 6, "0"))

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return since_time(table(spark, sf_dir, "orders"), "o_orderdate", since).select(
        key.cast("string").alias("transaction_id"),
        padded(cust).alias("from_account"),
        padded(cust - cust % 6 + (key * 7 + cust * 3) % 6).alias("to_account"),
        F.col("o_totalprice").alias("amount"),
        millis("o_orderdate").alias("t"),
    )


def employee_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("action_id"),
        F.concat(F.lit("emp_"), F.col("o_orderkey") % 20).alias("employee_id"),
        F.concat(F.lit("cust_"), F.col("o_custkey")).alias("customer_id"),
        F.lit("VIEW_ACCOUNT").alias("action_type"),
        millis("o_orderdate").alias("t"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max(millis("l_shipdate")).alias("updated_at"))
    )
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    level = F.substring("o_orderpriority", 1, 1)
    return (
        table(spark, sf_dir, "orders")
        .join(shipped, "o_orderkey")
        .select(
            key.alias("incident_id"),
            F.concat(F.lit("cust_"), F.col("o_custkey")).alias("identity_key"),
            F.when(status == "F", "CONFIRMED_FRAUD")
            .when(status == "O", F.when(key % 2 == 0, "OPEN").otherwise("INVESTIGATING"))
            .otherwise(F.when(key % 5 == 0, "RESOLVED_OTHER").otherwise("FALSE_POSITIVE"))
            .alias("status"),
            F.when(level == "1", "CRITICAL")
            .when(level == "2", "HIGH")
            .when(level == "3", "MEDIUM")
            .otherwise("LOW")
            .alias("severity"),
            millis("o_orderdate").alias("created_at"),
            "updated_at",
        )
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select(
            F.concat(F.lit("alt_"), F.col("event_id")).alias("alert_id"),
            _customer().alias("customer_id"),
            (F.col("value") * 2).alias("cumulative_score"),
            F.when(F.col("event_no") % 3 == 0, "python-secondary").otherwise("flink-primary").alias("engine_source"),
            "t",
        )
    )


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login, transfer and API rows as uniform risk events.

    Logins and transfers share the customer identity, API rows the IP identity.
    """
    none = F.lit(None)
    a, b, c = logins(spark, sf_dir), transfers(spark, sf_dir), api_requests(spark, sf_dir)
    a = a.select(
        "event_id",
        F.col("customer_id").alias("identity_key"),
        F.col("t").alias("event_time"),
        F.lit("login_events").alias("source_table"),
        "customer_id",
        none.cast("string").alias("account_id"),
        "country",
        "device_id",
        F.col("success").alias("login_success"),
        none.cast("double").alias("amount"),
        none.cast("string").alias("to_account_id"),
        none.cast("string").alias("endpoint"),
    )
    owner = F.concat(F.lit("cust_"), F.substring_index("from_account", "-", -1))
    b = b.select(
        F.col("transaction_id").alias("event_id"),
        owner.alias("identity_key"),
        F.col("t").alias("event_time"),
        F.lit("transactions").alias("source_table"),
        owner.alias("customer_id"),
        F.col("from_account").alias("account_id"),
        none.cast("string").alias("country"),
        none.cast("string").alias("device_id"),
        none.cast("boolean").alias("login_success"),
        "amount",
        F.col("to_account").alias("to_account_id"),
        none.cast("string").alias("endpoint"),
    )
    c = c.select(
        F.col("request_id").alias("event_id"),
        F.concat(F.lit("ip:"), F.col("ip_address")).alias("identity_key"),
        F.col("t").alias("event_time"),
        F.lit("api_requests").alias("source_table"),
        none.cast("string").alias("customer_id"),
        none.cast("string").alias("account_id"),
        none.cast("string").alias("country"),
        none.cast("string").alias("device_id"),
        none.cast("boolean").alias("login_success"),
        none.cast("double").alias("amount"),
        none.cast("string").alias("to_account_id"),
        "endpoint",
    )
    return a.unionByName(b).unionByName(c).withColumn("indicator", none.cast("string"))


def logins_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins with the centroid of their country; one login in ten has no coordinates."""
    # Rough country centroids (latitude, longitude).
    centroids = {
        "US": (39.8, -98.6),
        "CA": (56.1, -106.3),
        "KE": (0.0, 37.9),
        "RU": (61.5, 105.3),
        "CN": (35.9, 104.2),
    }

    def coordinate(axis: int) -> Column:
        lookup = F.create_map(*[F.lit(x) for name, at in centroids.items() for x in (name, at[axis])])
        return F.when(F.col("event_id").cast("long") % 10 != 0, F.element_at(lookup, F.col("country")))

    return logins(spark, sf_dir).withColumns({"latitude": coordinate(0), "longitude": coordinate(1)})


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device links taken from logins, so that a device can have several customers."""
    return (
        logins(spark, sf_dir)
        .select("device_id", "customer_id")
        .distinct()
        .withColumn("device_type", F.lit(None).cast("string"))
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ACC-"), F.col("c_custkey")).alias("account_id"),
        F.concat(F.lit("cust_"), F.col("c_custkey")).alias("customer_id"),
        F.col("c_acctbal").alias("balance"),
        F.lit("USD").alias("currency"),
        F.lit("ACTIVE").alias("status"),
    )


def incident_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst log: some incidents are assigned early, those not open got a status at the end."""
    base = incidents(spark, sf_dir)
    key = F.col("incident_id")
    none = F.lit(None).cast("string")
    who = F.concat(F.lit("analyst_"), key % 5)
    assign = F.when(
        key % 3 == 0,
        F.struct(
            F.lit("a").alias("change_id"),
            (F.col("created_at") + 3_600_000).alias("at"),
            F.lit("assign").alias("kind"),
            none.alias("new_status"),
            who.alias("assigned_to"),
            F.lit("lead").alias("changed_by"),
            none.alias("notes"),
        ),
    )
    close = F.when(
        F.col("status") != "OPEN",
        F.struct(
            F.lit("b").alias("change_id"),
            F.col("updated_at").alias("at"),
            F.lit("status").alias("kind"),
            F.col("status").alias("new_status"),
            none.alias("assigned_to"),
            who.alias("changed_by"),
            F.lit("reviewed").alias("notes"),
        ),
    )
    return base.select("incident_id", F.explode(F.array_compact(F.array(assign, close))).alias("x")).select(
        "incident_id", "x.*"
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages as they arrive: change envelopes, deletes, telemetry, broken text."""
    a = logins(spark, sf_dir)
    number = F.col("event_id").cast("long")
    deleted = number % 11 == 0
    after = F.struct(
        "event_id", "customer_id", "device_id", "country", "ip_address", "success", (F.col("t") * 1000).alias("timestamp")
    )
    source = F.struct(F.concat(F.lit("lsn-"), F.col("event_id")).alias("lsn"), F.lit("public.login_events").alias("table"))
    a = a.select(
        F.lit("banking.public.login_events").alias("topic"),
        F.to_json(
            F.struct(
                F.when(~deleted, after).alias("after"),
                source.alias("source"),
                F.when(deleted, "d").otherwise("c").alias("op"),
                F.col("t").alias("ts_ms"),
            )
        ).alias("value"),
        F.col("t").alias("ingest_time"),
    )
    b = transfers(spark, sf_dir)
    after = F.struct("transaction_id", "from_account", "to_account", "amount", (F.col("t") * 1000).alias("timestamp"))
    source = F.struct(
        F.concat(F.lit("tx-"), F.col("transaction_id")).alias("txId"), F.lit("public.transactions").alias("table")
    )
    b = b.select(
        F.lit("banking.public.transactions").alias("topic"),
        F.to_json(
            F.struct(after.alias("after"), source.alias("source"), F.lit("r").alias("op"), F.col("t").alias("ts_ms"))
        ).alias("value"),
        F.col("t").alias("ingest_time"),
    )
    c = api_requests(spark, sf_dir)
    text = F.to_json(
        F.struct("request_id", "ip_address", "endpoint", "method", "status_code", F.col("t").alias("timestamp"))
    )
    broken = F.col("request_id").cast("long") % 13 == 0
    c = c.withColumn("_text", text).select(
        F.lit("api_requests").alias("topic"),
        F.when(broken, F.expr("substring(_text, 1, length(_text) - 5)")).otherwise(F.col("_text")).alias("value"),
        F.col("t").alias("ingest_time"),
    )
    return a.unionByName(b).unionByName(c)


def account_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("op") == "d"
    row = F.struct("account_id", "customer_id")
    return account_changes(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.when(gone, F.struct("account_id")).alias("before"),
                F.when(~gone, row).alias("after"),
                "op",
                F.col("t").alias("ts_ms"),
            )
        ).alias("value")
    )


def telemetry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API telemetry; some records carry a text status code or no timestamp."""
    number = F.col("request_id").cast("long")

    def record(status: Column, *time: Column) -> Column:
        fields = ["request_id", "ip_address", F.lit("agent").alias("user_agent"), "endpoint", "method"]
        return F.to_json(F.struct(*fields, status.alias("status_code"), *time))

    time = F.col("t").alias("timestamp")
    value = (
        F.when(number % 17 == 0, record(F.lit("TWO_HUNDRED"), time))
        .when(number % 19 == 0, record(F.col("status_code")))
        .otherwise(record(F.col("status_code"), time))
    )
    return api_requests(spark, sf_dir).select(value.alias("value"), (F.col("t") + 1000).alias("ingest_time"))


def repeated_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with redeliveries: two inside the 24 h horizon of the first, one beyond it."""
    hours = F.explode(F.array(*[F.lit(h) for h in (0, 12, 23, 30)]))
    return (
        transfers(spark, sf_dir)
        .select("*", hours.alias("h"))
        .select(
            F.concat_ws("-", "transaction_id", "h").alias("event_id"),
            F.col("from_account").alias("identity_key"),
            # One transfer in seven lacks a key and is never a repeat.
            F.when(
                F.col("transaction_id").cast("long") % 7 != 0,
                F.concat(F.lit("transactions:"), F.col("transaction_id")),
            ).alias("dedup_key"),
            (F.col("t") + F.col("h") * 3_600_000).alias("event_time"),
        )
    )


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON text; those of the primary engine name no engine and rely on the topic."""
    primary = F.col("engine_source") == "flink-primary"
    return alerts(spark, sf_dir).select(
        F.when(primary, "fraud_alerts_v2").otherwise("fraud_alerts").alias("source_topic"),
        F.to_json(
            F.struct(
                "alert_id",
                "customer_id",
                F.col("t").alias("event_time"),
                F.col("cumulative_score"),
                F.when(~primary, F.col("engine_source")).alias("engine_source"),
            )
        ).alias("value"),
    )


def analyst_changes(alerts: DataFrame) -> DataFrame:
    """An analyst acts on some alerts: gives the incident to somebody, closes it, or opens it again."""
    day = F.floor(F.col("event_time") / 86_400_000)
    status = F.when(day % 4 == 0, "CONFIRMED_FRAUD").when(day % 4 == 1, "FALSE_POSITIVE").when(day % 8 == 2, "OPEN")
    return alerts.filter(day % 8 != 7).select(
        "identity_key",
        F.concat(F.lit("chg_"), "alert_id").alias("change_id"),
        (F.col("event_time") + 3_600_000 * (1 + day % 3)).alias("at"),
        F.when(status.isNull(), "assign").otherwise("status").alias("kind"),
        status.alias("new_status"),
        F.when(status.isNull(), F.concat(F.lit("analyst_"), (day % 5).cast("string"))).alias("assigned_to"),
    )


def latest(*frames: DataFrame) -> int:
    """Largest event time over the frames: the default ``as_of`` of lookbacks."""
    times = [f.agg(F.max("t").alias("t")) for f in frames]
    both = times[0]
    for other in times[1:]:
        both = both.unionByName(other)
    return both.agg(F.max("t")).first()[0] or 0
