"""Alerts bundled into incidents, and analyst changes applied to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import MINUTE
from riskloom.functions.ordered import DEFAULT_MAX_ROWS, KeyedRows, keyed_rows
from riskloom.functions.text import non_blank, short_hash

# Topics of the primary engine, and the names of the two engines.
PRIMARY_TOPICS = ("fraud_alerts_v2", "critical_alerts_v2")
PRIMARY_ENGINE, SECONDARY_ENGINE = "flink-primary", "python-secondary"


def resolve_alerts(alerts: DataFrame) -> DataFrame:
    """Fill identity, score, indicator and engine from whatever the alert carries."""
    have = set(alerts.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    listed = col("contributing_indicators", "array<string>")
    last = F.get(listed, F.size(listed) - 1)
    by_topic = F.when(col("source_topic", "string").isin(*PRIMARY_TOPICS), PRIMARY_ENGINE).otherwise(SECONDARY_ENGINE)
    identity = F.coalesce(
        non_blank(col("identity_key", "string")),
        non_blank(col("customer_id", "string")),
        non_blank(col("account_id", "string")),
        F.lit("UNKNOWN"),
    )
    resolved = {
        "identity_key": identity,
        "risk_score": F.coalesce(col("cumulative_score", "double"), col("risk_score", "double"), F.lit(50.0)),
        "indicator": F.coalesce(
            non_blank(col("trigger_reason", "string")),
            non_blank(col("rule_name", "string")),
            non_blank(last),
            F.lit("ANOMALY_DETECTED"),
        ),
        "engine_source": F.coalesce(non_blank(col("engine_source", "string")), by_topic),
        "source_topic": col("source_topic", "string"),
    }
    return alerts.withColumns(resolved)


def assign_incidents(alerts: DataFrame, gap: int = 30 * MINUTE, max_rows: int = DEFAULT_MAX_ROWS) -> KeyedRows:
    """Add ``incident_id`` and ``opened_at``: an alert joins its identity's incident
    while at most ``gap`` passed since the one before, and else opens one."""
    t = F.col("event_time")
    rows = keyed_rows(alerts, ["identity_key"], ["event_time", "alert_id"], max_rows).history(lasts={"_prev": t})
    opens = F.col("_prev").isNull() | (t - F.col("_prev") > gap)
    rows = rows.with_column("_opens", F.when(opens, t)).history(lasts={"_open": F.col("_opens")})
    opened = F.coalesce("_opens", "_open")
    tagged = rows.rows.withColumn("opened_at", opened).drop("_prev", "_opens", "_open")
    return rows.with_rows(
        tagged.withColumn("incident_id", short_hash(F.col("identity_key"), F.col("opened_at").cast("string"), length=32))
    )


def roll_up_incidents(assigned: DataFrame) -> DataFrame:
    """One row per incident. Everything combines map-side; the engine set is tiny."""
    score = F.max("risk_score")
    severity = F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").otherwise("MEDIUM")
    engines = F.sort_array(F.collect_set("engine_source"))
    first = F.min_by("indicator", F.struct("event_time", "alert_id"))
    return assigned.groupBy("incident_id", "identity_key").agg(
        F.concat(F.lit("Fraud Alert: "), first).alias("title"),
        F.lit("OPEN").alias("status"),
        severity.alias("severity"),
        F.count(F.lit(1)).alias("alert_count"),
        score.alias("max_risk_score"),
        F.min("event_time").alias("first_alert_at"),
        F.max("event_time").alias("last_alert_at"),
        F.max("event_time").alias("updated_at"),
        engines.alias("engine_sources"),
        (F.size(engines) > 1).alias("corroborated"),
    )


# An alert may join incidents in these states.
ACTIVE = ("OPEN", "INVESTIGATING")


def incident_timeline(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Resolved alerts and analyst changes of all identities as rows of one kind.

    ``changes``: identity_key, change_id, at, kind ('status' or 'assign'), new_status, assigned_to. A change is
    about the identity's latest incident. At one time alerts come before changes.
    """
    none = F.lit(None).cast("string")
    asked = alerts.select(
        "identity_key",
        F.col("event_time").alias("at"),
        F.lit(0).alias("rank"),
        F.col("alert_id").alias("row_id"),
        F.lit("alert").alias("kind"),
        F.col("risk_score").cast("double").alias("risk_score"),
        "indicator",
        "engine_source",
        none.alias("new_status"),
        none.alias("assigned_to"),
    )
    done = changes.select(
        "identity_key",
        "at",
        F.lit(1).alias("rank"),
        F.col("change_id").alias("row_id"),
        "kind",
        F.lit(None).cast("double").alias("risk_score"),
        none.alias("indicator"),
        none.alias("engine_source"),
        "new_status",
        "assigned_to",
    )
    return asked.unionByName(done).filter(F.col("identity_key").isNotNull())


def incidents_with_closings(
    timeline: DataFrame, gap: int = 30 * MINUTE, max_rows: int = DEFAULT_MAX_ROWS
) -> KeyedRows:
    """Add ``incident_id``, ``opened_at`` and ``opens`` to the rows of ``incident_timeline``.

    An alert joins the latest incident of its identity while that is open or under investigation and was touched, by an
    alert or a change, at most ``gap`` ago; else it opens a new one. Changes before the first alert go.
    """
    at, alert, status = F.col("at"), F.col("kind") == "alert", F.col("kind") == "status"
    rows = keyed_rows(timeline, ["identity_key"], ["at", "rank", "row_id"], max_rows)
    active = F.when(alert, True).when(status, F.coalesce(F.col("new_status").isin(*ACTIVE), F.lit(False)))
    rows = rows.history(lasts={"_prev": at, "_active": active, "_alert": F.when(alert, at)})
    apart = F.col("_alert").isNull() | ~F.col("_active") | (at - F.col("_prev") > gap)
    rows = rows.filter(alert | F.col("_alert").isNotNull()).with_column("opens", alert & apart)
    rows = rows.history(lasts={"_open": F.when(F.col("opens"), at)})
    opened = F.when(F.col("opens"), at).otherwise(F.col("_open"))
    tagged = rows.rows.withColumn("opened_at", opened).drop("_prev", "_active", "_alert", "_open")
    return rows.with_rows(
        tagged.withColumn("incident_id", short_hash(F.col("identity_key"), F.col("opened_at").cast("string"), length=32))
    )


def roll_up_lifecycle(tagged: DataFrame) -> DataFrame:
    """One row per incident with its current status. Everything combines map-side."""
    alert, place = F.col("kind") == "alert", F.struct("at", "rank", "row_id")
    said = F.when(F.col("opens"), "OPEN").when(F.col("kind") == "status", F.col("new_status"))
    given = F.when(F.col("kind") == "assign", place)
    score = F.max("risk_score")
    rolled = tagged.groupBy("incident_id", "identity_key").agg(
        F.concat(F.lit("Fraud Alert: "), F.min_by("indicator", F.when(alert, place))).alias("title"),
        F.max_by(said, F.when(said.isNotNull(), place)).alias("_said"),
        F.max(F.when(said.isNotNull(), place)).alias("_said_at"),
        F.max(given).alias("_given_at"),
        F.max_by("assigned_to", given).alias("assigned_to"),
        F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.count(F.when(alert, 1)).alias("alert_count"),
        score.alias("max_risk_score"),
        F.min(F.when(alert, F.col("at"))).alias("first_alert_at"),
        F.max(F.when(alert, F.col("at"))).alias("last_alert_at"),
        F.max("at").alias("updated_at"),
        F.sort_array(F.collect_set("engine_source")).alias("engine_sources"),
    )
    moved = (F.col("_said") == "OPEN") & F.coalesce(F.col("_given_at") > F.col("_said_at"), F.lit(False))
    return rolled.select(
        "incident_id",
        "identity_key",
        "title",
        F.when(moved, "INVESTIGATING").otherwise(F.col("_said")).alias("status"),
        "severity",
        "alert_count",
        "max_risk_score",
        "first_alert_at",
        "last_alert_at",
        "updated_at",
        "engine_sources",
        (F.size("engine_sources") > 1).alias("corroborated"),
        "assigned_to",
    )


def incident_links(assigned: DataFrame) -> DataFrame:
    """Every alert with the incident it belongs to and its payload as JSON."""
    payload = F.to_json(F.struct(*[c for c in assigned.columns if not c.startswith("_") and c not in ("opened_at",)]))
    return assigned.select(
        "incident_id",
        "alert_id",
        "indicator",
        "risk_score",
        "source_topic",
        payload.alias("raw_payload"),
        F.col("event_time").alias("received_at"),
    )


def incident_detail(incidents: DataFrame, links: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """Incidents with their alerts and audit rows, in long form.

    One row per child instead of nested lists: an incident of an identity under
    attack may hold any number of alerts and must not end up in one row.
    """
    head = incidents.select(
        "incident_id", "identity_key", "title", "status", "severity", "alert_count", "corroborated"
    )
    children = links.select(
        "incident_id",
        F.lit("alert").alias("child"),
        F.col("alert_id").alias("child_id"),
        F.col("indicator").alias("label"),
        "risk_score",
        F.col("received_at").alias("at"),
    )
    if audits is not None:
        change = F.concat_ws(" -> ", "previous_status", "new_status")
        children = children.unionByName(
            audits.select(
                "incident_id",
                F.lit("audit").alias("child"),
                F.col("changed_by").alias("child_id"),
                change.alias("label"),
                F.lit(None).cast("double").alias("risk_score"),
                F.col("at"),
            )
        )
    return head.join(children, "incident_id", "left")


def apply_changes(incidents: DataFrame, changes: DataFrame, max_rows: int = DEFAULT_MAX_ROWS):
    """Apply analyst changes in order: (current incidents, audit rows).

    ``changes``: incident_id, change_id, at, kind ('status' or 'assign'),
    new_status, assigned_to, changed_by, notes. Assignment moves an OPEN
    incident to INVESTIGATING and is audited only then. Status changes are
    always audited, also to the same status.
    """
    status_change = F.col("kind") == "status"
    base = incidents.select(
        "incident_id",
        F.lit("").alias("change_id"),
        F.col("created_at").alias("at"),
        F.lit("open").alias("kind"),
        F.col("status").alias("new_status"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("string").alias("changed_by"),
        F.lit(None).cast("string").alias("notes"),
    )
    opening = F.col("kind") == "open"
    log = base.unionByName(changes.select(*base.columns)).withColumn("_order", F.when(opening, 0).otherwise(1))
    rows = keyed_rows(log, ["incident_id"], ["_order", "at", "change_id"], max_rows)
    # The last explicit status, and whether an assignment came after it.
    explicit = F.when(opening | status_change, F.struct("new_status", F.lit(0).alias("n")))
    assigned = F.when(F.col("kind") == "assign", F.struct("_order", "at", "change_id"))
    marker = F.when(opening | status_change, F.struct("_order", "at", "change_id"))
    rows = rows.history(lasts={"_explicit": explicit, "_assign": assigned, "_marker": marker})
    moved = F.coalesce(F.col("_assign") > F.col("_marker"), F.lit(False)) & (
        F.col("_explicit.new_status") == "OPEN"
    )
    before = F.when(moved, F.lit("INVESTIGATING")).otherwise(F.col("_explicit.new_status"))
    rows = rows.with_column("previous_status", before)
    after = F.when(opening | status_change, F.col("new_status")).otherwise(
        F.when(F.col("previous_status") == "OPEN", "INVESTIGATING").otherwise(F.col("previous_status"))
    )
    applied = rows.with_column("_after", after).result()
    audited = status_change | ((F.col("kind") == "assign") & (F.col("previous_status") == "OPEN"))
    note = F.when(status_change, F.col("notes")).otherwise(
        F.concat(F.lit("Under investigation since it was given to "), F.col("assigned_to"))
    )
    audits = applied.filter(audited).select(
        "incident_id",
        "change_id",
        "previous_status",
        F.col("_after").alias("new_status"),
        "changed_by",
        note.alias("notes"),
        "at",
    )
    position = F.struct("_order", "at", "change_id")
    current = applied.groupBy("incident_id").agg(
        F.max_by("_after", position).alias("status"),
        F.max_by("assigned_to", F.when(F.col("assigned_to").isNotNull(), position)).alias("assigned_to"),
        F.max(F.when(opening | audited, F.col("at"))).alias("updated_at"),
        F.count(F.when(audited, 1)).alias("audit_rows"),
    )
    return current, audits
