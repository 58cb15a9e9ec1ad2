"""The whole chain: messages in, routed alerts and incidents out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import DAY, IndicatorConfig, ScoreConfig
from riskloom.functions.ordered import DEFAULT_MAX_ROWS
from riskloom.operators import enrich, incidents, normalize
from riskloom.operators.indicators import derive_indicators, identity_rows
from riskloom.operators.scoring import risk_alerts
from riskloom.session import cut_lineage
from riskloom.sinks import alerts as sink
from riskloom.streaming import jobs


@dataclass(frozen=True)
class Settings:
    indicators: IndicatorConfig = IndicatorConfig()
    scores: ScoreConfig = ScoreConfig()
    horizon: int = DAY
    max_rows: int = DEFAULT_MAX_ROWS


def batch_alerts(messages: DataFrame, account_messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Normalise, look up owners, mark repeats, score.

    Events without an identity are dropped only after the owner lookup, which
    may give them one.
    """
    events = normalize.normalize_events(messages)
    owned = enrich.enrich_accounts(events, normalize.parse_account_updates(account_messages), settings.max_rows)
    # Written once here and once after the repeats are marked: later steps read their rows several
    # times, and would parse all messages again each time.
    known = cut_lineage(owned.filter(F.col("identity_key").isNotNull()))
    marked = cut_lineage(enrich.dedup_events(known, settings.horizon, settings.max_rows, keep_repeats=True))
    rows = derive_indicators(identity_rows(marked, settings.max_rows), settings.indicators)
    return risk_alerts(rows, settings.scores)


def batch_incidents(alerts: DataFrame) -> DataFrame:
    """Incidents of alerts of both engines."""
    return incidents.roll_up_incidents(incidents.assign_incidents(incidents.resolve_alerts(alerts)).result())


def stream_alerts(
    messages: DataFrame, owners: DataFrame, settings: Settings = Settings(), delay: str = "300 seconds"
) -> DataFrame:
    """Continuous alerts. ``owners`` is the account snapshot: a stream-static join
    reads it anew in each micro-batch, so a refreshed table is picked up."""
    events = normalize.normalize_events(messages)
    asks = F.col("customer_id").isNull() & F.col("from_account_id").isNotNull()
    snapshot = owners.select(F.col("account_id").alias("from_account_id"), F.col("customer_id").alias("_owner"))
    joined = events.join(snapshot, "from_account_id", "left")
    owner = F.when(asks, F.col("_owner"))
    owned = joined.withColumns(
        {"customer_id": F.coalesce(owner, "customer_id"), "identity_key": F.coalesce(owner, "identity_key")}
    ).drop("_owner")
    return jobs.stream_risk_alerts(owned, settings.indicators, settings.scores, delay, settings.horizon)


def start_alert_sink(alerts: DataFrame, path: str, checkpoint: str, interval: str = "15 seconds"):
    """Alerts to one folder per severity; a retried micro-batch writes the same folder again."""

    def write(batch: DataFrame, epoch: int) -> None:
        sink.write_epoch(batch, path, epoch)

    return (
        alerts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .foreachBatch(write)
        .start()
    )
