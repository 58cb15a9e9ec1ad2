"""Continuous forms of the operators on Structured Streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import DAY, HOUR, MINUTE, IndicatorConfig, ScoreConfig
from riskloom.functions.text import short_hash
from riskloom.operators.incidents import ACTIVE
from riskloom.operators.metrics import event_rate
from riskloom.operators.scoring import format_alerts
from riskloom.session import checkpoint_dir
from riskloom.streaming.processors import (
    ALERT_INPUT,
    EVENT_FIELDS,
    INCIDENT_STATE,
    AccountOwnerProcessor,
    FirstSeenProcessor,
    IncidentProcessor,
    OwnerProcessor,
    RiskProcessor,
    TakeoverProcessor,
)
from riskloom.streaming.revisions import REVISED, RevisingRiskProcessor

FILE_ROWS = 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """State lives on disk next to the executors and in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def with_watermark(df: DataFrame, time: str, delay: str) -> DataFrame:
    """``time`` is epoch milliseconds. An idle partition does not hold the watermark back."""
    return df.withColumn("event_ts", F.timestamp_millis(time)).withWatermark("event_ts", delay)


def stream_risk_alerts(
    events: DataFrame,
    indicators: IndicatorConfig = IndicatorConfig(),
    scores: ScoreConfig = ScoreConfig(),
    delay: str = "300 seconds",
    horizon: int = DAY,
) -> DataFrame:
    """Alerts of a stream of risk events; rows behind the watermark are dropped."""
    prepare(events.sparkSession)
    hits = (
        with_watermark(_profile_rows(events), "event_time", delay)
        .groupBy("identity_key")
        .transformWithState(
            RiskProcessor(indicators, scores, horizon), ALERT_INPUT, outputMode="append", timeMode="eventTime"
        )
    )
    return format_alerts(hits, scores)


def _profile_rows(events: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast("string") for n in EVENT_FIELDS if n not in events.columns}
    known = events.withColumns(missing).filter(F.col("identity_key").isNotNull())
    return known.select("identity_key", "event_time", *EVENT_FIELDS)


def stream_revised_alerts(
    events: DataFrame,
    indicators: IndicatorConfig = IndicatorConfig(),
    scores: ScoreConfig = ScoreConfig(),
    delay: str = "300 seconds",
    horizon: int = DAY,
) -> DataFrame:
    """Alerts of a stream whose rows come up to ``delay`` out of order, for update mode.

    A row that comes late is scored in its place: alerts after it that it alters are told again with a higher
    ``revision``, those it takes away with ``withdrawn``. The last row per identity, event time and event id counts
    (see ``drain_latest``), and equals ``risk_alerts`` over the same rows. State holds the rows above the watermark.
    """
    prepare(events.sparkSession)
    hits = (
        with_watermark(_profile_rows(events), "event_time", delay)
        .groupBy("identity_key")
        .transformWithState(
            RevisingRiskProcessor(indicators, scores, horizon), REVISED, outputMode="update", timeMode="eventTime"
        )
    )
    return format_alerts(hits, scores, also=("event_id", "revision", "withdrawn"))


def stream_seen_before(events: DataFrame, history: DataFrame | None = None, beyond: int = DAY) -> DataFrame:
    """``seen_before`` of a stream that is its own history, begun with the batch table ``history`` if there is one.

    Rows may come up to ``beyond`` out of order without changing an answer: what decides lies further back. Nothing
    is dropped as late. Rows without an identity get null.
    """
    prepare(events.sparkSession)
    known, begin = events.filter(F.col("identity_key").isNotNull()), None
    if history is not None:
        firsts = history.filter(F.col("customer_id").isNotNull() & F.col("event_time").isNotNull())
        firsts = firsts.groupBy(F.col("customer_id").alias("identity_key")).agg(F.min("event_time").alias("first"))
        begin = firsts.groupBy("identity_key")
    found = (
        known.filter(F.col("event_time").isNotNull())
        .select("identity_key", "event_id", "event_time")
        .groupBy("identity_key")
        .transformWithState(
            FirstSeenProcessor(beyond),
            "event_id string, identity_key string, event_time long, seen_beyond_state_window boolean",
            outputMode="append",
            timeMode="None",
            initialState=begin,
        )
    )
    unknown = events.filter(F.col("identity_key").isNull() | F.col("event_time").isNull())
    seen = F.when(F.col("identity_key").isNotNull(), F.lit(False)).alias("seen_beyond_state_window")
    return found.unionByName(unknown.select("event_id", "identity_key", "event_time", seen))


def stream_account_enrichment(
    events: DataFrame, updates: DataFrame, delay: str = "300 seconds", early: bool = False
) -> DataFrame:
    """Owner of the paying account as of the event, from a change stream keyed by account.

    Equals ``enrich_accounts`` whatever the order of arrival, as long as nothing is later than ``delay``. A lookup
    is answered once, when the watermark has passed it. With ``early`` it is answered as it arrives and again when a
    change alters the answer, for update mode (see ``drain_latest``).

    Keyed state instead of a copy of the whole map on every task: live accounts, and what is above the watermark.
    """
    prepare(events.sparkSession)
    changes = updates.select(
        F.col("account_id").alias("from_account_id"),
        F.lit(0).alias("kind"),
        "event_time",
        F.coalesce("customer_id", F.lit("")).alias("event_id"),  # order of changes at one time
        F.when(~F.col("deleted"), F.col("customer_id")).alias("customer_id"),
    )
    asks = events.filter(F.col("customer_id").isNull() & F.col("from_account_id").isNotNull()).select(
        "from_account_id", F.lit(1).alias("kind"), "event_time", "event_id", F.lit(None).cast("string").alias("customer_id")
    )
    found = (
        with_watermark(changes.unionByName(asks), "event_time", delay)
        .groupBy("from_account_id")
        .transformWithState(
            OwnerProcessor(early),
            "event_id string, from_account_id string, event_time long, customer_id string",
            outputMode="update" if early else "append",
            timeMode="eventTime",
        )
    )
    account = F.concat(F.lit("acct:"), F.col("from_account_id"))
    return found.withColumn("identity_key", F.coalesce("customer_id", account))


def stream_timeline(
    logins: DataFrame,
    beneficiaries: DataFrame,
    transfers: DataFrame,
    accounts: DataFrame,
    delay: str = "5 seconds",
    hold: int = DAY,
) -> DataFrame:
    """Unified timeline; transfers meet the owners of their account in keyed state.

    An account may be any age: its owner is kept with the account. A transfer waits for account rows up to
    ``hold`` milliseconds after it, and neither may be later than ``delay``.
    """
    prepare(transfers.sparkSession)
    owned = accounts.filter(F.col("op").isin("c", "r") & F.col("customer_id").isNotNull()).select(
        "account_id",
        F.lit(0).alias("kind"),
        F.col("t").alias("event_time"),
        "customer_id",
        F.lit(None).cast("string").alias("row_id"),
        F.lit(None).cast("double").alias("amount"),
    )
    moved = transfers.select(
        F.col("from_account").alias("account_id"),
        F.lit(1).alias("kind"),
        F.col("t").alias("event_time"),
        F.lit(None).cast("string").alias("customer_id"),
        F.col("transaction_id").alias("row_id"),
        F.col("amount").cast("double").alias("amount"),
    )
    meet = owned.unionByName(moved).filter(F.col("account_id").isNotNull())
    joined = (
        with_watermark(meet, "event_time", delay)
        .groupBy("account_id")
        .transformWithState(
            AccountOwnerProcessor(hold),
            "customer_id string, event_time long, row_id string, amount double",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    rows = joined.select("customer_id", F.lit("TRANSFER").alias("event_type"), "event_time", "row_id", "amount")
    none = F.lit(0.0).alias("amount")
    failed = logins.filter(~F.col("success")).select(
        "customer_id", F.lit("LOGIN_FAILED").alias("event_type"), F.col("t").alias("event_time"),
        F.col("event_id").alias("row_id"), none,
    )
    added = beneficiaries.select(
        "customer_id", F.lit("BENEFICIARY_ADD").alias("event_type"), F.col("t").alias("event_time"),
        F.col("beneficiary_id").alias("row_id"), none,
    )
    return failed.unionByName(added).unionByName(rows)


def stream_takeovers(timeline: DataFrame, within: int = HOUR, delay: str = "5 seconds") -> DataFrame:
    prepare(timeline.sparkSession)
    found = (
        with_watermark(timeline, "event_time", delay)
        .groupBy("customer_id")
        .transformWithState(
            TakeoverProcessor(within),
            "customer_id string, initial_failed_login long, beneficiary_added_time long, "
            "exfiltration_transfer_time long, stolen_funds double",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    return found.withColumn("risk_indicator_type", F.lit("CEP_ATO_MATCH"))


def takeover_log(timeline: DataFrame, within: int = HOUR, delay: str = "5 seconds") -> DataFrame:
    """Timeline rows and the takeovers among them as one stream, told apart by ``kind`` (see ``TAKEOVER_SINKS``)."""
    rows = timeline.select(F.lit("timeline").alias("kind"), *TIMELINE)
    found = stream_takeovers(timeline, within, delay)
    return rows.unionByName(found.select(F.lit("takeover").alias("kind"), "*"), allowMissingColumns=True)


TIMELINE = ("customer_id", "event_type", "event_time", "row_id", "amount")
TAKEOVER = (
    "customer_id",
    "risk_indicator_type",
    "initial_failed_login",
    "beneficiary_added_time",
    "exfiltration_transfer_time",
    "stolen_funds",
)


def _late(batch: DataFrame, passed: int | None) -> DataFrame:
    late = F.lit(False) if passed is None else F.col("event_time") <= passed
    return batch.filter((F.col("kind") == "timeline") & late).select(*TIMELINE)


# Sinks of a ``takeover_log``: all rows, the matches, and the rows the matcher dropped as late.
TAKEOVER_SINKS = {
    "timeline": lambda batch, passed: batch.filter(F.col("kind") == "timeline").select(*TIMELINE),
    "takeovers": lambda batch, passed: batch.filter(F.col("kind") == "takeover").select(*TAKEOVER),
    "late": _late,
}


def stream_incidents(alerts: DataFrame, gap: int = 30 * MINUTE, delay: str = "300 seconds") -> DataFrame:
    """Incidents as session windows, emitted once closed. ``alerts`` are resolved alerts.

    The gap is inclusive, hence the extra microsecond on the window.
    """
    prepare(alerts.sparkSession)
    marked = with_watermark(alerts, "event_time", delay)
    session = F.session_window("event_ts", f"{gap * 1000 + 1} microseconds")
    engines = F.sort_array(F.collect_set("engine_source"))
    score = F.max("risk_score")
    grouped = marked.groupBy("identity_key", session.alias("session")).agg(
        F.min_by("indicator", F.struct("event_time", "alert_id")).alias("first"),
        F.count(F.lit(1)).alias("alert_count"),
        score.alias("max_risk_score"),
        F.min("event_time").alias("first_alert_at"),
        F.max("event_time").alias("last_alert_at"),
        engines.alias("engine_sources"),
    )
    top = F.col("max_risk_score")
    return grouped.select(
        F.md5(F.concat_ws("|", "identity_key", F.col("first_alert_at").cast("string"))).alias("incident_id"),
        "identity_key",
        F.concat(F.lit("Fraud Alert: "), F.col("first")).alias("title"),
        F.lit("OPEN").alias("status"),
        F.when(top >= 90, "CRITICAL").when(top >= 70, "HIGH").otherwise("MEDIUM").alias("severity"),
        "alert_count",
        "max_risk_score",
        "first_alert_at",
        "last_alert_at",
        F.col("last_alert_at").alias("updated_at"),
        "engine_sources",
        (F.size("engine_sources") > 1).alias("corroborated"),
    )


def stream_incident_states(
    timeline: DataFrame, gap: int = 30 * MINUTE, keep: int = 30 * DAY, delay: str = "300 seconds"
) -> DataFrame:
    """Incidents of a stream of ``incident_timeline`` rows as upserts: open ones with every micro-batch that
    touches them, and with the status analysts gave them. For update mode (see ``drain_latest``)."""
    prepare(timeline.sparkSession)
    states = (
        with_watermark(timeline, "at", delay)
        .groupBy("identity_key")
        .transformWithState(
            IncidentProcessor(gap, keep, ACTIVE),
            f"identity_key string, {INCIDENT_STATE}",
            outputMode="update",
            timeMode="eventTime",
        )
    )
    top = F.col("max_risk_score")
    return states.select(
        short_hash(F.col("identity_key"), F.col("opened_at").cast("string"), length=32).alias("incident_id"),
        "identity_key",
        "title",
        "status",
        F.when(top >= 90, "CRITICAL").when(top >= 70, "HIGH").otherwise("MEDIUM").alias("severity"),
        "alert_count",
        "max_risk_score",
        "first_alert_at",
        "last_alert_at",
        "updated_at",
        "engine_sources",
        (F.size("engine_sources") > 1).alias("corroborated"),
        "assigned_to",
        "version",
    )


def stream_event_rate(
    events: DataFrame, time: str, label: str, size: str = "5 minutes", slide: str | None = None, delay: str = "5 seconds"
) -> DataFrame:
    """Sliding event rates. In append mode each window comes once final, in update mode (see
    ``drain_latest``) with every change, the first event included."""
    return event_rate(with_watermark(events, time, delay), "event_ts", label, size, slide)


def stream_dedup(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Drop repeats of a dedup key inside the watermark; rows without key pass."""
    prepare(events.sparkSession)
    keyed = with_watermark(events.filter(F.col("dedup_key").isNotNull()), "event_time", delay)
    unique = keyed.dropDuplicatesWithinWatermark(["identity_key", "dedup_key"]).drop("event_ts")
    return unique.unionByName(events.filter(F.col("dedup_key").isNull()))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, name: str) -> str:
    """Run a stream over everything available into a fresh folder; its path.

    The checkpoint makes a restarted run continue where it stopped; the file
    sink commits each micro-batch once.
    """
    root = scratch(stream.sparkSession, name)
    (
        stream.writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .format("parquet")
        .option("path", f"{root}/out")
        .outputMode("append")
        .start()
        .awaitTermination()
    )
    return f"{root}/out"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """What a stream writes over everything available."""
    return stream.sparkSession.read.schema(stream.schema).parquet(run_available(stream, name))


def drain_latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last state of every key that a stream in update mode writes over everything available.

    A micro-batch that is run again writes its own folder again.
    """
    spark, root = stream.sparkSession, scratch(stream.sparkSession, name)
    versioned = T.StructType([*stream.schema.fields, T.StructField("_epoch", T.LongType())])
    spark.createDataFrame([], versioned).write.parquet(f"{root}/out/start")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{root}/out/{epoch}")

    (
        stream.writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .outputMode("update")
        .foreachBatch(keep)
        .start()
        .awaitTermination()
    )
    rows = spark.read.schema(versioned).parquet(f"{root}/out/*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_epoch").alias("_row"))
    return last.select("_row.*")


def replayed(df: DataFrame, time: str, cuts: list[int], name: str, spread: int = 0, file_rows: int = FILE_ROWS) -> DataFrame:
    """A table as a stream of ``len(cuts) + 1`` micro-batches: one per stretch of arrival times between cuts.

    A row arrives up to ``spread`` milliseconds after its time, by a hash of the row, so rows come out of order.
    Tables replayed with the same cuts move on together. A micro-batch has a file for about ``file_rows`` rows.
    """
    spark, root = df.sparkSession, scratch(df.sparkSession, name)
    delay = F.pmod(F.xxhash64(*df.columns), F.lit(spread)) if spread else F.lit(0)
    slot = sum((F.col(time) + delay >= c).cast("int") for c in cuts)
    # Worked out once by all tasks; a micro-batch then reads its own rows only.
    staged = df.withColumn("_slot", F.coalesce(slot, F.lit(0)).cast("int"))
    staged.write.partitionBy("_slot").parquet(f"{root}/rows")
    schema = T.StructType([*df.schema.fields, T.StructField("_slot", T.IntegerType())])
    staged = spark.read.schema(schema).parquet(f"{root}/rows")
    most = staged.groupBy("_slot").count().agg(F.max("count")).first()[0] or 0
    files = -(-most // file_rows) or 1
    for k in range(len(cuts) + 1):
        # As many files for every micro-batch, written one after the other: a stream reads files by age.
        own = staged.filter(F.col("_slot") == k).drop("_slot")
        own = own.coalesce(1) if files == 1 else own.repartition(files)
        own.write.parquet(f"{root}/feed/{k}")
        # A task without rows writes no file.
        for _ in range(files - len(spark.read.schema(df.schema).parquet(f"{root}/feed/{k}").inputFiles())):
            own.limit(0).coalesce(1).write.mode("append").parquet(f"{root}/feed/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/feed/*")


def late_rows(events: DataFrame, time: str, delay: int, name: str = "late") -> DataFrame:
    """Rows of a stream that stateful operators drop: behind the largest event time of earlier
    micro-batches by more than ``delay`` milliseconds. They can be scored in a batch run with their history.

    Each micro-batch leaves its largest time and its late rows under its own number, so one that is run again
    writes the same again.
    """
    spark, root = events.sparkSession, scratch(events.sparkSession, name)
    marks = "epoch long, high long"
    spark.createDataFrame([], marks).write.parquet(f"{root}/marks/start")
    spark.createDataFrame([], events.schema).write.parquet(f"{root}/late/start")

    def keep(batch: DataFrame, epoch: int) -> None:
        seen = spark.read.schema(marks).parquet(f"{root}/marks/*").filter(F.col("epoch") < epoch)
        high = seen.agg(F.max("high")).first()[0]
        if high is not None:
            late = batch.filter(F.col(time) < high - delay)
            late.write.mode("overwrite").parquet(f"{root}/late/{epoch}")
        own = batch.agg(F.max(time).cast("long").alias("high")).select(F.lit(epoch).cast("long").alias("epoch"), "high")
        own.write.mode("overwrite").parquet(f"{root}/marks/{epoch}")

    (
        events.writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(events.schema).parquet(f"{root}/late/*")


class StreamTables:
    """Stands in for a session when fixture views are wanted as streams."""

    def __init__(self, spark: SparkSession, files_per_trigger: int | None = None):
        self.spark, self.limit = spark, files_per_trigger

    @property
    def read(self) -> StreamTables:
        return self

    def parquet(self, path: str) -> DataFrame:
        schema = self.spark.read.parquet(path).schema
        folder, name = os.path.split(path)
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", name)
        if self.limit:
            reader = reader.option("maxFilesPerTrigger", self.limit)
        return reader.parquet(folder)
