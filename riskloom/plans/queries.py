"""Registered queries: every operator over the given tables.

Parameters are scaled to the sparse test data; library defaults stay as they are.
Arrays are joined to text, so results compare the same in any engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DAY, HOUR, IndicatorConfig, ScoreConfig, SecondaryConfig, secondary_indicators
from riskloom.functions.ordered import DEFAULT_MAX_ROWS
from riskloom.operators import enrich, graph, incidents, metrics, normalize, scorers, scoring, sequence
from riskloom.operators.indicators import derive_indicators, identity_rows, indicator_counts
from riskloom.session import use_utc
from riskloom.sinks import alerts as alert_sink
from riskloom.sinks import documents
from riskloom.sources import fixtures as fx
from riskloom.streaming import fanout, jobs

INDICATORS = IndicatorConfig(
    profile_ttl=48 * HOUR,
    travel_window=2 * HOUR,
    failed_login_count=2,
    failed_login_window=2 * DAY,
    velocity_count=3,
    velocity_window=48 * HOUR,
    large_transfer=100.0,
    api_count=5,
    api_window=24 * HOUR,
)
SCORES = ScoreConfig(decay=12 * HOUR, cooldown=6 * HOUR)
SECONDARY_INDICATORS = secondary_indicators(
    travel_window=2 * HOUR,
    failed_login_count=2,
    failed_login_window=2 * DAY,
    velocity_count=3,
    velocity_window=48 * HOUR,
    large_transfer=100.0,
    api_count=5,
    api_window=24 * HOUR,
)
SECONDARY = SecondaryConfig(decay=12 * HOUR, cooldown=6 * HOUR)
SECONDARY_COLUMNS = (
    "event_id",
    "event_time",
    "source_table",
    "customer_id",
    "account_id",
    "from_account_id",
    "ip_address",
    "country",
    "device_id",
    "login_success",
    "amount",
    "endpoint",
)
WEEK, YEAR = 7 * DAY, 365 * DAY
SPLIT_ROWS = 40  # rows of a key from which the *_split queries treat it as hot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(use_utc(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


@query
def normalize_events(spark, d):
    return normalize.normalize_events(fx.raw_messages(spark, d)).drop("source_operation")


@query
def telemetry_dead_letter(spark, d):
    return normalize.check_telemetry(fx.telemetry_messages(spark, d)).select("request_id", "timestamp", "error_message")


@query
def dedup_events(spark, d):
    return enrich.dedup_events(fx.repeated_transfers(spark, d))


@query
def dedup_split(spark, d):
    """As ``dedup_events``, with most accounts taken as hot."""
    return enrich.dedup_events(fx.repeated_transfers(spark, d), max_rows=SPLIT_ROWS)


@query
def account_snapshot(spark, d):
    return enrich.account_snapshot(normalize.parse_account_updates(fx.account_messages(spark, d)))


@query
def account_enrichment(spark, d):
    none = F.lit(None).cast("string")
    events = fx.transfers(spark, d).select(
        F.col("transaction_id").alias("event_id"),
        none.alias("dedup_key"),
        none.alias("customer_id"),
        F.col("from_account").alias("from_account_id"),
        F.concat(F.lit("acct:"), F.col("from_account")).alias("identity_key"),
        F.col("t").alias("event_time"),
    )
    updates = normalize.parse_account_updates(fx.account_messages(spark, d))
    enriched = enrich.enrich_accounts(events, updates)
    # An unmapped transaction keeps its account identity, so the filter comes after the join.
    return enriched.filter(F.col("identity_key").isNotNull()).drop("dedup_key")


@query
def historical_context(spark, d):
    logins = fx.logins(spark, d).select(
        "event_id", "customer_id", F.col("customer_id").alias("identity_key"), F.col("t").alias("event_time")
    )
    seen = enrich.seen_before(logins, logins, beyond=DAY)
    return seen.select("event_id", "identity_key", "event_time", "seen_beyond_state_window")


def indicator_rows(spark, d, max_rows=DEFAULT_MAX_ROWS):
    return derive_indicators(identity_rows(fx.risk_events(spark, d), max_rows), INDICATORS)


@query
def risk_indicators(spark, d):
    rows = indicator_rows(spark, d).result()
    return rows.select("identity_key", "event_id", "event_time", "source_table", "segment", joined("indicators"))


@query
def risk_scores(spark, d):
    rows = scoring.score_events(indicator_rows(spark, d), SCORES).result()
    return rows.select("identity_key", "event_id", "event_time", "weight", "score")


def primary_alerts(spark, d, max_rows=DEFAULT_MAX_ROWS):
    return scoring.risk_alerts(indicator_rows(spark, d, max_rows), SCORES)


@query
def risk_alerts(spark, d):
    names = [c if c not in ("contributing_indicators", "source_event_ids") else joined(c) for c in ALERT_COLUMNS]
    return primary_alerts(spark, d).select(*names)


@query
def risk_alerts_split(spark, d):
    """As ``risk_alerts``, with most identities taken as hot."""
    names = [c if c not in ("contributing_indicators", "source_event_ids") else joined(c) for c in ALERT_COLUMNS]
    return primary_alerts(spark, d, SPLIT_ROWS).select(*names)


ALERT_COLUMNS = [
    "alert_id",
    "identity_key",
    "customer_id",
    "account_id",
    "event_time",
    "severity",
    "cumulative_score",
    "threshold",
    "contributing_indicators",
    "trigger_reason",
    "first_seen_ts",
    "latest_seen_ts",
    "source_event_ids",
    "action_required",
]


@query
def alerts_by_severity(spark, d):
    routed = alert_sink.route(primary_alerts(spark, d))
    return routed.groupBy("topic", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("cumulative_score").alias("total_score")
    )


@query
def alerts_json(spark, d):
    return alert_sink.encode_json(primary_alerts(spark, d))


def secondary_counted():
    return (F.col("source_table") != "api_requests") | scorers.sensitive(F.coalesce("endpoint", F.lit("")))


def secondary_alerts(events, max_rows=DEFAULT_MAX_ROWS):
    rows = derive_indicators(identity_rows(events.filter(secondary_counted()), max_rows), SECONDARY_INDICATORS)
    alerts = scorers.secondary_risk_alerts(rows, SECONDARY)
    return alerts.drop("source_event_ids").withColumn(
        "contributing_indicators", F.array_join("contributing_indicators", ",")
    )


@query
def secondary_risk_alerts(spark, d):
    return secondary_alerts(fx.risk_events(spark, d))


@query
def secondary_split(spark, d):
    """As ``secondary_risk_alerts``, with most identities taken as hot."""
    return secondary_alerts(fx.risk_events(spark, d), SPLIT_ROWS)


@query
def secondary_end_to_end(spark, d):
    """From messages: owner before account, and logins that tell a status, or nothing, instead of a flag."""
    events = normalize.normalize_events(fx.raw_messages(spark, d))
    events = events.withColumn("event_id", F.coalesce("event_id", "dedup_key"))
    # What the engine reads, so that no more than that is stored on the way.
    events = events.filter(secondary_counted()).select(*SECONDARY_COLUMNS)
    owners = enrich.account_snapshot(normalize.parse_account_updates(fx.account_messages(spark, d)))
    known = scorers.secondary_identity(events, owners).filter(F.col("identity_key").isNotNull())
    number, is_login = F.col("event_id").try_cast("long"), F.col("source_table") == "login_events"
    told = (number % 5 == 0) & (number % 7 != 0)
    status = F.when(told, F.when(F.col("login_success"), "SUCCESS").otherwise("FAILURE"))
    flag = F.when(number % 5 != 0, F.col("login_success"))
    known = known.withColumn("login_success", F.when(is_login, scorers.login_succeeded(flag, status)))
    return secondary_alerts(known)


def labelled_events(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("indicators").alias("pos", "risk_indicator_type")).drop("indicators", "indicator")


def inactivity_alerts(rows):
    # Customers are identities here, so the rows are keyed already.
    same = rows.rows.filter(F.col("customer_id") == F.col("identity_key"))
    customers = rows.with_rows(labelled_events(same.withColumn("customer_id", F.col("identity_key"))))
    alerts = scorers.inactivity_reset_alerts(customers, idle=DAY)
    return alerts.withColumn("contributing_indicators", F.array_join("contributing_indicators", ","))


@query
def inactivity_reset_alerts(spark, d):
    return inactivity_alerts(indicator_rows(spark, d))


@query
def inactivity_split(spark, d):
    """As ``inactivity_reset_alerts``, with most identities taken as hot."""
    return inactivity_alerts(indicator_rows(spark, d, SPLIT_ROWS))


@query
def threshold_clear_alerts(spark, d):
    alerts = scorers.threshold_clear_alerts(labelled_events(indicator_rows(spark, d).result()))
    return alerts.withColumn("contributing_indicators", F.array_join("contributing_indicators", ","))


@query
def threshold_clear_split(spark, d):
    """As ``threshold_clear_alerts``, with most customers taken as hot."""
    labelled = labelled_events(indicator_rows(spark, d).result())
    alerts = scorers.threshold_clear_alerts(labelled, max_rows=SPLIT_ROWS)
    return alerts.withColumn("contributing_indicators", F.array_join("contributing_indicators", ","))


@query
def ip_velocity_alerts(spark, d):
    return scorers.ip_velocity_alerts(fx.api_requests(spark, d), hits=3, window=DAY, box=2 * DAY)


@query
def ip_velocity_split(spark, d):
    """As ``ip_velocity_alerts``, with most addresses taken as hot."""
    return scorers.ip_velocity_alerts(fx.api_requests(spark, d), hits=3, window=DAY, box=2 * DAY, max_rows=SPLIT_ROWS)


@query
def indicator_counts_query(spark, d):
    return indicator_counts(indicator_rows(spark, d).result())


QUERIES["indicator_counts"] = QUERIES.pop("indicator_counts_query")


@query
def identities_tracked(spark, d):
    return metrics.identities_tracked(fx.risk_events(spark, d), prefix="cust_")


def timeline(spark, d):
    changes = fx.account_changes(spark, d)
    return sequence.unified_timeline(fx.logins(spark, d), fx.beneficiaries(spark, d), fx.transfers(spark, d), changes)


@query
def unified_timeline(spark, d):
    return timeline(spark, d)


@query
def ato_sequence(spark, d):
    return sequence.takeover_sequences(timeline(spark, d), within=48 * HOUR)


@query
def ato_split(spark, d):
    """As ``ato_sequence``, with most customers taken as hot."""
    return sequence.takeover_sequences(timeline(spark, d), within=48 * HOUR, max_rows=SPLIT_ROWS // 4)


@query
def decode_alerts(spark, d):
    decoded = incidents.resolve_alerts(normalize.decode_alerts(fx.alert_messages(spark, d))[0])
    return decoded.select(
        "source_topic", "alert_id", "identity_key", "event_time", "risk_score", "indicator", "engine_source"
    )


@query
def alert_decoding(spark, d):
    """One message in five in the binary format, one in five cut off: every message is told of once."""
    day = F.floor(F.get_json_object("value", "$.event_time").cast("long") / DAY) % 5
    value = F.when(day == 0, F.concat(F.lit("\x00"), "value")).when(day == 1, F.substring("value", 1, 9)).otherwise(F.col("value"))
    decoded, undecoded = normalize.decode_alerts(fx.alert_messages(spark, d).withColumn("value", value))
    told = decoded.select("source_topic", F.lit("decoded").alias("outcome")).unionByName(
        undecoded.select("source_topic", F.col("error").alias("outcome"))
    )
    return told.groupBy("source_topic", "outcome").agg(F.count(F.lit(1)).alias("messages"))


def assigned_alerts(spark, d):
    decoded = incidents.resolve_alerts(normalize.decode_alerts(fx.alert_messages(spark, d))[0])
    return incidents.assign_incidents(decoded, gap=12 * HOUR).result()


@query
def incidents_query(spark, d):
    rolled = incidents.roll_up_incidents(assigned_alerts(spark, d))
    return rolled.withColumn("engine_sources", F.array_join("engine_sources", ","))


QUERIES["incidents"] = QUERIES.pop("incidents_query")


def _incident_timeline(tables, d):
    resolved = incidents.resolve_alerts(normalize.decode_alerts(fx.alert_messages(tables, d))[0])
    return incidents.incident_timeline(resolved, fx.analyst_changes(resolved))


def _shown(rolled):
    return rolled.drop("version").withColumn("engine_sources", F.array_join("engine_sources", ","))


@query
def incident_lifecycle(spark, d):
    """Incidents of alerts and analyst changes: a closed one takes no further alert."""
    tagged = incidents.incidents_with_closings(_incident_timeline(spark, d), gap=12 * HOUR)
    return _shown(incidents.roll_up_lifecycle(tagged.result()))


@query
def incident_lifecycle_split(spark, d):
    """The same with most identities taken as hot."""
    tagged = incidents.incidents_with_closings(_incident_timeline(spark, d), gap=12 * HOUR, max_rows=3)
    return _shown(incidents.roll_up_lifecycle(tagged.result()))


@query
def stream_incident_lifecycle(spark, d):
    """Current incidents, from the stream alone."""
    timeline = _incident_timeline(jobs.StreamTables(spark), d)
    return _shown(jobs.drain_latest(jobs.stream_incident_states(timeline, gap=12 * HOUR), ["incident_id"], "lifecycle"))


@query
def incident_detail(spark, d):
    assigned = assigned_alerts(spark, d)
    return incidents.incident_detail(incidents.roll_up_incidents(assigned), incidents.incident_links(assigned))


def _applied(spark, d):
    opened = fx.incidents(spark, d).withColumn("status", F.lit("OPEN"))
    return incidents.apply_changes(opened, fx.incident_changes(spark, d))


@query
def incident_transitions(spark, d):
    return _applied(spark, d)[1]


@query
def incident_states(spark, d):
    return _applied(spark, d)[0]


@query
def case_metrics(spark, d):
    return metrics.case_metrics(fx.incidents(spark, d))


@query
def severity_counts(spark, d):
    return metrics.severity_counts(fx.incidents(spark, d))


@query
def incident_queue(spark, d):
    return metrics.incident_queue(fx.incidents(spark, d), status="INVESTIGATING", limit=50, offset=10)


def ring_edges(spark, d):
    since = fx.latest(fx.account_graph_transfers(spark, d)) - YEAR
    return graph.transfer_edges(
        fx.account_graph_transfers(spark, d, since).select(
            graph.account_node(F.col("from_account")).alias("src"),
            graph.account_node(F.col("to_account")).alias("dst"),
            F.lit("TRANSFERRED_TO").alias("relationship"),
            "amount",
        )
    )


@query
def transfer_edges(spark, d):
    return ring_edges(spark, d).withColumn("total_amount", F.col("total_amount").cast("double"))


@query
def circular_rings(spark, d):
    rings = graph.circular_rings(ring_edges(spark, d), max_hops=6)
    return rings.withColumn("members", F.array_join("members", ","))


def entity_edges(spark, d, lookback=WEEK):
    owners = enrich.account_snapshot(normalize.parse_account_updates(fx.account_messages(spark, d)))
    as_of = fx.latest(fx.transfers(spark, d), fx.logins(spark, d))
    moved, logins = fx.transfers(spark, d, as_of - lookback), fx.logins(spark, d, as_of - lookback)
    return graph.build_edges(owners, moved, fx.devices(spark, d), logins, as_of=as_of, lookback=lookback)


@query
def entity_graph_edges(spark, d):
    return entity_edges(spark, d)


@query
def entity_graph_nodes(spark, d):
    return graph.build_nodes(entity_edges(spark, d))


@query
def graph_scan_counts(spark, d):
    return graph.scan_counts(entity_edges(spark, d))


@query
def shared_infrastructure(spark, d):
    return graph.shared_infrastructure(entity_edges(spark, d), min_customers=3)


@query
def shared_infrastructure_members(spark, d):
    return graph.shared_members(entity_edges(spark, d), min_customers=3)


@query
def ego_network(spark, d):
    _, edges = graph.ego_network(entity_edges(spark, d), "ACC-7", depth=2)
    return edges


@query
def ego_network_nodes(spark, d):
    nodes, _ = graph.ego_network(entity_edges(spark, d), "ACC-7", depth=2)
    return nodes


def _requested(spark, d):
    owner = F.concat(F.lit("cust_"), F.substring_index("from_account", "-", -1))
    return fx.transfers(spark, d).withColumn("requested_by", owner)


@query
def provisional_accounts(spark, d):
    known = enrich.account_snapshot(normalize.parse_account_updates(fx.account_messages(spark, d)))
    return enrich.provisional_accounts(_requested(spark, d), known)


@query
def provisional_customers(spark, d):
    known = enrich.account_snapshot(normalize.parse_account_updates(fx.account_messages(spark, d)))
    added = enrich.provisional_accounts(_requested(spark, d), known)
    return enrich.provisional_customers(added, fx.accounts(spark, d))


@query
def account_balances(spark, d):
    out = metrics.account_balances(fx.accounts(spark, d), fx.transfers(spark, d))
    return out.withColumn("balance", F.col("balance").cast("double"))


@query
def account_statement(spark, d):
    return metrics.account_statement(fx.transfers(spark, d), "ACC-7")


@query
def employee_mass_access(spark, d):
    return metrics.employee_mass_access(fx.employee_actions(spark, d), at_least=590)


@query
def failed_login_geo(spark, d):
    return metrics.failed_login_geo(fx.logins_located(spark, d))


@query
def api_request_rollup(spark, d):
    return metrics.api_request_rollup(fx.api_requests(spark, d))


@query
def event_rate_5m(spark, d):
    requests = fx.api_requests(spark, d).withColumn("ts", F.timestamp_millis("t"))
    return metrics.event_rate(requests, "ts", "method", "5 minutes", "1 minute")


@query
def index_documents(spark, d):
    number = F.col("event_id").cast("long")
    body = F.struct(
        *[F.col(c) for c in ("event_id", "customer_id", "success", "ip_address", "country", "device_id")],
        "latitude",
        "longitude",
        (F.col("t") * 1000).alias("timestamp"),
    )
    messages = fx.logins_located(spark, d).select(
        F.to_json(
            F.struct(
                F.when(number % 11 != 0, body).alias("after"),
                F.when(number % 11 == 0, "d").otherwise("c").alias("op"),
                F.col("t").alias("ts_ms"),
            )
        ).alias("value")
    )
    docs = documents.latest_documents(documents.index_documents(messages, "login_events"), "login_events")
    return docs.withColumns(
        {
            "timestamp": F.unix_millis("timestamp"),
            "geo_location": F.concat_ws(";", F.col("geo_location.lat").cast("decimal(9,1)"), F.col("geo_location.lon").cast("decimal(9,1)")),
        }
    ).drop("latitude", "longitude")


@query
def stream_risk_alerts(spark, d):
    events = fx.risk_events(jobs.StreamTables(spark), d)
    alerts = jobs.drain(jobs.stream_risk_alerts(events, INDICATORS, SCORES), "risk-alerts")
    names = [c if c not in ("contributing_indicators", "source_event_ids") else joined(c) for c in ALERT_COLUMNS]
    return alerts.select(*names)


def _cuts(frames, time, parts=3):
    """Points that cut the time span of all frames evenly."""
    spans = [df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")) for df in frames]
    lo, hi = reduce(DataFrame.union, spans).agg(F.min("lo"), F.max("hi")).first()
    return [] if lo is None else [lo + (hi - lo) * k // parts for k in range(1, parts)]


@query
def stream_account_enrichment(spark, d):
    """Several micro-batches of rows up to a day out of order; an answer is revised by a change that comes later."""
    events = fx.transfers(spark, d).select(
        F.col("transaction_id").alias("event_id"),
        F.lit(None).cast("string").alias("customer_id"),
        F.col("from_account").alias("from_account_id"),
        F.col("t").alias("event_time"),
    )
    updates = normalize.parse_account_updates(fx.account_messages(spark, d))
    cuts = _cuts([events, updates], "event_time")
    feeds = [jobs.replayed(df, "event_time", cuts, name, spread=DAY) for df, name in ((events, "asks"), (updates, "owners"))]
    answers = jobs.stream_account_enrichment(*feeds, delay="1 day", early=True)
    return jobs.drain_latest(answers, ["event_id"], "enrichment")


@query
def stream_incidents(spark, d):
    """Incidents as they stand at the end of the data, open ones included, from the stream alone."""
    resolved = incidents.resolve_alerts(normalize.decode_alerts(fx.alert_messages(jobs.StreamTables(spark), d))[0])
    nothing = fx.analyst_changes(resolved).filter(F.lit(False))
    states = jobs.stream_incident_states(incidents.incident_timeline(resolved, nothing), gap=12 * HOUR)
    return _shown(jobs.drain_latest(states, ["incident_id"], "incidents")).drop("assigned_to")


@query
def stream_ato_sequence(spark, d):
    """The timeline is an intermediate stream: one job writes it, the matcher reads it."""
    tables = [f(spark, d) for f in (fx.logins, fx.beneficiaries, fx.transfers, fx.account_changes)]
    cuts = _cuts(tables, "t")
    timeline = jobs.stream_timeline(*(jobs.replayed(df, "t", cuts, "ato") for df in tables))
    again = spark.readStream.schema(timeline.schema).parquet(jobs.run_available(timeline, "timeline"))
    return jobs.drain(jobs.stream_takeovers(again, within=48 * HOUR), "takeovers")


@query
def stream_event_rate(spark, d):
    """Every window an event fell into, final or not."""
    requests = fx.api_requests(jobs.StreamTables(spark), d)
    rates = jobs.stream_event_rate(requests, "t", "method", "5 minutes", "1 minute")
    return jobs.drain_latest(rates, ["window_start", "method"], "rate")


@query
def stream_risk_revisions(spark, d):
    """Several micro-batches of rows up to a day out of order: late rows are scored in their place."""
    events = fx.risk_events(spark, d)
    feed = jobs.replayed(events, "event_time", _cuts([events], "event_time", 4), "risk", spread=DAY)
    revised = jobs.stream_revised_alerts(feed, INDICATORS, SCORES, delay="1 day")
    last = jobs.drain_latest(revised, ["identity_key", "event_time", "event_id"], "revisions")
    names = [c if c not in ("contributing_indicators", "source_event_ids") else joined(c) for c in ALERT_COLUMNS]
    return last.filter(~F.col("withdrawn")).select(*names)


@query
def stream_historical_context(spark, d):
    """State begins with the first third of the logins as a batch table; the rest come as a stream."""
    logins = fx.logins(spark, d).select(
        "event_id", "customer_id", F.col("customer_id").alias("identity_key"), F.col("t").alias("event_time")
    )
    cuts = _cuts([logins], "event_time")
    start = cuts[0] if cuts else 0
    old = logins.filter(F.col("event_time") < start)
    feed = jobs.replayed(logins.filter(F.col("event_time") >= start), "event_time", cuts[1:], "logins", spread=DAY)
    asked = enrich.seen_before(old, old, beyond=DAY)
    found = jobs.drain(jobs.stream_seen_before(feed, old, beyond=DAY), "history")
    return found.unionByName(asked.select(*found.columns))


@query
def stream_takeover_sinks(spark, d):
    """One stream written to the timeline, to the takeovers and to the late rows, read back from the sinks."""
    rows = timeline(spark, d)
    feed = jobs.replayed(rows, "event_time", _cuts([rows], "event_time"), "timeline")
    root = jobs.scratch(spark, "takeover-sinks")
    log = jobs.takeover_log(feed, within=48 * HOUR)
    fanout.start_fan_out(log, "event_time", jobs.TAKEOVER_SINKS, root, f"{root}/state", delay=5000).awaitTermination()
    none = F.lit(None)

    def listed(name):
        kind, at, row, amount = F.col("event_type"), F.col("event_time"), F.col("row_id"), F.col("amount")
        begins = none.cast("long")
        if name == "takeovers":
            kind, at, amount = F.col("risk_indicator_type"), F.col("exfiltration_transfer_time"), F.col("stolen_funds")
            row, begins = none.cast("string"), F.col("initial_failed_login")
        return fanout.read_sink(spark, root, name).select(
            F.lit(name).alias("sink"), "customer_id", kind.alias("event_type"), at.alias("event_time"),
            row.alias("row_id"), amount.alias("amount"), begins.alias("begins_at"),
        )

    return reduce(DataFrame.unionByName, map(listed, jobs.TAKEOVER_SINKS))
