"""The smaller scorers: accumulate-and-reset, penalty box, float decay."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import (
    ACCUMULATOR_WEIGHTS,
    CLEARING_WEIGHTS,
    HOUR,
    SECOND,
    SENSITIVE_ENDPOINTS,
    SecondaryConfig,
)
from riskloom.functions.chain import greedy_chain
from riskloom.functions.ordered import CHUNK, DEFAULT_MAX_ROWS, KeyedRows, keyed_rows
from riskloom.functions.text import first_non_blank, short_hash
from riskloom.session import cut_lineage, stored


def sensitive(endpoint: Column) -> Column:
    return endpoint.rlike("|".join(SENSITIVE_ENDPOINTS))


def _weight(label: Column, weights: dict[str, int], unknown: int | None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, label), F.lit(unknown)).cast("long")


def _sum_and_clear(
    rows: KeyedRows, key: list[str], threshold: int, lightest: int, sums: Mapping[str, Column] | None = None
) -> KeyedRows:
    """Accepted rows: where the sum since the last accepted row reaches the threshold.

    On the axis of the running sum this is a greedy chain with the threshold as
    gap, so no per-row fold is needed and hot keys run in parallel. Adds
    ``score`` and ``contributing``. ``sums``: ``_sum``, unless the rows have it.
    """
    # Weights are positive, so a sum below the threshold spans few rows.
    span = -(-threshold // lightest)
    past = [f"_past{i}" for i in range(span - 1, 0, -1)]
    # The rows before are of the same row key; only what the group adds to it can differ.
    finer = [k for k in key if k not in rows.key]
    tagged = F.struct(*finer, F.col("label").alias("label")) if finer else F.col("label")
    rows = rows.history(
        sums={"_n": F.lit(1).cast("long"), **(sums or {})},
        lags={name: (tagged, span - 1 - i) for i, name in enumerate(past)},
    )
    group = F.struct(*[F.col(k) for k in key])
    labels = [F.col(name) for name in past]
    if finer:
        here = F.struct(*finer)
        labels = [F.when(F.struct(*[c[k] for k in finer]) == here, c["label"]) for c in labels]
    listed = F.array(*labels, "label")
    if labels:  # if the earliest belongs to the group, all do
        listed = F.when(labels[0].isNotNull(), listed).otherwise(F.array_compact(listed))
    # One list instead of all that is behind it goes through the chain; and what the chain gives is read more than once.
    rows = rows.with_rows(rows.rows.withColumn("_own", listed).drop(*past))
    hits = greedy_chain(rows.staged(), key, "_sum", "_sum", threshold, start=threshold).staged()
    hits = hits.history(lasts={"_before": F.struct(group.alias("g"), F.col("_sum").alias("s"), F.col("_n").alias("n"))})
    same = F.col("_before.g") == group
    base = F.when(same, F.col("_before.s")).otherwise(F.lit(0))
    taken = F.when(same, F.col("_n") - F.col("_before.n")).otherwise(F.lit(span))
    own = F.col("_own")
    kept = F.least(taken, F.size(own)).cast("int")
    listed = F.slice(own, F.size(own) - kept + 1, kept)
    return hits.with_rows(
        hits.rows.withColumns({"score": F.col("_sum") - F.coalesce(base, F.lit(0)), "contributing": listed})
    )


def inactivity_reset_alerts(
    labelled: DataFrame | KeyedRows,
    idle: int = HOUR,
    threshold: int = 80,
    weights: dict[str, int] | None = None,
    max_rows: int = DEFAULT_MAX_ROWS,
) -> DataFrame:
    """Sum known labels per customer; reset after ``idle`` without one and after an alert.

    ``labelled``: customer_id, risk_indicator_type, event_time, event_id, pos;
    rows already keyed by customer keep their chunks and are not counted again.
    """
    weights = weights or ACCUMULATOR_WEIGHTS
    label, t = F.col("risk_indicator_type"), F.col("event_time")
    source = labelled.rows if isinstance(labelled, KeyedRows) else labelled
    known = source.filter(F.col("customer_id").isNotNull() & label.isin(*weights))
    known = known.withColumns({"label": label, "w": _weight(label, weights, 0)})
    key, order = ["customer_id"], ["event_time", "event_id", "pos"]
    # What an alert is made of, and no more, goes through all that follows.
    known = known.select(*key, *order, "label", "w", *([CHUNK] if CHUNK in known.columns else []))
    if isinstance(labelled, KeyedRows):
        # Stored, so that the indicators are not derived again for each look back below.
        rows = replace(labelled, rows=known, key=tuple(key), order=tuple(order)).staged()
    else:
        rows = keyed_rows(known, key, order, max_rows)
    rows = rows.history(lasts={"_prev": t}, sums={"_run": F.col("w")})
    begins = F.col("_prev").isNull() | (t - F.col("_prev") > idle)
    here = F.when(begins, F.struct(t.alias("t"), (F.col("_run") - F.col("w")).alias("before")))
    rows = rows.with_column("_begins", here).history(lasts={"_open": F.col("_begins")})
    stretch = F.coalesce("_begins", "_open")
    rows = rows.with_rows(
        rows.rows.withColumns({"_stretch": stretch["t"], "_sum": F.col("_run") - stretch["before"]}).drop(
            "w", "_prev", "_run", "_begins", "_open"
        )
    )
    hits = _sum_and_clear(rows, ["customer_id", "_stretch"], threshold, min(weights.values())).result()
    action = F.when(F.col("score") >= 100, "FREEZE_ACCOUNT").otherwise("REQUIRE_MFA")
    seconds = F.floor(t / 1000).cast("long").cast("string")
    return _accumulated(hits, F.concat(F.lit("ALT-"), seconds), action)


def threshold_clear_alerts(
    labelled: DataFrame,
    threshold: int = 80,
    weights: dict[str, int] | None = None,
    unknown: int = 10,
    max_rows: int = DEFAULT_MAX_ROWS,
) -> DataFrame:
    """Sum labels per customer, alert and clear at the threshold; nothing decays."""
    weights = weights or CLEARING_WEIGHTS
    label = F.coalesce("risk_indicator_type", F.lit("UNKNOWN"))
    named = labelled.withColumns(
        {
            "customer_id": F.coalesce("customer_id", F.lit("unknown_ip")),
            "label": label,
            "w": _weight(label, weights, unknown),
        }
    )
    # The labels are derived once, not once for the count of hot keys and once more for the sums.
    named = stored(named.select("customer_id", "event_time", "event_id", "pos", "label", "w"), "labels")
    rows = keyed_rows(named, ["customer_id"], ["event_time", "event_id", "pos"], max_rows)
    lightest = min(unknown, *weights.values())
    hits = _sum_and_clear(rows, ["customer_id"], threshold, lightest, {"_sum": F.col("w")}).result()
    action = F.when(F.col("score") < 100, "REQUIRE_MFA").otherwise("LOCK_ACCOUNT")
    where = [F.col("customer_id"), F.col("event_time").cast("string"), F.col("event_id"), F.col("pos").cast("string")]
    return _accumulated(hits, F.concat(F.lit("ALT-"), F.upper(short_hash(*where, length=10))), action)


def _accumulated(hits: DataFrame, alert_id: Column, action: Column) -> DataFrame:
    return hits.select(
        alert_id.alias("alert_id"),
        "customer_id",
        "event_id",
        "event_time",
        F.col("score").alias("cumulative_score"),
        F.col("contributing").alias("contributing_indicators"),
        action.alias("action_required"),
    )


def ip_velocity_alerts(
    requests: DataFrame,
    hits: int = 3,
    window: int = 10 * SECOND,
    box: int = 30 * SECOND,
    max_rows: int = DEFAULT_MAX_ROWS,
) -> DataFrame:
    """``hits`` sensitive calls of an IP inside ``window``; the IP is then ignored for ``box``.

    A run of ``hits`` calls is a candidate from its first to its last call; the
    next alert needs a run that starts after the box, since ignored calls are
    not counted. That is a greedy chain over the candidate intervals.
    """
    t = F.col("t")
    calls = requests.filter(sensitive(F.col("endpoint")))
    rows = keyed_rows(calls, ["ip_address"], ["t", "request_id"], max_rows)
    if hits > 1:
        rows = rows.history(lags={"_from": (t, hits - 1)})
    else:
        rows = rows.with_column("_from", t)
    runs = rows.filter(F.col("_from").isNotNull() & (t - F.col("_from") <= window))
    alerts = greedy_chain(runs.staged(), ["ip_address"], "_from", "t", box).result()
    return alerts.select(
        F.col("ip_address").alias("customer_id"),
        F.lit("VELOCITY_VIOLATION").alias("risk_indicator_type"),
        "endpoint",
        F.lit(hits).cast("long").alias("hits"),
        F.lit(window // SECOND).cast("long").alias("window_sec"),
        t.alias("timestamp"),
    )


def secondary_identity(events: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Identity in the order of the secondary engine: customer, owner, account, IP.

    ``owners`` has one row per account. Only rows that ask for an owner meet it, so rows without an account do
    not all land on one key. Both kinds are read from one stored copy of ``events``, so these are derived once,
    whatever reads the result.
    """
    customer = first_non_blank(F.col("customer_id"))
    account = F.concat(F.lit("acct:"), F.col("from_account_id"))
    ip = F.concat(F.lit("ip:"), F.col("ip_address"))
    if owners is None:
        return events.withColumn("identity_key", F.coalesce(customer, account, ip))
    events = stored(events, "identity-events")
    asks = customer.isNull() & F.col("from_account_id").isNotNull()
    lookup = owners.select(F.col("account_id").alias("_account"), F.col("customer_id").alias("_owner"))
    asked = events.filter(asks).join(lookup, F.col("from_account_id") == F.col("_account"), "left")
    found = asked.withColumn("identity_key", F.coalesce("_owner", account)).drop("_account", "_owner")
    return found.unionByName(events.filter(~asks).withColumn("identity_key", F.coalesce(customer, account, ip)))


def login_succeeded(success: Column, status: Column) -> Column:
    """Explicit flag, else anything but a failed status."""
    return F.coalesce(success, ~F.coalesce(status, F.lit("")).isin("FAILED", "FAILURE"))


SENT_STATES = 50_000  # a state is a few numbers and at most ``listed_indicators`` names
_PROFILE = "struct<score:double,decayed_at:bigint,alerted_at:bigint,listed:array<string>>"


def secondary_risk_alerts(rows: KeyedRows, config: SecondaryConfig = SecondaryConfig()) -> DataFrame:
    """Alerts of rows with ``indicators``: float decay, reset on alert, cooldown.

    The decay clock restarts at the event that decays, so the state does not
    compose in closed form. Cold identities fold in one pass. The rows of a
    hot identity pass once through one task in order, which keeps nothing but
    the state and tells the one each chunk starts from; the chunks then fold
    in parallel.
    """
    key, order = list(rows.key), list(rows.order)
    event = F.struct(*order, "account_id", "indicators")
    empty = F.expr(f"named_struct('score', 0D, 'decayed_at', null, 'alerted_at', null, 'listed', array())").cast(_PROFILE)
    parts = [*key, CHUNK] if rows.chunked else key
    grouped = rows.rows.groupBy(*parts).agg(F.sort_array(F.collect_list(event)).alias("events"))
    if not rows.chunked:
        return _secondary_output(grouped.withColumn("start", empty), config)

    cold = grouped.filter(F.col(CHUNK) < 0).withColumn("start", empty)
    hot = cut_lineage(grouped.filter(F.col(CHUNK) >= 0))
    starts = cut_lineage(_walked_starts(hot, key, order, config))
    settled = _from_states(hot, starts, parts, starts.count())
    return _secondary_output(cold.unionByName(settled), config)


def _from_states(chunks: DataFrame, states: DataFrame, parts: list[str], n: int) -> DataFrame:
    """Chunks with the state each starts from; ``n`` states are sent to all tasks only while they are few."""
    return chunks.join(F.broadcast(states) if n <= SENT_STATES else states, parts)


def _walked_starts(chunks: DataFrame, key: list[str], order: list[str], config: SecondaryConfig) -> DataFrame:
    """The state at the start of every chunk; the rows of an identity pass one after the other through one task."""
    parts = [*key, CHUNK]
    rows = chunks.select(*parts, F.inline("events")).select(*parts, *order, "indicators")
    keys = [f for f in rows.schema.fields if f.name in parts]
    state = "score double, decayed_at bigint, alerted_at bigint, listed array<string>"
    schema = T.StructType([*keys, *T.StructType.fromDDL(state)])
    types = {"score": pa.float64(), "decayed_at": pa.int64(), "alerted_at": pa.int64(), "listed": pa.list_(pa.string())}
    fresh = (0.0, None, None, [])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, chunk, now = None, None, fresh
        for batch in batches:
            begins, states = [], []
            values = [batch.column(name).to_pylist() for name in (*parts, "event_time", "indicators")]
            for i, (*who, number, t, names) in enumerate(zip(*values)):
                if who != here:
                    here, chunk, now = who, None, fresh
                if number != chunk:
                    chunk = number
                    begins.append(i)
                    states.append(now)
                now = _secondary_step(now, t, names, config)
            found = pa.Table.from_batches([batch]).select(parts).take(pa.array(begins, pa.int64()))
            for at, (name, kind) in enumerate(types.items()):
                found = found.append_column(name, pa.array([s[at] for s in states], kind))
            yield from found.select(schema.names).to_batches()

    walked = rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(walk, schema)
    return walked.select(*parts, F.struct(*types).cast(_PROFILE).alias("start"))


def _secondary_step(state: tuple, t: int, names: list[str], config: SecondaryConfig) -> tuple:
    """One step of ``_secondary_fold`` without its alerts."""
    score, clock, alerted, listed = state
    halvings = 0 if clock is None else min((t - clock) // config.decay, config.max_halvings)
    if halvings > 0:
        score /= 2.0**halvings
    if clock is None or halvings > 0:
        clock = t
    for name in names:
        score += config.weights.get(name, 0)
    if score >= config.alert_from and (alerted is None or t - alerted >= config.cooldown):
        return 0.0, clock, t, []
    return score, clock, alerted, [*listed, *names][-config.listed_indicators :]


def _secondary_fold(start: Column, config: SecondaryConfig) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in config.weights.items() for x in pair])
    alert_type = "array<struct<event_time:bigint,account_id:string,score:double,listed:array<string>>>"
    t_name = "event_time"

    def step(acc: Column, x: Column) -> Column:
        state, t = acc["state"], x[t_name]
        steps = F.floor((t - F.coalesce(state["decayed_at"], t)) / F.lit(config.decay))
        halvings = F.least(steps, F.lit(config.max_halvings))
        first = state["decayed_at"].isNull()
        decayed = F.when(halvings > 0, state["score"] / F.pow(F.lit(2.0), halvings)).otherwise(state["score"])
        clock = F.when(first | (halvings > 0), t).otherwise(state["decayed_at"])
        score = F.aggregate(
            x["indicators"],
            decayed,
            lambda total, name: total + F.coalesce(F.try_element_at(lookup, name), F.lit(0)).cast("double"),
        )
        names = F.concat(state["listed"], x["indicators"])
        keep = F.lit(config.listed_indicators)
        listed = F.slice(names, F.greatest(F.size(names) - keep + 1, F.lit(1)), keep)
        # Bind the new values once; a lambda over a one-element array acts as "let".
        bound = F.array(F.struct(score.alias("score"), clock.alias("clock"), listed.alias("listed")))

        def settle(n: Column) -> Column:
            ready = state["alerted_at"].isNull() | (t - state["alerted_at"] >= config.cooldown)
            fires = (n["score"] >= config.alert_from) & ready
            cleared = F.struct(
                F.lit(0.0).alias("score"),
                n["clock"].alias("decayed_at"),
                t.alias("alerted_at"),
                F.array().cast("array<string>").alias("listed"),
            )
            kept = F.struct(
                n["score"].alias("score"),
                n["clock"].alias("decayed_at"),
                state["alerted_at"].alias("alerted_at"),
                n["listed"].alias("listed"),
            )
            alert = F.struct(
                t.alias("event_time"),
                x["account_id"].alias("account_id"),
                n["score"].alias("score"),
                n["listed"].alias("listed"),
            )
            return F.struct(
                F.when(fires, cleared).otherwise(kept).cast(_PROFILE).alias("state"),
                F.when(fires, F.concat(acc["alerts"], F.array(alert))).otherwise(acc["alerts"]).cast(alert_type).alias("alerts"),
            )

        return F.get(F.transform(bound, settle), F.lit(0))

    init = F.struct(start.cast(_PROFILE).alias("state"), F.array().cast(alert_type).alias("alerts"))
    return F.aggregate("events", init, step)


def _secondary_output(grouped: DataFrame, config: SecondaryConfig) -> DataFrame:
    alerts = _secondary_fold(F.col("start"), config)["alerts"]
    rows = grouped.select("identity_key", F.inline(alerts))
    critical = F.col("score") >= config.critical_from
    severity = F.when(critical, "CRITICAL").otherwise("FRAUD")
    t = F.col("event_time")
    window = F.floor(t / config.cooldown).cast("long").cast("string")
    return rows.select(
        F.concat_ws("-", F.lit("SEC"), F.col("identity_key"), window).alias("alert_id"),
        "identity_key",
        F.col("identity_key").alias("customer_id"),
        "account_id",
        "event_time",
        severity.alias("severity"),
        F.bround("score", 2).alias("cumulative_score"),
        F.lit(config.alert_from).cast("long").alias("threshold"),
        F.col("listed").alias("contributing_indicators"),
        F.coalesce(F.get("listed", F.size("listed") - 1), F.lit("ANOMALY_DETECTED")).alias("trigger_reason"),
        t.alias("first_seen_ts"),
        t.alias("latest_seen_ts"),
        F.array().cast("array<string>").alias("source_event_ids"),
        F.when(critical, "FREEZE_ACCOUNT").otherwise("REQUIRE_MFA").alias("action_required"),
        F.lit(config.engine_source).alias("engine_source"),
    )
