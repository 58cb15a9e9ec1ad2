"""Keyed state for the continuous operators.

Rows of a micro-batch reach a key in no order, so each processor sorts its
slice by (event time, id) first. State is kept in the state store, is bounded
by the windows of the rules, and is dropped by event-time timers.

Most keys have a row or two in a micro-batch, so the processors take and give
rows: a data frame per key costs far more than the work on it. State is only
asked for what the rows need.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import asdict, fields

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.config import IndicatorConfig, ScoreConfig
from riskloom.streaming.profile import Profile, advance

PROFILE_STATE = (
    "segment long, last_t long, device string, country string, login_t long, failures array<long>, "
    "transfers array<long>, requests array<long>, score long, cell long, alerted_t long, listed array<string>, timer long"
)
EVENT_FIELDS = (
    "indicator",
    "source_table",
    "device_id",
    "country",
    "login_success",
    "amount",
    "to_account_id",
    "customer_id",
    "account_id",
    "event_id",
    "dedup_key",
)
ALERT_INPUT = (
    "identity_key string, customer_id string, account_id string, event_id string, event_time long, indicator string, "
    "indicators array<string>, contributing array<string>, score long"
)
ALERT_INPUT_ROW = Row(*[column.split()[0] for column in ALERT_INPUT.split(", ")])


def _in_order(rows: Iterable[Row], by: list[str]) -> list[dict]:
    return sorted((row.asDict() for row in rows), key=lambda r: tuple("" if r[c] is None else r[c] for c in by))


class RiskProcessor(StatefulProcessor):
    """Dedup, profile, score, cooldown; emits the rows that alert."""

    def __init__(self, indicators: IndicatorConfig, scores: ScoreConfig, horizon: int):
        self.indicators, self.scores, self.horizon = indicators, scores, horizon
        self.keep = max(indicators.profile_ttl, horizon)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", PROFILE_STATE)
        self.seen = handle.getMapState("seen", "dedup_key string", "t long")

    def _load(self) -> Profile | None:
        values = self.profile.get()
        if values is None:
            return None
        return Profile(**{f.name: v for f, v in zip(fields(Profile), values)})

    def _repeated(self, key: str | None, t: int) -> bool:
        if key is None:
            return False
        before = self.seen.getValue((key,))
        if before is not None and t - int(before[0]) <= self.horizon:
            return True
        self.seen.updateValue((key,), (t,))
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        profile, out = self._load(), []
        for e in _in_order(rows, ["event_time", "event_id"]):
            t = e["event_time"]
            if self._repeated(e.get("dedup_key"), t):
                # A repeat changes nothing but keeps the profile alive.
                if profile is not None:
                    profile.last_t = max(profile.last_t, t)
                continue
            profile, fired, alerts = advance(profile, e, self.indicators, self.scores)
            if alerts:
                who = key[0], e["customer_id"], e["account_id"], e["event_id"], t, e["indicator"]
                out.append(ALERT_INPUT_ROW(*who, fired, list(profile.listed), profile.score))
        if profile is not None:
            self._store(profile)
        return iter(out)

    def _store(self, profile: Profile) -> None:
        # One timer per identity is enough: it looks at the last event when it fires.
        if profile.timer is None:
            profile.timer = profile.last_t + self.keep
            self.handle.registerTimer(profile.timer)
        self.profile.update(tuple(asdict(profile).values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        profile, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        for seen_key, (t,) in list(self.seen.iterator()):
            if now - int(t) > self.horizon:
                self.seen.removeKey(seen_key)
        if profile is not None:
            if profile.last_t + self.keep > now:
                profile.timer = None
                self._store(profile)
            elif self.indicators.profile_ttl:
                # Silent for a whole profile life: forget the identity.
                self.profile.clear()
            else:
                profile.timer = None
                self.profile.update(tuple(asdict(profile).values()))
        return iter(())


FOUND = Row("event_id", "from_account_id", "event_time", "customer_id")


class OwnerProcessor(StatefulProcessor):
    """Owner of an account as of each lookup, whatever the order in which changes and lookups arrive.

    State holds the owner versions that a row above the watermark can still ask for, in order, and the lookups
    the watermark has not passed. ``early`` answers a lookup when it arrives and again whenever a change with an
    earlier time alters the answer; otherwise it is answered once, when the watermark has passed it.
    """

    def __init__(self, early: bool):
        self.early = early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getValueState("versions", "times array<long>, ties array<string>, owners array<string>, timer long")
        self.asks = handle.getListState("asks", "event_time long, event_id string, customer_id string")

    def _load(self) -> tuple[list, int | None]:
        held = self.versions.get()
        if held is None:
            return [], None
        return list(zip(*held[:3])), held[3]

    def _store(self, versions: list, timer: int | None, due: int | None) -> None:
        """Keep versions with one timer, the earliest time at which something leaves the state."""
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if versions or timer is not None:
            times, ties, owners = ([v[i] for v in versions] for i in range(3))
            self.versions.update((times, ties, owners, timer))
        else:
            self.versions.clear()

    @staticmethod
    def _owned(versions: list, asks: list[tuple]) -> list[tuple]:
        """Lookups (event_time, event_id, customer_id) with the owner as of each."""
        times = [v[0] for v in versions]
        at = (bisect_right(times, ask[0]) for ask in asks)
        return [(t, event, versions[k - 1][2] if k else None) for (t, event, _), k in zip(asks, at)]

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.asks.get()] if self.asks.exists() else []

    @staticmethod
    def _answers(key, asks: list[tuple]) -> Iterator[Row]:
        return iter([FOUND(event, key[0], t, who) for t, event, who in asks])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        versions, timer = self._load()
        changes, asks = [], []
        for r in rows:
            if r["kind"] == 0:
                changes.append((r["event_time"], r["event_id"], r["customer_id"]))
            else:
                asks.append((r["event_time"], r["event_id"], None))
        told = []
        # A lookup that waits has a timer.
        if self.early and changes and timer is not None:
            told = self._revised(versions := self._merged(versions, changes), min(c[0] for c in changes))
        elif changes:
            versions = self._merged(versions, changes)
        if asks:
            asks = self._owned(versions, asks) if self.early else asks
            self.asks.appendList(asks)
        self._store(versions, timer, min([*(a[0] for a in asks), *(v[0] for v in versions[1:])], default=None))
        return self._answers(key, told + asks if self.early else [])

    @staticmethod
    def _merged(versions: list, changes: list) -> list:
        return sorted([*versions, *changes], key=lambda v: v[:2])

    def _revised(self, versions: list, since: int) -> list[tuple]:
        """Earlier lookups whose answer the changes from ``since`` on have altered."""
        held = self._waiting()
        now = self._owned(versions, held)
        other = [b for a, b in zip(held, now) if b[0] >= since and a[2] != b[2]]
        if other:
            self.asks.put(now)
        return other

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        versions, held = self._load()[0], self._waiting()
        final, later = [a for a in held if a[0] <= passed], [a for a in held if a[0] > passed]
        if final:
            if later:
                self.asks.put(later)
            else:
                self.asks.clear()
        answers = [] if self.early else self._owned(versions, final)
        # Rows still to come are above the watermark: of the versions below it they can see the last one only.
        below = sum(v[0] <= passed for v in versions)
        versions = versions[max(below - 1, 0) :]
        if len(versions) == 1 and versions[0][0] <= passed and versions[0][2] is None:
            versions = []
        self._store(versions, None, min([*(a[0] for a in later), *(v[0] for v in versions[1:])], default=None))
        return self._answers(key, answers)


SEEN = Row("event_id", "identity_key", "event_time", "seen_beyond_state_window")


class FirstSeenProcessor(StatefulProcessor):
    """Whether an identity was first seen more than ``beyond`` before an event.

    State is one number per identity. It begins with a table of first times and goes on with the stream.
    """

    def __init__(self, beyond: int):
        self.beyond = beyond

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "t long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.first.update((initialState["first"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A row of the same micro-batch that lies beyond an event is in the minimum, one that does not changes nothing.
        new = [(r["event_id"], r["event_time"]) for r in rows]
        first, held = min(t for _, t in new), self.first.get()
        if held is None or first < held[0]:
            self.first.update((first,))
        else:
            first = held[0]
        return iter([SEEN(event, key[0], t, first < t - self.beyond) for event, t in new])


OWNED = Row("customer_id", "event_time", "row_id", "amount")


class AccountOwnerProcessor(StatefulProcessor):
    """Every created account row joined with every transfer of the account.

    Owners are kept as one number per (account, customer), so their state grows with the accounts and not with
    time. A transfer meets the owners there are at once, and is held for owners that come up to ``hold`` later.
    """

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owners = handle.getMapState("owners", "customer_id string", "n long")
        self.moved = handle.getListState("moved", "event_time long, row_id string, amount double")
        self.timer = handle.getValueState("timer", "t long")

    @staticmethod
    def _joined(owners: dict, moved: list[tuple]) -> list[Row]:
        return [OWNED(who, *move) for who, n in owners.items() for _ in range(n) for move in moved]

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.moved.get()] if self.moved.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, arrived, out = Counter(), [], []
        for r in rows:
            if r["kind"] == 1:
                arrived.append((r["event_time"], r["row_id"], r["amount"]))
            else:
                new[r["customer_id"]] += 1
        if new:
            out += self._joined(new, self._held())
            for who, n in new.items():
                before = self.owners.getValue((who,))
                self.owners.updateValue((who,), ((before[0] if before else 0) + n,))
        if arrived:
            self.moved.appendList(arrived)
            if not self.timer.exists():
                self._wait(min(a[0] for a in arrived))
            out += self._joined({k[0]: v[0] for k, v in self.owners.iterator()}, arrived)
        return iter(out)

    def _wait(self, since: int) -> None:
        self.handle.registerTimer(since + self.hold)
        self.timer.update((since + self.hold,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rest = [m for m in self._held() if m[0] + self.hold > passed]
        self.timer.clear()
        if rest:
            self.moved.put(rest)
            self._wait(min(m[0] for m in rest))
        else:
            self.moved.clear()
        return iter(())


INCIDENT_STATE = (
    "opened_at long, status string, title string, alert_count long, max_risk_score double, first_alert_at long, "
    "last_alert_at long, updated_at long, engine_sources array<string>, assigned_to string, version long"
)
INCIDENT_COLUMNS = [column.split()[0] for column in INCIDENT_STATE.split(", ")]
INCIDENT = Row("identity_key", *INCIDENT_COLUMNS)


class IncidentProcessor(StatefulProcessor):
    """The latest incident of an identity, fed by alerts and analyst changes.

    Every micro-batch emits each incident it touched once, as it stands after it; ``version`` counts what touched
    the incident. An incident that nothing has touched for ``keep`` is forgotten.
    """

    def __init__(self, gap: int, keep: int, active: tuple[str, ...]):
        self.gap, self.keep, self.active = gap, max(keep, gap), active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", INCIDENT_STATE + ", timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        now, timer = (None, None) if held is None else (dict(zip(INCIDENT_COLUMNS, held)), held[-1])
        if now is not None and now["updated_at"] + self.keep <= timerValues.getCurrentWatermarkInMs():
            now = None  # its timer is due in this micro-batch
        done = []
        for r in _in_order(rows, ["at", "rank", "row_id"]):
            if r["kind"] == "alert":
                now, before = self._alert(now, r["at"], r["risk_score"], r["indicator"], r["engine_source"])
                if before is not None:
                    done.append(before)
            elif now is not None:
                self._change(now, r["at"], r["kind"], r["new_status"], r["assigned_to"])
        if now is not None:
            done.append(now)
            if timer is None:
                timer = now["updated_at"] + self.keep
                self.handle.registerTimer(timer)
            self.state.update((*now.values(), timer))
        return iter([INCIDENT(key[0], *i.values()) for i in done])

    def _alert(self, now, at, score, indicator, engine) -> tuple[dict, dict | None]:
        """The incident the alert is in, and the one before where it opens another."""
        if now is not None and now["status"] in self.active and at - now["updated_at"] <= self.gap:
            now["alert_count"] += 1
            now["max_risk_score"] = max(now["max_risk_score"], score)
            now["first_alert_at"] = min(now["first_alert_at"], at)
            now["last_alert_at"] = max(now["last_alert_at"], at)
            now["engine_sources"] = sorted({*now["engine_sources"], engine})
            now["updated_at"], now["version"] = max(now["updated_at"], at), now["version"] + 1
            return now, None
        values = (at, "OPEN", f"Fraud Alert: {indicator}", 1, score, at, at, at, [engine], None, 1)
        return dict(zip(INCIDENT_COLUMNS, values)), now

    def _change(self, now, at, kind, status, who) -> None:
        if kind == "status":
            now["status"] = status
        else:
            now["assigned_to"] = who
            now["status"] = "INVESTIGATING" if now["status"] == "OPEN" else now["status"]
        now["updated_at"], now["version"] = max(now["updated_at"], at), now["version"] + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is not None:
            last = held[INCIDENT_COLUMNS.index("updated_at")] + self.keep
            if last > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(last)
                self.state.update((*held[:-1], last))
            else:
                self.state.clear()
        return iter(())


class TakeoverProcessor(StatefulProcessor):
    """Failed login, then beneficiary, then transfer, inside a window; no overlaps.

    ``waiting`` are failed logins that have not met a beneficiary yet; ``armed``
    are those that have, with its time. Both only reach back one window.
    """

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "open", "waiting array<long>, armed array<long>, added array<long>, timer long"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.state.get()
        waiting, armed, added, timer = ([], [], [], None) if stored is None else stored
        out, t = [], 0
        for r in _in_order(rows, ["event_time", "row_id"]):
            t = r["event_time"]
            waiting = [f for f in waiting if t - f < self.within]
            live = [i for i, f in enumerate(armed) if t - f < self.within]
            armed, added = [armed[i] for i in live], [added[i] for i in live]
            if r["event_type"] == "LOGIN_FAILED":
                waiting.append(t)
            elif r["event_type"] == "BENEFICIARY_ADD":
                armed, added = armed + waiting, added + [t] * len(waiting)
                waiting = []
            elif r["event_type"] == "TRANSFER":
                if armed:
                    out.append(TAKEOVER_ROW(key[0], armed[0], added[0], t, r["amount"]))
                    waiting = []
                armed, added = [], []
        self._store(waiting, armed, added, timer, t)
        return iter(out)

    def _store(self, waiting, armed, added, timer, t) -> None:
        if timer is None and (waiting or armed):
            timer = t + self.within
            self.handle.registerTimer(timer)
        if timer is None:
            self.state.clear()
        else:
            self.state.update((waiting, armed, added, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, stored = expiredTimerInfo.getExpiryTimeInMs(), self.state.get()
        if stored is not None:
            waiting, armed, added, _ = stored
            waiting = [f for f in waiting if now - f < self.within]
            live = [i for i, f in enumerate(armed) if now - f < self.within]
            self._store(waiting, [armed[i] for i in live], [added[i] for i in live], None, now)
        return iter(())


TAKEOVER_ROW = Row("customer_id", "initial_failed_login", "beneficiary_added_time", "exfiltration_transfer_time", "stolen_funds")
