"""Risk alerts that late rows may still change.

An identity's state has two profiles: ``settled``, after every row at or below the watermark, and ``head``, after
every row seen. The rows between them are held. Rows in order advance the head; a row out of order makes the held
rows be judged again from the settled profile, and what that alters is emitted as a new revision.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import asdict, fields

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.config import IndicatorConfig, ScoreConfig
from riskloom.streaming.processors import ALERT_INPUT, PROFILE_STATE, _in_order
from riskloom.streaming.profile import Profile, advance

HELD = "rows binary"  # a block of rows: handing over every row of a key by itself costs more than judging it
HELD_COLUMNS = [*"event_time event_id indicator source_table device_id country login_success amount to_account_id customer_id".split(),
                *"account_id dedup_key repeated score indicators contributing".split()]
HELD_ROWS = 1000
SAID = ("score", "indicators", "contributing")  # the alert given for a held row; score is null without one
REVISED = f"{ALERT_INPUT}, revision long, withdrawn boolean"
REVISED_ROW = Row(*[column.split()[0] for column in REVISED.split(", ")])


def _order(row: dict) -> tuple:
    return row["event_time"], row["event_id"] or ""


class RevisingRiskProcessor(StatefulProcessor):
    """Alerts as they are known, and again whenever a row out of order alters or withdraws them."""

    def __init__(self, indicators: IndicatorConfig, scores: ScoreConfig, horizon: int):
        self.indicators, self.scores, self.horizon = indicators, scores, horizon
        self.keep = max(indicators.profile_ttl, horizon)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", PROFILE_STATE)
        self.head = handle.getValueState("head", PROFILE_STATE)
        self.held = handle.getListState("held", HELD)
        self.seen = handle.getMapState("seen", "dedup_key string", "t long")
        self.clock = handle.getValueState("clock", "timer long, swept long, revision long")

    @staticmethod
    def _profile(state) -> Profile | None:
        values = state.get()
        return None if values is None else Profile(**{f.name: v for f, v in zip(fields(Profile), values)})

    @staticmethod
    def _keep_profile(state, profile: Profile | None) -> None:
        if profile is None:
            state.clear()
        else:
            state.update(tuple(asdict(profile).values()))

    def _held_rows(self) -> list[dict]:
        blocks = list(self.held.get()) if self.held.exists() else []
        return [dict(zip(HELD_COLUMNS, row)) for (block,) in blocks for row in pickle.loads(block)]

    @staticmethod
    def _blocks(rows: list[dict]) -> list[tuple]:
        values = [tuple(e[c] for c in HELD_COLUMNS) for e in rows]
        return [(bytearray(pickle.dumps(values[k : k + HELD_ROWS], protocol=4)),) for k in range(0, len(values), HELD_ROWS)]

    def _clock(self) -> list:
        values = self.clock.get()
        return [None, 0, 0] if values is None else list(values)

    def _wake(self, clock: list, due: int) -> None:
        """One timer per identity, at the earliest time at which something is due."""
        if clock[0] is None or due < clock[0]:
            if clock[0] is not None:
                self.handle.deleteTimer(clock[0])
            self.handle.registerTimer(due)
            clock[0] = due

    def _judge(self, profile: Profile | None, rows: list[dict], recent: dict) -> tuple[Profile | None, list]:
        """The profile after ``rows``, and what each row says: nothing, or (score, indicators, contributing).

        ``recent`` has the dedup keys of rows above the settled profile and is added to."""
        said = []
        for e in rows:
            t, key = e["event_time"], e["dedup_key"]
            last = None
            if key is not None:
                last = recent.get(key)
                if last is None:
                    found = self.seen.getValue((key,))
                    last = None if found is None else int(found[0])
            e["repeated"] = last is not None and t - last <= self.horizon
            if e["repeated"]:
                # A repeat changes nothing but keeps the profile alive.
                if profile is not None:
                    profile.last_t = max(profile.last_t, t)
                said.append(None)
                continue
            if key is not None:
                recent[key] = t
            profile, fired, alerts = advance(profile, e, self.indicators, self.scores)
            said.append((profile.score, fired, list(profile.listed)) if alerts else None)
        return profile, said

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = _in_order(rows, ["event_time", "event_id"])
        for e in new:
            e.update(dict.fromkeys(SAID))
        # Rows that are held have a clock.
        clock = self.clock.get()
        held, clock = ([], [None, 0, 0]) if clock is None else (self._held_rows(), list(clock))
        if not held or _order(new[0]) >= _order(held[-1]):
            judged = new
            recent = {e["dedup_key"]: e["event_time"] for e in held if e["dedup_key"] is not None and not e["repeated"]}
            profile, said = self._judge(self._profile(self.head), judged, recent)
        else:
            clock[2] += 1
            judged = sorted([*held, *new], key=_order)
            profile, said = self._judge(self._profile(self.settled), judged, {})
        changed = {}
        for e, now in zip(judged, said):
            before = tuple(e[c] for c in SAID) if e["score"] is not None else None
            if now == before:
                continue
            # Of two rows that share time and id, the alert is told and not the withdrawal.
            at = _order(e)
            if now is not None or at not in changed:
                score, fired, listed = before if now is None else now
                changed[at] = {**e, "identity_key": key[0], "score": score, "indicators": fired, "contributing": listed,
                               "revision": clock[2], "withdrawn": now is None}
            e.update(zip(SAID, (None, None, None) if now is None else now))
        if judged is new:
            self.held.appendList(self._blocks(judged))
        else:
            self.held.put(self._blocks(judged))
        self._keep_profile(self.head, profile)
        self._wake(clock, min(e["event_time"] for e in new))
        self.clock.update(tuple(clock))
        return iter([REVISED_ROW(*[e[c] for c in REVISED_ROW]) for e in changed.values()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Rows the watermark has passed are settled: nothing can come before them any more."""
        passed, clock, held = timerValues.getCurrentWatermarkInMs(), self._clock(), self._held_rows()
        clock[0] = None
        done = [e for e in held if e["event_time"] <= passed]
        rest = held[len(done) :]
        profile = self._profile(self.settled)
        if done:
            recent: dict = {}
            profile = self._judge(copy.deepcopy(profile), done, recent)[0]
            for dedup_key, t in recent.items():
                self.seen.updateValue((dedup_key,), (t,))
            if rest:
                self.held.put(self._blocks(rest))
            else:
                self.held.clear()
        silent = profile is None or profile.last_t + self.keep <= passed
        if silent or passed - clock[1] >= self.horizon:
            clock[1] = passed
            for dedup_key, (t,) in list(self.seen.iterator()):
                if passed - int(t) >= self.horizon:
                    self.seen.removeKey(dedup_key)
        if silent and not rest and self.indicators.profile_ttl:
            # Silent for a whole profile life: forget the identity.
            self.settled.clear(), self.head.clear(), self.clock.clear()
        else:
            self._keep_profile(self.settled, profile)
            if rest:
                self._wake(clock, rest[0]["event_time"])
            elif not silent:
                self._wake(clock, profile.last_t + self.keep)
            self.clock.update(tuple(clock))
        return iter(())
