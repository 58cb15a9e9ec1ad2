"""What one event does to one identity's profile.

The continuous form keeps a profile per identity and advances it event by
event; the batch operators express the same rules as ordered history.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from riskloom.config import IndicatorConfig, ScoreConfig


@dataclass
class Profile:
    segment: int
    last_t: int
    device: str | None = None
    country: str | None = None
    login_t: int | None = None
    failures: list[int] = field(default_factory=list)
    transfers: list[int] = field(default_factory=list)
    requests: list[int] = field(default_factory=list)
    score: int = 0
    cell: int = 0
    alerted_t: int | None = None
    listed: list[str] = field(default_factory=list)
    timer: int | None = None


def _count(stamps: list[int], t: int, window: int, limit: int) -> int:
    stamps.append(t)
    stamps[:] = [s for s in stamps if t - s <= window][-limit:]
    return len(stamps)


def derive(p: Profile, e: dict, c: IndicatorConfig) -> list[str]:
    if c.honour_explicit and e.get("indicator") is not None:
        return [e["indicator"]]
    t, found = e["event_time"], []
    if e["source_table"] == "login_events":
        device, country, success = e.get("device_id"), e.get("country"), e.get("login_success")
        if device is not None:
            if p.device not in (None, device):
                found.append("NEW_DEVICE")
            p.device = device
        if country is not None:
            if p.country not in (None, country):
                found.append("NEW_COUNTRY")
                since = None if p.login_t is None else t - p.login_t
                if since is not None and (since <= c.travel_window if c.travel_inclusive else since < c.travel_window):
                    found.append("IMPOSSIBLE_TRAVEL")
            p.country = country
        p.login_t = t
        if success is False:
            if _count(p.failures, t, c.failed_login_window, c.retained_stamps) >= c.failed_login_count:
                found.append("MULTIPLE_FAILED_LOGINS")
        elif success and c.success_clears_failures:
            p.failures.clear()
    elif e["source_table"] == "transactions":
        amount = e.get("amount")
        if amount is not None and amount > c.large_transfer:
            found.append("LARGE_TRANSFER_AMOUNT")
        if _count(p.transfers, t, c.velocity_window, c.retained_stamps) >= c.velocity_count:
            found.append("VELOCITY_VIOLATION")
        if e.get("to_account_id") in c.high_risk_recipients:
            found.append("HIGH_RISK_RECIPIENT")
    elif e["source_table"] == "api_requests":
        if _count(p.requests, t, c.api_window, c.retained_stamps) >= c.api_count:
            found.append("SUSPICIOUS_API_PATTERN")
    return found


def advance(p: Profile | None, e: dict, c: IndicatorConfig, s: ScoreConfig) -> tuple[Profile, list[str], bool]:
    """(profile after the event, indicators it fired, whether it alerts)."""
    t = e["event_time"]
    if p is None or (c.profile_ttl and t - p.last_t >= c.profile_ttl):
        p = Profile(segment=t, last_t=t)
    p.last_t = t
    cell = (t - p.segment) // s.decay
    if cell > p.cell:
        p.score >>= cell - p.cell
        p.cell = cell
    fired = derive(p, e, c)
    p.score += sum(s.weights.get(name, s.unknown_weight) for name in fired)
    p.listed = (p.listed + fired)[-s.listed_indicators :]
    alerts = p.score > s.alert_above and (p.alerted_t is None or t - p.alerted_t >= s.cooldown)
    if alerts:
        p.alerted_t = t
    return p, fired, alerts
