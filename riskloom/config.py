"""Weights, thresholds and windows of the scoring engines; all are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000

# Indicator weights of the primary engine.
PRIMARY_WEIGHTS = {
    "NEW_DEVICE": 30,
    "NEW_COUNTRY": 35,
    "MULTIPLE_FAILED_LOGINS": 25,
    "IMPOSSIBLE_TRAVEL": 50,
    "LARGE_TRANSFER_AMOUNT": 35,
    "VELOCITY_VIOLATION": 30,
    "SUSPICIOUS_API_PATTERN": 20,
    "HIGH_RISK_RECIPIENT": 40,
}

# Indicator weights of the secondary engine.
SECONDARY_WEIGHTS = {
    "NEW_DEVICE": 30,
    "NEW_COUNTRY": 40,
    "IMPOSSIBLE_TRAVEL": 60,
    "MULTIPLE_FAILED_LOGINS": 35,
    "LARGE_TRANSFER_AMOUNT": 25,
    "VELOCITY_VIOLATION": 30,
    "SUSPICIOUS_API_PATTERN": 20,
}

# Labels and weights of the inactivity-reset accumulator; other labels are ignored.
ACCUMULATOR_WEIGHTS = {
    "NEW_DEVICE": 30,
    "COUNTRY_CHANGE": 40,
    "VELOCITY_VIOLATION": 30,
    "LARGE_TRANSFER": 25,
    "FAILED_LOGIN": 15,
    "CEP_ATO_MATCH": 100,
}

# Labels and weights of the accumulate-and-clear scorer; other labels weigh 10.
CLEARING_WEIGHTS = {
    "VELOCITY_VIOLATION": 30,
    "SUSPICIOUS_DEVICE": 40,
    "IMPOSSIBLE_TRAVEL": 50,
    "LARGE_TRANSFER_ANOMALY": 35,
}

# Path fragments that mark a sensitive API call.
SENSITIVE_ENDPOINTS = ("/transfers", "/login", "/beneficiaries")


@dataclass(frozen=True)
class IndicatorConfig:
    """Windows in milliseconds."""

    profile_ttl: int = DAY
    large_transfer: float = 10_000.0
    velocity_window: int = 5 * MINUTE
    velocity_count: int = 4
    failed_login_window: int = 5 * MINUTE
    failed_login_count: int = 3
    travel_window: int = 2 * HOUR
    travel_inclusive: bool = True
    api_window: int = MINUTE
    api_count: int = 50
    retained_stamps: int = 50
    success_clears_failures: bool = True
    honour_explicit: bool = True
    high_risk_recipients: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScoreConfig:
    weights: dict[str, int] = field(default_factory=lambda: dict(PRIMARY_WEIGHTS))
    unknown_weight: int = 10
    decay: int = 30 * MINUTE
    alert_above: int = 80
    critical_from: int = 100
    cooldown: int = 15 * MINUTE
    listed_indicators: int = 8


@dataclass(frozen=True)
class SecondaryConfig:
    weights: dict[str, int] = field(default_factory=lambda: dict(SECONDARY_WEIGHTS))
    decay: int = 30 * MINUTE
    max_halvings: int = 10
    alert_from: int = 80
    critical_from: int = 100
    cooldown: int = 15 * MINUTE
    listed_indicators: int = 8
    engine_source: str = "python-secondary"


def secondary_indicators(**overrides) -> IndicatorConfig:
    """The secondary engine: strict travel window, failures never cleared, no profile expiry."""
    base = dict(travel_inclusive=False, success_clears_failures=False, honour_explicit=False, profile_ttl=0)
    return IndicatorConfig(**{**base, **overrides})
