"""Thresholds of the detectors, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    alert_type: str
    points: int


@dataclass(frozen=True)
class Settings:
    # Default thresholds, windows in seconds, and points of each alert.
    window: int = 120
    slide: int = 30
    watermark: int = 60
    velocity_window: int = 120
    velocity_over: int = 5
    failures_window: int = 60
    failures_over: int = 10
    speed_over: float = 800.0
    high_value_times: float = 5.0
    high_value_history: int = 2
    high_value_short: int = 7 * 86400
    high_value_long: int = 30 * 86400
    login_gap: int = 300
    risk_window: int = 300
    dedup_delay: int = 30
    velocity: Rule = field(default=Rule("HIGH_TRANSACTION_VELOCITY", 25))
    travel: Rule = field(default=Rule("IMPOSSIBLE_TRAVEL", 30))
    login: Rule = field(default=Rule("LOGIN_TRANSACTION_CORRELATION", 20))
    failures: Rule = field(default=Rule("CARD_TESTING_ATTACK", 30))
    high_value: Rule = field(default=Rule("HIGH_VALUE_ANOMALY", 25))
    #: Lowest points of each level, lowest level first.
    levels: tuple[tuple[str, int], ...] = (("LOW", 0), ("MEDIUM", 26), ("HIGH", 51), ("CRITICAL", 76))


DEFAULT = Settings()
