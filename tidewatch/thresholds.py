"""Tunable limits of the five monitors.

Field defaults are fixed values, the published ones.  A value that makes no sense is refused when
the limits are made; there are no upper bounds but those of a percentage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


def _require(limits: object, least: int, most: int | None, *names: str) -> None:
    for name in names:
        value = getattr(limits, name)
        if value < least or (most is not None and value > most):
            bound = f"at least {least}" if most is None else f"between {least} and {most}"
            raise ValueError(f"{name} must be {bound}, not {value}")


@dataclass(frozen=True)
class StallThresholds:
    """Shared by the single-feed and the dataset-wide stall monitors."""

    lookback_days: int = 120
    stall_days: int = 5
    past_threshold_days: int = 7
    trend_days: int = 30
    incident_trend_days: int = 10

    @property
    def past_days(self) -> int:
        return max(self.past_threshold_days, self.stall_days)

    @property
    def incident_history_days(self) -> int:
        return self.lookback_days + self.incident_trend_days

    @property
    def trend_history_days(self) -> int:
        return self.lookback_days + max(self.trend_days, self.incident_trend_days)

    def __post_init__(self) -> None:
        _require(self, 1, None, "lookback_days", "stall_days", "past_threshold_days", "trend_days", "incident_trend_days")


@dataclass(frozen=True)
class ErrorThresholds:
    success_lookback_days: int = 15
    error_days: int = 1
    past_threshold_days: int = 3
    trend_days: int = 30
    incident_trend_days: int = 10

    @property
    def past_days(self) -> int:
        return max(self.past_threshold_days, self.error_days)

    @property
    def incident_history_days(self) -> int:
        return max(self.success_lookback_days, self.incident_trend_days)

    @property
    def trend_history_days(self) -> int:
        return self.trend_days - 1 + self.incident_history_days

    def __post_init__(self) -> None:
        _require(
            self, 1, None, "success_lookback_days", "error_days", "past_threshold_days", "trend_days", "incident_trend_days"
        )


@dataclass(frozen=True)
class DeclineThresholds:
    window_days: int = 5
    drop_percent: int = 10
    past_threshold_drop_percent: int = 25
    min_future_opportunities: int = 50
    qualify_window_days: int = 10
    qualify_drop_percent: int = 10
    trend_days: int = 30
    incident_trend_days: int = 10

    @property
    def min_observations(self) -> int:
        return max(2, min(3, self.window_days))

    @property
    def past_percent(self) -> int:
        return max(self.past_threshold_drop_percent, self.drop_percent)

    @property
    def qualify_days(self) -> int:
        return max(self.qualify_window_days, self.window_days)

    @property
    def incident_history_days(self) -> int:
        return max(self.qualify_days, self.incident_trend_days)

    @property
    def trend_history_days(self) -> int:
        return self.trend_days - 1 + self.incident_history_days

    def __post_init__(self) -> None:
        _require(self, 1, None, "window_days", "qualify_window_days", "trend_days", "incident_trend_days")
        _require(self, 1, 100, "drop_percent", "past_threshold_drop_percent", "qualify_drop_percent")
        _require(self, 0, None, "min_future_opportunities")


@dataclass(frozen=True)
class OrphanThresholds:
    min_orphans: int = 1_000
    min_share: float = 0.10
    past_threshold_orphans: int = 10_000

    @property
    def past_orphans(self) -> int:
        return max(self.past_threshold_orphans, self.min_orphans)

    @property
    def share_gate(self) -> float:
        return 0.0 if math.isnan(self.min_share) else max(0.0, min(1.0, self.min_share))

    def __post_init__(self) -> None:
        _require(self, 1, None, "min_orphans", "past_threshold_orphans")
