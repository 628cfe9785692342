"""Typed parameters. Unknown names are rejected by the dataclass constructors."""

from __future__ import annotations

from dataclasses import dataclass, field

KEYS = ("item", "warehouse")


@dataclass(frozen=True)
class SeriesParams:
    """How a demand series is weighted and clipped before any statistic."""

    decay: float = 0.9
    winsor_upper: float = 0.95


@dataclass(frozen=True)
class ClassifierParams:
    new_item_weeks: int = 8
    single_zero_ratio: float = 0.95
    single_recent_demand: float = 0.0
    single_recent_weeks_ago: int = 12
    intermittent_zero_ratio: float = 0.7
    steady_cv: float = 1.0
    steady_min_weeks_ratio: float = 0.25
    steady_max_zero_ratio: float = 0.6
    trend_slope: float = 0.3
    trend_mean_share: float = 0.05
    seasonal_std_share: float = 0.4
    seasonal_min: float = 0.5
    burst_cv: float = 1.5
    burst_max_zero_ratio: float = 0.3
    burst_multiplier: float = 3.0
    burst_tail_weeks: int = 4
    burst_mean_weeks: int = 12
    dormant_zero_ratio: float = 0.95
    inactive_zero_ratio: float = 0.8
    inactive_max_hits: int = 2
    occasional_zero_ratio: float = 0.6
    activity_weeks: int = 12
    replaced_service_level: float = 0.85
    # The seasonal period is fixed at four weeks; False leaves slope and strength null.
    decompose: bool = True


@dataclass(frozen=True)
class ForecastParams:
    horizon_weeks: int = 12
    steady_quantile: float = 0.6
    croston_alpha: float = 0.1
    burst_quantile: float = 0.9
    seasonal_baseline_weeks: int = 12
    seasonal_default: float = 1.0


@dataclass(frozen=True)
class ServiceLevelParams:
    max_lead_days: int = 360
    minimum: float = 0.85
    maximum: float = 0.95

    def bounds(self) -> tuple[float, float]:
        """The usable (minimum, maximum); an impossible pair falls back to (0.85, 0.99)."""
        if self.maximum <= self.minimum or self.maximum > 0.99:
            return 0.85, 0.99
        return self.minimum, self.maximum


@dataclass(frozen=True)
class SafetyParams:
    croston_alpha: float = 0.1
    burst_share: float = 0.8
    default_lead_days: int = 7
    service_level: ServiceLevelParams = field(default_factory=ServiceLevelParams)


@dataclass(frozen=True)
class OrderParams:
    """Replenishment order sizing."""

    use_moq: bool = True
    min_moq: int = 1
    use_lots: bool = False
    round_up_lots: bool = False
    include_zero: bool = False


@dataclass(frozen=True)
class EtaParams:
    tolerance_days: int = 5
    fast_limit_days: int = 14
    default_transport_days: int = 14
    shipped_default_days: int = 7
    tail_default_interval: int = 7
    tail_default_lead: int = 14
    tail_min_batch: int = 10
    # True labels likely-split batches apart from tail batches.
    distinct_batch_flag: bool = False
