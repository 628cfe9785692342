"""Safety stock (P1-P11), on keys that carry class, metrics, forecast and master data."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import half_even, inverse_normal, ratio
from stowage.operators import classify as kinds
from stowage.params import SafetyParams, ServiceLevelParams

# A flat or straight forecast has no spread; sums of doubles leave traces below this.
NOISE = 1e-9


def service_level(cost: Column, lead_days: Column, cv: Column, p: ServiceLevelParams = ServiceLevelParams()) -> Column:
    """Between minimum and maximum by variability, lead time and cost; unknown inputs give the minimum."""
    low, high = p.bounds()
    score = ratio(cv * F.log1p(lead_days.cast("double")) / F.log1p(F.lit(float(p.max_lead_days))), F.log1p(cost))
    usable = F.when((cv < float("inf")) & (F.abs(score) < float("inf")), score)
    level = half_even(low + (high - low) / (1 + F.exp(-usable)), 4)
    return F.coalesce(level, F.lit(low))


def lead_weeks(days: Column, p: SafetyParams = SafetyParams()) -> Column:
    """Whole weeks, at least one; an unknown or zero lead time counts as a week."""
    known = F.when(days != 0, days)
    return F.greatest(F.lit(1), F.ceil(F.coalesce(known, F.lit(p.default_lead_days)) / 7).cast("int"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _spread(values: Column) -> Column:
    """Sample standard deviation of an array; zero for fewer than two values or pure rounding noise."""
    n = F.size(values)
    mean = _total(values) / n
    squares = _total(F.transform(values, lambda v: F.pow(v - mean, 2)))
    std = F.sqrt(ratio(squares, n - 1))
    return F.when((n > 1) & (std > NOISE), std).otherwise(0.0)


def _line_spread(values: Column) -> Column:
    """Sample standard deviation around a fitted line; zero when the values lie on it."""
    n = F.size(values)
    mean = _total(values) / n
    middle = (n - 1) / 2.0
    # Over positions 0..n-1 the squared deviations of the position sum to n(n^2-1)/12.
    across = F.transform(values, lambda v, i: (i - middle) * (v - mean))
    slope = ratio(_total(across) * 12, n * (n * n - 1))
    residual = F.transform(values, lambda v, i: F.pow(v - mean - slope * (i - middle), 2))
    std = F.sqrt(ratio(_total(residual), n - 1))
    return F.when((n > 1) & (std > NOISE), std).otherwise(0.0)


def _or_demand(std: Column) -> Column:
    return F.when(std != 0, std).otherwise(F.coalesce(F.col("demand_std"), F.lit(0.0)))


def _weeks(count: Column) -> Column:
    return F.slice("forecast", F.lit(1), count)


def steady(z: Column, weeks: Column, p: SafetyParams) -> Column:
    """P4."""
    return half_even(z * _or_demand(_spread(_weeks(weeks))), 2)


def seasonal(z: Column, weeks: Column, p: SafetyParams) -> Column:
    """P5: the window is twice the lead time."""
    return half_even(z * _or_demand(_spread(_weeks(weeks * 2))), 2)


def trended(z: Column, weeks: Column, p: SafetyParams) -> Column:
    """P6."""
    return half_even(z * _or_demand(_line_spread(_weeks(weeks))) * F.sqrt(weeks.cast("double")), 2)


def intermittent(z: Column, weeks: Column, p: SafetyParams) -> Column:
    """Spread of the order sizes over the smoothed interval; unrounded, the larger of the two is kept."""
    interval = F.coalesce(F.col("croston_interval"), F.lit(1.0))
    sizes = F.coalesce(z * F.col("size_std") * F.sqrt(ratio(weeks, interval)), F.lit(0.0))
    overall = half_even(z * F.col("demand_std") * F.sqrt(ratio(weeks, F.greatest(interval, F.lit(1.0)))), 2)
    return F.when(sizes != 0, sizes).otherwise(F.coalesce(overall, F.lit(0.0)))


def burst(z: Column, weeks: Column, p: SafetyParams) -> Column:
    """P8."""
    return half_even(F.coalesce(F.array_max(_weeks(weeks)) * p.burst_share, F.lit(0.0)), 2)


STRATEGIES = {
    kinds.STEADY: steady,
    kinds.SEASONAL: seasonal,
    kinds.TRENDED: trended,
    kinds.INTERMITTENT: intermittent,
    kinds.BURST: burst,
}
Strategy = Callable[[Column, Column, SafetyParams], Column]


def _sized(items: DataFrame, kind: Column, cold: Column, weeks: Column, level: Column, p: SafetyParams, strategies: Mapping[str, Strategy] | None = None) -> DataFrame:
    strategies = STRATEGIES | dict(strategies or {})
    known = items.withColumns({"_kind": kind, "_cold": cold, "lead_weeks": weeks, "_level": level})
    z = inverse_normal(F.col("_level"))
    manual = F.coalesce(F.col("safety").cast("double"), F.lit(0.0))
    ruled = ~F.col("_cold") & F.col("_kind").isin(*strategies)
    # Without any history only the forecast-based sizes apply, and they are zero.
    unseen = F.col("weeks").isNull()
    size = F.when(~ruled | unseen, 0.0)
    for label, strategy in strategies.items():
        size = size.when(F.col("_kind") == label, strategy(z, F.col("lead_weeks"), p))
    return (
        known.withColumn("_size", F.coalesce(size, F.lit(0.0)))
        .withColumns(
            {
                "service_level": F.when(ruled, half_even(F.col("_level"), 4)),
                "dynamic_safety": half_even(F.col("_size"), 2),
                "final_safety": F.when(ruled, F.greatest(F.col("_size"), manual)).otherwise(manual),
            }
        )
        .drop("_kind", "_cold", "_level", "_size")
    )


def _cold() -> Column:
    """Cold starts keep the manual stock."""
    return F.col("demand_type").isin(kinds.SINGLE, kinds.NEW) | F.col("activity_level").isin(
        kinds.DORMANT, kinds.INACTIVE
    )


def safety_stock(items: DataFrame, params: SafetyParams = SafetyParams(), strategies: Mapping[str, Strategy] | None = None) -> DataFrame:
    """Service level, dynamic and final safety stock under the master lead time.

    ``strategies`` adds to or replaces the sizes by demand type: functions of the normal quantile, the lead time in weeks and the parameters.
    """
    level = service_level(F.col("cost"), F.col("lead_days"), F.col("cv"), params.service_level)
    return _sized(items, F.col("demand_type"), _cold(), lead_weeks(F.col("lead_days"), params), level, params, strategies)


def safety_stock_with(items: DataFrame, method: str, params: SafetyParams = SafetyParams(), strategies: Mapping[str, Strategy] | None = None) -> DataFrame:
    """P10: one strategy for every key; takes the label or its first word in any case."""
    names = {label.split()[0].upper(): label for label in STRATEGIES | dict(strategies or {})}
    label = names.get(method.upper(), method)
    level = service_level(F.col("cost"), F.col("lead_days"), F.col("cv"), params.service_level)
    return _sized(items, F.lit(label), F.lit(False), lead_weeks(F.col("lead_days"), params), level, params, strategies)


def dynamic_safety_stock(items: DataFrame, params: SafetyParams = SafetyParams()) -> DataFrame:
    """As ``safety_stock`` with the learned lead time ``smart_days`` where a key has one.

    An optional ``lead_weeks_hint`` column is used before the master lead time.
    """
    learned = F.greatest(F.lit(1), F.floor(F.col("smart_days") / 7).cast("int"))
    known = F.col("lead_weeks_hint") if "lead_weeks_hint" in items.columns else F.lit(None).cast("double")
    weeks = (
        F.when(F.col("smart_days") > 0, learned)
        .when(known.isNotNull(), F.greatest(F.lit(1), F.rint(known).cast("int")))
        .otherwise(lead_weeks(F.col("lead_days"), params))
    )
    level = service_level(F.col("cost"), F.col("smart_days"), F.col("cv"), params.service_level)
    return _sized(items, F.col("demand_type"), _cold(), weeks, level, params)
