"""Demand metrics and classification.

All windows partition by the key, so one shuffle serves the whole module. A key's rows are its
weeks since the first demand: the calendar bounds them, however large the order table is.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.numeric import is_true, ratio
from stowage.functions.weeks import monday_of
from stowage.params import KEYS, ClassifierParams, ForecastParams, SeriesParams

# Labels of demand types and activity levels.
STEADY = "Steady Demand"
SEASONAL = "Seasonal Demand"
TRENDED = "Trended Demand"
INTERMITTENT = "Intermittent Demand"
BURST = "Burst Demand"
SINGLE = "Single Demand"
NEW = "New Item"
REPLACED = "Replaced"
STOCK_ONLY = "Stock Only"
ACTIVE = "Active"
OCCASIONAL = "Occasional"
INACTIVE = "Inactive"
DORMANT = "Dormant"

PERIOD = 4


def winsorise(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = KEYS,
    lower: float | None = None,
    upper: float | None = 0.95,
    out: str = "demand",
) -> DataFrame:
    """Clip a series at its own quantiles, on one side or both."""
    group = Window.partitionBy(*keys)
    clipped = F.col(value)
    if upper is not None:
        clipped = F.least(clipped, F.percentile(value, F.lit(upper)).over(group))
    if lower is not None:
        clipped = F.greatest(clipped, F.percentile(value, F.lit(lower)).over(group))
    return df.withColumn(out, clipped)


def prepare_series(
    filled: DataFrame, keys: Sequence[str] = KEYS, params: SeriesParams = SeriesParams()
) -> DataFrame:
    """Weeks ago, decay weight and clipped demand; the week column is kept."""
    group = Window.partitionBy(*keys)
    ago = F.floor(F.datediff(F.max("week_start").over(group), F.col("week_start")) / 7).cast("int")
    clipped = winsorise(filled, "qty", keys, upper=params.winsor_upper)
    return clipped.withColumn("weeks_ago", ago).withColumn(
        "weight", F.pow(F.lit(params.decay), F.col("weeks_ago"))
    )


def series_metrics(
    prepared: DataFrame,
    keys: Sequence[str] = KEYS,
    params: ClassifierParams = ClassifierParams(),
    models: ForecastParams = ForecastParams(),
) -> DataFrame:
    """C4, C5 and the sufficient statistics of every forecast model: one row per key."""
    keys = list(keys)
    group = Window.partitionBy(*keys)
    by_week = group.orderBy("week_start")
    by_size = group.orderBy("demand").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_week.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_week.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, w = F.col("demand"), F.col("weight")

    def beside(k: int) -> Column:
        return F.lag(x, k).over(by_week) if k > 0 else F.lead(x, -k).over(by_week)

    moving = (beside(2) * 0.5 + beside(1) + x + beside(-1) + beside(-2) * 0.5) / PERIOD
    hit = x > 0
    keep = F.lit(1.0 - models.croston_alpha)
    rows = (
        prepared.withColumns(
            {
                "_row": F.row_number().over(by_week),
                "_rows": F.count(F.lit(1)).over(group),
                "_mean": F.sum(x * w).over(group) / F.sum(w).over(group),
                "_moving": moving,
                "_hits": F.count(F.when(hit, 1)).over(group),
                "_hit_no": F.count(F.when(hit, 1)).over(upto),
                "_share": F.sum(w).over(by_size) / F.sum(w).over(group),
            }
        )
        .withColumn("_last_hit", F.coalesce(F.max(F.when(hit, F.col("_row"))).over(earlier), F.lit(0)))
        .withColumn("_detrended", x - F.col("_moving"))
        .withColumn("_phase", (F.col("_row") - 1) % PERIOD)
        .withColumn("_week_no", F.weekofyear("week_start"))
        .withColumn("_week_mean", F.avg(x).over(Window.partitionBy(*keys, "_week_no")))
    )
    smooth = F.pow(keep, F.col("_hits") - F.col("_hit_no")) * F.when(
        F.col("_hit_no") > 1, F.lit(models.croston_alpha)
    ).otherwise(1.0)
    ago = F.col("weeks_ago")
    phases = [F.avg(F.when(F.col("_phase") == k, F.col("_detrended"))).alias(f"_phase_{k}") for k in range(PERIOD)]
    sizes = [F.count(F.when(F.col("_phase") == k, 1)).alias(f"_size_{k}") for k in range(PERIOD)]
    base = models.seasonal_baseline_weeks
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.max("week_start").alias("last_week"),
        F.max(ago).alias("max_weeks_ago"),
        F.count(F.when(hit, 1)).alias("weeks_with_demand"),
        (F.count(F.when(x == 0, 1)) / F.count(F.lit(1))).alias("zero_ratio"),
        F.max("_mean").alias("weighted_mean"),
        F.sqrt(F.sum(w * F.pow(x - F.col("_mean"), 2)) / F.sum(w)).alias("weighted_std"),
        F.coalesce(F.sum(F.when(ago <= params.single_recent_weeks_ago, x)), F.lit(0.0)).alias("recent_demand"),
        F.count(F.when(hit & (ago <= params.activity_weeks - 1), 1)).alias("recent_hits"),
        F.max(F.when(F.col("_row") > F.col("_rows") - params.burst_tail_weeks, x)).alias("tail_max"),
        F.avg(F.when(F.col("_row") > F.col("_rows") - params.burst_mean_weeks, x)).alias("tail_mean"),
        (
            F.max(F.when(F.col("_row") == F.col("_rows") - 2, F.col("_moving")))
            - F.max(F.when(F.col("_row") == 3, F.col("_moving")))
        ).alias("_rise"),
        *phases,
        *sizes,
        F.min(F.when(F.col("_share") >= models.steady_quantile, x)).alias("steady_level"),
        F.percentile(x, F.lit(models.burst_quantile)).alias("burst_level"),
        F.regr_slope(x, F.col("_row") - 1).alias("_slope"),
        F.regr_intercept(x, F.col("_row") - 1).alias("_intercept"),
        F.avg(x).alias("demand_mean"),
        F.stddev_samp(x).alias("demand_std"),
        F.stddev_samp(F.when(hit, x)).alias("size_std"),
        F.sum(F.when(hit, x * smooth)).alias("croston_size"),
        F.sum(F.when(hit, (F.col("_row") - F.col("_last_hit")) * smooth)).alias("croston_interval"),
        F.sum(F.when(F.col("_row") > F.col("_rows") - base, x * w)).alias("_base_top"),
        F.sum(F.when(F.col("_row") > F.col("_rows") - base, w)).alias("_base_weight"),
        F.map_from_entries(F.collect_set(F.struct("_week_no", "_week_mean"))).alias("week_means"),
    )
    return _finished(totals, keys, params)


def _finished(totals: DataFrame, keys: Sequence[str], params: ClassifierParams) -> DataFrame:
    """The metrics that follow from a key's sums."""
    long_enough = F.col("weeks") >= 2 * PERIOD if params.decompose else F.lit(False)
    centre = sum((F.col(f"_phase_{k}") for k in range(1, PERIOD)), F.col("_phase_0")) / PERIOD
    strength = sum(
        (F.abs(F.col(f"_phase_{k}") - centre) * F.col(f"_size_{k}") for k in range(1, PERIOD)),
        F.abs(F.col("_phase_0") - centre) * F.col("_size_0"),
    ) / F.col("weeks")
    cv = F.when(
        F.col("weighted_mean") > 0, ratio(F.col("weighted_std"), F.col("weighted_mean"))
    ).otherwise(F.lit(float("inf")))
    named = totals.withColumns(
        {
            "cv": cv,
            "trend_slope": F.when(long_enough, F.try_divide(F.col("_rise"), (F.col("weeks") - 5).cast("double"))),
            "seasonal_strength": F.when(long_enough, strength),
            "line_slope": F.when(F.col("weeks") > 1, F.col("_slope")).otherwise(0.0),
            "line_start": F.when(F.col("weeks") > 1, F.col("_intercept")).otherwise(F.col("demand_mean")),
            "seasonal_base": F.when(F.col("_base_weight") > 0, F.col("_base_top") / F.col("_base_weight")).otherwise(
                1.0
            ),
        }
    )
    return named.select(
        *keys, "weeks", "last_week", "max_weeks_ago", "weeks_with_demand", "zero_ratio", "weighted_mean",
        "weighted_std", "cv", "trend_slope", "seasonal_strength", "recent_demand", "recent_hits", "tail_max",
        "tail_mean", "steady_level", "burst_level", "line_slope", "line_start", "demand_std", "size_std",
        "croston_size", "croston_interval", "seasonal_base", "week_means",
    )


def run_lengths(weekly: DataFrame, as_of: dt.date, keys: Sequence[str] = KEYS, params: SeriesParams = SeriesParams()) -> DataFrame:
    """C3 without filled weeks: a row per week with demand and one per run of weeks without, so the work follows the orders, not the calendar.

    ``n`` equal weeks from row ``start`` on, of ``rows`` in the series; ``demand`` is clipped as in ``prepare_series``.
    """
    last = F.lit(monday_of(as_of)).cast("date")
    group = Window.partitionBy(*keys)
    following = F.lead("week_start").over(group.orderBy("week_start"))
    weeks_to = lambda day: F.floor(F.datediff(day, F.col("week_start")) / 7).cast("int")
    placed = weekly.where(F.col("week_start") <= last).select(
        *keys,
        "week_start",
        F.coalesce(F.col("qty"), F.lit(0.0)).alias("_own"),
        weeks_to(F.coalesce(F.date_sub(following, 7), last)).alias("_gap"),
        F.min("week_start").over(group).alias("first_week"),
        F.weekofyear("week_start").alias("week_no"),
    ).withColumn("start", F.floor(F.datediff("week_start", "first_week") / 7).cast("int") + 1)
    own = F.struct(F.col("start"), F.lit(1).alias("n"), F.col("_own").alias("qty"), F.col("week_no"))
    rest = F.struct((F.col("start") + 1).alias("start"), F.col("_gap").alias("n"), F.lit(0.0).alias("qty"), F.lit(None).cast("int").alias("week_no"))
    runs = placed.select(*keys, "first_week", F.inline(F.when(F.col("_gap") > 0, F.array(own, rest)).otherwise(F.array(own))))
    demand = F.col("qty")
    if params.winsor_upper is not None:
        demand = F.least(demand, F.percentile("qty", F.lit(params.winsor_upper), F.col("n")).over(group))
    return runs.withColumns({"rows": F.sum("n").over(group).cast("int"), "demand": demand})


def run_metrics(
    runs: DataFrame,
    keys: Sequence[str] = KEYS,
    series: SeriesParams = SeriesParams(),
    params: ClassifierParams = ClassifierParams(),
    models: ForecastParams = ForecastParams(),
) -> DataFrame:
    """C4, C5 and the models' statistics as ``series_metrics`` gives them, in closed form over ``run_lengths``."""
    keys = list(keys)
    group = Window.partitionBy(*keys)
    by_row = group.orderBy("start")
    by_size = group.orderBy("demand").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x, n, start, rows = F.col("demand"), F.col("n"), F.col("start"), F.col("rows")
    end = start + n - 1
    oldest, newest = rows - start, rows - end
    hit = x > 0

    def weight_to(limit: Column) -> Column:
        """The decay weights of the run's weeks that are at most ``limit`` weeks ago: a geometric sum."""
        upto = F.least(oldest, limit)
        if series.decay == 1:
            total = (upto - newest + 1).cast("double")
        else:
            total = (F.pow(F.lit(series.decay), newest) - F.pow(F.lit(series.decay), upto + 1)) / (1 - series.decay)
        return F.when(upto >= newest, total).otherwise(0.0)

    def weeks_to(limit: Column) -> Column:
        return F.greatest(F.least(oldest, limit) - newest + 1, F.lit(0))

    def in_phase(low: Column, high: Column, phase: int) -> Column:
        """How many rows from low to high are of a phase; row r is of phase (r - 1) % PERIOD."""
        upto = lambda r: F.floor((r - 1 - phase + PERIOD) / PERIOD)
        return F.when(high >= low, upto(high) - upto(low - 1)).otherwise(0)

    def detrended(phase: int) -> Column:
        """The run's share in the sum of a phase's detrended rows: what it is itself, less what it is in the means around it."""
        inside = lambda by: in_phase(F.greatest(start + by, F.lit(3)), F.least(end + by, rows - 2), phase)
        around = inside(-2) * 0.5 + inside(-1) + inside(0) + inside(1) + inside(2) * 0.5
        return x * (inside(0) - around / PERIOD)

    def at(row: Column) -> Column:
        return F.max(F.when((start <= row) & (row <= end), x))

    def moving(row: Column) -> Column:
        return (at(row - 2) * 0.5 + at(row - 1) + at(row) + at(row + 1) + at(row + 2) * 0.5) / PERIOD

    whole = weight_to(oldest)
    keep = F.lit(1.0 - models.croston_alpha)
    upto = by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = runs.withColumns(
        {
            "_w": whole,
            "_mean": F.sum(x * whole).over(group) / F.sum(whole).over(group),
            "_hits": F.count(F.when(hit, 1)).over(group),
            "_hit_no": F.count(F.when(hit, 1)).over(upto),
            "_last_hit": F.coalesce(F.max(F.when(hit, start)).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_share": F.sum(whole).over(by_size) / F.sum(whole).over(group),
            "_week_sum": F.sum(x).over(Window.partitionBy(*keys, "week_no")),
            "_week_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys, "week_no")),
        }
    )
    smooth = F.pow(keep, F.col("_hits") - F.col("_hit_no")) * F.when(F.col("_hit_no") > 1, F.lit(models.croston_alpha)).otherwise(1.0)
    burst = lambda weeks: F.lit(weeks - 1)
    recent, active = F.lit(params.single_recent_weeks_ago), F.lit(params.activity_weeks - 1)
    base = F.lit(models.seasonal_baseline_weeks - 1)
    length = F.max(rows)
    # Rows of the series by phase, all and those that have a moving mean.
    sizes = [in_phase(F.lit(1), length, k) for k in range(PERIOD)]
    inner = [in_phase(F.lit(3), length - 2, k) for k in range(PERIOD)]
    positions = F.sum(x * n * (2 * (start - 1) + n - 1) / 2)
    mean = F.sum(x * n) / length
    off = x - F.col("_mean")
    spread = length.cast("double") * (length.cast("double") * length - 1) / 12
    totals = placed.groupBy(*keys).agg(
        length.cast("long").alias("weeks"),
        F.max(F.date_add("first_week", (rows - 1) * 7)).alias("last_week"),
        (length - 1).cast("int").alias("max_weeks_ago"),
        F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("weeks_with_demand"),
        (F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)) / length).alias("zero_ratio"),
        F.max("_mean").alias("weighted_mean"),
        F.sqrt(F.sum(F.col("_w") * F.pow(x - F.col("_mean"), 2)) / F.sum("_w")).alias("weighted_std"),
        F.coalesce(F.sum(F.when(weeks_to(recent) > 0, x * weeks_to(recent))), F.lit(0.0)).alias("recent_demand"),
        F.coalesce(F.sum(F.when(hit, weeks_to(active))), F.lit(0)).alias("recent_hits"),
        F.max(F.when(weeks_to(burst(params.burst_tail_weeks)) > 0, x)).alias("tail_max"),
        (F.sum(x * weeks_to(burst(params.burst_mean_weeks))) / F.sum(weeks_to(burst(params.burst_mean_weeks)))).alias("tail_mean"),
        (moving(rows - 2) - moving(F.lit(3))).alias("_rise"),
        *[F.when(inner[k] > 0, F.sum(detrended(k)) / inner[k]).alias(f"_phase_{k}") for k in range(PERIOD)],
        *[sizes[k].alias(f"_size_{k}") for k in range(PERIOD)],
        F.min(F.when(F.col("_share") >= models.steady_quantile, x)).alias("steady_level"),
        F.percentile(x, F.lit(models.burst_quantile), n).alias("burst_level"),
        F.when(length > 1, (positions - mean * length * (length - 1) / 2) / spread).alias("_slope"),
        mean.alias("demand_mean"),
        # Around the weighted mean, so that equal values have no spread left over from rounding.
        F.when(length > 1, F.sqrt(F.greatest(F.sum(n * off * off) - F.sum(n * off) * F.sum(n * off) / length, F.lit(0.0)) / (length - 1))).alias("demand_std"),
        F.stddev_samp(F.when(hit, x)).alias("size_std"),
        F.sum(F.when(hit, x * smooth)).alias("croston_size"),
        F.sum(F.when(hit, (start - F.col("_last_hit")) * smooth)).alias("croston_interval"),
        F.sum(F.when(weeks_to(base) > 0, x * weight_to(base))).alias("_base_top"),
        F.sum(F.when(weeks_to(base) > 0, weight_to(base))).alias("_base_weight"),
        F.max("first_week").alias("_first"),
        F.min(F.when(F.col("week_no").isNull(), x)).alias("_idle"),
        F.map_from_entries(F.collect_set(F.when(F.col("week_no").isNotNull(), F.struct("week_no", F.struct(F.col("_week_sum").alias("top"), F.col("_week_rows").alias("n")))))).alias("_weeks"),
    )
    with_line = totals.withColumn("_intercept", F.col("demand_mean") - F.coalesce("_slope", F.lit(0.0)) * (F.col("weeks") - 1) / 2)
    return _finished(with_line.withColumn("week_means", _week_means()), keys, params)


def _week_means() -> Column:
    """The mean of every ISO week number that lies between the first and the last week, from the sums of weeks with demand.

    What depends on the key alone is bound once, as the variable of an outer lambda: inside the lambda over the weeks it would be worked out for each.
    """
    year = lambda d: F.extract(F.lit("YEAROFWEEK"), d)
    long = lambda y: F.weekofyear(F.make_date(y, F.lit(12), F.lit(28))) == 53
    first, last = F.col("_first"), F.col("last_week")
    key = F.struct(
        (year(last) - year(first) + 1).alias("years"),
        F.size(F.filter(F.sequence(year(first), year(last)), long)).alias("long_years"),
        F.weekofyear(first).alias("from_week"),
        F.weekofyear(last).alias("to_week"),
        long(year(first)).cast("int").alias("long_first"),
        long(year(last)).cast("int").alias("long_last"),
        F.col("_weeks").alias("seen"),
        F.coalesce("_idle", F.lit(0.0)).alias("idle"),
    )

    def means(k: Column) -> Column:
        def count(w: Column) -> Column:
            among = F.when(w == 53, k["long_years"]).otherwise(k["years"])
            # A first year that begins after the week, and a last one that ends before it, do not count.
            before = F.when(w < k["from_week"], F.when(w == 53, k["long_first"]).otherwise(1)).otherwise(0)
            after = F.when(w > k["to_week"], F.when(w == 53, k["long_last"]).otherwise(1)).otherwise(0)
            return among - before - after

        def entry(x: Column) -> Column:
            top = F.coalesce(x["seen"]["top"], F.lit(0.0)) + k["idle"] * (x["n"] - F.coalesce(x["seen"]["n"], F.lit(0)))
            return F.struct(x["week"].alias("key"), (top / x["n"]).alias("value"))

        weeks = F.transform(
            F.sequence(F.lit(1), F.lit(53)),
            lambda w: F.struct(w.alias("week"), count(w).alias("n"), F.try_element_at(k["seen"], w).alias("seen")),
        )
        return F.map_from_entries(F.transform(F.filter(weeks, lambda x: x["n"] > 0), entry))

    return F.transform(F.array(key), means)[0]


def demand_type(p: ClassifierParams = ClassifierParams()) -> Column:
    """The first rule that holds."""
    steady = (
        (F.col("cv") < p.steady_cv)
        & (F.col("weeks_with_demand") / F.col("weeks") > p.steady_min_weeks_ratio)
        & (F.col("zero_ratio") < p.steady_max_zero_ratio)
    )
    trended = F.abs("trend_slope") > F.greatest(
        F.lit(p.trend_slope), F.col("weighted_mean") * p.trend_mean_share
    )
    seasonal = F.col("seasonal_strength") > F.greatest(
        F.col("weighted_std") * p.seasonal_std_share, F.lit(p.seasonal_min)
    )
    burst = (
        (F.col("cv") > p.burst_cv)
        & (F.col("zero_ratio") < p.burst_max_zero_ratio)
        & (F.col("tail_max") > F.col("tail_mean") * p.burst_multiplier)
    )
    single = (F.col("zero_ratio") > p.single_zero_ratio) & (F.col("recent_demand") <= p.single_recent_demand)
    return (
        F.when(
            F.col("max_weeks_ago") < p.new_item_weeks,
            F.when(F.col("weeks_with_demand") <= p.new_item_weeks, NEW).otherwise(STEADY),
        )
        .when(single, SINGLE)
        .when(F.col("zero_ratio") > p.intermittent_zero_ratio, INTERMITTENT)
        .when(steady, STEADY)
        .when(is_true(trended), TRENDED)
        .when(is_true(seasonal), SEASONAL)
        .when(is_true(burst), BURST)
        .otherwise(INTERMITTENT)
    )


def activity_level(p: ClassifierParams = ClassifierParams()) -> Column:
    """How alive the demand is."""
    zero, hits = F.col("zero_ratio"), F.col("recent_hits")
    return (
        F.when((zero >= p.dormant_zero_ratio) & (hits == 0), DORMANT)
        .when((zero >= p.inactive_zero_ratio) & (hits <= p.inactive_max_hits), INACTIVE)
        .when(zero >= p.occasional_zero_ratio, OCCASIONAL)
        .otherwise(ACTIVE)
    )


def classify(metrics: DataFrame, params: ClassifierParams = ClassifierParams()) -> DataFrame:
    """C6, C7 on the metrics of keys with history."""
    return metrics.withColumns({"demand_type": demand_type(params), "activity_level": activity_level(params)})


def classify_items(
    master: DataFrame, metrics: DataFrame, params: ClassifierParams = ClassifierParams()
) -> DataFrame:
    """Every key of the master data with its class.

    Replaced items and keys that only hold manual stock are dormant; a key with neither history nor
    manual stock is left out.
    """
    joined = master.join(classify(metrics, params), list(KEYS), "left")
    replaced = is_true(F.col("rpflag") == "Y")
    unseen = F.col("weeks").isNull()
    stock_only = unseen & is_true(F.col("safety") > 0)
    short = replaced | stock_only

    def unless_short(name: str, value: Column | None = None) -> Column:
        fallback = F.lit(None) if value is None else value
        return F.when(short, fallback).otherwise(F.col(name))

    return joined.where(replaced | ~unseen | stock_only).withColumns(
        {
            "demand_type": F.when(replaced, REPLACED).when(stock_only, STOCK_ONLY).otherwise(F.col("demand_type")),
            "activity_level": unless_short("activity_level", F.lit(DORMANT)),
            "weeks_with_demand": unless_short("weeks_with_demand", F.lit(0).cast("long")),
            "zero_ratio": unless_short("zero_ratio", F.lit(1.0)),
            "cv": unless_short("cv"),
            "trend_slope": unless_short("trend_slope"),
            "seasonal_strength": unless_short("seasonal_strength"),
            "service_level_hint": F.when(replaced, F.lit(params.replaced_service_level)),
        }
    )
