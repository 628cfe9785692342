"""Transport-mode correction and lead-time statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.distribution import described
from stowage.functions.modes import ASSIGNABLE, INF, MODES, attribute, move_days
from stowage.functions.numeric import is_true
from stowage.functions.running import first_rows
from stowage.operators.po import base_line
from stowage.session import materialised

ROUTE = ("vendor", "warehouse", "mode")
SWITCH_COST = 20
PARTS = ("low", "high", "mean", "stats_mean")


def fallback_means(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A1: mean transport days of each route, where the mean suits the mode.

    ``weight`` counts the rows behind a pre-aggregated row.
    """
    n = F.lit(1) if weight is None else weight
    days = F.col("transport_days").cast("double")
    return (
        df.where(F.col("transport_days").isNotNull() & F.col("mode").isNotNull())
        .groupBy(*ROUTE)
        .agg((F.sum(days * n) / F.sum(n)).alias("fallback_days"))
        .where(F.col("fallback_days").between(attribute(F.col("mode"), "low"), attribute(F.col("mode"), "high")))
    )


def lead_time_ranges(stats: DataFrame | None, fallback: DataFrame | None) -> DataFrame:
    """A2: low, high and mean days of every route that has statistics or a fallback mean.

    Values outside the mode's own range are ignored. ``stats_mean`` leaves the fallback out.
    """
    if stats is None and fallback is None:
        raise ValueError("lead_time_ranges needs statistics or fallback means")
    measured = ["mean_days", "mode_days", "smoothed_days", "p90_days"]
    if stats is None:
        routes = fallback.select("*", *[F.lit(None).cast("double").alias(c) for c in measured])
    elif fallback is None:
        routes = stats.select(*ROUTE, *measured, F.lit(None).cast("double").alias("fallback_days"))
    else:
        routes = stats.select(*ROUTE, *measured).join(fallback, list(ROUTE), "full")
    low, high = attribute(F.col("mode"), "low"), attribute(F.col("mode"), "high")

    def inside(name: str) -> Column:
        return F.when(F.col(name).between(low, high), F.col(name))

    stats_mean = F.coalesce(inside("mean_days"), (low + high) / 2)
    return routes.where(low.isNotNull()).select(
        *ROUTE,
        F.coalesce(inside("mode_days"), inside("smoothed_days"), low).alias("low"),
        F.coalesce(F.when(F.col("p90_days") <= high, F.col("p90_days")), high).alias("high"),
        F.coalesce(inside("fallback_days"), stats_mean).alias("mean"),
        stats_mean.alias("stats_mean"),
    )


def _profile_name(mode: str, part: str) -> str:
    return f"_{mode.lower()}_{part}"


def _profiles(ranges: DataFrame) -> DataFrame:
    """The ranges of the assignable modes side by side, one row per vendor and warehouse."""
    columns = [
        F.max(F.when(F.col("mode") == m.name, F.col(part))).alias(_profile_name(m.name, part))
        for m in ASSIGNABLE
        for part in PARTS
    ]
    return ranges.groupBy("vendor", "warehouse").agg(*columns)


def _static(mode, part: str) -> float:
    if part == "low":
        return mode.low
    if part == "high":
        return mode.high
    return INF if mode.high == INF else (mode.low + mode.high) / 2


def mode_choices(routes: DataFrame, ranges: DataFrame, fallback_for_candidates: bool = True) -> DataFrame:
    """A3: what each route compares its days with: its own range, and the mean and price of every permitted mode.

    A mode that may not be chosen has no price. Routes are few, so the rules are worked out here
    and rows only compare numbers.
    """
    mode = F.col("mode")

    def part(m, name: str) -> Column:
        return F.coalesce(F.col(_profile_name(m.name, name)), F.lit(_static(m, name)))

    def own(name: str) -> Column:
        chosen = F
        for m in MODES:
            chosen = chosen.when(mode == m.name, part(m, name) if m.assignable else F.lit(_static(m, name)))
        return chosen

    mean = "mean" if fallback_for_candidates else "stats_mean"
    columns = [own(name).alias(f"_own_{name}") for name in ("low", "high", "mean")]
    for m in ASSIGNABLE:
        columns.append(part(m, mean).alias(f"_mean_{m.ord}"))
        columns.append((move_days(mode, m) + SWITCH_COST).alias(f"_price_{m.ord}"))
    return routes.join(_profiles(ranges), ["vendor", "warehouse"], "left").select(*ROUTE, *columns)


def predicted_mode(days: Column, tolerance: float) -> Column:
    """A3: the mode itself if its days are plausible, else the cheapest permitted mode that fits them."""
    accepted = days.between(F.col("_own_low"), F.col("_own_high")) & (F.abs(days - F.col("_own_mean")) <= tolerance)
    costs = []
    for k, m in enumerate(ASSIGNABLE):
        cost = F.abs(days - F.col(f"_mean_{m.ord}")) + F.col(f"_price_{m.ord}")
        fits = days.between(F.lit(m.low), F.lit(m.high)) & cost.isNotNull()
        costs.append(F.when(fits, F.struct(cost.alias("cost"), F.lit(k).alias("at"), F.lit(m.name).alias("mode"))))
    # The least struct is the lowest cost, the first mode on ties; every cost is worked out once.
    best = F.array_min(F.array(*costs))["mode"]
    return F.when(is_true(accepted), F.col("mode")).otherwise(F.coalesce(best, F.col("mode")))


def correct_modes(
    df: DataFrame,
    ranges: DataFrame,
    tolerance: float = 5,
    overwrite: bool = True,
    courier_to_air: bool = False,
    fallback_for_candidates: bool = True,
) -> DataFrame:
    """A3 over a table of transports: adds original_mode and predicted_mode, and replaces mode on request.

    ``fallback_for_candidates=False`` scores other modes by their statistics alone.
    """
    kept = [c for c in df.columns if c not in {"original_mode", "predicted_mode"}]
    original = F.col("original_mode") if "original_mode" in df.columns else F.col("mode")
    start = df.withColumn("original_mode", original)
    if courier_to_air:
        start = start.withColumn("mode", F.when(F.col("mode") == "Courier", "Air").otherwise(F.col("mode")))
    choices = mode_choices(start.select(*ROUTE).distinct(), ranges, fallback_for_candidates)
    predicted = predicted_mode(F.col("transport_days").cast("double"), tolerance)
    joined = start.join(choices, list(ROUTE), "left").withColumn("predicted_mode", predicted)
    if overwrite:
        joined = joined.withColumn("mode", F.col("predicted_mode"))
    return joined.select(*kept, "original_mode", "predicted_mode")


def _all_known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def shipments(deliveries: DataFrame) -> DataFrame:
    """Deliveries of a vendor that left and arrived together count as one shipment."""
    return (
        deliveries.where(F.col("invoice_date").isNotNull() & F.col("delivery_date").isNotNull())
        .groupBy("warehouse", "vendor", "invoice_date", "delivery_date", "mode")
        .agg(
            F.avg("transport_days").alias("transport_days"),
            F.countDistinct(F.concat_ws("-", "ponum", "poline")).alias("shipment_size"),
        )
    )


def transport_stats(
    deliveries: DataFrame,
    previous: DataFrame | None = None,
    quantile: float = 0.9,
    tolerance: float = 0,
    shipment_grain: bool = True,
    alpha: float = 0.2,
) -> DataFrame:
    """Transport days per warehouse, vendor and corrected mode. Cost columns are filled by the freight model.

    Transports are counted by route, invoice date and days once; fallback means, mode choice and all statistics
    come from that table, which is materialised.
    """
    # Rows move by what both groupings share, so that one shuffle serves them.
    rows = shipments(deliveries.repartition("vendor", "warehouse", "invoice_date")) if shipment_grain else deliveries
    known = rows.where(F.col("transport_days").isNotNull())
    counted = materialised(known.groupBy(*ROUTE, "invoice_date", "transport_days").agg(F.count(F.lit(1)).alias("_n")))
    ranges = lead_time_ranges(previous, fallback_means(counted, F.col("_n")))
    # A route keeps its vendor and warehouse whatever its mode becomes: one shuffle serves the choice and all windows.
    corrected = correct_modes(counted.repartition("vendor", "warehouse"), ranges, tolerance)
    keys = ["warehouse", "vendor", "mode"]
    spread = described(corrected, keys, "invoice_date", "transport_days", {"p60": 0.6, "p90": quantile}, alpha, "_n")
    return spread.select(
        *keys,
        F.col("mean").alias("mean_days"),
        F.col("std").alias("std_days"),
        F.col("p60").alias("p60_days"),
        F.col("p90").alias("p90_days"),
        F.col("typical").alias("mode_days"),
        # A route that is not known in full has no smoothed figure.
        F.when(_all_known(keys), F.col("recent")).alias("smoothed_days"),
        "samples",
        F.lit(None).cast("double").alias("cost_per_kg"),
        F.lit(None).cast("double").alias("base_charge"),
    )


def last_batches(deliveries: DataFrame) -> DataFrame:
    """The last delivered batch of every order line."""
    rest = [c for c in deliveries.columns if c not in {"ponum", "invoice_date"}]
    order = [F.col("invoice_date").desc_nulls_first(), *[F.col(c).desc_nulls_first() for c in rest]]
    return first_rows(deliveries.withColumn("_base", base_line()), ["ponum", "_base"], order).drop("_base")


def prepare_stats(deliveries: DataFrame, alpha: float = 0.3, tail_only: bool = True) -> DataFrame:
    """Preparation days per item, warehouse and vendor."""
    rows = last_batches(deliveries) if tail_only else deliveries
    keys = ["item", "warehouse", "vendor"]
    known = rows.where(_all_known(keys)).select(*keys, "invoice_date", "prepare_days").repartition(*keys)
    spread = described(known, keys, "invoice_date", "prepare_days", {"p60": 0.6, "p90": 0.9}, alpha)
    return spread.select(
        *keys,
        F.col("mean").alias("mean_prep"),
        F.col("std").alias("std_prep"),
        F.col("typical").alias("mode_prep"),
        F.col("p60").alias("p60_prep"),
        F.col("p90").alias("p90_prep"),
        "samples",
        F.col("recent").alias("smoothed_prep"),
    )


def preference_counts(deliveries: DataFrame) -> DataFrame:
    """Rows by item, warehouse, vendor, mode and days, and the last delivery among them."""
    return (
        deliveries.where(F.col("transport_days").isNotNull() & F.col("mode").isNotNull())
        .groupBy("item", "warehouse", "vendor", "mode", "transport_days")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("delivery_date").alias("_last"))
    )


def transport_preference(deliveries: DataFrame, stats: DataFrame | None = None, tolerance: float = 0) -> DataFrame:
    """How often each item came by each (corrected) mode, ranked per item, warehouse and vendor.

    Rows are counted by mode and days before the correction, which depends on nothing else; the counts are
    materialised.
    """
    return ranked_preference(materialised(preference_counts(deliveries)), stats, tolerance)


def ranked_preference(counted: DataFrame, stats: DataFrame | None = None, tolerance: float = 0) -> DataFrame:
    """A9 from ``preference_counts``."""
    keys = ["item", "warehouse", "vendor"]
    ranges = lead_time_ranges(stats, fallback_means(counted, F.col("_n")))
    corrected = correct_modes(counted.repartition("vendor", "warehouse"), ranges, tolerance, courier_to_air=True)
    mode = F.when(F.col("mode") == "Courier", "Air").otherwise(F.col("mode"))
    ranking = Window.partitionBy(*keys).orderBy(F.col("count").desc(), "mode")
    whole = ranking.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        corrected.groupBy(*keys, mode.alias("mode"))
        .agg(F.sum("_n").alias("count"), F.max("_last").alias("last_used"))
        .withColumns(
            {
                "confidence": F.col("count") / F.sum("count").over(whole),
                "rank": F.row_number().over(ranking),
            }
        )
        .select(*keys, "mode", "rank", "count", "confidence", "last_used")
    )


def smart_lead_times(
    preference: DataFrame, prepare: DataFrame, transport: DataFrame, vendors: DataFrame
) -> DataFrame:
    """A10: preparation plus transport for every preferred route, with the quality of its source.

    A missing transport figure is filled from the vendor's static days; a route without any is
    dropped. The smoothed transport figure is not filled.
    """
    prep = prepare.withColumnRenamed("samples", "_prep_samples")
    trans = transport.drop("cost_per_kg", "base_charge").withColumnRenamed("samples", "_transport_samples")
    static = vendors.select("vendor", "mode", F.col("static_days").cast("double").alias("_static"))
    joined = (
        preference.repartition("vendor", "warehouse").join(prep, ["item", "warehouse", "vendor"], "left")
        .join(trans, ["vendor", "warehouse", "mode"], "left")
        .join(static, ["vendor", "mode"], "left")
    )
    has_prep = F.col("p60_prep").isNotNull()
    level = (
        F.when(has_prep & F.col("p60_days").isNotNull(), 0)
        .when(has_prep & F.col("_static").isNotNull(), 1)
        .when(has_prep, 2)
        .otherwise(3)
    )
    # Names of the source levels.
    names = F.array(*[F.lit(n) for n in ("SMART", "SEMI_SMART_STATIC", "MISSING_TRANSPORT", "FALLBACK_WLEAD")])

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.col("_static"))

    def total(prep_name: str, transport_days: Column) -> Column:
        return F.coalesce(F.col(prep_name), F.lit(0.0)) + F.coalesce(transport_days, F.lit(0.0))

    spread = F.sqrt(F.coalesce(F.col("std_prep"), F.lit(0.0)) * F.coalesce(F.col("std_days"), F.lit(0.0)))
    return (
        joined.withColumns({"fallback_level": level, "p60_transport": filled("p60_days")})
        .where(F.col("p60_transport").isNotNull())
        .select(
            "item", "warehouse", "vendor", "mode",
            total("mean_prep", filled("mean_days")).alias("mean_lead"),
            total("mode_prep", filled("mode_days")).alias("mode_lead"),
            total("p60_prep", F.col("p60_transport")).alias("p60_lead"),
            total("p90_prep", filled("p90_days")).alias("p90_lead"),
            total("smoothed_prep", F.col("smoothed_days")).alias("smoothed_lead"),
            spread.alias("lead_std"),
            "p60_prep", "p60_transport",
            F.least("_prep_samples", "_transport_samples").alias("samples"),
            names[F.col("fallback_level")].alias("source"),
            "fallback_level",
            F.when(F.upper("mode") == "AIR", "Y").alias("air_flag"),
        )
    )
