"""Supply routes of every item and warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.numeric import whole
from stowage.functions.running import stacked
from stowage.params import KEYS

# Stand-ins for a route without statistics.
UNKNOWN_COST = 99999.0
UNKNOWN_LEAD = 999
ROUTE = ("item", "warehouse", "vendor", "mode")


def candidate_routes(
    universe: DataFrame,
    preference: DataFrame,
    stats: DataFrame,
    vendors: DataFrame,
    items: DataFrame,
    min_confidence: float = 0.1,
    lead: str = "p60_days",
    vendor_paths: bool = True,
) -> DataFrame:
    """Routes in use, every other mode of those vendors, and every mode of the default vendor.

    Only routes that are active in the vendor master stay. Lead time and cost come from statistics,
    else from the static days and a prohibitive cost.
    """
    keys = universe.select(*KEYS).distinct()
    used = (
        preference.where(F.col("confidence") >= min_confidence)
        .join(keys, list(KEYS), "left_semi")
        .select(*ROUTE)
    )
    active = vendors.where(F.col("is_active") == "Y").select("vendor", "mode", "static_days")
    if vendor_paths:
        defaults = keys.join(items.select("item", "vendor"), "item").where(F.col("vendor").isNotNull())
        partners = stacked(used.select(*KEYS, "vendor"), defaults.select(*KEYS, "vendor")).distinct()
        # A route in use, or of a measured mode, that is active is one of the active modes of a partner: these are all there are, and no two are equal.
        routes = partners.join(active, "vendor")
    else:
        routes = used.distinct().join(active, ["vendor", "mode"])
    figures = stats.select("vendor", "warehouse", "mode", F.col(lead).alias("_days"), "cost_per_kg")
    known = F.col("_days").isNotNull()
    return (
        routes.join(figures, ["vendor", "warehouse", "mode"], "left")
        .select(
            *ROUTE,
            known.alias("from_stats"),
            F.when(known, whole(F.col("_days")))
            .otherwise(F.coalesce(F.col("static_days").cast("int"), F.lit(UNKNOWN_LEAD)))
            .alias("lead_time"),
            F.when(known, F.coalesce(F.col("cost_per_kg"), F.lit(0.0))).otherwise(UNKNOWN_COST).alias("cost_per_kg"),
        )
    )


def with_prepare_time(
    routes: DataFrame, prepare: DataFrame, item_warehouse: DataFrame, metric: str = "p60_prep"
) -> DataFrame:
    """R2: preparation days of a route: the vendor's largest figure for the item, else the master lead time."""
    measured = prepare.groupBy("item", "vendor").agg(F.max(metric).alias("_prep"))
    master = item_warehouse.select(*KEYS, F.col("lead_days").alias("_master")).distinct()
    fallback = F.greatest(F.col("_master"), F.lit(0)).cast("double")
    days = whole(F.coalesce(F.col("_prep"), F.when(F.col("_master").isNotNull(), fallback), F.lit(0.0)))
    return (
        routes.join(measured, ["item", "vendor"], "left")
        .join(master, list(KEYS), "left")
        .withColumns({"prepare_from_stats": F.col("_prep").isNotNull(), "prepare_time": days})
        .withColumn("total_lead_time", F.col("prepare_time") + F.col("lead_time"))
        .select(*routes.columns, "prepare_time", "prepare_from_stats", "total_lead_time")
    )


# Selection criteria and their sort order.
CRITERIA = {
    "cost": ("cost_per_kg", "total_lead_time", "vendor", "mode"),
    "lead": ("total_lead_time", "cost_per_kg", "vendor", "mode"),
}


def rank_routes(enriched: DataFrame, criterion: str = "cost") -> DataFrame:
    """Routes ranked per key by lowest cost or shortest lead time."""
    order = CRITERIA[criterion]
    return enriched.withColumn("choice", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order)))
