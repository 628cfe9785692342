"""Replenishment orders (M1-M6), on keys that carry forecast, safety stock, stock and master data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import is_true, whole
from stowage.operators import classify as kinds
from stowage.params import KEYS, OrderParams

# Order reasons.
ON_DEMAND = "On-Demand"
TOP_UP = "SafetyStockTopUp"
REPLENISH = "Replenish"
REPLENISH_AND_ON_DEMAND = "Replenish & On-Demand"

STATIC = "Static"
DYNAMIC = "Dynamic"

OUTPUT = (
    "warehouse", "item", "moq", "mode", "lead_days", "manual_safety", "plc", "item_desc", "vendor", "vendor_name",
    "available", "in_transit", "demand_type", "activity_level", "service_level", "forecast_in_lead",
    "dynamic_safety", "final_safety", "net_requirement", "recommended_qty", "order_reason", "algorithm", "calc_date",
)


def static_weeks(lead_days: Column) -> Column:
    """M1: whole weeks of the master lead time, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.rint(F.coalesce(lead_days, F.lit(0)) / 7).cast("int"))


def smart_weeks(smart_days: Column) -> Column:
    """M6: full weeks of the learned lead time, at least one."""
    return F.greatest(F.lit(1), F.floor(smart_days.cast("int") / 7).cast("int"))


def forecast_within(weeks: Column, series: str = "forecast") -> Column:
    """M1: demand over the lead time; beyond the horizon the last value repeats."""
    inside = F.aggregate(F.slice(series, F.lit(1), weeks), F.lit(0.0), lambda a, x: a + x)
    beyond = F.greatest(F.lit(0), weeks - F.size(series))
    return inside + beyond * F.element_at(series, -1)


def order_quantity(p: OrderParams) -> Column:
    """M2, M3: the net requirement raised to the minimum order and fitted to lots."""
    qty = F.greatest(F.lit(0.0), F.col("net_requirement"))
    needed = qty > 0
    if p.use_moq:
        least = F.greatest(F.col("moq"), F.lit(p.min_moq)).cast("double")
        qty = F.when(needed, F.greatest(qty, least)).otherwise(qty)
    if p.use_lots:
        lot = F.when(F.col("lot") != 0, F.col("lot")).otherwise(1)
        lots = F.ceil(qty / lot) if p.round_up_lots else F.rint(qty / lot)
        qty = F.when(needed, lots * lot).otherwise(qty)
    return F.rint(qty).cast("long")


def order_reason() -> Column:
    """M4: the strongest reason that applies."""
    idle = F.col("activity_level").isin(kinds.DORMANT, kinds.INACTIVE)
    ordered = F.col("recommended_qty") > 0
    short = idle & (F.col("available") + F.col("in_transit") < 0)
    top_up = idle & (F.col("net_requirement") > 0) & (F.col("forecast_in_lead") < 1e-5)
    return (
        F.when(is_true(ordered & (F.col("available") < F.col("in_transit"))), REPLENISH_AND_ON_DEMAND)
        .when(is_true(top_up), TOP_UP)
        .when(is_true(short), ON_DEMAND)
        .when(is_true(ordered), REPLENISH)
    )


def _orders(planned: DataFrame, algorithm: Column, weeks: Column, days: Column, mode: Column, p: OrderParams, as_of: dt.date | None) -> DataFrame:
    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in planned.columns else F.lit(None).cast(kind)

    def or_one(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name)).otherwise(1)

    sized = (
        planned.withColumn("lead_weeks", weeks)
        .withColumns(
            {
                "algorithm": algorithm,
                "mode": mode,
                "forecast_in_lead": forecast_within(F.col("lead_weeks")),
                "lead_days": F.coalesce(days, F.lit(0)),
                "manual_safety": F.coalesce(F.col("safety").cast("double"), F.lit(0.0)),
                "moq": or_one("moq"),
                "lot": or_one("lot"),
                "available": F.coalesce(F.col("available"), F.lit(0.0)),
                "in_transit": F.coalesce(F.col("in_transit"), F.lit(0.0)),
                "plc": column("plc", "string"),
                "item_desc": column("item_desc", "string"),
                "vendor_name": column("vendor_name", "string"),
            }
        )
        .withColumn(
            "net_requirement",
            F.col("forecast_in_lead") + F.col("final_safety") - F.col("available") - F.col("in_transit"),
        )
        .withColumn("recommended_qty", order_quantity(p))
        .withColumns({"order_reason": order_reason(), "calc_date": F.lit(as_of).cast("date")})
    )
    # M5
    kept = sized if p.include_zero else sized.where(F.col("recommended_qty") > 0)
    return kept.select(*OUTPUT)


def static_orders(planned: DataFrame, params: OrderParams = OrderParams(), as_of: dt.date | None = None) -> DataFrame:
    """M1-M5: orders under the master lead time."""
    days = F.col("lead_days")
    return _orders(planned, F.lit(STATIC), static_weeks(days), days, F.lit("Default"), params, as_of)


def dynamic_orders(planned: DataFrame, lead_times: DataFrame, params: OrderParams = OrderParams(), as_of: dt.date | None = None) -> DataFrame:
    """M6: orders under the learned lead time, for keys that have one."""
    learned = _learned(lead_times)
    days = F.col("smart_days")
    return _orders(planned.join(learned, list(KEYS)), F.lit(DYNAMIC), smart_weeks(days), days, F.col("smart_mode"), params, as_of)


def all_orders(
    planned: DataFrame, lead_times: DataFrame, params: OrderParams = OrderParams(), as_of: dt.date | None = None
) -> DataFrame:
    """Static and dynamic orders in one pass over the planned keys."""
    joined = planned.join(_learned(lead_times), list(KEYS), "left")
    runs = F.when(F.col("smart_days").isNotNull(), F.array(F.lit(STATIC), F.lit(DYNAMIC))).otherwise(
        F.array(F.lit(STATIC))
    )
    doubled = joined.select("*", F.explode(runs).alias("_run"))
    dynamic = F.col("_run") == DYNAMIC
    days = F.col("lead_days")
    return _orders(
        doubled,
        F.col("_run"),
        F.when(dynamic, smart_weeks(F.col("smart_days"))).otherwise(static_weeks(days)),
        F.when(dynamic, F.col("smart_days")).otherwise(days),
        F.when(dynamic, F.col("smart_mode")).otherwise("Default"),
        params,
        as_of,
    )


def _learned(lead_times: DataFrame) -> DataFrame:
    return lead_times.where(F.col("p60_lead") != 0).select(
        *KEYS, whole(F.col("p60_lead")).alias("smart_days"), F.col("mode").alias("smart_mode")
    )
