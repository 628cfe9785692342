"""Replenishment orders and the planning chain (M1-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.demand import weekly
from checks.forecasts import planned
from checks.registry import STEPS, query
from checks.views import AS_OF
from stowage.operators import demand, mrp, safety
from stowage.params import KEYS, OrderParams
from stowage.plans.planning import plan_orders

DOUBLES = "forecast_in_lead net_requirement available in_transit dynamic_safety final_safety service_level manual_safety"
# A learned lead time for the keys that hold a safety stock.
STEPS["o_learned_leads"] = """
SELECT item, warehouse, CAST(lead_days + LENGTH(item) AS DOUBLE) AS p60_lead, CASE WHEN warehouse = '5' THEN 'Air' ELSE 'Vessel' END AS mode
FROM item_warehouse WHERE safety > 0"""


def order_sql(prefix: str, base: str, weeks: str, days: str, mode: str, algorithm: str, lots: str = "qty", zero: bool = False) -> str:
    """Orders from keys with safety stock, step by step."""
    STEPS[f"{prefix}_need"] = f"""
SELECT b.item, b.warehouse, b.moq, b.lot, {days} AS lead_days, {mode} AS mode, b.activity_level, b.demand_type, b.dynamic_safety, b.final_safety, b.service_level,
  b.available, b.in_transit, f.total AS forecast_in_lead, f.total + b.final_safety - b.available - b.in_transit AS net_requirement
FROM {base} b JOIN (SELECT b.item, b.warehouse, SUM(f.forecast) AS total FROM {base} b JOIN o_forecast f
  ON f.item = b.item AND f.warehouse = b.warehouse AND f.k <= {weeks} GROUP BY b.item, b.warehouse) f
  ON f.item = b.item AND f.warehouse = b.warehouse"""
    STEPS[f"{prefix}_sized"] = f"""
SELECT n.*, CAST(round_even(CASE WHEN net_requirement > 0 THEN {lots} ELSE 0 END, 0) AS BIGINT) AS recommended_qty
FROM (SELECT *, greatest(net_requirement, moq, 1) AS qty FROM {prefix}_need) n"""
    kept = "" if zero else "WHERE recommended_qty > 0"
    return f"""
SELECT z.item, z.warehouse, CAST(z.moq AS INTEGER) AS moq, mode, CAST(z.lead_days AS INTEGER) AS lead_days, available, in_transit, demand_type, activity_level,
  forecast_in_lead, dynamic_safety, final_safety, net_requirement, recommended_qty,
  CASE WHEN recommended_qty > 0 AND available < in_transit THEN 'Replenish & On-Demand'
    WHEN activity_level IN ('Dormant', 'Inactive') AND net_requirement > 0 AND forecast_in_lead < 1e-5 THEN 'SafetyStockTopUp'
    WHEN activity_level IN ('Dormant', 'Inactive') AND available + in_transit < 0 THEN 'On-Demand'
    WHEN recommended_qty > 0 THEN 'Replenish' END AS order_reason, '{algorithm}' AS algorithm, service_level, COALESCE(CAST(w.safety AS DOUBLE), 0) AS manual_safety,
  CAST(NULL AS VARCHAR) AS plc, CAST(NULL AS VARCHAR) AS item_desc, m.vendor, CAST(NULL AS VARCHAR) AS vendor_name, DATE '2001-08-01' AS calc_date
FROM {prefix}_sized z LEFT JOIN item_warehouse w ON w.item = z.item AND w.warehouse = z.warehouse LEFT JOIN item_master m ON m.item = z.item {kept}"""


STEPS["o_stocked"] = """
SELECT s.*, l.moq, l.lot, l.lead_days, COALESCE(k.available, 0) AS available, COALESCE(k.in_transit, 0) AS in_transit FROM o_static_safety s
JOIN o_levels l ON l.item = s.item AND l.warehouse = s.warehouse LEFT JOIN o_stock k ON k.item = s.item AND k.warehouse = s.warehouse"""
STEPS["o_stocked_learned"] = """
SELECT s.*, CAST(floor(d.p60_lead) AS INTEGER) AS smart_days, d.mode AS smart_mode FROM o_stocked s
JOIN o_learned_leads d ON d.item = s.item AND d.warehouse = s.warehouse"""
STATIC_WEEKS = "greatest(1, CAST(round_even(b.lead_days / 7.0, 0) AS INTEGER))"
SMART_WEEKS = "greatest(1, b.smart_days // 7)"
STEPS["o_static_orders"] = order_sql("o_s", "o_stocked", STATIC_WEEKS, "b.lead_days", "'Default'", "Static")
STEPS["o_dynamic_orders"] = order_sql("o_d", "o_stocked_learned", SMART_WEEKS, "b.smart_days", "b.smart_mode", "Dynamic")


def stocked(t):
    universe = demand.item_universe(weekly(t), t.item_warehouse)
    stock = demand.merge_parent_stock(t.stock, t.replacement, universe)
    return safety.safety_stock(planned(t)).join(stock, list(KEYS), "left")


def learned(t):
    mode = F.when(F.col("warehouse") == "5", "Air").otherwise("Vessel")
    return t.item_warehouse.where(F.col("safety") > 0).select(
        *KEYS, (F.col("lead_days") + F.length("item")).cast("double").alias("p60_lead"), mode.alias("mode")
    )


def shown(orders):
    """Every column of an order."""
    return orders.select(*mrp.OUTPUT)


@query(
    "forecast_within_lead_time",
    "SELECT item, warehouse, forecast_in_lead, net_requirement FROM o_s_need",
    "forecast_in_lead net_requirement",
)
def _(t):
    return mrp.static_orders(stocked(t), OrderParams(include_zero=True)).select(
        "item", "warehouse", "forecast_in_lead", "net_requirement"
    )


@query("static_orders", "SELECT * FROM o_static_orders", DOUBLES)
def _(t):
    return shown(mrp.static_orders(stocked(t), as_of=AS_OF))


@query("dynamic_orders", "SELECT * FROM o_dynamic_orders", DOUBLES)
def _(t):
    return shown(mrp.dynamic_orders(stocked(t), learned(t), as_of=AS_OF))


@query(
    "orders_in_nearest_lots",
    order_sql("o_nl", "o_stocked", STATIC_WEEKS, "b.lead_days", "'Default'", "Static", "round_even(qty / lot, 0) * lot", zero=True),
    DOUBLES,
)
def _(t):
    return shown(mrp.static_orders(stocked(t), OrderParams(use_lots=True, include_zero=True), AS_OF))


@query(
    "orders_in_full_lots",
    order_sql("o_fl", "o_stocked", STATIC_WEEKS, "b.lead_days", "'Default'", "Static", "ceil(qty / lot) * lot"),
    DOUBLES,
)
def _(t):
    return shown(mrp.static_orders(stocked(t), OrderParams(use_lots=True, round_up_lots=True), AS_OF))


@query(
    "static_and_dynamic_orders",
    "SELECT * FROM o_static_orders UNION ALL SELECT * FROM o_dynamic_orders",
    DOUBLES,
)
def _(t):
    return shown(mrp.all_orders(stocked(t), learned(t), as_of=AS_OF))


def planning_run(t):
    return plan_orders(weekly(t), t.item_master, t.item_warehouse, t.replacement, t.stock, AS_OF, learned(t))


# The whole chain on merged demand. Its comparison re-reads the same steps over the merged series.
@query("planning_run")
def _(t):
    return shown(planning_run(t))


# Stored results read back for the keys that hold a safety stock.
STEPS["o_holding"] = "SELECT item, warehouse FROM item_warehouse WHERE safety > 0"


@query(
    "stored_forecasts",
    """
SELECT f.item, f.warehouse, f.model, CAST(COUNT(*) AS INTEGER) AS weeks, SUM(round_even(f.forecast * 100, 0) / 100) AS total,
  CASE WHEN f.warehouse = '5' THEN SUM(CASE WHEN f.k <= 4 THEN round_even(f.forecast * 100, 0) / 100 END) ELSE round_even(SUM(CASE WHEN f.k <= 4 THEN f.forecast END) * 100, 0) / 100 END AS forecast_monthly
FROM o_forecast f JOIN o_holding h ON h.item = f.item AND h.warehouse = f.warehouse GROUP BY f.item, f.warehouse, f.model""",
    "total forecast_monthly",
)
def _(t):
    stored = planned(t).select(
        *KEYS, "forecast_json", F.when(F.col("warehouse") != "5", F.col("forecast_monthly")).alias("forecast_monthly"), "model"
    )
    read = demand.stored_forecasts(stored, demand.universe_from_safety(t.item_warehouse))
    total = F.aggregate("forecast", F.lit(0.0), lambda a, x: a + x)
    return read.select(*KEYS, "model", F.size("forecast").alias("weeks"), total.alias("total"), "forecast_monthly")


@query(
    "stored_demand_types",
    """
SELECT t.item, t.warehouse, t.demand_type, t.activity_level, t.weeks_with_demand, t.zero_ratio, t.cv, t.trend_slope, t.seasonal_strength
FROM o_types t JOIN o_holding h ON h.item = t.item AND h.warehouse = t.warehouse""",
    "zero_ratio cv trend_slope seasonal_strength",
)
def _(t):
    return demand.stored_demand_types(planned(t), demand.universe_from_safety(t.item_warehouse))


@query(
    "stored_safety",
    """
SELECT s.item, s.warehouse, s.service_level, s.dynamic_safety, s.final_safety FROM o_static_safety s JOIN o_holding h ON h.item = s.item AND h.warehouse = s.warehouse""",
    "service_level dynamic_safety final_safety",
)
def _(t):
    return demand.stored_safety(safety.safety_stock(planned(t)), demand.universe_from_safety(t.item_warehouse))
