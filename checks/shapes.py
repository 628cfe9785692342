"""The planning chain over series of every shape: classes, models, sizes and reasons that the order lines hardly reach."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from checks.forecasts import long_form
from checks.registry import STEPS, query
from checks.replenish import DOUBLES, STATIC_WEEKS, order_sql
from checks.reports import CHAIN, restated
from checks.sources import new_table
from checks.views import AS_OF
from stowage.operators import classify, demand, forecast, mrp, safety
from stowage.params import KEYS, OrderParams
from stowage.plans import results
from stowage.session import materialised

# Workers need neither package installed: functions go to them by value.
for _name in ("checks", "stowage"):
    cloudpickle.register_pickle_by_value(sys.modules[_name])

restated(
    "h_",
    {
        "o_filled": STEPS["o_filled"].replace("o_weekly", "shaped_weekly"),
        "o_levels": STEPS["o_levels"].replace("item_master m", "shaped_items m").replace("item_warehouse w", "shaped_places w"),
    },
    CHAIN,
)
STEPS["h_stocked"] = """
SELECT s.*, l.moq, l.lot, l.lead_days, k.available, k.in_transit FROM h_o_static_safety s
JOIN h_o_levels l ON l.item = s.item AND l.warehouse = s.warehouse JOIN shaped_stock k ON k.item = s.item AND k.warehouse = s.warehouse"""
ORDERS = order_sql("h_s", "h_stocked", STATIC_WEEKS, "b.lead_days", "'Default'", "Static", zero=True)
STEPS["h_s_need"] = STEPS["h_s_need"].replace("JOIN o_forecast f", "JOIN h_o_forecast f")
ORDERS = ORDERS.replace("item_warehouse w", "shaped_places w").replace("item_master m", "shaped_items m")


def metrics(t):
    """Over runs of equal weeks, without filled ones."""
    return classify.run_metrics(classify.run_lengths(t.shaped_weekly, AS_OF))


def planned(t):
    master = demand.master_data(demand.universe_from_demand(t.shaped_weekly), t.shaped_items, t.shaped_places)
    return forecast.forecast(classify.classify_items(master, metrics(t)))


@query(
    "run_length_metrics",
    """SELECT item, warehouse, weeks, weeks_with_demand, zero_ratio, weighted_mean, weighted_std, cv, recent_demand, recent_hits,
  tail_max, tail_mean, trend_slope, seasonal_strength FROM h_o_metrics""",
    "zero_ratio weighted_mean weighted_std cv recent_demand tail_max tail_mean trend_slope seasonal_strength",
)
def _(t):
    return metrics(t).select(
        "item", "warehouse", "weeks", "weeks_with_demand", "zero_ratio", "weighted_mean", "weighted_std", "cv",
        "recent_demand", "recent_hits", "tail_max", "tail_mean", "trend_slope", "seasonal_strength",
    )


@query("shaped_types", "SELECT item, warehouse, demand_type, activity_level FROM h_o_types")
def _(t):
    return classify.classify(metrics(t)).select("item", "warehouse", "demand_type", "activity_level")


@query("shaped_forecasts", "SELECT item, warehouse, CAST(k AS INTEGER) AS k, model, forecast FROM h_o_forecast", "forecast")
def _(t):
    packed = forecast.forecast(classify.classify(metrics(t)))
    return long_form(packed).join(packed.select("item", "warehouse", "model"), ["item", "warehouse"])


def last_season(rows, p):
    """A model of the user's own: the last four weeks again and again."""
    weeks = rows.column("demand").to_pylist()[-4:]
    return [weeks[k % len(weeks)] for k in range(p.horizon_weeks)]


@query(
    "user_forecasts",
    """
SELECT f.item, f.warehouse, CAST(f.k AS INTEGER) AS k, f.model,
  CASE WHEN f.model = 'Seasonal Demand' THEN p.demand WHEN f.model = 'Steady Demand' THEN m.plain * 2 ELSE f.forecast END AS forecast
FROM h_o_forecast f JOIN h_o_models m ON m.item = f.item AND m.warehouse = f.warehouse AND m.k = f.k
JOIN h_o_basics b ON b.item = f.item AND b.warehouse = f.warehouse
LEFT JOIN h_o_prepared p ON p.item = f.item AND p.warehouse = f.warehouse AND p.pos = b.weeks - 3 + (f.k - 1) % 4""",
    "forecast",
)
def _(t):
    """C9 with two models of the user: a column for steady keys, a function over the weeks of seasonal ones."""
    models = {
        classify.STEADY: lambda p: forecast.flat(F.col("weighted_mean") * 2, p.horizon_weeks),
        classify.SEASONAL: forecast.GroupedModel(last_season),
    }
    weeks = classify.prepare_series(demand.fill_weeks(t.shaped_weekly, AS_OF))
    packed = forecast.forecast(classify.classify(metrics(t)), models=models, series=weeks)
    return packed.select("item", "warehouse", "model", F.posexplode("forecast").alias("k", "forecast")).withColumn("k", F.col("k") + 1)


@query("shaped_safety", "SELECT * FROM h_o_static_safety", "service_level dynamic_safety final_safety")
def _(t):
    return safety.safety_stock(planned(t)).select(
        "item", "warehouse", "demand_type", "activity_level", "lead_weeks", "service_level", "dynamic_safety", "final_safety"
    )


@query("shaped_orders", ORDERS, DOUBLES)
def _(t):
    stocked = safety.safety_stock(planned(t)).join(t.shaped_stock, list(KEYS), "left")
    return mrp.static_orders(stocked, OrderParams(include_zero=True), AS_OF).select(*mrp.OUTPUT)


@query(
    "written_plan",
    """
SELECT t.item, t.warehouse, 'weeks_with_demand' AS field_name, CAST(t.weeks_with_demand + 1 AS VARCHAR) AS old_value, CAST(t.weeks_with_demand AS VARCHAR) AS new_value,
  DATE '2001-08-01' AS change_date, 'Classify Update' AS change_reason, f.model, s.final_safety, o.reasons
FROM h_o_types t JOIN shaped_parts p ON p.item = t.item AND p.warehouse = t.warehouse AND p.size % 3 = 0
JOIN (SELECT DISTINCT item, warehouse, model FROM h_o_forecast) f ON f.item = t.item AND f.warehouse = t.warehouse
JOIN h_o_static_safety s ON s.item = t.item AND s.warehouse = t.warehouse
LEFT JOIN (SELECT item, warehouse, MAX(order_reason) AS reasons FROM ({ORDERS}) x WHERE order_reason IS NOT NULL GROUP BY item, warehouse) o ON o.item = t.item AND o.warehouse = t.warehouse""".replace("{ORDERS}", ORDERS),
    "final_safety",
)
def _(t):
    """A run with other counts for some parts, the run itself, and the same again, which changes nothing; the log and the stored results."""
    stocked = materialised(safety.safety_stock(planned(t)).join(t.shaped_stock, list(KEYS), "left"))
    orders = mrp.static_orders(stocked, OrderParams(include_zero=True), AS_OF).where("order_reason IS NOT NULL")
    made = {}
    table_of = lambda name: made.setdefault(name, new_table(t, name))
    odd = t.shaped_parts.where("size % 3 = 0").select(*KEYS, F.lit(1).cast("long").alias("_more"))
    other = stocked.join(odd, list(KEYS), "left").withColumn("weeks_with_demand", F.col("weeks_with_demand") + F.coalesce("_more", F.lit(0)))
    for run in (other, stocked, stocked):
        results.write_plan(run, orders, table_of, AS_OF)
    stored = lambda name, *columns: made[name].read().select(*KEYS, *columns)
    return (
        made[f"{results.TYPES}_log"].read().join(stored(results.FORECASTS, "model"), list(KEYS)).join(stored(results.SAFETY, "final_safety"), list(KEYS))
        .join(stored(results.ORDERS, F.col("order_reason").alias("reasons")), list(KEYS), "left")
    )
