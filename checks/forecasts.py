"""Forecast models, dispatch and safety stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.classes import metrics
from checks.registry import STEPS, query
from stowage.functions.numeric import inverse_normal
from stowage.operators import classify, demand, forecast, safety

WEEKS = "(SELECT UNNEST(range(1, 13)) AS k) w"


def polynomial(x: str, coefficients: str) -> str:
    return " + ".join(f"{c} * pow({x}, {i})" for i, c in enumerate(coefficients.split()))


# The published coefficients of algorithm AS 241, as powers rather than nested products.
A = "3.3871328727963666080e0 133.14166789178437745e0 1971.5909503065514427e0 13731.693765509461125e0 45921.953931549871457e0 67265.770927008700853e0 33430.575583588128105e0 2509.0809287301226727e0"
B = "1e0 42.313330701600911252e0 687.18700749205790830e0 5394.1960214247511077e0 21213.794301586595867e0 39307.895800092710610e0 28729.085735721942674e0 5226.4952788528545610e0"
C = "1.42343711074968357734e0 4.63033784615654529590e0 5.76949722146069140550e0 3.64784832476320460504e0 1.27045825245236838258e0 0.241780725177450611770e0 0.0227238449892691845833e0 7.74545014278341407640e-4"
D = "1e0 2.05319162663775882187e0 1.67638483018380384940e0 0.689767334985100004550e0 0.148103976427480074590e0 0.0151986665636164571966e0 5.47593808499534494600e-4 1.05075007164441684324e-9"


def z_sql(p: str) -> str:
    q = f"({p} - 0.5)"
    near = f"(0.180625 - {q} * {q})"
    far = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * ({polynomial(near, A)}) / ({polynomial(near, B)}) "
        f"ELSE sign({q}) * ({polynomial(far, C)}) / ({polynomial(far, D)}) END"
    )


# Steady level: the smallest value at which six tenths of the weight are reached.
STEPS["o_value_weights"] = """
SELECT item, warehouse, demand, SUM(weight) AS weight FROM o_prepared GROUP BY item, warehouse, demand"""
STEPS["o_steady"] = """
SELECT item, warehouse, MIN(demand) AS steady_level FROM (
  SELECT item, warehouse, demand, SUM(weight) OVER (PARTITION BY item, warehouse ORDER BY demand) / SUM(weight) OVER (PARTITION BY item, warehouse) AS share
  FROM o_value_weights) s WHERE share >= 0.6 GROUP BY item, warehouse"""
STEPS["o_week_profile"] = """
SELECT item, warehouse, week(week_start) AS wk, AVG(demand) AS level FROM o_prepared GROUP BY item, warehouse, 3"""
STEPS["o_week_centre"] = "SELECT item, warehouse, AVG(level) AS centre FROM o_week_profile GROUP BY item, warehouse"
# Croston by recursion over the weeks with demand.
STEPS["o_hits"] = """
SELECT item, warehouse, demand, pos, ROW_NUMBER() OVER (PARTITION BY item, warehouse ORDER BY pos) AS hit,
  pos - COALESCE(LAG(pos) OVER (PARTITION BY item, warehouse ORDER BY pos), 0) AS gap FROM o_prepared WHERE demand > 0"""
STEPS["o_croston"] = """
SELECT item, warehouse, list_reduce(list(CAST(demand AS DOUBLE) ORDER BY pos), lambda s, x: 0.1 * x + 0.9 * s) AS size,
  list_reduce(list(CAST(gap AS DOUBLE) ORDER BY pos), lambda s, x: 0.1 * x + 0.9 * s) AS gap FROM o_hits GROUP BY item, warehouse"""
STEPS["o_models"] = f"""
SELECT t.item, t.warehouse, w.k, t.demand_type, t.activity_level,
  s.steady_level AS steady,
  CASE WHEN week(t.last_week + CAST(7 * w.k AS INTEGER)) <= 52 THEN COALESCE(p.level / CASE WHEN c.centre <> 0 THEN c.centre ELSE 1.0 END, 1.0) ELSE 1.0 END * t.seasonal_base AS seasonal,
  t.line_start + t.line_slope * (t.weeks - 1 + w.k) AS trended,
  COALESCE(x.size / x.gap * 0.95, 0.0) AS intermittent, t.burst_level AS burst, t.weighted_mean AS plain
FROM o_types t CROSS JOIN {WEEKS}
JOIN o_steady s ON s.item = t.item AND s.warehouse = t.warehouse
JOIN o_week_centre c ON c.item = t.item AND c.warehouse = t.warehouse
LEFT JOIN o_week_profile p ON p.item = t.item AND p.warehouse = t.warehouse AND p.wk = week(t.last_week + CAST(7 * w.k AS INTEGER))
LEFT JOIN o_croston x ON x.item = t.item AND x.warehouse = t.warehouse"""
STEPS["o_forecast"] = """
SELECT item, warehouse, k, demand_type, activity_level,
  CASE WHEN demand_type IN ('Single Demand', 'New Item') OR activity_level IN ('Dormant', 'Inactive') THEN 0.0
    WHEN demand_type = 'Steady Demand' THEN steady WHEN demand_type = 'Seasonal Demand' THEN seasonal
    WHEN demand_type = 'Trended Demand' THEN trended WHEN demand_type = 'Intermittent Demand' THEN intermittent
    WHEN demand_type = 'Burst Demand' THEN burst ELSE plain END AS forecast,
  CASE WHEN demand_type IN ('Single Demand', 'New Item') OR activity_level IN ('Dormant', 'Inactive') THEN 'cold_start' ELSE demand_type END AS model
FROM o_models"""


def model_query(name: str, method: str, column: str) -> None:
    @query(name, f"SELECT item, warehouse, CAST(k AS INTEGER) AS k, {column} AS forecast FROM o_models", "forecast")
    def _(t):
        return long_form(forecast.forecast_with(metrics(t), method))


def long_form(df):
    return df.select("item", "warehouse", F.posexplode("forecast").alias("k", "forecast")).withColumn("k", F.col("k") + 1)


for _name, _method, _column in (
    ("steady_forecast", "STEADY", "steady"),
    ("seasonal_forecast", "Seasonal Demand", "seasonal"),
    ("trended_forecast", "trended", "trended"),
    ("croston_forecast", "INTERMITTENT", "intermittent"),
    ("burst_forecast", "Burst Demand", "burst"),
    ("default_forecast", "weighted mean", "plain"),
):
    model_query(_name, _method, _column)


@query(
    "dispatched_forecast",
    "SELECT item, warehouse, CAST(k AS INTEGER) AS k, model, forecast FROM o_forecast",
    "forecast",
)
def _(t):
    packed = forecast.forecast(classify.classify(metrics(t)))
    return packed.select("item", "warehouse", "model", F.posexplode("forecast").alias("k", "forecast")).withColumn(
        "k", F.col("k") + 1
    )


# Trended sums may lie near a half cent on either side; one more digit keeps both engines together.
@query(
    "forecast_packing",
    """
SELECT item, warehouse, round_even(SUM(CASE WHEN k <= 4 THEN forecast END) * 100, 0) / 100 AS forecast_monthly,
  SUM(round_even(forecast * 100, 0) / 100) AS stored_total, CAST(12 AS INTEGER) AS stored_weeks FROM o_forecast GROUP BY item, warehouse""",
    "forecast_monthly stored_total",
)
def _(t):
    packed = forecast.forecast(classify.classify(metrics(t)))
    stored = F.from_json("forecast_json", "array<double>")
    return packed.select(
        "item", "warehouse", "forecast_monthly",
        F.aggregate(stored, F.lit(0.0), lambda a, x: a + x).alias("stored_total"),
        F.size(stored).alias("stored_weeks"),
    )


# Safety stock. The level follows cost, lead time and variability.
STEPS["o_levels"] = """
SELECT t.item, t.warehouse, t.demand_type, t.activity_level, t.weeks, t.demand_std, t.size_std, t.cv, m.cost, w.lead_days, w.safety, w.moq, w.lot, m.vendor,
  CAST(greatest(1, ceil(COALESCE(NULLIF(w.lead_days, 0), 7) / 7.0)) AS INTEGER) AS lead_weeks,
  COALESCE(round_even((0.85 + (0.95 - 0.85) / (1 + exp(-(t.cv * ln(1.0 + w.lead_days) / ln(361.0) / NULLIF(ln(1.0 + m.cost), 0))))) * 10000, 0) / 10000, 0.85) AS level
FROM o_types t JOIN item_master m ON m.item = t.item JOIN item_warehouse w ON w.item = t.item AND w.warehouse = t.warehouse"""


def size_steps(prefix: str, levels: str, weeks: str) -> None:
    """Windows of the forecast under a lead time, and the size each strategy gives."""
    STEPS[f"{prefix}_windows"] = f"""
SELECT l.item, l.warehouse, MAX({weeks}) AS lead_weeks,
  COALESCE(stddev_samp(CASE WHEN f.k <= {weeks} THEN f.forecast END), 0) AS spread,
  COALESCE(stddev_samp(CASE WHEN f.k <= 2 * {weeks} THEN f.forecast END), 0) AS wide_spread,
  COALESCE(MAX(CASE WHEN f.k <= {weeks} THEN f.forecast END), 0) AS peak
FROM {levels} l JOIN o_forecast f ON f.item = l.item AND f.warehouse = l.warehouse GROUP BY l.item, l.warehouse"""
    z = z_sql("level")
    STEPS[f"{prefix}_z"] = f"SELECT *, {z} AS z FROM {levels}"
    STEPS[f"{prefix}_sizes"] = f"""
SELECT z.*, w.lead_weeks AS lw,
  round_even(z.z * CASE WHEN w.spread > 1e-9 THEN w.spread ELSE z.demand_std END * 100, 0) / 100 AS steady,
  round_even(z.z * CASE WHEN w.wide_spread > 1e-9 THEN w.wide_spread ELSE z.demand_std END * 100, 0) / 100 AS seasonal,
  round_even(z.z * z.demand_std * sqrt(w.lead_weeks) * 100, 0) / 100 AS trended,
  CASE WHEN COALESCE(z.size_std, 0) <> 0 THEN z.z * z.size_std * sqrt(w.lead_weeks / c.gap)
    ELSE COALESCE(round_even(z.z * z.demand_std * sqrt(w.lead_weeks / greatest(c.gap, 1)) * 100, 0) / 100, 0) END AS intermittent,
  round_even(0.8 * w.peak * 100, 0) / 100 AS burst
FROM {prefix}_z z JOIN {prefix}_windows w ON w.item = z.item AND w.warehouse = z.warehouse
LEFT JOIN o_croston c ON c.item = z.item AND c.warehouse = z.warehouse"""
    STEPS[f"{prefix}_safety"] = f"""
SELECT item, warehouse, demand_type, activity_level, lw AS lead_weeks, CASE WHEN ruled THEN level END AS service_level,
  round_even(size * 100, 0) / 100 AS dynamic_safety,
  CAST(CASE WHEN ruled THEN greatest(size, safety) ELSE safety END AS DOUBLE) AS final_safety FROM (
  SELECT s.*, ruled, CASE WHEN NOT ruled THEN 0.0 WHEN demand_type = 'Steady Demand' THEN steady WHEN demand_type = 'Seasonal Demand' THEN seasonal
    WHEN demand_type = 'Trended Demand' THEN trended WHEN demand_type = 'Intermittent Demand' THEN intermittent ELSE burst END AS size
  FROM (SELECT *, NOT (demand_type IN ('Single Demand', 'New Item') OR activity_level IN ('Dormant', 'Inactive')) AS ruled FROM {prefix}_sizes) s) x"""


size_steps("o_static", "o_levels", "l.lead_weeks")


def planned(t):
    master = demand.master_data(demand.universe_from_demand(demand.weekly_demand(t.demand_lines)), t.item_master, t.item_warehouse)
    return forecast.forecast(classify.classify_items(master, metrics(t)))


@query("service_levels", "SELECT item, warehouse, level FROM o_levels", "level")
def _(t):
    level = safety.service_level(F.col("cost"), F.col("lead_days"), F.col("cv"))
    return planned(t).select("item", "warehouse", level.alias("level"))


@query("lead_time_weeks", "SELECT item, warehouse, CAST(greatest(1, ceil(COALESCE(NULLIF(lead_days, 0), 7) / 7.0)) AS INTEGER) AS lead_weeks FROM item_warehouse")
def _(t):
    return t.item_warehouse.select("item", "warehouse", safety.lead_weeks(F.col("lead_days")).alias("lead_weeks"))


def strategy_query(name: str, method: str, column: str) -> None:
    @query(
        name,
        f"""SELECT item, warehouse, lw AS lead_weeks, level AS service_level, round_even({column} * 100, 0) / 100 AS dynamic_safety,
  CAST(greatest({column}, safety) AS DOUBLE) AS final_safety FROM o_static_sizes""",
        "service_level dynamic_safety final_safety",
    )
    def _(t):
        return safety.safety_stock_with(planned(t), method).select(
            "item", "warehouse", "lead_weeks", "service_level", "dynamic_safety", "final_safety"
        )


for _name, _method, _column in (
    ("steady_safety", "STEADY", "steady"),
    ("seasonal_safety", "SEASONAL", "seasonal"),
    ("intermittent_safety", "Intermittent Demand", "intermittent"),
    ("burst_safety", "BURST", "burst"),
):
    strategy_query(_name, _method, _column)

# The trended strategy is meant for straight forecasts, so it is compared on the trended model.
STEPS["o_trended_sizes"] = """
SELECT l.*, round_even(z * demand_std * sqrt(lead_weeks) * 100, 0) / 100 AS trended FROM o_static_z l"""


@query(
    "trended_safety",
    """SELECT item, warehouse, level AS service_level, trended AS dynamic_safety, CAST(greatest(trended, safety) AS DOUBLE) AS final_safety
FROM o_trended_sizes""",
    "service_level dynamic_safety final_safety",
)
def _(t):
    master = demand.master_data(demand.universe_from_demand(demand.weekly_demand(t.demand_lines)), t.item_master, t.item_warehouse)
    straight = forecast.forecast_with(classify.classify_items(master, metrics(t)), "TRENDED")
    return safety.safety_stock_with(straight, "TRENDED").select(
        "item", "warehouse", "service_level", "dynamic_safety", "final_safety"
    )


@query(
    "default_safety",
    """SELECT item, warehouse, CAST(NULL AS DOUBLE) AS service_level, 0.0::DOUBLE AS dynamic_safety, CAST(safety AS DOUBLE) AS final_safety
FROM o_levels""",
    "service_level dynamic_safety final_safety",
)
def _(t):
    return safety.safety_stock_with(planned(t), "none").select(
        "item", "warehouse", "service_level", "dynamic_safety", "final_safety"
    )


@query(
    "safety_stock",
    "SELECT * FROM o_static_safety",
    "service_level dynamic_safety final_safety",
)
def _(t):
    return safety.safety_stock(planned(t)).select(
        "item", "warehouse", "demand_type", "activity_level", "lead_weeks", "service_level", "dynamic_safety", "final_safety"
    )


# A learned lead time for the keys that hold a safety stock.
STEPS["o_learned"] = """
SELECT item, warehouse, CASE WHEN safety > 0 THEN lead_days + 10 END AS smart_days, 3 AS hint FROM item_warehouse"""
STEPS["o_dynamic_levels"] = """
SELECT l.* REPLACE (COALESCE(round_even((0.85 + (0.95 - 0.85) / (1 + exp(-(l.cv * ln(1.0 + d.smart_days) / ln(361.0) / NULLIF(ln(1.0 + l.cost), 0))))) * 10000, 0) / 10000, 0.85) AS level,
  CASE WHEN d.smart_days IS NOT NULL THEN greatest(1, d.smart_days // 7) ELSE d.hint END AS lead_weeks)
FROM o_levels l JOIN o_learned d ON d.item = l.item AND d.warehouse = l.warehouse"""
size_steps("o_dynamic", "o_dynamic_levels", "l.lead_weeks")


@query("dynamic_safety_stock", "SELECT * FROM o_dynamic_safety", "service_level dynamic_safety final_safety")
def _(t):
    learned = planned(t).withColumns(
        {"smart_days": F.when(F.col("safety") > 0, F.col("lead_days") + 10), "lead_weeks_hint": F.lit(3)}
    )
    return safety.dynamic_safety_stock(learned).select(
        "item", "warehouse", "demand_type", "activity_level", "lead_weeks", "service_level", "dynamic_safety", "final_safety"
    )


STEPS["o_shares"] = "SELECT l_orderkey, l_linenumber, 0.5 + 0.4999 * l_discount / 0.1 AS p FROM lineitem"


@query("inverse_normal", f"SELECT l_orderkey, l_linenumber, p, {z_sql('p')} AS z FROM o_shares", "p z")
def _(t):
    share = F.lit(0.5) + F.lit(0.4999) * F.col("l_discount") / 0.1
    return t.lineitem.select("l_orderkey", "l_linenumber", share.alias("p"), inverse_normal(share).alias("z"))
