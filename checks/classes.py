"""Demand metrics and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import STEPS, query
from checks.views import AS_OF
from stowage.operators import classify, demand

STEPS["o_prepared"] = """
SELECT f.item, f.warehouse, f.week_start, f.qty, LEAST(f.qty, q.p95) AS demand,
  CAST((DATE '2001-07-30' - f.week_start) // 7 AS INTEGER) AS weeks_ago,
  pow(0.9, (DATE '2001-07-30' - f.week_start) // 7) AS weight,
  ROW_NUMBER() OVER (PARTITION BY f.item, f.warehouse ORDER BY f.week_start) AS pos
FROM o_filled f JOIN (SELECT item, warehouse, quantile_cont(CAST(qty AS DOUBLE), 0.95) AS p95 FROM o_filled GROUP BY item, warehouse) q
  ON q.item = f.item AND q.warehouse = f.warehouse"""
STEPS["o_basics"] = """
SELECT item, warehouse, COUNT(*) AS weeks, MAX(week_start) AS last_week, MAX(weeks_ago) AS max_weeks_ago,
  COUNT(*) FILTER (WHERE demand > 0) AS weeks_with_demand,
  CAST(COUNT(*) FILTER (WHERE demand = 0) AS DOUBLE) / COUNT(*) AS zero_ratio, SUM(demand * weight) / SUM(weight) AS weighted_mean,
  COALESCE(SUM(demand) FILTER (WHERE weeks_ago <= 12), 0.0) AS recent_demand,
  COUNT(*) FILTER (WHERE demand > 0 AND weeks_ago <= 11) AS recent_hits, AVG(demand) AS demand_mean, stddev_samp(demand) AS demand_std,
  stddev_samp(CASE WHEN demand > 0 THEN demand END) AS size_std, quantile_cont(CAST(demand AS DOUBLE), 0.9) AS burst_level,
  regr_slope(demand, pos - 1) AS line_slope, regr_intercept(demand, pos - 1) AS line_start
FROM o_prepared GROUP BY item, warehouse"""
STEPS["o_spread"] = """
SELECT p.item, p.warehouse, sqrt(SUM(weight * (demand - weighted_mean) * (demand - weighted_mean)) / SUM(weight)) AS weighted_std,
  MAX(CASE WHEN pos > weeks - 4 THEN demand END) AS tail_max, AVG(CASE WHEN pos > weeks - 12 THEN demand END) AS tail_mean,
  SUM(CASE WHEN pos > weeks - 12 THEN demand * weight END) / SUM(CASE WHEN pos > weeks - 12 THEN weight END) AS seasonal_base
FROM o_prepared p JOIN o_basics b ON b.item = p.item AND b.warehouse = p.warehouse GROUP BY p.item, p.warehouse"""
# The centred average by joining each week to its neighbours, not by a frame.
STEPS["o_trend"] = """
SELECT a.item, a.warehouse, a.pos, a.demand,
  CASE WHEN COUNT(*) = 5 THEN SUM(CASE WHEN abs(b.pos - a.pos) = 2 THEN b.demand / 2 ELSE b.demand END) / 4 END AS trend
FROM o_prepared a JOIN o_prepared b ON b.item = a.item AND b.warehouse = a.warehouse AND b.pos BETWEEN a.pos - 2 AND a.pos + 2
GROUP BY a.item, a.warehouse, a.pos, a.demand"""
STEPS["o_slope"] = """
SELECT item, warehouse, (arg_max(trend, pos) - arg_min(trend, pos)) / (COUNT(*) - 1) AS trend_slope
FROM o_trend WHERE trend IS NOT NULL GROUP BY item, warehouse"""
STEPS["o_phases"] = """
SELECT item, warehouse, (pos - 1) % 4 AS phase, COUNT(*) AS n, AVG(demand - trend) AS level FROM o_trend GROUP BY item, warehouse, 3"""
STEPS["o_strength"] = """
SELECT p.item, p.warehouse, SUM(p.n * abs(p.level - c.centre)) / SUM(p.n) AS seasonal_strength
FROM o_phases p JOIN (SELECT item, warehouse, AVG(level) AS centre FROM o_phases GROUP BY item, warehouse) c
  ON c.item = p.item AND c.warehouse = p.warehouse GROUP BY p.item, p.warehouse"""
STEPS["o_metrics"] = """
SELECT b.*, s.weighted_std, s.tail_max, s.tail_mean, s.seasonal_base,
  CASE WHEN b.weighted_mean > 0 THEN s.weighted_std / b.weighted_mean ELSE CAST('inf' AS DOUBLE) END AS cv,
  CASE WHEN b.weeks >= 8 THEN l.trend_slope END AS trend_slope, CASE WHEN b.weeks >= 8 THEN g.seasonal_strength END AS seasonal_strength
FROM o_basics b JOIN o_spread s ON s.item = b.item AND s.warehouse = b.warehouse
LEFT JOIN o_slope l ON l.item = b.item AND l.warehouse = b.warehouse
LEFT JOIN o_strength g ON g.item = b.item AND g.warehouse = b.warehouse"""
STEPS["o_types"] = """
SELECT m.*, CASE WHEN max_weeks_ago < 8 THEN 'New Item'
    WHEN zero_ratio > 0.95 AND recent_demand <= 0 THEN 'Single Demand'
    WHEN zero_ratio > 0.7 THEN 'Intermittent Demand'
    WHEN cv < 1.0 AND CAST(weeks_with_demand AS DOUBLE) / weeks > 0.25 AND zero_ratio < 0.6 THEN 'Steady Demand'
    WHEN abs(trend_slope) > greatest(0.3, 0.05 * weighted_mean) THEN 'Trended Demand'
    WHEN seasonal_strength > greatest(0.4 * weighted_std, 0.5) THEN 'Seasonal Demand'
    WHEN cv > 1.5 AND zero_ratio < 0.3 AND tail_max > 3 * tail_mean THEN 'Burst Demand'
    ELSE 'Intermittent Demand' END AS demand_type,
  CASE WHEN zero_ratio >= 0.95 AND recent_hits = 0 THEN 'Dormant' WHEN zero_ratio >= 0.8 AND recent_hits <= 2 THEN 'Inactive'
    WHEN zero_ratio >= 0.6 THEN 'Occasional' ELSE 'Active' END AS activity_level
FROM o_metrics m"""


def prepared(t):
    return classify.prepare_series(demand.fill_weeks(demand.weekly_demand(t.demand_lines), AS_OF))


def metrics(t):
    return classify.series_metrics(prepared(t))


@query(
    "winsorised_above",
    "SELECT item, warehouse, week_start, qty, demand FROM o_prepared",
    "qty demand",
)
def _(t):
    return classify.winsorise(demand.fill_weeks(demand.weekly_demand(t.demand_lines), AS_OF), "qty", upper=0.95)


@query(
    "winsorised_both_sides",
    """
SELECT f.item, f.warehouse, f.week_start, f.qty, GREATEST(LEAST(f.qty, q.high), q.low) AS demand FROM o_filled f JOIN
  (SELECT item, warehouse, quantile_cont(CAST(qty AS DOUBLE), 0.99) AS high, quantile_cont(CAST(qty AS DOUBLE), 0.01) AS low
   FROM o_filled GROUP BY item, warehouse) q ON q.item = f.item AND q.warehouse = f.warehouse""",
    "qty demand",
)
def _(t):
    filled = demand.fill_weeks(demand.weekly_demand(t.demand_lines), AS_OF)
    return classify.winsorise(filled, "qty", lower=0.01, upper=0.99)


@query(
    "prepared_series",
    "SELECT item, warehouse, week_start, qty, demand, weeks_ago, weight FROM o_prepared",
    "qty demand weight",
)
def _(t):
    return prepared(t)


@query(
    "demand_metrics",
    """SELECT item, warehouse, weeks, weeks_with_demand, zero_ratio, weighted_mean, weighted_std, cv, recent_demand, recent_hits,
  tail_max, tail_mean FROM o_metrics""",
    "zero_ratio weighted_mean weighted_std cv recent_demand tail_max tail_mean",
)
def _(t):
    return metrics(t).select(
        "item", "warehouse", "weeks", "weeks_with_demand", "zero_ratio", "weighted_mean", "weighted_std", "cv",
        "recent_demand", "recent_hits", "tail_max", "tail_mean",
    )


@query(
    "trend_and_season",
    "SELECT item, warehouse, trend_slope, seasonal_strength FROM o_metrics",
    "trend_slope seasonal_strength",
)
def _(t):
    return metrics(t).select("item", "warehouse", "trend_slope", "seasonal_strength")


@query("demand_types", "SELECT item, warehouse, demand_type FROM o_types")
def _(t):
    return classify.classify(metrics(t)).select("item", "warehouse", "demand_type")


@query("activity_levels", "SELECT item, warehouse, activity_level, zero_ratio, recent_hits FROM o_types", "zero_ratio")
def _(t):
    return classify.classify(metrics(t)).select(
        "item", "warehouse", "activity_level", "zero_ratio", "recent_hits"
    )


# Replaced items are the parents of links; keys with a large minimum order count as never ordered.
STEPS["o_gaps"] = """
SELECT w.item, w.warehouse, w.safety, CASE WHEN w.item LIKE '%/ECONOMY' THEN 'Y' END AS rpflag,
  w.moq > 6 OR w.warehouse = '7' AS unseen FROM item_warehouse w"""


@query(
    "item_classes",
    """
SELECT g.item, g.warehouse,
  CASE WHEN g.rpflag = 'Y' THEN 'Replaced' WHEN g.unseen THEN 'Stock Only' ELSE t.demand_type END AS demand_type,
  CASE WHEN g.rpflag = 'Y' OR g.unseen THEN 'Dormant' ELSE t.activity_level END AS activity_level,
  CASE WHEN g.rpflag = 'Y' OR g.unseen THEN 1.0 ELSE t.zero_ratio END AS zero_ratio,
  CAST(CASE WHEN g.rpflag = 'Y' OR g.unseen THEN 0 ELSE t.weeks_with_demand END AS BIGINT) AS weeks_with_demand,
  CASE WHEN g.rpflag = 'Y' OR g.unseen THEN NULL ELSE t.cv END AS cv,
  CAST(CASE WHEN g.rpflag = 'Y' THEN 0.85 END AS DOUBLE) AS service_level_hint
FROM o_gaps g LEFT JOIN o_types t ON t.item = g.item AND t.warehouse = g.warehouse
WHERE g.rpflag = 'Y' OR NOT g.unseen OR g.safety > 0""",
    "zero_ratio cv service_level_hint",
)
def _(t):
    master = t.item_warehouse.select(
        "item", "warehouse", "safety", F.when(F.col("item").like("%/ECONOMY"), "Y").alias("rpflag"),
        (F.col("moq") > 6).alias("unseen"),
    )
    seen = metrics(t).join(master.where(~F.col("unseen")).select("item", "warehouse"), ["item", "warehouse"], "left_semi")
    return classify.classify_items(master, seen).select(
        "item", "warehouse", "demand_type", "activity_level", "zero_ratio", "weeks_with_demand", "cv",
        "service_level_hint",
    )

