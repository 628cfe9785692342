"""Backtest, report and layout tables (F1-F4, W1-W5), and the planning run on merged demand."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from checks.demand import weekly
from checks.registry import ORACLES, STEPS, query
from checks.replenish import order_sql
from checks.views import AS_OF
from stowage.operators import evaluate, layout
from stowage.plans.planning import backtest

CUTOFF = dt.date(2001, 6, 20)
MONDAY = "2001-06-18"
START = dt.date(1995, 1, 1)


def restated(prefix: str, first: dict[str, str], wanted: list[str]) -> None:
    """The shared steps once more under a prefix, with some of them replaced."""
    names = [n for n in STEPS if n.startswith("o_")]
    for name in wanted:
        text = first.get(name, STEPS[name])
        for other in names:
            if other in wanted:
                text = re.sub(rf"\b{other}\b", f"{prefix}{other}", text)
        STEPS[f"{prefix}{name}"] = text


CHAIN = [
    "o_filled", "o_prepared", "o_basics", "o_spread", "o_trend", "o_slope", "o_phases", "o_strength", "o_metrics", "o_types",
    "o_value_weights", "o_steady", "o_week_profile", "o_week_centre", "o_hits", "o_croston", "o_models", "o_forecast", "o_levels",
    "o_static_windows", "o_static_z", "o_static_sizes", "o_static_safety",
]
# As of the cut-off: the series ends there.
restated(
    "b_",
    {
        "o_filled": f"SELECT * FROM full_filled WHERE week_start <= DATE '{MONDAY}'",
        "o_prepared": STEPS["o_prepared"].replace("2001-07-30", MONDAY),
    },
    CHAIN,
)
# The planned series: demand of replaced items counts under their successor.
STEPS["full_filled"] = STEPS["o_filled"].replace("o_weekly", "o_merged")
STEPS["b_windows"] = f"""
SELECT item, warehouse, COALESCE(SUM(qty) FILTER (WHERE week_start >= DATE '{MONDAY}' AND week_start < DATE '{MONDAY}' + 28), 0) AS actual,
  COALESCE(SUM(qty) FILTER (WHERE week_start >= DATE '{MONDAY}' - 28 AND week_start < DATE '{MONDAY}'), 0) AS last_period,
  COALESCE(SUM(qty) FILTER (WHERE week_start >= DATE '2000-06-18' AND week_start < DATE '2000-07-16'), 0) AS last_year
FROM full_filled GROUP BY item, warehouse HAVING COUNT(*) FILTER (WHERE week_start <= DATE '{MONDAY}') > 0"""
STEPS["b_months"] = """
SELECT item, warehouse, round_even(SUM(forecast) FILTER (WHERE k <= 4) * 100, 0) / 100 AS monthly FROM b_o_forecast GROUP BY item, warehouse"""
STEPS["b_joined"] = """
SELECT s.item, s.warehouse, s.demand_type, s.activity_level, s.dynamic_safety, s.final_safety, s.service_level, m.cost, w.actual, w.last_period, w.last_year,
  greatest(f.monthly * {months}, 0) AS predicted FROM b_o_static_safety s JOIN b_windows w ON w.item = s.item AND w.warehouse = s.warehouse
JOIN b_months f ON f.item = s.item AND f.warehouse = s.warehouse JOIN item_master m ON m.item = s.item"""
STEPS["b_measured"] = """
SELECT *, predicted - actual AS error, CASE WHEN actual > 0 THEN abs(predicted - actual) / actual END AS ape,
  CASE WHEN last_period > 0 THEN (actual - last_period) / last_period ELSE 0.0 END AS mom_growth, CASE WHEN last_year > 0 THEN (actual - last_year) / last_year ELSE 0.0 END AS yoy_growth,
  predicted + dynamic_safety AS forecast_plus_safety, predicted + dynamic_safety - actual AS coverage_gap, actual <= predicted + dynamic_safety AS covered FROM b_joined"""
STEPS["b_scored"] = """
SELECT item, warehouse, predicted, actual, last_year, last_period, yoy_growth, mom_growth, error, abs(error) AS absolute_error, ape,
  round_even((0.4 * CASE WHEN ape IS NULL THEN 0 ELSE 1 / (1 + ape) END + 0.2 / (1 + abs(mom_growth) + abs(yoy_growth)) + 0.2 * CASE WHEN covered THEN 1.0 ELSE greatest(0.5, 1 - abs(coverage_gap) / (actual + 1e-6)) END
    + 0.2 * greatest(0.5, 1 - greatest(0, (predicted - actual) / (actual + 1e-6)))) * 1000, 0) / 1000 AS score,
  demand_type, activity_level, cost, dynamic_safety, CASE WHEN final_safety <> 0 THEN final_safety ELSE dynamic_safety END AS final_safety, forecast_plus_safety, coverage_gap, covered,
  CASE WHEN COALESCE(service_level, 0) <> 0 THEN service_level ELSE 0.85 END AS service_level FROM b_measured"""
for _step in ("b_joined", "b_measured", "b_scored"):
    STEPS[_step.replace("b_", "q_", 1)] = STEPS[_step].replace("{months}", "3").replace("FROM b_joined", "FROM q_joined").replace("FROM b_measured", "FROM q_measured")
STEPS["b_joined"] = STEPS["b_joined"].replace("{months}", "1")
SCORED = "predicted actual last_year last_period yoy_growth mom_growth error absolute_error ape score cost dynamic_safety final_safety forecast_plus_safety coverage_gap service_level"


def scored(t, **options):
    return backtest(weekly(t), t.item_master, t.item_warehouse, t.replacement, CUTOFF, AS_OF, START, **options)


def stored(t):
    return evaluate.evaluation_rows(scored(t), CUTOFF, START)


@query("forecast_backtest", "SELECT * FROM b_scored", SCORED)
def _(t):
    return scored(t)


@query("quarterly_backtest", "SELECT * FROM q_scored", SCORED)
def _(t):
    return scored(t, quarterly=True)


@query(
    "evaluation_rows",
    f"""SELECT item, warehouse, DATE '1995-01-01' AS eval_start, DATE '{MONDAY}' AS eval_end, CAST(4 AS INTEGER) AS backtest_weeks, predicted, dynamic_safety, actual, ape, mom_growth, yoy_growth,
  score, CASE WHEN covered THEN 'Y' ELSE 'N' END AS covered, coverage_gap, demand_type, activity_level FROM b_scored""",
    "predicted dynamic_safety actual ape mom_growth yoy_growth score coverage_gap",
)
def _(t):
    return stored(t)


STEPS["b_reported"] = "SELECT * FROM b_scored WHERE activity_level NOT IN ('Inactive', 'Dormant') AND demand_type NOT IN ('New Item', 'Replaced', 'Stock Only')"


def report_sql(level: str, group: str, grouping: str) -> str:
    rmse = "round_even(sqrt(AVG((actual - predicted) * (actual - predicted))) * 10000, 0) / 10000" if level == "Overall" else "CAST(NULL AS DOUBLE)"
    return f"""
SELECT '{level}' AS level, {group} AS group_name, COUNT(*) AS items, round_even(AVG(COALESCE(ape, 0)) * 10000, 0) / 10000 AS mape, round_even(SUM(abs(error)) / NULLIF(SUM(actual), 0) * 10000, 0) / 10000 AS wape,
  {rmse} AS rmse, round_even(AVG(score) * 10000, 0) / 10000 AS score, round_even(AVG(CASE WHEN covered THEN 1.0 ELSE 0.0 END) * 10000, 0) / 10000 AS coverage_rate,
  CASE WHEN SUM(actual) > 0 THEN round_even((SUM(predicted) - SUM(actual)) / SUM(actual) * 10000, 0) / 10000 END AS bias FROM b_reported {grouping}"""


@query(
    "forecast_report",
    " UNION ALL ".join(
        (
            report_sql("Overall", "'All'", ""),
            report_sql("DemandType", "demand_type", "GROUP BY demand_type"),
            report_sql("ActivityLevel", "activity_level", "GROUP BY activity_level"),
        )
    ),
    "mape wape rmse score coverage_rate bias",
)
def _(t):
    return evaluate.forecast_report(stored(t))


@query(
    "worst_forecasts",
    """SELECT item, warehouse, demand_type, activity_level, actual, predicted, COALESCE(ape, 0) AS ape, score, coverage_gap, CASE WHEN covered THEN 'Y' ELSE 'N' END AS covered
FROM b_reported ORDER BY COALESCE(ape, 0) DESC, item, warehouse LIMIT 20""",
    "actual predicted ape score coverage_gap",
)
def _(t):
    return evaluate.worst_forecasts(stored(t))


# The planning run: demand merged into replacing items, keys without demand kept when they hold stock.
restated("m_", {"o_filled": STEPS["o_filled"].replace("o_weekly", "o_merged")}, CHAIN)
STEPS["m_stock_only"] = """
SELECT u.item, u.warehouse, w.safety, w.moq, w.lot, w.lead_days FROM o_universe u JOIN item_warehouse w ON w.item = u.item AND w.warehouse = u.warehouse
WHERE w.safety > 0 AND NOT EXISTS (SELECT 1 FROM m_o_types t WHERE t.item = u.item AND t.warehouse = u.warehouse)"""
STEPS["m_stocked"] = """
SELECT s.item, s.warehouse, s.demand_type, s.activity_level, s.dynamic_safety, s.final_safety, s.service_level, l.moq, l.lot, l.lead_days, k.available, k.in_transit
FROM m_o_static_safety s JOIN m_o_levels l ON l.item = s.item AND l.warehouse = s.warehouse JOIN o_stock k ON k.item = s.item AND k.warehouse = s.warehouse
UNION ALL SELECT x.item, x.warehouse, 'Stock Only', 'Dormant', 0.0, CAST(x.safety AS DOUBLE), NULL, x.moq, x.lot, x.lead_days, k.available, k.in_transit
FROM m_stock_only x JOIN o_stock k ON k.item = x.item AND k.warehouse = x.warehouse"""
STEPS["m_stocked_learned"] = """
SELECT s.*, CAST(floor(d.p60_lead) AS INTEGER) AS smart_days, d.mode AS smart_mode FROM m_stocked s JOIN o_learned_leads d ON d.item = s.item AND d.warehouse = s.warehouse"""
STEPS["m_forecast"] = """
SELECT item, warehouse, k, forecast FROM m_o_forecast UNION ALL SELECT item, warehouse, 1, 0.0 FROM m_stock_only"""
_static = order_sql("m_s", "m_stocked", "greatest(1, CAST(round_even(b.lead_days / 7.0, 0) AS INTEGER))", "b.lead_days", "'Default'", "Static")
_dynamic = order_sql("m_d", "m_stocked_learned", "greatest(1, b.smart_days // 7)", "b.smart_days", "b.smart_mode", "Dynamic")
for _prefix in ("m_s", "m_d"):
    STEPS[f"{_prefix}_need"] = STEPS[f"{_prefix}_need"].replace("JOIN o_forecast f", "JOIN m_forecast f")
_columns = "forecast_in_lead net_requirement available in_transit dynamic_safety final_safety service_level manual_safety".split()
ORACLES["planning_run"] = (
    "SELECT * REPLACE (" + ", ".join(f"round_even({c} * 1e6, 0) / 1e6 + 0.0 AS {c}" for c in _columns) + f") FROM ({_static} UNION ALL {_dynamic}) result"
)


# Layout.
@query(
    "shared_coordinates",
    """
SELECT *, COUNT(*) OVER (PARTITION BY x, y, z) AS sharing FROM (
  SELECT split_part(description, ',', 1) AS x, split_part(description, ',', 2) AS y, split_part(description, ',', 3) AS z, TRIM(location) AS location, COUNT(*) AS copies
  FROM location_rows GROUP BY 1, 2, 3, 4) d""",
)
def _(t):
    return layout.shared_coordinates(t.location_rows)


@query(
    "location_table",
    """
SELECT warehouse, TRIM(location) AS location, description, split_part(description, ',', 1) AS x, split_part(description, ',', 2) AS y, split_part(description, ',', 3) AS z,
  'NORMAL' AS location_type, CAST(NULL AS VARCHAR) AS zone, CAST(NULL AS DOUBLE) AS volume_capacity, CAST(NULL AS DOUBLE) AS weight_capacity FROM location_rows""",
)
def _(t):
    return layout.location_table(t.location_rows)


@query("duplicate_locations", "SELECT TRIM(location) AS location, COUNT(*) AS copies FROM location_rows GROUP BY 1 HAVING COUNT(*) > 1")
def _(t):
    return layout.duplicate_locations(t.location_rows)


STEPS["o_picks"] = """
SELECT lord, item, LEAD(item) OVER (PARTITION BY lord ORDER BY CAST(lline AS INTEGER), lline, item, warehouse, order_date, qty) AS following FROM demand_lines"""
STEPS["o_pairs"] = """
SELECT least(item, following) AS item_a, greatest(item, following) AS item_b, COUNT(*) AS co_occurrence FROM o_picks WHERE item <> following GROUP BY 1, 2"""
STEPS["o_item_places"] = "SELECT item, CONCAT('L', CAST(MIN(lead_days) AS VARCHAR)) AS location FROM (SELECT CASE WHEN item LIKE '%/SMALL' THEN CONCAT(item, '?') ELSE item END AS item, lead_days FROM item_warehouse) w GROUP BY item"


@query("consecutive_picks", "SELECT * FROM o_pairs")
def _(t):
    return layout.consecutive_picks(t.demand_lines)


def misfiled(item):
    return F.when(item.like("%/SMALL"), F.concat(item, F.lit("?"))).otherwise(item)


@query(
    "top_pairs",
    """
SELECT p.item_a, p.item_b, p.co_occurrence, a.location AS location_a, b.location AS location_b FROM (SELECT * FROM o_pairs ORDER BY co_occurrence DESC, item_a, item_b LIMIT 100) p
JOIN o_item_places a ON a.item = p.item_a JOIN o_item_places b ON b.item = p.item_b""",
)
def _(t):
    # Items of one kind are filed under another name and so have no place.
    places = (
        t.item_warehouse.groupBy(misfiled(F.col("item")).alias("item"))
        .agg(F.concat(F.lit("L"), F.min("lead_days").cast("string")).alias("location"))
    )
    return layout.top_pairs(layout.consecutive_picks(t.demand_lines), places)


# Parts are what customers pick here: 200 at the smallest size, 20,000 at the largest.
STEPS["o_shipped"] = "SELECT DISTINCT lord, CAST(l_partkey AS VARCHAR) AS item FROM (SELECT CAST(o_orderkey AS VARCHAR) AS lord, l_partkey FROM lines) l"
STEPS["o_shipped_pairs"] = """
SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS co_occurrence FROM o_shipped a JOIN o_shipped b ON a.lord = b.lord AND a.item < b.item GROUP BY a.item, b.item"""
# Orders of a customer and year as one shipment: some hundred items in the larger ones.
STEPS["o_truckloads"] = """
SELECT DISTINCT CONCAT(CAST(o_custkey % 25 AS VARCHAR), '/', CAST(YEAR(order_date) AS VARCHAR)) AS lord, CAST(l_partkey AS VARCHAR) AS item FROM lines"""
STEPS["o_truckload_pairs"] = """
SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS co_occurrence FROM o_truckloads a JOIN o_truckloads b ON a.lord = b.lord AND a.item < b.item GROUP BY a.item, b.item"""


@query(
    "co_shipped_pairs",
    """
SELECT p.item_a, p.item_b, p.co_occurrence, a.location AS location_a, b.location AS location_b
FROM (SELECT * FROM o_shipped_pairs ORDER BY co_occurrence DESC, item_a, item_b LIMIT 100) p
JOIN (SELECT CAST(p_partkey AS VARCHAR) AS item, CONCAT('L', CAST(p_size AS VARCHAR)) AS location FROM part) a ON a.item = p.item_a
JOIN (SELECT CAST(p_partkey AS VARCHAR) AS item, CONCAT('L', CAST(p_size AS VARCHAR)) AS location FROM part) b ON b.item = p.item_b""",
)
def _(t):
    lines = t.lines.select(F.col("o_orderkey").cast("string").alias("lord"), F.col("l_partkey").cast("string").alias("item"))
    places = t.part.select(F.col("p_partkey").cast("string").alias("item"), F.concat(F.lit("L"), F.col("p_size").cast("string")).alias("location"))
    return layout.top_pairs(layout.frequent_pairs(lines), places)


@query("co_shipped_pairs_of_large_orders", "SELECT * FROM o_truckload_pairs ORDER BY co_occurrence DESC, item_a, item_b LIMIT 100")
def _(t):
    shipment = F.concat((F.col("o_custkey") % 25).cast("string"), F.lit("/"), F.year("order_date").cast("string"))
    return layout.frequent_pairs(t.lines.select(shipment.alias("lord"), F.col("l_partkey").cast("string").alias("item")))


def abc_query(name: str, subject: str, source: str) -> None:
    @query(
        name,
        f"""
SELECT warehouse, {subject}, picks, share AS cumulative_share, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (
  SELECT *, CAST(SUM(picks) OVER (PARTITION BY warehouse ORDER BY picks DESC) AS DOUBLE) / SUM(picks) OVER (PARTITION BY warehouse) AS share
  FROM (SELECT warehouse, {subject}, COUNT(*) AS picks FROM {source} GROUP BY warehouse, {subject}) p) s""",
        "cumulative_share",
    )
    def _(t):
        return layout.abc_classes(getattr(t, source), subject)


abc_query("item_abc_classes", "item", "demand_lines")
abc_query("location_abc_classes", "location", "pick_locations")


@query(
    "stock_on_layout",
    """
SELECT l.warehouse, l.location, l.x, l.y, l.z, s.item, s.on_hand FROM
  (SELECT warehouse, TRIM(location) AS location, split_part(description, ',', 1) AS x, split_part(description, ',', 2) AS y, split_part(description, ',', 3) AS z FROM location_rows) l
LEFT JOIN (SELECT warehouse, location, item, CAST(COUNT(*) AS DOUBLE) AS on_hand FROM (SELECT item, warehouse, CASE WHEN item LIKE '%/SMALL' THEN CONCAT(location, '?') ELSE location END AS location FROM pick_locations) k GROUP BY warehouse, location, item) s
  ON s.warehouse = l.warehouse AND s.location = l.location""",
    "on_hand",
)
def _(t):
    held = (
        t.pick_locations.withColumn("location", F.when(F.col("item").like("%/SMALL"), F.concat("location", F.lit("?"))).otherwise(F.col("location")))
        .groupBy("warehouse", "location", "item")
        .agg(F.count(F.lit(1)).cast("double").alias("on_hand"))
    )
    return layout.stock_on_layout(layout.location_table(t.location_rows), held)
