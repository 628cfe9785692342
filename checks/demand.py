"""Demand series, universe and master data."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import STEPS, query
from checks.views import AS_OF
from stowage.operators import demand

STEPS["o_weekly"] = """
SELECT item, warehouse, CAST(date_trunc('week', order_date) AS DATE) AS week_start, SUM(qty) AS qty
FROM demand_lines GROUP BY item, warehouse, 3"""
STEPS["o_filled"] = """
SELECT s.item, s.warehouse, s.week_start, COALESCE(w.qty, 0.0) AS qty
FROM (SELECT item, warehouse, CAST(UNNEST(generate_series(MIN(week_start), DATE '2001-07-30', INTERVAL 7 DAY)) AS DATE) AS week_start
      FROM o_weekly GROUP BY item, warehouse) s
LEFT JOIN o_weekly w ON w.item = s.item AND w.warehouse = s.warehouse AND w.week_start = s.week_start"""
STEPS["o_universe"] = """
SELECT item, warehouse FROM o_weekly UNION SELECT item, warehouse FROM item_warehouse WHERE safety > 0"""
STEPS["o_redirect"] = """
SELECT r.parent, u.warehouse, MIN(r.child) AS child FROM o_universe u
JOIN replacement r ON r.child = u.item AND r.type = '1' AND r.using_existing = 'Y' GROUP BY r.parent, u.warehouse"""
STEPS["o_merged"] = """
SELECT COALESCE(d.child, w.item) AS item, w.warehouse, w.week_start, SUM(w.qty) AS qty
FROM o_weekly w LEFT JOIN o_redirect d ON d.parent = w.item AND d.warehouse = w.warehouse
WHERE (w.item IN (SELECT item FROM o_universe) OR w.item IN (SELECT parent FROM o_redirect))
GROUP BY 1, 2, 3"""
STEPS["o_stock"] = """
SELECT u.item, u.warehouse,
  round_even((COALESCE(MAX(s.available), 0) + COALESCE(SUM(p.available), 0)) * 100, 0) / 100 AS available,
  round_even((COALESCE(MAX(s.on_order), 0) + COALESCE(SUM(p.on_order), 0)) * 100, 0) / 100 AS in_transit
FROM o_universe u
LEFT JOIN stock s ON s.item = u.item AND s.warehouse = u.warehouse
LEFT JOIN replacement r ON r.child = u.item AND r.type = '1' AND r.using_existing = 'Y'
LEFT JOIN stock p ON p.item = r.parent AND p.warehouse = u.warehouse
GROUP BY u.item, u.warehouse"""


def weekly(t):
    return demand.weekly_demand(t.demand_lines)


@query("weekly_demand", "SELECT * FROM o_weekly", "qty")
def _(t):
    return weekly(t)


@query(
    "week_labels",
    """
SELECT order_date, printf('%d-W%02d', isoyear(order_date), week(order_date)) AS history_label,
  printf('%d-%02dW', isoyear(order_date), week(order_date)) AS week_label,
  CAST(isoyear(order_date) * 100 + week(order_date) AS INTEGER) AS week_number,
  CAST(date_trunc('week', order_date) AS DATE) AS from_history, CAST(date_trunc('week', order_date) AS DATE) AS from_label,
  CAST(date_trunc('week', order_date) AS DATE) AS from_number,
  CAST(isoyear(order_date + 77) * 100 + week(order_date + 77) AS INTEGER) AS twelfth, n
FROM (SELECT order_date, COUNT(*) AS n FROM lines GROUP BY order_date) d""",
)
def _(t):
    days = t.lines.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    rendered = demand.week_renderings(days, "order_date")
    return rendered.withColumn("twelfth", F.element_at("following", 12)).drop("following")


@query("gap_filled_demand", "SELECT * FROM o_filled", "qty")
def _(t):
    return demand.fill_weeks(weekly(t), AS_OF)


@query(
    "replacement_map",
    "SELECT child, parent, using_existing = 'Y' AS using_existing FROM replacement WHERE type = '1'",
)
def _(t):
    return demand.replacement_map(t.replacement)


@query("parent_demand_merged", "SELECT * FROM o_merged", "qty")
def _(t):
    w = weekly(t)
    return demand.merge_parent_demand(w, t.replacement, demand.item_universe(w, t.item_warehouse))


@query("parent_stock_merged", "SELECT * FROM o_stock", "available in_transit")
def _(t):
    universe = demand.item_universe(weekly(t), t.item_warehouse)
    return demand.merge_parent_stock(t.stock, t.replacement, universe)


@query(
    "stock_by_location",
    """
SELECT item, warehouse, location, SUM(on_hand) AS on_hand, SUM(available) AS available FROM (
  SELECT TRIM("LPROD") AS item, TRIM("LWHS") AS warehouse, COALESCE(NULLIF(TRIM("LLOC"), ''), 'DEFAULT') AS location,
    "LOPB" + "LRCT" - "LISSU" + "LADJU" AS on_hand, "LOPB" + "LRCT" - "LISSU" + "LADJU" - "LIALOC" AS available FROM ili) x
GROUP BY item, warehouse, location""",
    "on_hand available",
)
def _(t):
    on_hand = F.col("LOPB") + F.col("LRCT") - F.col("LISSU") + F.col("LADJU")
    rows = t.ili.select(
        F.trim("LPROD").alias("item"), F.trim("LWHS").alias("warehouse"),
        F.coalesce(F.nullif(F.trim("LLOC"), F.lit("")), F.lit("DEFAULT")).alias("location"),
        on_hand.alias("on_hand"), (on_hand - F.col("LIALOC")).alias("available"),
    )
    return demand.stock_by_location(rows)


@query("item_universe", "SELECT * FROM o_universe")
def _(t):
    return demand.item_universe(weekly(t), t.item_warehouse)


@query("universe_from_demand", "SELECT DISTINCT item, warehouse FROM demand_lines")
def _(t):
    return demand.universe_from_demand(weekly(t))


@query("universe_from_safety", "SELECT DISTINCT item, warehouse FROM item_warehouse WHERE safety > 0")
def _(t):
    return demand.universe_from_safety(t.item_warehouse)


@query(
    "master_data",
    """
SELECT u.item, u.warehouse, m.cost, m.vendor, m.rpflag, w.lead_days, w.moq, w.lot, w.safety FROM o_universe u
LEFT JOIN item_master m ON m.item = u.item LEFT JOIN item_warehouse w ON w.item = u.item AND w.warehouse = u.warehouse""",
    "cost",
)
def _(t):
    universe = demand.item_universe(weekly(t), t.item_warehouse)
    return demand.master_data(universe, t.item_master, t.item_warehouse)


@query(
    "stock_snapshot",
    """SELECT item, warehouse, COALESCE(available, 0.0) AS available, COALESCE(on_order, 0.0) AS in_transit FROM
(SELECT item, warehouse, NULLIF(available, 0.0) AS available, on_order FROM stock) s""",
    "available in_transit",
)
def _(t):
    return demand.stock_snapshot(t.stock.withColumn("available", F.nullif(F.col("available"), F.lit(0.0))))
