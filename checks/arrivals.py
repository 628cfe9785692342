"""Arrival dates, movements, projected stock and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.classes import metrics
from checks.leadtime import ON_KEYS, combined, lead_times, mapping_step
from checks.registry import STEPS, query
from checks.views import AS_OF
from stowage.operators import classify, eta, forecast, projection, routes
from stowage.plans.arrivals import dated_batches, predict_arrivals
from stowage.session import materialised

LINE = "o.ponum, o.poline, o.vendor, o.warehouse, o.item"
STEPS["o_enriched"] = """
SELECT o.*, COALESCE(s.p60_lead, w.lead_days) AS total_lead, CASE WHEN s.p60_lead IS NULL THEN 'Y' ELSE 'N' END AS total_fallback,
  p.is_batch_prone, p.predicted_batch_count, p.predicted_interval_days, p.predicted_tail_share
FROM o_open_lines o LEFT JOIN o_smart s ON s.item = o.item AND s.warehouse = o.warehouse AND s.vendor = o.vendor AND s.mode = o.mode
LEFT JOIN item_warehouse w ON w.item = o.item AND w.warehouse = o.warehouse
LEFT JOIN o_profile p ON p.item = o.item AND p.warehouse = o.warehouse AND p.vendor = o.vendor AND p.mode = o.mode"""
STEPS["o_cases"] = """
SELECT *, CASE WHEN upper(comment) IN ('DELIVERY DATE CONFIRMED', 'ESTIMATED DELIVERY DATE') THEN 'Confirmed' WHEN in_transit_qty > 0 THEN 'Shipped'
  WHEN remaining_qty > 0 AND remaining_qty < ordered_qty THEN 'SplitInProgress' WHEN is_batch_prone = 'Y' THEN 'LikelySplit' ELSE 'SingleDelivery' END AS "case" FROM o_enriched"""
STEPS["o_shipped_days"] = """
SELECT *, CAST(CASE WHEN "case" = 'Shipped' THEN DATE '2001-08-01' - invoice_date END AS INTEGER) AS transport_days FROM o_cases"""
mapping_step("o_late_map", "o_shipped_days", "o_record_ranges", 5)
STEPS["o_remoded"] = f"""
SELECT c.* REPLACE (CASE WHEN c.mode IN ('Air', 'Courier', 'International Truck') AND c.transport_days > 14 THEN m.predicted ELSE c.mode END AS mode)
FROM o_shipped_days c LEFT JOIN o_late_map m ON {ON_KEYS.format(m='m', s='c')}"""
STEPS["o_timed"] = """
SELECT c.*, CAST(trunc(round_even((COALESCE(s.p60_days, v.static_days, 7)) * 1e9, 0) / 1e9) AS INTEGER) AS shipped_days, CASE WHEN s.p60_days IS NULL THEN 'Y' ELSE 'N' END AS shipped_fallback,
  CAST(trunc(round_even((COALESCE(s.p60_days, v.static_days, CASE WHEN d.high < 'inf' THEN d.high END, 14)) * 1e9, 0) / 1e9) AS INTEGER) AS planned_days
FROM o_remoded c LEFT JOIN o_stats s ON s.vendor = c.vendor AND s.mode = c.mode AND s.warehouse = c.warehouse
LEFT JOIN vendor_master v ON v.vendor = c.vendor AND v.mode = c.mode LEFT JOIN o_modes d ON d.mode = c.mode"""
STEPS["o_last"] = """
SELECT ponum, split_part(poline, '-', 1) AS base_poline, MAX(invoice_date) AS last_invoice FROM o_record_rows WHERE invoice_date IS NOT NULL GROUP BY ponum, 2"""
STEPS["o_siblings"] = """
SELECT a.ponum, a.poline, list(b.invoice_date ORDER BY b.invoice_date) AS dates FROM o_open_lines a JOIN o_open_lines b
  ON b.ponum = a.ponum AND split_part(b.poline, '-', 1) = split_part(a.poline, '-', 1) AND b.poline <> a.poline AND b.invoice_date IS NOT NULL GROUP BY a.ponum, a.poline"""
STEPS["o_context"] = """
SELECT t.*, split_part(t.poline, '-', 1) AS base_poline, l.last_invoice, CAST(s.dates[2] - s.dates[1] AS INTEGER) AS sibling_interval, b.max_batch_qty
FROM o_timed t LEFT JOIN o_last l ON l.ponum = t.ponum AND l.base_poline = split_part(t.poline, '-', 1) LEFT JOIN o_siblings s ON s.ponum = t.ponum AND s.poline = t.poline
LEFT JOIN o_behaviour b ON b.item = t.item AND b.warehouse = t.warehouse AND b.vendor = t.vendor AND b.mode = t.mode"""
STEPS["o_planned"] = """
SELECT *, predicted_batch_count IS NOT NULL AND total_fallback <> 'Y' AS profiled, CAST(round_even(remaining_qty, 0) AS BIGINT) AS whole,
  CAST(trunc(round_even((CASE WHEN COALESCE(predicted_interval_days, 0) = 0 THEN 7 ELSE predicted_interval_days END) * 1e9, 0) / 1e9) AS INTEGER) AS rhythm FROM o_context"""
STEPS["o_counted"] = """
SELECT *, CASE WHEN "case" = 'SplitInProgress' THEN CASE WHEN whole <= 0 THEN 0 WHEN NOT profiled OR whole <= trunc(round_even((COALESCE(max_batch_qty, 0)) * 1e9, 0) / 1e9) OR predicted_batch_count <= 1 OR whole < predicted_batch_count THEN 1 ELSE predicted_batch_count END
  WHEN "case" = 'LikelySplit' THEN CASE WHEN remaining_qty > 0 THEN predicted_batch_count ELSE 0 END ELSE 1 END AS n FROM o_planned"""
STEPS["o_exploded"] = "SELECT *, CAST(UNNEST(range(1, n + 1)) AS INTEGER) AS k FROM o_counted WHERE n > 0"
STEPS["o_arrival_rows"] = """
SELECT item, warehouse, ponum, CASE WHEN "case" = 'SplitInProgress' THEN poline || '-' || CAST(k AS VARCHAR) ELSE poline END AS poline, vendor, mode, "case",
  CASE "case" WHEN 'Shipped' THEN in_transit_qty WHEN 'SplitInProgress' THEN CASE WHEN k < n THEN whole // n ELSE whole - (whole // n) * (n - 1) END
    WHEN 'LikelySplit' THEN round_even(CASE WHEN predicted_tail_share > 0 AND n >= 2 THEN CASE WHEN k = n THEN round_even(remaining_qty * predicted_tail_share, 0)
      ELSE (remaining_qty - round_even(remaining_qty * predicted_tail_share, 0)) / (n - 1) END ELSE remaining_qty / n END, 0) ELSE remaining_qty END AS qty,
  CASE "case" WHEN 'Confirmed' THEN invoice_date WHEN 'Shipped' THEN invoice_date + shipped_days
    WHEN 'SplitInProgress' THEN COALESCE(last_invoice, po_entry_date + CAST(trunc(round_even((CASE WHEN COALESCE(total_lead, 0) = 0 THEN 14 ELSE total_lead END) * 1e9, 0) / 1e9) AS INTEGER)) + CASE WHEN profiled THEN rhythm ELSE COALESCE(sibling_interval, 7) END * k + planned_days
    WHEN 'LikelySplit' THEN po_entry_date + rhythm * (k - 1) + planned_days ELSE po_entry_date + CAST(trunc(round_even((total_lead) * 1e9, 0) / 1e9) AS INTEGER) END AS eta_date,
  CASE "case" WHEN 'Confirmed' THEN 'ConfirmedDate' WHEN 'Shipped' THEN 'TransportEstimatedDate' WHEN 'LikelySplit' THEN 'TailBatchSimulated'
    WHEN 'SplitInProgress' THEN CASE WHEN profiled THEN 'TailBatchSimulated' WHEN sibling_interval IS NOT NULL THEN 'TailBatchSimulated_FB_SelfBoot' ELSE 'TailBatchSimulated_FB_Default' END
    ELSE CASE WHEN total_fallback = 'Y' THEN 'StaticWLEAD' ELSE 'SimulatedSingle' END END AS eta_flag, comment, k, n, shipped_fallback, total_fallback FROM o_exploded"""
STEPS["o_arrivals_plain"] = """
SELECT item, warehouse, ponum, poline, vendor, mode, CAST(qty AS DOUBLE) AS qty, eta_date, printf('%d-%02dW', isoyear(eta_date), week(eta_date)) AS eta_week, eta_flag,
  CASE "case" WHEN 'Confirmed' THEN comment || CASE WHEN date_trunc('week', eta_date) < DATE '2001-07-30' THEN 'ETA overdue! Contact supplier.' ELSE '' END WHEN 'SingleDelivery' THEN comment END AS comment,
  CAST(CASE WHEN "case" IN ('SplitInProgress', 'LikelySplit') THEN k ELSE 0 END AS INTEGER) AS batch_index,
  CASE WHEN "case" IN ('SplitInProgress', 'LikelySplit') THEN CASE WHEN k = n THEN 'Y' ELSE 'N' END END AS is_final_batch,
  CASE WHEN "case" = 'Shipped' THEN shipped_fallback END AS transport_fallback, CASE WHEN "case" = 'SingleDelivery' THEN total_fallback END AS total_fallback,
  date_trunc('week', eta_date) < DATE '2001-07-30' AS overdue, "case" FROM o_arrival_rows"""
OUT = "item, warehouse, ponum, poline, vendor, mode, qty, eta_date, eta_week, eta_flag, comment, batch_index, is_final_batch, transport_fallback, total_fallback, overdue"
STEPS["o_split_arrivals"] = f"""
SELECT {OUT.replace('ponum, poline,', "ponum, CASE WHEN c > 1 THEN poline || '-' || CAST(rn AS VARCHAR) ELSE poline END AS poline,")}
FROM (SELECT *, COUNT(*) OVER (PARTITION BY ponum, poline) AS c, ROW_NUMBER() OVER (PARTITION BY ponum, poline ORDER BY eta_date NULLS LAST, item, warehouse, vendor, mode, qty, eta_week, eta_flag,
  comment, batch_index) AS rn FROM o_arrivals_plain WHERE "case" = 'LikelySplit') x"""
STEPS["o_arrivals"] = f"""SELECT {OUT} FROM o_arrivals_plain WHERE "case" <> 'LikelySplit' UNION ALL SELECT {OUT} FROM o_split_arrivals"""


def enriched(t, leads):
    return eta.enrich_in_transit(leads.in_transit, leads.smart, materialised(t.item_warehouse), leads.profile)


def cases(t, leads):
    return eta.delivery_case(enriched(t, leads))


@query(
    "enriched_open_lines",
    f"SELECT {LINE}, o.mode, o.total_lead, o.total_fallback, o.is_batch_prone, o.predicted_batch_count, o.predicted_interval_days FROM o_enriched o",
    "total_lead predicted_interval_days",
)
def _(t):
    return enriched(t, lead_times(t)).select(
        "ponum", "poline", "vendor", "warehouse", "item", "mode", "total_lead", "total_fallback", "is_batch_prone",
        "predicted_batch_count", "predicted_interval_days",
    )


@query("delivery_cases", f'SELECT {LINE}, o.mode, "case" FROM o_cases o')
def _(t):
    return cases(t, lead_times(t)).select("ponum", "poline", "vendor", "warehouse", "item", "mode", "case")


@query("last_deliveries", "SELECT * FROM o_last")
def _(t):
    return eta.last_deliveries(combined(t))


@query("remoded_shipments", f'SELECT {LINE}, mode, "case", transport_days FROM o_remoded o')
def _(t):
    leads = lead_times(t)
    return eta.remode_shipped(cases(t, leads), leads.transport, leads.deliveries, AS_OF).select(
        "ponum", "poline", "vendor", "warehouse", "item", "mode", "case", "transport_days"
    )


@query("transport_days", f"SELECT {LINE}, mode, shipped_days, shipped_fallback, planned_days FROM o_timed o")
def _(t):
    leads = lead_times(t)
    remoded = eta.remode_shipped(cases(t, leads), leads.transport, leads.deliveries, AS_OF)
    return eta.with_transport_days(remoded, leads.transport, t.vendor_master).select(
        "ponum", "poline", "vendor", "warehouse", "item", "mode", "shipped_days", "shipped_fallback", "planned_days"
    )


def arrival_inputs(t):
    leads = lead_times(t)
    return leads.in_transit, leads.deliveries, leads, t.vendor_master, materialised(t.item_warehouse), AS_OF


def case_query(name: str, case: str) -> None:
    source = "o_split_arrivals" if case == eta.LIKELY_SPLIT else "o_arrivals_plain"
    where = "" if case == eta.LIKELY_SPLIT else f" WHERE \"case\" = '{case}'"

    @query(name, f"SELECT {OUT} FROM {source}{where}", "qty")
    def _(t):
        return eta.arrivals_of(dated_batches(*arrival_inputs(t)), case)


case_query("confirmed_arrivals", eta.CONFIRMED)
case_query("shipped_arrivals", eta.SHIPPED)
case_query("tail_batch_arrivals", eta.TAIL)
case_query("single_arrivals", eta.SINGLE)
case_query("likely_split_arrivals", eta.LIKELY_SPLIT)


@query("arrivals", "SELECT * FROM o_arrivals", "qty")
def _(t):
    return predict_arrivals(*arrival_inputs(t))


STEPS["o_movements"] = """
SELECT item, warehouse, week_start, change_type, SUM(qty_change) AS qty_change FROM (
  SELECT item, warehouse, CAST(date_trunc('week', eta_date) AS DATE) AS week_start, 'ETAInbound' AS change_type, qty AS qty_change FROM o_arrivals WHERE eta_date IS NOT NULL AND NOT overdue
  UNION ALL SELECT f.item, f.warehouse, DATE '2001-07-30' + CAST(7 * (f.k - 1) AS INTEGER), 'ForecastDemand', -round_even(f.forecast * 100, 0) / 100 FROM o_forecast f
  WHERE (f.item, f.warehouse) IN (SELECT (item, warehouse) FROM o_forecast WHERE round_even(forecast * 100, 0) <> 0)) m GROUP BY item, warehouse, week_start, change_type"""
STEPS["o_projection"] = """
SELECT m.item, m.warehouse, m.week_start, printf('%d-%02dW', isoyear(m.week_start), week(m.week_start)) AS week, m.change_type, m.qty_change,
  COALESCE(s.available, 0) + SUM(m.qty_change) OVER (PARTITION BY m.item, m.warehouse ORDER BY m.week_start, m.change_type) AS projected
FROM o_movements m LEFT JOIN stock s ON s.item = m.item AND s.warehouse = m.warehouse"""


def movements(t):
    forecasts = forecast.forecast(classify.classify(metrics(t)))
    return projection.virtual_transactions(predict_arrivals(*arrival_inputs(t)), forecasts, AS_OF)


@query(
    "virtual_transactions",
    "SELECT *, printf('%d-%02dW', isoyear(week_start), week(week_start)) AS week FROM o_movements",
    "qty_change",
)
def _(t):
    return movements(t)


@query("projected_stock", "SELECT * FROM o_projection", "qty_change projected")
def _(t):
    return projection.projected_stock(t.stock, movements(t))


# Routes of every item and warehouse.
STEPS["o_used"] = "SELECT item, warehouse, vendor, mode FROM o_preference WHERE confidence >= 0.1"
STEPS["o_partners"] = """
SELECT item, warehouse, vendor FROM o_used UNION SELECT w.item, w.warehouse, i.vendor FROM item_warehouse w JOIN item_master i ON i.item = w.item"""
STEPS["o_active"] = "SELECT vendor, mode, static_days FROM vendor_master WHERE is_active = 'Y'"
STEPS["o_priced"] = """
SELECT s.* REPLACE (f.cost_per_kg AS cost_per_kg) FROM o_stats s LEFT JOIN o_freight_by_vendor f ON f.vendor = s.vendor AND f.warehouse = s.warehouse AND f.mode = s.mode"""
STEPS["o_all_routes"] = """
SELECT * FROM o_used UNION SELECT p.item, p.warehouse, p.vendor, s.mode FROM o_partners p JOIN o_stats s ON s.vendor = p.vendor AND s.warehouse = p.warehouse
UNION SELECT p.item, p.warehouse, p.vendor, a.mode FROM o_partners p JOIN o_active a ON a.vendor = p.vendor"""


def route_sql(routes_step: str) -> str:
    return f"""
SELECT r.item, r.warehouse, r.vendor, r.mode, s.p60_days IS NOT NULL AS from_stats, CAST(trunc(round_even((COALESCE(s.p60_days, a.static_days, 999)) * 1e9, 0) / 1e9) AS INTEGER) AS lead_time,
  CAST(CASE WHEN s.p60_days IS NOT NULL THEN COALESCE(s.cost_per_kg, 0) ELSE 99999 END AS DOUBLE) AS cost_per_kg
FROM {routes_step} r JOIN o_active a ON a.vendor = r.vendor AND a.mode = r.mode LEFT JOIN o_priced s ON s.vendor = r.vendor AND s.warehouse = r.warehouse AND s.mode = r.mode"""


STEPS["o_routes"] = route_sql("o_all_routes")
STEPS["o_timed_routes"] = """
SELECT r.*, CAST(trunc(round_even((COALESCE(p.prep, greatest(w.lead_days, 0), 0)) * 1e9, 0) / 1e9) AS INTEGER) AS prepare_time, p.prep IS NOT NULL AS prepare_from_stats,
  CAST(trunc(round_even((COALESCE(p.prep, greatest(w.lead_days, 0), 0)) * 1e9, 0) / 1e9) AS INTEGER) + r.lead_time AS total_lead_time
FROM o_routes r LEFT JOIN (SELECT item, vendor, MAX(p60_prep) AS prep FROM o_prepare GROUP BY item, vendor) p ON p.item = r.item AND p.vendor = r.vendor
LEFT JOIN item_warehouse w ON w.item = r.item AND w.warehouse = r.warehouse"""


def candidates(t, leads, **options):
    # Items and places are read for the routes and for their preparation.
    t.store("item_master")
    t.store("item_warehouse")
    return routes.candidate_routes(
        t.item_warehouse, leads.preference, leads.transport, t.vendor_master, t.item_master, **options
    )


@query("candidate_routes", "SELECT * FROM o_routes", "cost_per_kg")
def _(t):
    return candidates(t, lead_times(t))


@query("preferred_routes_only", route_sql("o_used"), "cost_per_kg")
def _(t):
    return candidates(t, lead_times(t), vendor_paths=False)


@query("routes_with_prepare_time", "SELECT * FROM o_timed_routes", "cost_per_kg")
def _(t):
    leads = lead_times(t)
    return routes.with_prepare_time(candidates(t, leads), leads.prepare, t.item_warehouse)


def ranked_query(criterion: str, order: str) -> None:
    @query(
        f"routes_by_{criterion}",
        f"SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item, warehouse ORDER BY {order}) AS INTEGER) AS choice FROM o_timed_routes",
        "cost_per_kg",
    )
    def _(t):
        leads = lead_times(t)
        timed = routes.with_prepare_time(candidates(t, leads), leads.prepare, t.item_warehouse)
        return routes.rank_routes(timed, criterion)


ranked_query("cost", "cost_per_kg, total_lead_time, vendor, mode")
ranked_query("lead", "total_lead_time, cost_per_kg, vendor, mode")
