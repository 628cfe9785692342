"""Mode correction, delivery behaviour, lead times and freight."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import STEPS, query
from checks.sources import new_table
from stowage.functions.distribution import smoothed
from stowage.operators import delivery, demand, freight, leadtime
from stowage.plans import states
from stowage.plans.leadtime import analyse_lead_times
from stowage.session import materialised

# The transport modes.
STEPS["o_modes"] = """
SELECT * FROM (VALUES (0, 'Vessel', 15.0::DOUBLE, 'inf'::DOUBLE, 'SLOW', true), (1, 'Air', 0, 14, 'INTERNATIONAL_FAST', true), (2, 'Courier', 0, 7, 'INTERNATIONAL_FAST', true),
  (3, 'Truck', 0, 7, 'DOMESTIC', true), (4, 'Train', 5, 10, 'DOMESTIC', true), (5, 'Teleportation', 0, 0.1, 'UNKNOWN', false), (6, 'Internal Transfer', 0, 5, 'UNKNOWN', false),
  (7, 'Unknown', 0, 'inf', 'UNKNOWN', false), (8, 'International Truck', 5, 10, 'INTERNATIONAL_FAST', false), (9, 'International Train', 15, 40, 'INTERNATIONAL_MIDDLE', false),
  (10, 'Default', 0, 'inf', 'UNKNOWN', false)) m(ord, mode, low, high, grp, assignable)"""


def fallback_step(name: str, source: str) -> None:
    STEPS[name] = f"""
SELECT f.vendor, f.warehouse, f.mode, f.fallback_days FROM (SELECT vendor, warehouse, mode, AVG(CAST(transport_days AS DOUBLE)) AS fallback_days FROM {source} WHERE transport_days IS NOT NULL GROUP BY vendor, warehouse, mode) f
JOIN o_modes m ON m.mode = f.mode WHERE f.fallback_days BETWEEN m.low AND m.high"""


def ranges_step(name: str, fallback: str, stats: str | None) -> None:
    if stats is None:
        STEPS[name] = f"""
SELECT f.vendor, f.warehouse, f.mode, m.low, m.high, f.fallback_days AS mean, (m.low + m.high) / 2 AS stats_mean FROM {fallback} f JOIN o_modes m ON m.mode = f.mode"""
        return
    STEPS[name] = f"""
SELECT x.vendor, x.warehouse, x.mode,
  CASE WHEN x.mode_days BETWEEN m.low AND m.high THEN x.mode_days WHEN x.smoothed_days BETWEEN m.low AND m.high THEN x.smoothed_days ELSE m.low END AS low,
  CASE WHEN x.p90_days <= m.high THEN x.p90_days ELSE m.high END AS high,
  CASE WHEN x.fallback_days IS NOT NULL THEN x.fallback_days WHEN x.mean_days BETWEEN m.low AND m.high THEN x.mean_days ELSE (m.low + m.high) / 2 END AS mean,
  CASE WHEN x.mean_days BETWEEN m.low AND m.high THEN x.mean_days ELSE (m.low + m.high) / 2 END AS stats_mean
FROM (SELECT COALESCE(s.vendor, f.vendor) AS vendor, COALESCE(s.warehouse, f.warehouse) AS warehouse, COALESCE(s.mode, f.mode) AS mode, s.mean_days, s.mode_days, s.smoothed_days, s.p90_days, f.fallback_days
  FROM {stats} s FULL JOIN {fallback} f ON f.vendor = s.vendor AND f.warehouse = s.warehouse AND f.mode = s.mode) x JOIN o_modes m ON m.mode = x.mode"""


def mapping_step(name: str, source: str, ranges: str, tolerance: int, candidate: str = "mean", days: str = "transport_days") -> None:
    """Predicted mode of every distinct (vendor, warehouse, mode, days)."""
    STEPS[f"{name}_keys"] = f"SELECT DISTINCT vendor, warehouse, mode, CAST({days} AS DOUBLE) AS days FROM {source}"
    STEPS[f"{name}_best"] = f"""
SELECT k.vendor, k.warehouse, k.mode, k.days, c.mode AS best FROM {name}_keys k JOIN o_modes s ON s.mode = k.mode
JOIN o_modes c ON c.assignable AND c.mode <> k.mode AND c.grp <> s.grp AND k.days BETWEEN c.low AND c.high
  AND NOT (s.grp = 'DOMESTIC' AND c.grp IN ('INTERNATIONAL_FAST', 'INTERNATIONAL_MIDDLE', 'SLOW')) AND NOT (s.grp IN ('INTERNATIONAL_FAST', 'SLOW') AND c.grp = 'DOMESTIC')
LEFT JOIN {ranges} r ON r.vendor = k.vendor AND r.warehouse = k.warehouse AND r.mode = c.mode
QUALIFY ROW_NUMBER() OVER (PARTITION BY k.vendor, k.warehouse, k.mode, k.days
  ORDER BY abs(k.days - COALESCE(r.{candidate}, (c.low + c.high) / 2)) + CASE WHEN s.grp LIKE '%INTERNATIONAL%' OR c.grp LIKE '%INTERNATIONAL%' THEN 50 ELSE 100 END + 20, c.ord) = 1"""
    STEPS[name] = f"""
SELECT k.vendor, k.warehouse, k.mode, k.days,
  CASE WHEN k.days BETWEEN CASE WHEN s.assignable THEN COALESCE(r.low, s.low) ELSE s.low END AND CASE WHEN s.assignable THEN COALESCE(r.high, s.high) ELSE s.high END
    AND abs(k.days - CASE WHEN s.assignable THEN COALESCE(r.mean, (s.low + s.high) / 2) ELSE (s.low + s.high) / 2 END) <= {tolerance} THEN k.mode ELSE COALESCE(b.best, k.mode) END AS predicted
FROM {name}_keys k JOIN o_modes s ON s.mode = k.mode LEFT JOIN {ranges} r ON r.vendor = k.vendor AND r.warehouse = k.warehouse AND r.mode = k.mode
LEFT JOIN {name}_best b ON b.vendor = k.vendor AND b.warehouse = k.warehouse AND b.mode = k.mode AND b.days = k.days"""


ON_KEYS = "{m}.vendor = {s}.vendor AND {m}.warehouse = {s}.warehouse AND {m}.mode = {s}.mode AND {m}.days IS NOT DISTINCT FROM {s}.transport_days"

# Statistics of an earlier run, by plain aggregation.
STEPS["o_previous"] = """
SELECT vendor, warehouse, mode, AVG(CAST(transport_days AS DOUBLE)) AS mean_days, CAST(MIN(transport_days) AS DOUBLE) AS mode_days,
  CAST(MAX(transport_days) AS DOUBLE) / 2 AS smoothed_days, CAST(MAX(transport_days) - 5 AS DOUBLE) AS p90_days FROM po_delivery GROUP BY vendor, warehouse, mode"""


def previous(t):
    days = F.col("transport_days").cast("double")
    return t.po_delivery.groupBy("vendor", "warehouse", "mode").agg(
        F.avg(days).alias("mean_days"), F.min(days).alias("mode_days"), (F.max(days) / 2).alias("smoothed_days"),
        (F.max(days) - 5).alias("p90_days"),
    )


fallback_step("o_fallback", "po_delivery")
ranges_step("o_ranges", "o_fallback", "o_previous")
ranges_step("o_bare_ranges", "o_fallback", None)
mapping_step("o_map", "po_delivery", "o_ranges", 5)
mapping_step("o_map_stats", "po_delivery", "o_ranges", 5, "stats_mean")


@query("fallback_means", "SELECT * FROM o_fallback", "fallback_days")
def _(t):
    return leadtime.fallback_means(t.po_delivery)


@query("lead_time_ranges", "SELECT vendor, warehouse, mode, NULLIF(low, 'inf'::DOUBLE) AS low, NULLIF(high, 'inf'::DOUBLE) AS high, NULLIF(mean, 'inf'::DOUBLE) AS mean, NULLIF(stats_mean, 'inf'::DOUBLE) AS stats_mean FROM o_ranges", "low high mean stats_mean")
def _(t):
    ranges = leadtime.lead_time_ranges(previous(t), leadtime.fallback_means(t.po_delivery))
    # Open ends show as null: the comparison rounds numbers.
    shown = [F.when(F.col(c) < float("inf"), F.col(c)).alias(c) for c in ("low", "high", "mean", "stats_mean")]
    return ranges.select("vendor", "warehouse", "mode", *shown)


SHOWN = ("ponum", "poline", "vendor", "warehouse", "item", "transport_days", "mode", "original_mode", "predicted_mode")


def corrected(t, **options):
    ranges = leadtime.lead_time_ranges(previous(t), leadtime.fallback_means(t.po_delivery))
    return leadtime.correct_modes(t.po_delivery, ranges, **options).select(*SHOWN)


def correction_sql(mapping: str) -> str:
    return f"""
SELECT d.ponum, d.poline, d.vendor, d.warehouse, d.item, d.transport_days, m.predicted AS mode, d.mode AS original_mode, m.predicted AS predicted_mode
FROM po_delivery d JOIN {mapping} m ON {ON_KEYS.format(m='m', s='d')}"""


@query("mode_correction", correction_sql("o_map"))
def _(t):
    return corrected(t)


@query("mode_correction_by_statistics", correction_sql("o_map_stats"))
def _(t):
    return corrected(t, fallback_for_candidates=False)


# Shipment grain, then the correction at tolerance 0.
STEPS["o_shipments"] = """
SELECT warehouse, vendor, invoice_date, delivery_date, mode, AVG(CAST(transport_days AS DOUBLE)) AS transport_days, COUNT(DISTINCT ponum || '-' || poline) AS shipment_size
FROM po_delivery GROUP BY warehouse, vendor, invoice_date, delivery_date, mode"""
fallback_step("o_ship_fallback", "o_shipments")
ranges_step("o_ship_ranges", "o_ship_fallback", "o_previous")
mapping_step("o_ship_map", "o_shipments", "o_ship_ranges", 0)
ranges_step("o_first_ranges", "o_ship_fallback", None)
mapping_step("o_first_map", "o_shipments", "o_first_ranges", 0)


def stats_steps(name: str, mapping: str, source: str) -> None:
    STEPS[f"{name}_rows"] = f"""
SELECT s.warehouse, s.vendor, m.predicted AS mode, s.invoice_date, CAST(s.transport_days AS DOUBLE) AS days FROM {source} s JOIN {mapping} m ON {ON_KEYS.format(m='m', s='s')} WHERE s.transport_days IS NOT NULL"""
    STEPS[f"{name}_modes"] = f"""
SELECT warehouse, vendor, mode, days FROM (SELECT warehouse, vendor, mode, days, ROW_NUMBER() OVER (PARTITION BY warehouse, vendor, mode ORDER BY COUNT(*) DESC, days) AS rn
  FROM {name}_rows GROUP BY warehouse, vendor, mode, days) x WHERE rn = 1"""
    STEPS[name] = f"""
SELECT r.warehouse, r.vendor, r.mode, AVG(r.days) AS mean_days, stddev_samp(r.days) AS std_days, quantile_cont(r.days, 0.6) AS p60_days, quantile_cont(r.days, 0.9) AS p90_days,
  MAX(m.days) AS mode_days, list_reduce(list(r.days ORDER BY r.invoice_date, r.days), lambda s, x: 0.2 * x + 0.8 * s) AS smoothed_days, COUNT(*) AS samples,
  CAST(NULL AS DOUBLE) AS cost_per_kg, CAST(NULL AS DOUBLE) AS base_charge
FROM {name}_rows r JOIN {name}_modes m ON m.warehouse = r.warehouse AND m.vendor = r.vendor AND m.mode = r.mode GROUP BY r.warehouse, r.vendor, r.mode"""


stats_steps("o_stats_again", "o_ship_map", "o_shipments")
stats_steps("o_stats", "o_first_map", "o_shipments")
fallback_step("o_line_fallback", "po_delivery")
ranges_step("o_line_ranges", "o_line_fallback", "o_previous")
mapping_step("o_line_map", "po_delivery", "o_line_ranges", 0)
stats_steps("o_line_stats", "o_line_map", "po_delivery")
STATS = "mean_days std_days p60_days p90_days mode_days smoothed_days"


@query("shipments", "SELECT * FROM o_shipments", "transport_days")
def _(t):
    return leadtime.shipments(t.po_delivery)


@query("transport_stats", "SELECT * FROM o_stats_again", STATS)
def _(t):
    return leadtime.transport_stats(t.po_delivery, previous(t))


@query("transport_stats_first_run", "SELECT * FROM o_stats", STATS)
def _(t):
    return leadtime.transport_stats(t.po_delivery)


@query("transport_stats_by_line", "SELECT * FROM o_line_stats", STATS)
def _(t):
    return leadtime.transport_stats(t.po_delivery, previous(t), shipment_grain=False)


@query(
    "smoothed_days",
    """
SELECT vendor, warehouse, list_reduce(list(CAST(transport_days AS DOUBLE) ORDER BY invoice_date, transport_days), lambda s, x: 0.3 * x + 0.7 * s) AS smoothed
FROM po_delivery WHERE transport_days IS NOT NULL GROUP BY vendor, warehouse""",
    "smoothed",
)
def _(t):
    return smoothed(t.po_delivery, ["vendor", "warehouse"], "invoice_date", "transport_days", 0.3, "smoothed")


STEPS["o_last_batches"] = """
SELECT * FROM po_delivery QUALIFY ROW_NUMBER() OVER (PARTITION BY ponum, split_part(poline, '-', 1) ORDER BY invoice_date DESC, poline DESC, vendor DESC, warehouse DESC, item DESC,
  ordered_qty DESC, received_qty DESC, po_entry_date DESC, delivery_date DESC, prepare_days DESC, transport_days DESC, mode DESC, is_closed DESC) = 1"""
STEPS["o_prepare_modes"] = """
SELECT item, warehouse, vendor, prepare_days FROM (SELECT item, warehouse, vendor, prepare_days, ROW_NUMBER() OVER (PARTITION BY item, warehouse, vendor ORDER BY COUNT(*) DESC, prepare_days) AS rn
  FROM o_last_batches GROUP BY item, warehouse, vendor, prepare_days) x WHERE rn = 1"""
STEPS["o_prepare"] = """
SELECT r.item, r.warehouse, r.vendor, AVG(CAST(r.prepare_days AS DOUBLE)) AS mean_prep, stddev_samp(r.prepare_days) AS std_prep, CAST(MAX(m.prepare_days) AS DOUBLE) AS mode_prep,
  quantile_cont(CAST(r.prepare_days AS DOUBLE), 0.6) AS p60_prep, quantile_cont(CAST(r.prepare_days AS DOUBLE), 0.9) AS p90_prep, COUNT(*) AS samples,
  list_reduce(list(CAST(r.prepare_days AS DOUBLE) ORDER BY r.invoice_date, r.prepare_days), lambda s, x: 0.3 * x + 0.7 * s) AS smoothed_prep
FROM o_last_batches r JOIN o_prepare_modes m ON m.item = r.item AND m.warehouse = r.warehouse AND m.vendor = r.vendor GROUP BY r.item, r.warehouse, r.vendor"""


@query("prepare_stats", "SELECT * FROM o_prepare", "mean_prep std_prep mode_prep p60_prep p90_prep smoothed_prep")
def _(t):
    return leadtime.prepare_stats(t.po_delivery)


STEPS["o_pref_source"] = "SELECT *, CASE WHEN mode = 'Courier' THEN 'Air' ELSE mode END AS flown FROM po_delivery"
ranges_step("o_pref_ranges", "o_fallback", "o_stats")
mapping_step("o_pref_map", "po_delivery", "o_pref_ranges", 0)
STEPS["o_preference"] = f"""
SELECT item, warehouse, vendor, mode, CAST(ROW_NUMBER() OVER (PARTITION BY item, warehouse, vendor ORDER BY n DESC, mode) AS INTEGER) AS rank, n AS count,
  CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY item, warehouse, vendor) AS confidence, last_used
FROM (SELECT d.item, d.warehouse, d.vendor, CASE WHEN m.predicted = 'Courier' THEN 'Air' ELSE m.predicted END AS mode, COUNT(*) AS n, MAX(d.delivery_date) AS last_used
  FROM po_delivery d JOIN o_pref_map m ON {ON_KEYS.format(m='m', s='d')} WHERE d.transport_days IS NOT NULL GROUP BY d.item, d.warehouse, d.vendor, 4) x"""
STEPS["o_smart"] = """
SELECT p.item, p.warehouse, p.vendor, p.mode, COALESCE(q.mean_prep, 0) + COALESCE(s.mean_days, v.static_days, 0) AS mean_lead, COALESCE(q.mode_prep, 0) + COALESCE(s.mode_days, v.static_days, 0) AS mode_lead,
  COALESCE(q.p60_prep, 0) + COALESCE(s.p60_days, v.static_days) AS p60_lead, COALESCE(q.p90_prep, 0) + COALESCE(s.p90_days, v.static_days, 0) AS p90_lead,
  COALESCE(q.smoothed_prep, 0) + COALESCE(s.smoothed_days, 0) AS smoothed_lead, sqrt(COALESCE(q.std_prep, 0) * COALESCE(s.std_days, 0)) AS lead_std, q.p60_prep,
  CAST(COALESCE(s.p60_days, v.static_days) AS DOUBLE) AS p60_transport, least(q.samples, s.samples) AS samples,
  CASE WHEN q.p60_prep IS NULL THEN 'FALLBACK_WLEAD' WHEN s.p60_days IS NOT NULL THEN 'SMART' WHEN v.static_days IS NOT NULL THEN 'SEMI_SMART_STATIC' ELSE 'MISSING_TRANSPORT' END AS source,
  CAST(CASE WHEN q.p60_prep IS NULL THEN 3 WHEN s.p60_days IS NOT NULL THEN 0 WHEN v.static_days IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS fallback_level,
  CASE WHEN p.mode = 'Air' THEN 'Y' END AS air_flag
FROM o_preference p LEFT JOIN o_prepare q ON q.item = p.item AND q.warehouse = p.warehouse AND q.vendor = p.vendor
LEFT JOIN o_stats s ON s.vendor = p.vendor AND s.warehouse = p.warehouse AND s.mode = p.mode LEFT JOIN vendor_master v ON v.vendor = p.vendor AND v.mode = p.mode
WHERE COALESCE(s.p60_days, v.static_days) IS NOT NULL"""
SMART = "mean_lead mode_lead p60_lead p90_lead smoothed_lead lead_std p60_prep p60_transport"


def preference(t):
    return leadtime.transport_preference(t.po_delivery, leadtime.transport_stats(t.po_delivery))


@query("transport_preference", "SELECT * FROM o_preference", "confidence")
def _(t):
    return preference(t)


def smart(t):
    rows = materialised(t.po_delivery)
    stats = materialised(leadtime.transport_stats(rows))
    prefer = leadtime.transport_preference(rows, stats)
    return leadtime.smart_lead_times(prefer, leadtime.prepare_stats(rows), stats, t.vendor_master)


@query("smart_lead_times", "SELECT * FROM o_smart", SMART)
def _(t):
    return smart(t)


# The static fallbacks: statistics exist for vessels only.
@query(
    "smart_lead_times_with_gaps",
    "SELECT * FROM o_smart_gaps",
    SMART,
)
def _(t):
    rows = materialised(t.po_delivery)
    stats = materialised(leadtime.transport_stats(rows))
    prefer = leadtime.transport_preference(rows, stats)
    prepared = leadtime.prepare_stats(rows).where(F.col("warehouse") == "5")
    vendors = t.vendor_master.where(F.col("is_active") == "Y")
    return leadtime.smart_lead_times(prefer, prepared, stats.where(F.col("mode") == "Vessel"), vendors)


STEPS["o_prepare_gaps"] = "SELECT * FROM o_prepare WHERE warehouse = '5'"
STEPS["o_stats_gaps"] = "SELECT * FROM o_stats WHERE mode = 'Vessel'"
STEPS["o_vendor_gaps"] = "SELECT * FROM vendor_master WHERE is_active = 'Y'"
STEPS["o_smart_gaps"] = (
    STEPS["o_smart"].replace("JOIN o_prepare q", "JOIN o_prepare_gaps q").replace("JOIN o_stats s", "JOIN o_stats_gaps s").replace("JOIN vendor_master v", "JOIN o_vendor_gaps v")
)
STEPS["o_best_lead"] = """
SELECT s.item, s.warehouse, s.vendor, s.mode, s.source, s.p60_lead, s.p60_prep, s.p60_transport FROM o_smart s JOIN item_master i ON i.item = s.item AND i.vendor = s.vendor
LEFT JOIN o_preference p ON p.item = s.item AND p.warehouse = s.warehouse AND p.vendor = s.vendor AND p.mode = s.mode
QUALIFY ROW_NUMBER() OVER (PARTITION BY s.item, s.warehouse ORDER BY p.rank NULLS LAST, s.mode) = 1"""


@query("best_lead_time", "SELECT * FROM o_best_lead", "p60_lead p60_prep p60_transport")
def _(t):
    return demand.best_lead_time(smart(t), t.item_master, preference(t))


# Delivery records: corrected history and invoiced open lines, numbered together.
ranges_step("o_record_ranges", "o_fallback", "o_stats")
mapping_step("o_record_map", "po_delivery", "o_record_ranges", 2)
STEPS["o_record_rows"] = f"""
SELECT d.ponum, d.poline, d.item, d.vendor, d.warehouse, d.ordered_qty, d.received_qty AS shipped_qty, d.po_entry_date, d.invoice_date, d.delivery_date,
  CASE WHEN m.predicted = 'Courier' THEN 'Air' ELSE m.predicted END AS mode, 'HIST' AS source, d.is_closed
FROM po_delivery d JOIN o_record_map m ON {ON_KEYS.format(m='m', s='d')}
UNION ALL SELECT ponum, poline, item, vendor, warehouse, ordered_qty, in_transit_qty, po_entry_date, invoice_date, CAST(NULL AS DATE), mode, 'GIT', 'N' FROM o_open_lines WHERE invoice_date IS NOT NULL"""
STEPS["o_records"] = """
SELECT ponum, poline, item, vendor, warehouse, ordered_qty, shipped_qty, po_entry_date, invoice_date, delivery_date, mode, source, is_closed,
  CASE WHEN n > 1 THEN poline || '-' || CAST(rn AS VARCHAR) ELSE poline END AS unified_poline, split_part(poline, '-', 1) AS base_poline, COUNT(*) OVER (PARTITION BY ponum, split_part(poline, '-', 1)) > 1 AS is_split
FROM (SELECT *, COUNT(*) OVER (PARTITION BY ponum, poline) AS n, ROW_NUMBER() OVER (PARTITION BY ponum, poline ORDER BY invoice_date NULLS LAST, delivery_date NULLS LAST, item, vendor, warehouse,
  ordered_qty, shipped_qty, po_entry_date, mode, source, is_closed) AS rn FROM o_record_rows) x"""


def records(t):
    from checks.orders import open_lines

    t.store("lines")
    rows = materialised(t.po_delivery)
    return delivery.delivery_records(rows, materialised(open_lines(t)), materialised(leadtime.transport_stats(rows)))


def combined(t):
    from checks.orders import open_lines

    t.store("lines")
    rows = materialised(t.po_delivery)
    return materialised(delivery.combined_deliveries(rows, open_lines(t), leadtime.transport_stats(rows)))


@query("delivery_records", "SELECT * FROM o_records", "ordered_qty shipped_qty")
def _(t):
    return records(t)


def behaviour_steps(name: str, closed: bool) -> None:
    rows = "SELECT *, split_part(poline, '-', 1) AS base FROM o_records" + (" WHERE is_closed = 'Y'" if closed else "")
    STEPS[f"{name}_batches"] = f"SELECT ponum, base, invoice_date, SUM(shipped_qty) AS qty FROM ({rows}) r WHERE invoice_date IS NOT NULL GROUP BY ponum, base, invoice_date"
    STEPS[f"{name}_lines"] = f"""
SELECT ponum, base, COUNT(*) AS n, SUM(qty) AS total, MAX(qty) AS largest, AVG(qty) AS average, MAX(invoice_date) - MIN(invoice_date) AS spread, arg_max(qty, invoice_date) AS tail FROM {name}_batches GROUP BY ponum, base"""
    STEPS[f"{name}_heads"] = f"""
SELECT ponum, base, vendor, mode, warehouse, item FROM ({rows}) r
QUALIFY ROW_NUMBER() OVER (PARTITION BY ponum, base ORDER BY poline NULLS LAST, invoice_date NULLS LAST, delivery_date NULLS LAST, vendor, mode, warehouse, item) = 1"""
    STEPS[name] = f"""
SELECT h.vendor, h.mode, h.warehouse, h.item, COUNT(*) AS total_pos, AVG(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS split_rate, COALESCE(AVG(CASE WHEN n > 1 THEN n END), 1.0) AS avg_batch_count,
  AVG(average) AS typical_batch_qty, COALESCE(AVG(CASE WHEN spread > 0 THEN spread END), 0.0) AS avg_spread_days, COALESCE(AVG(CASE WHEN spread > 0 THEN CAST(spread AS DOUBLE) / (n - 1) END), 0.0) AS avg_interval_days,
  AVG(CASE WHEN total > 0 THEN tail / total ELSE 0.0 END) AS avg_tail_share, quantile_cont(CAST(largest AS DOUBLE), 0.9) AS max_batch_qty
FROM {name}_lines l JOIN {name}_heads h ON h.ponum = l.ponum AND h.base = l.base GROUP BY h.vendor, h.mode, h.warehouse, h.item"""


behaviour_steps("o_behaviour", True)
behaviour_steps("o_all_behaviour", False)
HABITS = "split_rate avg_batch_count typical_batch_qty avg_spread_days avg_interval_days avg_tail_share max_batch_qty"
STEPS["o_profile"] = """
SELECT vendor, mode, warehouse, item, CASE WHEN split_rate > 0.5 AND avg_batch_count >= 2 AND avg_spread_days >= 7 THEN 'Y' ELSE 'N' END AS is_batch_prone, max_batch_qty AS batch_trigger_qty,
  CAST(ceil(avg_batch_count) AS INTEGER) AS predicted_batch_count, typical_batch_qty AS predicted_batch_qty, avg_interval_days AS predicted_interval_days, avg_tail_share AS predicted_tail_share FROM o_behaviour"""


@query("delivery_behaviour", "SELECT * FROM o_behaviour", HABITS)
def _(t):
    return delivery.delivery_behaviour(combined(t))


@query("delivery_behaviour_all_lines", "SELECT * FROM o_all_behaviour", HABITS)
def _(t):
    return delivery.delivery_behaviour(combined(t), closed_only=False)


@query("batch_profile", "SELECT * FROM o_profile", "batch_trigger_qty predicted_batch_qty predicted_interval_days predicted_tail_share")
def _(t):
    return delivery.batch_profile(delivery.delivery_behaviour(combined(t)))


# Freight.
def _converted(name: str) -> str:
    return f"CASE WHEN f.currency = 'JPY' THEN f.{name} WHEN x.method = 'M' THEN f.{name} * x.rate WHEN x.method = 'D' THEN f.{name} / x.rate END AS {name}_base"


STEPS["o_converted"] = f"""
SELECT f.*, {_converted('invoice_total')}, {_converted('item_total')}, {_converted('freight')} FROM freight f
LEFT JOIN fx x ON x.from_currency = f.currency AND x.to_currency = 'JPY' AND x.usage_type = 'SPOT' AND date_trunc('month', x.valid_date) = date_trunc('month', f.invoice_date)"""
STEPS["o_plausible"] = """
SELECT *, freight_base / NULLIF(item_total_base, 0) AS freight_share FROM o_converted WHERE mode <> 'Vessel' OR freight_base / NULLIF(item_total_base, 0) <= 0.05"""
STEPS["o_freight_sums"] = """
SELECT global_code, warehouse, mode, COUNT(*) AS n, AVG(gross_kg) AS mx, AVG(freight_base) AS my, regr_sxx(freight_base, gross_kg) AS sxx, regr_sxy(freight_base, gross_kg) AS sxy, regr_syy(freight_base, gross_kg) AS syy,
  SUM(gross_kg * freight_base) / SUM(gross_kg * gross_kg) AS through_zero
FROM o_plausible_default WHERE freight_base IS NOT NULL AND gross_kg IS NOT NULL GROUP BY global_code, warehouse, mode HAVING COUNT(*) >= 3 AND regr_sxx(freight_base, gross_kg) > 0"""
STEPS["o_plausible_default"] = STEPS["o_plausible"].replace("<= 0.05", "<= 0.2")
# Candidate lines by residual: the free fit if allowed, else the better edge.
STEPS["o_freight_fits"] = """
SELECT s.*, c.base, c.rate, syy + n * pow(my - c.base - c.rate * mx, 2) - 2 * c.rate * sxy + c.rate * c.rate * sxx AS residual, c.kind FROM o_freight_sums s,
LATERAL (SELECT my - sxy / sxx * mx AS base, sxy / sxx AS rate, 0 AS kind UNION ALL SELECT greatest(my, 0), 0.0, 1 UNION ALL SELECT 0.0, greatest(through_zero, 0), 2) c"""
STEPS["o_freight_model"] = """
SELECT global_code, warehouse, mode, base AS base_charge, rate AS cost_per_kg, n AS samples, CASE WHEN syy > 0 THEN 1 - residual / syy END AS r_square FROM o_freight_fits
WHERE kind > 0 OR (base >= 0 AND rate >= 0)
QUALIFY ROW_NUMBER() OVER (PARTITION BY global_code, warehouse, mode ORDER BY CASE WHEN kind = 0 THEN 0 ELSE 1 END, residual, kind) = 1"""
STEPS["o_freight_by_vendor"] = """
SELECT v.vendor, m.global_code, m.warehouse, m.mode, round_even(m.base_charge * 100, 0) / 100 AS base_charge, round_even(m.cost_per_kg * 100, 0) / 100 AS cost_per_kg, m.samples, round_even(m.r_square * 10000, 0) / 10000 AS r_square
FROM o_freight_model m LEFT JOIN (SELECT DISTINCT global_code, vendor FROM vendor_master) v ON v.global_code = m.global_code"""
AMOUNTS = "item_total invoice_total freight gross_kg invoice_total_base item_total_base freight_base"


@query("charges_in_base_currency", "SELECT * FROM o_converted", AMOUNTS)
def _(t):
    return freight.in_base_currency(t.freight, t.fx)


@query("plausible_charges", "SELECT * FROM o_plausible_default", AMOUNTS + " freight_share")
def _(t):
    return freight.plausible_charges(freight.in_base_currency(t.freight, t.fx))


@query("freight_model", "SELECT * FROM o_freight_model", "base_charge cost_per_kg r_square")
def _(t):
    return freight.freight_model(freight.plausible_charges(freight.in_base_currency(t.freight, t.fx)))


@query("freight_by_vendor", "SELECT * FROM o_freight_by_vendor", "base_charge cost_per_kg r_square")
def _(t):
    return freight.analyse_freight(t.freight, t.fx, t.vendor_master)


def lead_times(t):
    from checks.orders import open_lines

    # Deliveries, open lines, charges, items and places are all made of order lines.
    t.store("lines")
    return analyse_lead_times(t.po_delivery, open_lines(t), t.vendor_master, t.freight, t.fx)


@query(
    "lead_time_run",
    """
SELECT s.* REPLACE (f.cost_per_kg AS cost_per_kg, f.base_charge AS base_charge) FROM o_stats s
LEFT JOIN o_freight_by_vendor f ON f.vendor = s.vendor AND f.warehouse = s.warehouse AND f.mode = s.mode""",
    STATS + " cost_per_kg base_charge",
)
def _(t):
    return lead_times(t).transport


def taken_in(t, statistic, *context):
    """Deliveries in three steps by order, so that later steps bring late rows, and one that brings nothing."""
    state, results = new_table(t, "state", statistic.date, statistic.keys), new_table(t, "results")
    rows = materialised(t.po_delivery)
    third = F.pmod(F.col("ponum").cast("bigint"), F.lit(3))
    for part in (third == 0, third == 2, third == 1, F.lit(False)):
        out = states.advance(statistic, state, results, rows.where(part), *context)
    return out


@query("transport_stats_in_steps", "SELECT * FROM o_stats_again", STATS)
def _(t):
    return taken_in(t, states.TRANSPORT, materialised(previous(t)))


@query("prepare_stats_in_steps", "SELECT * FROM o_prepare", "mean_prep std_prep mode_prep p60_prep p90_prep smoothed_prep")
def _(t):
    return taken_in(t, states.PREPARE)


@query("transport_preference_in_steps", "SELECT * FROM o_preference", "confidence")
def _(t):
    return taken_in(t, states.PREFERENCE, materialised(leadtime.transport_stats(t.po_delivery)))
