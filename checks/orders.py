"""Purchase-order lines and order changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import STEPS, query
from checks.sources import new_table
from checks.views import AS_OF
from stowage.functions.modes import mode_of_code, static_days, vendor_type
from stowage.operators import orders, po
from stowage.plans import intake

MODE_OF_CODE = (
    "CASE WHEN TRIM({c}) IN ('50', '53', '60') THEN 'Air' WHEN TRIM({c}) = '55' THEN 'Courier' WHEN TRIM({c}) = '20' THEN 'Vessel' ELSE 'Truck' END"
)


@query(
    "transport_codes",
    f"""
SELECT "STSPCD" AS code, "STTPTC" AS raw, {MODE_OF_CODE.format(c='"STTPTC"')} AS mode,
  CAST(CASE WHEN TRIM("STTPTC") IN ('50', '53', '60', '55', '20') THEN "STNMDY" ELSE 3 END AS INTEGER) AS days FROM dst""",
)
def _(t):
    mode = mode_of_code(F.col("STTPTC"))
    return t.dst.select(
        F.col("STSPCD").alias("code"), F.col("STTPTC").alias("raw"), mode.alias("mode"),
        static_days(mode, F.col("STNMDY")).alias("days"),
    )


@query(
    "vendor_types",
    """
SELECT "VENDOR" AS vendor, "VTYPE" AS vtype, CASE WHEN "VENDOR" IN (99908, 99909) THEN 'INTERNAL' WHEN "VTYPE" = 'EDIC' THEN 'OVERSEA_DC'
  WHEN "VTYPE" IN ('ACGC', 'EXTC') THEN 'OVERSEA_EXTERNAL' ELSE 'DOMESTIC_EXTERNAL' END AS vendor_type FROM avm""",
)
def _(t):
    return t.avm.select(
        F.col("VENDOR").alias("vendor"), F.col("VTYPE").alias("vtype"),
        vendor_type(F.col("VTYPE"), F.col("VENDOR")).alias("vendor_type"),
    )


DAYS = "ponum, poline, vendor, item, invoice_date"


@query(
    "stage_days",
    f"""
SELECT {DAYS}, CAST(invoice_date - po_entry_date AS INTEGER) AS prepare_days, CAST(delivery_date - invoice_date AS INTEGER) AS transport_days,
  CAST(delivery_date - po_entry_date AS INTEGER) AS total_days FROM po_delivery""",
)
def _(t):
    return po.stage_days(t.po_delivery).select(
        *DAYS.split(", "), "prepare_days", "transport_days", "total_days"
    )


@query(
    "truck_day_repair",
    f"""
SELECT {DAYS}, CAST(CASE WHEN tr < 0 THEN total WHEN tr > 7 THEN pr + tr - 7 ELSE pr END AS INTEGER) AS prepare_days,
  CAST(CASE WHEN tr < 0 THEN 0 WHEN tr > 7 THEN 7 ELSE tr END AS INTEGER) AS transport_days, CAST(total AS INTEGER) AS total_days,
  CASE WHEN tr < 0 THEN 'NEGATIVE_TRANSPORT_FIXED' WHEN tr > 7 THEN 'TRUCK_OVERSHOOT_CORRECTED' ELSE 'OK' END AS transport_flag
FROM (SELECT *, delivery_date - 5 - invoice_date AS tr, invoice_date - po_entry_date AS pr, delivery_date - 5 - po_entry_date AS total FROM po_delivery) d""",
)
def _(t):
    early = t.po_delivery.withColumn("delivery_date", F.date_sub("delivery_date", 5))
    return po.repair_truck_days(po.stage_days(early)).select(
        *DAYS.split(", "), "prepare_days", "transport_days", "total_days", "transport_flag"
    )


STEPS["o_repaired"] = """
SELECT p.* REPLACE (CASE WHEN wrong THEN expected ELSE remaining_qty END AS remaining_qty), CAST(wrong AS INTEGER) AS remaining_corrected
FROM (SELECT *, remaining_qty > expected AS wrong FROM (SELECT *, ordered_qty - SUM(in_transit_qty) OVER (PARTITION BY ponum, poline) AS expected FROM po_in_transit) x) p"""
STEPS["o_ordered_rows"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY ponum, poline ORDER BY invoice_date NULLS LAST, vendor, warehouse, item, ordered_qty, in_transit_qty,
  remaining_qty, po_entry_date, mode, comment, remaining_corrected) AS rn FROM o_repaired"""
STEPS["o_tail_heads"] = "SELECT * FROM o_ordered_rows WHERE rn = 1 AND remaining_qty > 0 AND remaining_qty < ordered_qty"
OPEN = "ponum, poline, vendor, warehouse, item, ordered_qty, in_transit_qty, remaining_qty, po_entry_date, invoice_date, mode, comment, remaining_corrected"
STEPS["o_tailed"] = """
SELECT r.ponum, r.poline, r.vendor, r.warehouse, r.item, r.ordered_qty, r.in_transit_qty,
  CASE WHEN h.ponum IS NOT NULL THEN 0.0 ELSE r.remaining_qty END AS remaining_qty, r.po_entry_date, r.invoice_date, r.mode, r.comment, r.remaining_corrected
FROM o_repaired r LEFT JOIN o_tail_heads h ON h.ponum = r.ponum AND h.poline = r.poline
UNION ALL
SELECT ponum, poline, vendor, warehouse, item, ordered_qty, 0.0, remaining_qty, po_entry_date, NULL, mode, comment || '[VIRTUAL_TAIL]', 0 FROM o_tail_heads"""
STEPS["o_open_lines"] = """
SELECT ponum, CASE WHEN n > 1 THEN poline || '-' || CAST(rn AS VARCHAR) ELSE poline END AS poline, vendor, warehouse, item, ordered_qty, in_transit_qty,
  remaining_qty, po_entry_date, invoice_date, mode, comment, remaining_corrected
FROM (SELECT *, COUNT(*) OVER (PARTITION BY ponum, poline) AS n, ROW_NUMBER() OVER (PARTITION BY ponum, poline ORDER BY invoice_date NULLS LAST,
  vendor, warehouse, item, ordered_qty, in_transit_qty, remaining_qty, po_entry_date, mode, comment, remaining_corrected) AS rn FROM o_tailed) x"""


def open_lines(t):
    """Open lines after all repairs, with unique sub-lines."""
    return intake.open_order_lines(t.po_in_transit)


@query("open_order_run", f"SELECT {OPEN} FROM o_open_lines", "ordered_qty in_transit_qty remaining_qty")
def _(t):
    return open_lines(t)


@query("remaining_repair", f"SELECT {OPEN} FROM o_repaired", "ordered_qty in_transit_qty remaining_qty")
def _(t):
    return po.repair_remaining(t.po_in_transit)


@query("tail_lines", f"SELECT {OPEN} FROM o_tailed", "ordered_qty in_transit_qty remaining_qty")
def _(t):
    return po.add_tail_lines(po.repair_remaining(t.po_in_transit))


@query("numbered_sublines", f"SELECT {OPEN} FROM o_open_lines", "ordered_qty in_transit_qty remaining_qty")
def _(t):
    return open_lines(t)


@query(
    "tail_subline_labels",
    """
SELECT ponum, poline, CASE WHEN poline LIKE '%-%' THEN split_part(poline, '-', 1) ELSE poline END || '-' ||
  CAST(2 + CASE WHEN poline LIKE '%-%' THEN CAST(split_part(poline, '-', 2) AS INTEGER) ELSE 0 END AS VARCHAR) AS next_line FROM o_open_lines""",
)
def _(t):
    return open_lines(t).select("ponum", "poline", po.tail_subline(F.col("poline"), F.lit(2)).alias("next_line"))


@query(
    "snapshot_events",
    """
SELECT DATE '2001-08-01' AS snapshot_date, ponum, poline, item, warehouse, 'INVOICE' AS event_type, pc - pc0 AS qty_delta, pc AS qty_total, 'PCQTY' AS field_name FROM o_snapshots WHERE pc > pc0
UNION ALL SELECT DATE '2001-08-01', ponum, poline, item, warehouse, 'RECEIPT', pr - pr0, pr, 'PQREC' FROM o_snapshots WHERE pr > pr0
UNION ALL SELECT DATE '2001-08-01', b.ponum, b.poline, b.item, b.warehouse,
  CASE WHEN b."PQTRANSIT" > 0 OR b.ponum || '/' || b.poline IN (SELECT ponum || '/' || split_part(poline, '-', 1) FROM snapshot_delivered) THEN 'RECEIPT' ELSE 'CANCEL' END,
  CASE WHEN b."PQTRANSIT" > 0 THEN b."PQTRANSIT" ELSE b."PQORD" END, b."PQREC" + CASE WHEN b."PQTRANSIT" > 0 THEN b."PQTRANSIT" ELSE 0 END, 'PQREC'
FROM snapshot_before b WHERE NOT EXISTS (SELECT 1 FROM snapshot_now n WHERE n.ponum = b.ponum AND n.poline = b.poline)""",
    "qty_delta qty_total",
)
def _(t):
    return po.snapshot_events(t.snapshot_before, t.snapshot_now, t.snapshot_delivered, AS_OF)


STEPS["o_snapshot_log"] = """
SELECT DATE '2001-08-01' AS snapshot_date, ponum, poline, item, warehouse, 'INVOICE' AS event_type, pc - pc0 AS qty_delta, pc AS qty_total, 'PCQTY' AS field_name FROM o_snapshots WHERE pc > pc0
UNION ALL SELECT DATE '2001-08-01', ponum, poline, item, warehouse, 'RECEIPT', pr - pr0, pr, 'PQREC' FROM o_snapshots WHERE pr > pr0
UNION ALL SELECT DATE '2001-08-01', b.ponum, b.poline, b.item, b.warehouse,
  CASE WHEN b."PQTRANSIT" > 0 OR b.ponum || '/' || b.poline IN (SELECT ponum || '/' || split_part(poline, '-', 1) FROM snapshot_delivered) THEN 'RECEIPT' ELSE 'CANCEL' END,
  CASE WHEN b."PQTRANSIT" > 0 THEN b."PQTRANSIT" ELSE b."PQORD" END, b."PQREC" + CASE WHEN b."PQTRANSIT" > 0 THEN b."PQTRANSIT" ELSE 0 END, 'PQREC'
FROM snapshot_before b WHERE NOT EXISTS (SELECT 1 FROM snapshot_now n WHERE n.ponum = b.ponum AND n.poline = b.poline)"""


@query("snapshot_run", "SELECT * FROM o_snapshot_log", "qty_delta qty_total")
def _(t):
    """A first run, the run with events, and a run without any; what the log holds then."""
    snapshot, log = new_table(t, "snapshot"), new_table(t, "snapshot_log")
    for current in (t.snapshot_before, t.snapshot_now, t.snapshot_now):
        intake.snapshot_run(snapshot, log, current, t.snapshot_delivered, AS_OF)
    return log.read()


@query(
    "post_extract_run",
    """
SELECT w.item, w.warehouse, CAST(CASE WHEN c.child IS NOT NULL THEN c.child_safety_after WHEN EXISTS (SELECT 1 FROM o_transfers p WHERE p.parent = w.item AND p.warehouse = w.warehouse) THEN 0 ELSE w.safety END AS DOUBLE) AS safety,
  CASE WHEN w.item IN (SELECT parent FROM o_links WHERE type = '1') THEN 'Y' END AS rpflag, COALESCE(m.marked, 0) AS marked
FROM item_warehouse w LEFT JOIN o_transfers c ON c.child = w.item AND c.warehouse = w.warehouse
LEFT JOIN (SELECT x.warehouse, COUNT(*) AS marked FROM o_compared x WHERE gone OR qty <> clean_qty GROUP BY x.warehouse) m ON m.warehouse = w.warehouse""",
    "safety",
)
def _(t):
    """The stored tables after the run; orders marked in it are counted per warehouse."""
    items, places, raw, log = (new_table(t, n) for n in ("items", "places", "raw_orders", "order_changes"))
    items.overwrite(t.item_master)
    places.overwrite(t.item_warehouse.withColumn("safety", F.col("safety").cast("double")))
    raw.overwrite(t.raw_orders)
    intake.post_extract_run(items, places, raw, links(t), t.clean_orders, AS_OF, change_log=log)
    marked = log.read().groupBy("warehouse").agg(F.count(F.lit(1)).alias("marked"))
    return (
        places.read().select("item", "warehouse", "safety").join(items.read().select("item", "rpflag"), "item", "left")
        .join(marked, "warehouse", "left").na.fill(0, ["marked"])
    )


STEPS["o_snapshots"] = """
SELECT n.ponum, n.poline, n.item, n.warehouse, n."PCQTY" AS pc, b."PCQTY" AS pc0, n."PQREC" AS pr, b."PQREC" AS pr0
FROM snapshot_now n JOIN snapshot_before b ON b.ponum = n.ponum AND b.poline = n.poline"""
STEPS["o_compared"] = """
SELECT r.*, c.lord IS NULL AS gone, c.qty AS clean_qty, c.item AS clean_item FROM raw_orders r
LEFT JOIN clean_orders c ON c.lord = r.lord AND c.lline = r.lline AND c.warehouse = r.warehouse WHERE r.is_changed = 0"""


@query(
    "order_changes",
    """
SELECT lord, lline, warehouse, DATE '2001-08-01' AS change_date, 'ROW' AS field_name, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value,
  'Order line missing (deleted or cancelled)' AS change_reason FROM o_compared WHERE gone
UNION ALL SELECT lord, lline, warehouse, DATE '2001-08-01', 'qty', CAST(clean_qty AS VARCHAR), CAST(qty AS VARCHAR), 'qty changed' FROM o_compared WHERE NOT gone AND qty <> clean_qty
UNION ALL SELECT lord, lline, warehouse, DATE '2001-08-01', 'item', clean_item, item, 'item changed' FROM o_compared WHERE NOT gone AND item <> clean_item""",
)
def _(t):
    return orders.order_changes(t.raw_orders, t.clean_orders, AS_OF, ("qty", "item"))


@query(
    "marked_order_changes",
    """
SELECT lord, lline, warehouse, item, qty, is_changed, change_date, reason FROM raw_orders WHERE is_changed <> 0
UNION ALL SELECT lord, lline, warehouse, item, qty, CASE WHEN fields <> '' THEN 1 ELSE is_changed END, CASE WHEN fields <> '' THEN DATE '2001-08-01' ELSE change_date END,
  CASE WHEN fields <> '' THEN 'Field(s) changed: ' || fields ELSE reason END
FROM (SELECT *, CASE WHEN gone THEN 'ROW' WHEN item <> clean_item AND qty <> clean_qty THEN 'item, qty' WHEN item <> clean_item THEN 'item' WHEN qty <> clean_qty THEN 'qty' ELSE '' END AS fields FROM o_compared) x""",
    "qty",
)
def _(t):
    return orders.mark_order_changes(t.raw_orders, t.clean_orders, AS_OF, ("qty", "item"))


# Every parent has one child in the given links, so a second parent is added under the same child.
STEPS["o_links"] = """
SELECT parent, child, type, qty FROM replacement
UNION ALL SELECT REPLACE(parent, 'ECONOMY', 'STANDARD'), child, type, 2.0 FROM replacement"""
STEPS["o_transfers"] = """
SELECT p.warehouse, l.parent, l.child, p.safety AS parent_safety, c.safety AS child_safety_before, round(p.safety / l.qty, 2) AS child_safety_after, l.qty
FROM o_links l JOIN item_warehouse p ON p.item = l.parent AND p.safety > 0 JOIN item_warehouse c ON c.item = l.child AND c.warehouse = p.warehouse AND c.safety <= 0
WHERE l.type = '1' AND l.qty > 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY p.warehouse, l.child ORDER BY l.parent) = 1"""


def links(t):
    own = t.replacement.select("parent", "child", "type", "qty")
    second = own.withColumns({"parent": F.replace("parent", F.lit("ECONOMY"), F.lit("STANDARD")), "qty": F.lit(2.0)})
    return own.unionByName(second)


@query("safety_transfers", "SELECT * FROM o_transfers", "child_safety_after qty")
def _(t):
    return orders.safety_transfers(t.item_warehouse, links(t))


@query(
    "inherited_safety",
    """
SELECT w.item, w.warehouse, w.lead_days, w.moq, w.lot,
  CAST(CASE WHEN c.child IS NOT NULL THEN c.child_safety_after WHEN EXISTS (SELECT 1 FROM o_transfers p WHERE p.parent = w.item AND p.warehouse = w.warehouse) THEN 0 ELSE w.safety END AS DOUBLE) AS safety
FROM item_warehouse w LEFT JOIN o_transfers c ON c.child = w.item AND c.warehouse = w.warehouse""",
    "safety",
)
def _(t):
    return orders.inherit_safety(t.item_warehouse, links(t))


@query(
    "replaced_flags",
    "SELECT item, cost, vendor, CASE WHEN item IN (SELECT parent FROM replacement WHERE type = '1') THEN 'Y' END AS rpflag FROM item_master",
    "cost",
)
def _(t):
    return orders.flag_replaced(t.item_master, t.replacement)
