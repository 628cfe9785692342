"""The order-planning tables, derived from the given tables by SQL that both engines run.

Integer arithmetic only, so that both derive the same rows. ``mode_map`` is a constant; everything
else grows with the given tables.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from stowage.session import configure, materialised

AS_OF = dt.date(2001, 8, 1)
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Return flag to transport mode and static days.
MODE_ROWS = (("A", "Air", 5), ("N", "Vessel", 28), ("R", "Truck", 3))


def _digits(date: str) -> str:
    return f"CAST(YEAR({date}) * 10000 + MONTH({date}) * 100 + DAY({date}) AS INT)"


def _text(number: str) -> str:
    return f"CAST({number} AS VARCHAR(20))"


VIEWS: dict[str, str] = {
    "mode_map": " UNION ALL ".join(f"SELECT '{f}' AS rf, '{m}' AS mode, {d} AS static_days" for f, m, d in MODE_ROWS),
    "lines": """
SELECT o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(o.o_orderdate AS DATE) AS order_date,
  CAST(l.l_shipdate AS DATE) AS ship_date, l.l_quantity AS qty, l.l_extendedprice AS price, l.l_tax AS tax,
  l.l_returnflag AS rf, l.l_linestatus AS ls, p.p_brand, p.p_type, p.p_size, p.p_retailprice,
  CASE WHEN l.l_partkey % 2 = 0 THEN '5' ELSE '6' END AS warehouse,
  CONCAT(p.p_brand, '/', p.p_type) AS item
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "demand_lines": f"""
SELECT {_text('o_orderkey')} AS lord, {_text('l_linenumber')} AS lline, warehouse, item, order_date, qty FROM lines""",
    "po_delivery": f"""
SELECT {_text('o_orderkey')} AS ponum, {_text('l_linenumber')} AS poline, {_text('l_suppkey')} AS vendor,
  warehouse, item, qty AS ordered_qty, qty AS received_qty, order_date AS po_entry_date,
  order_date + CAST(l_partkey % 30 AS INT) AS invoice_date,
  order_date + CAST(l_partkey % 30 + (l_suppkey * 7 + l_linenumber * 3 + l_partkey) % 40 AS INT) AS delivery_date,
  CAST(l_partkey % 30 AS INT) AS prepare_days,
  CASE WHEN l_partkey % 41 <> 0 THEN CAST((l_suppkey * 7 + l_linenumber * 3 + l_partkey) % 40 AS INT) END AS transport_days,
  CASE l_partkey % 37 WHEN 0 THEN 'Courier' WHEN 1 THEN 'Train' WHEN 2 THEN 'International Truck' WHEN 3 THEN 'Unknown' ELSE m.mode END AS mode, CASE WHEN ls = 'F' THEN 'Y' ELSE 'N' END AS is_closed
FROM lines JOIN mode_map m USING (rf)""",
    "po_in_transit": f"""
SELECT {_text('o_orderkey')} AS ponum, {_text('l_linenumber')} AS poline, {_text('l_suppkey')} AS vendor, warehouse, item,
  qty AS ordered_qty,
  CAST(CASE l_partkey % 4 WHEN 0 THEN qty WHEN 1 THEN FLOOR(qty / 2) ELSE 0.0 END AS DOUBLE) AS in_transit_qty,
  CAST(CASE l_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN qty - FLOOR(qty / 2) WHEN 2 THEN FLOOR(qty / 3) ELSE qty END AS DOUBLE)
    AS remaining_qty,
  order_date AS po_entry_date,
  CASE WHEN l_partkey % 4 <= 1 OR l_partkey % 11 = 0 THEN order_date + CAST(l_partkey % 30 AS INT) END AS invoice_date,
  CASE WHEN l_partkey % 29 = 0 THEN 'International Train' ELSE m.mode END AS mode, CASE WHEN l_partkey % 11 = 0 THEN 'Delivery Date Confirmed' ELSE '' END AS comment
FROM lines JOIN mode_map m USING (rf) WHERE ls = 'O'""",
    "vendor_master": " UNION ALL ".join(
        f"""SELECT {_text('s_suppkey')} AS vendor, '{m}' AS mode, CAST({d} + s_suppkey % 5 AS INT) AS static_days,
  CONCAT('G', {_text('s_suppkey')}) AS global_code,
  CASE WHEN s_suppkey % 20 = 0 THEN 'N' ELSE 'Y' END AS is_active FROM supplier"""
        for _, m, d in MODE_ROWS
    ),
    "item_master": f"""
SELECT item, MIN(p_retailprice) AS cost, {_text('MIN(l_suppkey)')} AS vendor,
  CAST(NULL AS VARCHAR(1)) AS rpflag FROM lines GROUP BY item""",
    "item_warehouse": """
SELECT item, warehouse, CAST(7 + MIN(p_size) % 50 + LENGTH(item) AS INT) AS lead_days,
  CAST(1 + MAX(p_size) % 10 AS INT) AS moq, 5 AS lot, CAST(MIN(p_size) % 4 AS INT) AS safety
FROM lines GROUP BY item, warehouse
UNION ALL SELECT item, '7', 30, 4, 5, 2 FROM item_master WHERE LENGTH(item) % 5 = 1""",
    "stock": """
SELECT item, warehouse, CAST(COUNT(*) % 97 AS DOUBLE) AS available, CAST(SUM(l_partkey) % 53 AS DOUBLE) AS on_order
FROM lines GROUP BY item, warehouse""",
    "replacement": """
SELECT DISTINCT CONCAT(p_brand, '/ECONOMY') AS parent, CONCAT(p_brand, '/PROMO') AS child, '1' AS type,
  CAST(1.0 AS DOUBLE) AS qty, CASE WHEN LENGTH(p_brand) = 7 THEN 'Y' ELSE 'N' END AS using_existing FROM part""",
    "freight": f"""
SELECT CONCAT('G', {_text('l_suppkey')}) AS global_code, o_orderkey AS shipment, warehouse, m.mode AS mode,
  MIN(order_date) AS invoice_date,
  CASE WHEN l_suppkey % 10 = 9 THEN 'GBP' WHEN l_suppkey % 3 = 0 THEN 'JPY' WHEN l_suppkey % 3 = 1 THEN 'USD' ELSE 'EUR' END AS currency,
  SUM(price) AS item_total, SUM(price * (1 + tax)) AS invoice_total, SUM(price * tax) * CASE WHEN o_orderkey % 11 = 0 THEN 6 ELSE 1 END AS freight, SUM(qty) AS gross_kg
FROM lines JOIN mode_map m USING (rf) GROUP BY l_suppkey, o_orderkey, warehouse, m.mode""",
    "fx": " UNION ALL ".join(
        f"""SELECT DISTINCT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS valid_date, '{c}' AS from_currency,
  'JPY' AS to_currency, 'SPOT' AS usage_type, CAST({r} AS DOUBLE) AS rate, '{k}' AS method FROM orders"""
        for c, r, k in (("USD", "100.0 + MONTH(o_orderdate)", "M"), ("EUR", "0.008", "D"))
    ),
    # Two snapshots of the open orders: quantities rise for some lines, some vanish, some are new.
    "snapshot_lines": f"""
SELECT {_text('o_orderkey')} AS ponum, {_text('l_linenumber')} AS poline, MIN(item) AS item, MIN(warehouse) AS warehouse,
  SUM(qty) AS ordered, CAST(SUM(l_partkey) AS BIGINT) AS k FROM lines WHERE ls = 'O' GROUP BY o_orderkey, l_linenumber""",
    "snapshot_before": """
SELECT ponum, poline, item, warehouse, ordered AS "PQORD", CAST(FLOOR(ordered / 4) AS DOUBLE) AS "PQREC",
  CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(FLOOR(ordered / 2) AS DOUBLE) END AS "PCQTY",
  CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(FLOOR(ordered / 5) AS DOUBLE) END AS "PQTRANSIT"
FROM snapshot_lines WHERE k % 13 <> 1""",
    "snapshot_now": """
SELECT ponum, poline, item, warehouse, ordered AS "PQORD",
  CAST(FLOOR(ordered / 4) AS DOUBLE) + CASE WHEN k % 5 = 0 THEN 2.0 ELSE 0.0 END AS "PQREC",
  CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(FLOOR(ordered / 2) AS DOUBLE) END + CASE WHEN k % 4 = 0 THEN 3.0 ELSE 0.0 END AS "PCQTY"
FROM snapshot_lines WHERE k % 7 <> 2""",
    "snapshot_delivered": f"""
SELECT DISTINCT {_text('o_orderkey')} AS ponum, CONCAT({_text('l_linenumber')}, '-1') AS poline FROM lines
WHERE ls = 'O' AND l_suppkey % 2 = 0""",
    "clean_orders": f"""
SELECT {_text('o_orderkey')} AS lord, {_text('l_linenumber')} AS lline, warehouse, MIN(item) AS item, SUM(qty) AS qty
FROM lines WHERE (o_orderkey + l_linenumber) % 9 <> 0 GROUP BY o_orderkey, l_linenumber, warehouse""",
    "raw_orders": f"""
SELECT {_text('o_orderkey')} AS lord, {_text('l_linenumber')} AS lline, warehouse,
  CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE MIN(item) END AS item,
  SUM(qty) + CASE WHEN o_orderkey % 8 = 0 THEN 1.0 ELSE 0.0 END AS qty,
  CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS is_changed,
  CASE WHEN o_orderkey % 6 = 0 THEN DATE '2001-07-01' END AS change_date,
  CASE WHEN o_orderkey % 6 = 0 THEN 'earlier' END AS reason
FROM lines GROUP BY o_orderkey, l_linenumber, warehouse""",
    # Location tables: codes repeat, some descriptions hold no coordinates.
    "pick_locations": """
SELECT DISTINCT warehouse, CONCAT('L', CAST(l_partkey % 997 AS VARCHAR(20))) AS location, item, l_partkey % 997 AS slot
FROM lines""",
    "location_rows": """
SELECT warehouse, CONCAT(' ', location, ' ') AS location,
  CONCAT(CAST(slot % 31 AS VARCHAR(20)), ',', CAST(slot % 17 AS VARCHAR(20)), ',', CAST(slot % 3 AS VARCHAR(20))) AS description
FROM (SELECT DISTINCT warehouse, location, slot FROM pick_locations) p""",
    "stored_items": """
SELECT item, CASE WHEN LENGTH(item) % 3 = 0 THEN cost + 1 ELSE cost END AS cost,
  CASE WHEN LENGTH(item) % 4 = 0 THEN NULL ELSE vendor END AS vendor FROM item_master WHERE LENGTH(item) % 5 <> 0""",
}

# A series per part whose shape goes by the part's number, so that every class, model and order reason occurs; they grow with the parts.
VIEWS |= {
    "plan_weeks": "SELECT DISTINCT CAST(o_orderkey % 60 AS INT) AS n FROM orders",
    # Steady, rising, in one half of every four weeks, with rare peaks, rare, once long ago, new, and hardly alive.
    "shaped_parts": f"""
SELECT {_text('p_partkey')} AS item, CASE WHEN p_size % 2 = 0 THEN '5' ELSE '6' END AS warehouse, CAST(p_partkey % 8 AS INT) AS shape, CAST(p_partkey AS INT) AS number, CAST(p_size AS INT) AS size,
  p_retailprice AS cost, CASE p_partkey % 8 WHEN 1 THEN 40 WHEN 5 THEN 41 WHEN 6 THEN 5 ELSE 60 END AS weeks FROM part""",
    "shaped_weekly": """
SELECT item, warehouse, DATE '2001-07-30' - CAST(7 * n AS INT) AS week_start, CAST(qty AS DOUBLE) AS qty FROM (
  SELECT p.item, p.warehouse, w.n, CASE p.shape WHEN 0 THEN 10 + (p.number + w.n) % 5
    WHEN 1 THEN CASE WHEN w.n < 6 THEN (100 + p.size) * (6 - w.n) ELSE 1 END
    WHEN 2 THEN CASE w.n % 4 WHEN 0 THEN 40 + p.size WHEN 1 THEN 10 ELSE 0 END
    WHEN 3 THEN CASE WHEN w.n % 13 = 0 THEN 300 + p.size ELSE 2 END
    WHEN 4 THEN CASE WHEN w.n % 4 = 1 THEN 6 + (p.number + w.n) % 7 ELSE 0 END
    WHEN 5 THEN CASE WHEN w.n = 40 THEN 9 ELSE 0 END
    WHEN 6 THEN 3
    ELSE CASE WHEN w.n % 6 = 3 THEN 5 ELSE 0 END END AS qty
  FROM shaped_parts p JOIN plan_weeks w ON w.n < p.weeks) x WHERE qty > 0""",
    "shaped_items": f"SELECT item, cost, {_text('1 + size')} AS vendor, CAST(NULL AS VARCHAR(1)) AS rpflag FROM shaped_parts",
    # Some slow items are oversold while their safety stock is set below zero.
    "shaped_places": """
SELECT item, warehouse, CAST(7 + size % 50 AS INT) AS lead_days, CAST(1 + size % 10 AS INT) AS moq, 5 AS lot,
  CAST(CASE WHEN shape = 7 AND size % 2 = 0 THEN -5 ELSE 4 END AS INT) AS safety FROM shaped_parts""",
    "shaped_stock": """
SELECT item, warehouse, CAST(CASE WHEN shape = 7 THEN -3 WHEN shape = 3 THEN 50 ELSE 0 END AS DOUBLE) AS available,
  CAST(CASE WHEN shape = 0 THEN 5 ELSE 0 END AS DOUBLE) AS in_transit FROM shaped_parts""",
}

# Tables of the order system, under their own column names.
VIEWS |= {
    "ecl": f"""
SELECT {_digits('order_date')} AS "LODTE", {_text('o_orderkey')} AS "LORD", {_text('l_linenumber')} AS "LLINE",
  CONCAT(item, ' ') AS "LPROD", CASE WHEN l_linenumber = 7 THEN -qty ELSE qty END AS "LQORD",
  CASE WHEN ls = 'F' THEN qty ELSE 0.0 END AS "LQSHP", {_digits('order_date')} AS "LRDTE", {_digits('ship_date')} AS "LSDTE",
  CONCAT(warehouse, ' ') AS "LWHS", CASE WHEN l_partkey % 13 = 0 THEN 'CZ' ELSE 'CL' END AS "LID" FROM lines""",
    "ech": f"""
SELECT {_text('o_orderkey')} AS "HORD", '1' AS "HDTYP", CAST(500 + o_custkey * 7 AS INT) AS "HCUST",
  CASE WHEN o_orderkey % 17 = 0 THEN 'CZ' ELSE 'CH' END AS "HID" FROM orders""",
    "jsb": f"""
SELECT {_text('o_orderkey')} AS "SBHORD",
  CASE o_orderkey % 4 WHEN 0 THEN 'KIT' WHEN 1 THEN 'GW ' WHEN 2 THEN 'ZZZ' ELSE 'ASY' END AS "SBSWKT"
FROM orders WHERE o_orderkey % 3 = 0""",
    "iim": f"""
SELECT CONCAT(item, ' ') AS "IPROD", CASE LENGTH(item) % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'E' WHEN 2 THEN 'Q' ELSE 'K' END AS "IITYP",
  CONCAT(' part ', item) AS "IDESC", CONCAT('local ', item) AS "IDSCE", CAST(LENGTH(item) % 6 AS VARCHAR(20)) AS "ICLAS",
  CAST(100 + MAX(l_suppkey) AS INT) AS "IVEND", MIN(p_retailprice) AS "ISCST", CAST(MIN(p_size) % 5 AS DOUBLE) AS "ICUSA",
  CAST(COUNT(*) % 7 AS DOUBLE) AS "IONOD" FROM lines GROUP BY item""",
    "ili": """
SELECT warehouse AS "LWHS", CASE WHEN l_partkey % 19 = 0 THEN ' ' ELSE CONCAT('L', CAST(l_partkey % 997 AS VARCHAR(20))) END AS "LLOC",
  CONCAT(item, ' ') AS "LPROD", CASE WHEN l_partkey % 23 = 0 THEN '' ELSE CONCAT('S', CAST(l_partkey AS VARCHAR(20))) END AS "LLOT",
  CAST(COUNT(*) AS DOUBLE) AS "LOPB", SUM(qty) AS "LRCT", SUM(CASE WHEN ls = 'F' THEN qty ELSE 0.0 END) AS "LISSU",
  CAST(-COUNT(*) AS DOUBLE) AS "LADJU", CAST(l_partkey % 4 AS DOUBLE) AS "LIALOC" FROM lines GROUP BY warehouse, l_partkey, item""",
    "iwi": """
SELECT warehouse AS "WWHS", CONCAT(item, ' ') AS "WPROD", CASE WHEN LENGTH(item) = 14 THEN 'BARAKI' ELSE CONCAT('L', warehouse) END AS "WILOC",
  CAST(COUNT(*) AS DOUBLE) AS "WOPB", SUM(qty) AS "WRCT", SUM(qty) AS "WISS", CASE WHEN COUNT(*) % 2 = 0 THEN CAST(-COUNT(*) AS DOUBLE) ELSE 0.0 END AS "WADJ",
  CAST(MIN(p_size) % 2 AS DOUBLE) AS "WCUSA", CASE WHEN MIN(p_size) % 3 = 0 THEN NULL ELSE CAST(MIN(p_size) AS INT) END AS "WLOTS",
  CASE WHEN MAX(p_size) % 4 = 0 THEN NULL ELSE CAST(MAX(p_size) AS INT) END AS "WLEAD" FROM lines GROUP BY warehouse, item""",
    "icx": """
SELECT DISTINCT CAST(LENGTH(item) % 6 AS VARCHAR(20)) AS "CXCLAS", CASE LENGTH(item) % 6 WHEN 0 THEN 'MRS' WHEN 1 THEN 'SMT' WHEN 2 THEN 'ZZZ' WHEN 3 THEN 'HAT' ELSE 'EDB' END AS "CXPPLC",
  CONCAT('P', CAST(LENGTH(item) % 6 AS VARCHAR(20))) AS "CXATLC", CONCAT('G', CAST(LENGTH(item) % 6 AS VARCHAR(20))) AS "CXPGAC"
FROM lines WHERE LENGTH(item) % 6 <> 5""",
    "iix": """
SELECT CONCAT(item, ' ') AS "IXITMN", CASE WHEN MIN(p_size) % 4 = 0 THEN NULL ELSE CAST(MIN(p_size) * 10 AS DOUBLE) END AS "IXNWIG" FROM lines GROUP BY item""",
    "ilm": """
SELECT CONCAT(warehouse, ' ') AS "WWHS", CONCAT('L', CAST(l_partkey % 997 AS VARCHAR(20))) AS "WLOC",
  CASE WHEN l_partkey % 997 % 29 = 0 THEN 'no place' ELSE CONCAT(CAST(l_partkey % 31 AS VARCHAR(20)), ' , -', CAST(l_partkey % 17 AS VARCHAR(20)), '.5,', CAST(l_partkey % 3 AS VARCHAR(20))) END AS "WDESC",
  'N' AS "WLTYP", CAST(NULL AS VARCHAR(1)) AS "WZONE", CAST(l_partkey % 10 AS DOUBLE) AS "WVOLC", CAST(l_partkey % 12 AS DOUBLE) AS "WWGHC"
FROM (SELECT DISTINCT warehouse, l_partkey FROM lines) x""",
    "dps": """
SELECT DISTINCT CONCAT(p_brand, '/ECONOMY ') AS "PSPITM", CASE WHEN p_size = 7 THEN CONCAT('97', p_type) ELSE CONCAT(p_brand, '/', p_type, ' ') END AS "PSCITM",
  CASE WHEN p_type = 'PROMO' THEN '1' WHEN p_type = 'SMALL' THEN '1' ELSE '2' END AS "PSSTRF", 'Y' AS "PSUSES", CAST(1.0 AS DOUBLE) AS "PSCQTY" FROM part""",
    "avm": """
SELECT CAST(100 + s_suppkey AS INT) AS "VENDOR", CONCAT(s_name, ' ') AS "VNDNAM",
  CASE s_suppkey % 5 WHEN 0 THEN 'EDIC' WHEN 1 THEN 'LOCC' WHEN 2 THEN 'EXTC' ELSE 'DOMX' END AS "VTYPE" FROM supplier
UNION ALL SELECT CAST(10000 + s_suppkey * 5 AS INT), s_name, 'ACGX' FROM supplier
UNION ALL SELECT CAST(99907 + s_suppkey AS INT), s_name, 'EXTC' FROM supplier WHERE s_suppkey <= 2""",
    "avx": """
SELECT CAST(100 + s_suppkey AS INT) AS "VXVNDN", CONCAT('C', CAST(s_suppkey % 40 AS VARCHAR(20))) AS "VXSPCD" FROM supplier
UNION ALL SELECT CAST(10000 + s_suppkey * 5 AS INT), CONCAT('C', CAST(s_suppkey % 50 AS VARCHAR(20))) FROM supplier""",
    "dst": """
SELECT DISTINCT CONCAT('C', CAST(s_suppkey % 45 AS VARCHAR(20))) AS "STSPCD",
  CASE s_suppkey % 6 WHEN 0 THEN '20' WHEN 1 THEN '50' WHEN 2 THEN '55' WHEN 3 THEN ' ' WHEN 4 THEN '53' ELSE 'x' END AS "STTPTC",
  CAST(3 + s_suppkey % 25 AS INT) AS "STNMDY", CASE WHEN s_suppkey % 7 = 0 THEN 'XX' ELSE 'UR' END AS "STORTC" FROM supplier""",
    "gcc": f"""
SELECT DISTINCT {_digits("CAST(DATE_TRUNC('month', o_orderdate) AS DATE)")} AS "CCNVDT", CAST(100.0 + MONTH(o_orderdate) AS DOUBLE) AS "CCNVFC",
  'USD' AS "CCFRCR", 'JPY' AS "CCTOCR", 'SPOT ' AS "CCRTYP", CASE WHEN MONTH(o_orderdate) % 2 = 0 THEN ' ' ELSE 'D ' END AS "CCMETH" FROM orders""",
    "po_lines": """
SELECT o_orderkey, l_linenumber, MIN(l_suppkey) AS suppkey, MIN(l_partkey) AS partkey, MIN(item) AS item, MIN(warehouse) AS warehouse,
  MIN(order_date) AS order_date, SUM(qty) AS qty, COUNT(*) AS deliveries, MIN(ls) AS ls FROM lines GROUP BY o_orderkey, l_linenumber""",
    "hpo": f"""
SELECT warehouse AS "PWHSE", {_text('o_orderkey')} AS "PORD", {_text('l_linenumber')} AS "PLINE", CONCAT(item, ' ') AS "PPROD",
  CAST(9990 + suppkey AS INT) AS "PVEND", CASE WHEN partkey % 9 = 0 THEN 'PX' ELSE 'PO' END AS "PID", CAST(NULL AS VARCHAR(10)) AS "PCMT",
  qty AS "PQORD", CASE WHEN ls = 'F' THEN qty ELSE CAST(FLOOR(qty / 3) AS DOUBLE) END AS "PQREC", CAST(FLOOR(qty / 2) AS DOUBLE) AS "PCQTY",
  {_digits('order_date')} AS "PEDTE", {_digits('order_date + CAST(partkey % 30 AS INT)')} AS "PDDTE",
  {_digits('order_date + CAST(partkey % 25 AS INT)')} AS "HVDUE" FROM po_lines""",
    "dpo": f"""
SELECT {_text('o_orderkey')} AS "POPORD", CASE o_orderkey % 5 WHEN 0 THEN '20' WHEN 1 THEN '50' WHEN 2 THEN '  ' WHEN 3 THEN '55' ELSE '40' END AS "POTPTC",
  'UR' AS "POORTC", CASE WHEN o_orderkey % 2 = 0 THEN '5 ' ELSE '6 ' END AS "POWHCD" FROM orders WHERE o_orderkey % 4 <> 1""",
    "ith": f"""
SELECT {_text('o_orderkey')} AS "TREF", CONCAT(i.item, ' ') AS "TPROD", {_text('l_linenumber')} AS "THLIN", 'GI' AS "TTYPE",
  CONCAT('T', CAST(l_partkey AS VARCHAR(20))) AS "TLOT", {_digits('i.order_date + CAST(l_partkey % 30 AS INT)')} AS "TTDTE", i.bucket AS "TQTY",
  CAST(l_partkey AS INT) AS "TSEQ" FROM ith_rows i
UNION ALL SELECT {_text('o_orderkey')}, CONCAT(i.item, ' '), {_text('l_linenumber')}, 'GA', CONCAT('T', CAST(l_partkey AS VARCHAR(20))),
  {_digits('i.order_date + CAST(l_partkey % 30 + l_suppkey % 20 AS INT)')}, i.bucket, CAST(l_suppkey AS INT) FROM ith_rows i WHERE l_suppkey % 3 <> 0
UNION ALL SELECT {_text('o_orderkey')}, CONCAT(i.item, ' '), {_text('l_linenumber')}, 'H', CONCAT('T', CAST(l_partkey AS VARCHAR(20))),
  {_digits('i.order_date + CAST(l_partkey % 45 AS INT)')}, i.bucket, CAST(l_partkey AS INT) FROM ith_rows i WHERE l_partkey % 2 = 0""",
    "ith_rows": """
SELECT l.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.item, p.order_date, CAST(10 + FLOOR(l.qty / 25) * 10 AS DOUBLE) AS bucket
FROM lines l JOIN po_lines p ON l.o_orderkey = p.o_orderkey AND l.l_linenumber = p.l_linenumber""",
    "dil": f"""
SELECT CONCAT('I', {_text('o_orderkey')}) AS "ILPINN", CONCAT('C', CAST(l_suppkey % 50 AS VARCHAR(20))) AS "ILSPCD", CAST(FLOOR(price) AS DOUBLE) AS "ILINVP",
  qty AS "ILQTYI", {_text('o_orderkey')} AS "ILPORD", {_digits('order_date')} AS "ILDOFD" FROM lines""",
    "dih": f"""
SELECT {_digits('MIN(order_date)')} AS "IHINVD", CONCAT('H', CAST(o_orderkey % 5000 AS VARCHAR(20))) AS "IHSHPN", CONCAT('C', CAST(l_suppkey % 50 AS VARCHAR(20))) AS "IHSPCD",
  'USD' AS "IHPRCC", SUM(FLOOR(price) * qty) + SUM(qty) AS "IHPRCT", CONCAT('I', {_text('o_orderkey')}) AS "IHPINN", {_digits('MIN(order_date)')} AS "IHDOFD"
FROM lines GROUP BY o_orderkey, l_suppkey % 50""",
    "dpk": """
SELECT CONCAT('C', CAST(l_suppkey % 50 AS VARCHAR(20))) AS "PKSPCD", CONCAT('H', CAST(o_orderkey % 5000 AS VARCHAR(20))) AS "PKSHPN", qty AS "PKPKGW" FROM lines""",
    "dsh": """
SELECT DISTINCT CONCAT('H', CAST(o_orderkey % 5000 AS VARCHAR(20))) AS "SHSHPN", CONCAT('C', CAST(l_suppkey % 50 AS VARCHAR(20))) AS "SHSPCD",
  CASE l_suppkey % 50 % 4 WHEN 0 THEN '20' WHEN 1 THEN ' ' WHEN 2 THEN '55' ELSE '40' END AS "SHTPTC" FROM lines""",
    "iwm": """
SELECT CONCAT(CAST(c_nationkey AS VARCHAR(20)), '-', c_mktsegment) AS warehouse, CASE WHEN c_nationkey % 3 = 0 THEN 'JP' ELSE 'SG' END AS country,
  CONCAT('F', CAST(c_nationkey % 2 AS VARCHAR(20))) AS facility, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS status FROM customer""",
}


def needed(sql: str, catalogue: dict[str, str]) -> list[str]:
    """The catalogue entries a statement uses, directly or through others, in dependency order."""
    found: list[str] = []

    def visit(text: str, inside: str) -> None:
        for name in catalogue:
            if name != inside and name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                visit(catalogue[name], name)
                if name not in found:
                    found.append(name)

    visit(sql, "")
    return found


def with_views(sql: str, catalogue: dict[str, str] | None = None) -> str:
    """A statement preceded by the views it uses."""
    catalogue = VIEWS if catalogue is None else catalogue
    parts = [f"{name} AS ({catalogue[name]})" for name in needed(sql, catalogue)]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


class Tables:
    """The derived tables of one test folder, as lazy DataFrames by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self._base = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in BASE_TABLES}
        self._stored: dict[str, DataFrame] = {}

    def store(self, name: str) -> None:
        """Work a derived table out once; tables asked for later read the stored rows in place of joining it again."""
        if name not in self._stored:
            self._stored[name] = materialised(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in self._base):
            raise AttributeError(name)
        if name in self._base:
            return self._base[name]
        if name in self._stored:
            return self._stored[name]
        for table, df in self._base.items():
            df.createOrReplaceTempView(table)
        for table, df in self._stored.items():
            df.createOrReplaceTempView(table)
        # Quoted names are standard SQL; Spark quotes names with backticks.
        left = {view: sql for view, sql in VIEWS.items() if view not in self._stored}
        text = with_views(f"SELECT * FROM {name}", left).replace('"', "`")
        return self.spark.sql(text)
