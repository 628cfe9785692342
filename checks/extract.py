"""Extraction queries over the order system's tables."""

from __future__ import annotations

from checks.orders import MODE_OF_CODE
from checks.registry import STEPS, query
from checks.views import AS_OF
from stowage.operators import extract

DEMAND = extract.DemandExtract(min_order_date=19941231, only_recent=False)
RAW = extract.DemandExtract(min_order_date=19941231, only_recent=False, exclude_deleted=False)
RECENT = extract.DemandExtract(min_order_date=19941231, exclude_internal=True, work_types=(), exclude_redistribution=False)
PURCHASE = extract.OrderExtract(
    warehouses=("5", "6"), entry_min=19941231, invoice_min=19941231, stock_in_min=19941231, freight_min=19941231
)
MASTER = extract.MasterExtract(rate_date_min=19941231)

OPEN_CODE = """COALESCE(d."POTPTC", '40')"""
VENDOR_CODE = """COALESCE(d."STTPTC", '')"""


def date_of(digits: str) -> str:
    return f"CAST(try_strptime(CAST({digits} AS VARCHAR), '%Y%m%d') AS DATE)"


def demand_sql(where: str) -> str:
    return f"""
SELECT h."HDTYP" AS order_type, h."HCUST" AS customer, {date_of('l."LODTE"')} AS order_date, l."LORD" AS lord, l."LLINE" AS lline, TRIM(l."LPROD") AS item, l."LQORD" AS qty,
  {date_of('l."LRDTE"')} AS request_date, {date_of('l."LSDTE"')} AS ship_date, TRIM(l."LWHS") AS warehouse, j."SBSWKT" AS work_type
FROM ecl l JOIN ech h ON l."LORD" = h."HORD" JOIN iim i ON l."LPROD" = i."IPROD" LEFT JOIN jsb j ON h."HORD" = j."SBHORD"
WHERE l."LODTE" > 19941231 AND l."LPROD" NOT LIKE 'FA%' AND i."IITYP" IN ('S', 'E', 'K', 'A') AND TRIM(l."LWHS") IN ('5', '6')
  AND NOT (COALESCE(j."SBSWKT", '') IN ('ASY', 'KIT') AND l."LQORD" < 0) AND {where}"""


WORK = """(j."SBSWKT" IS NULL OR RTRIM(j."SBSWKT") IN ('ASX', 'ASY', 'GW', 'KIT', 'REP', 'SPW'))"""
OUTSIDE = """NOT (h."HCUST" > 1000 AND h."HCUST" < 10000 AND h."HCUST" <> 9125)"""
KEPT = """NOT ((h."HID" = 'CZ' OR l."LID" = 'CZ') AND l."LQSHP" = 0)"""


def demand_query(name: str, params, where: str) -> None:
    @query(name, demand_sql(where), "qty")
    def _(t):
        return extract.demand_lines(t.ecl, t.ech, t.iim, t.jsb, AS_OF, params)


demand_query("extract_demand_lines", DEMAND, f"{WORK} AND {OUTSIDE} AND {KEPT}")
demand_query("extract_raw_demand_lines", RAW, f"{WORK} AND {OUTSIDE}")
demand_query("extract_recent_demand_lines", RECENT, f"""j."SBSWKT" IS NULL AND h."HCUST" > 1000 AND {KEPT} AND l."LODTE" >= 20010201""")

ON_HAND = 's."LOPB" + s."LRCT" - s."LISSU" + s."LADJU"'


@query(
    "extract_stock_by_location",
    f"""
SELECT TRIM(s."LWHS") AS warehouse, CASE WHEN TRIM(s."LLOC") = '' THEN 'DEFAULT' ELSE TRIM(s."LLOC") END AS location, TRIM(s."LPROD") AS item, TRIM(i."IDESC") AS item_desc, i."ISCST" AS cost,
  {ON_HAND} AS on_hand, {ON_HAND} - i."ICUSA" AS available, s."LIALOC" AS allocated, i."IONOD" AS on_order, ({ON_HAND}) * i."ISCST" AS value, CASE WHEN TRIM(s."LLOT") = '' THEN 'NA' ELSE TRIM(s."LLOT") END AS serial
FROM ili s JOIN iim i ON s."LPROD" = i."IPROD" WHERE {ON_HAND} <> 0 AND s."LWHS" IN ('5', '6')""",
    "cost on_hand available allocated on_order value",
)
def _(t):
    return extract.stock_by_location(t.ili, t.iim)


W_HAND = 'w."WOPB" + w."WRCT" - w."WISS" + w."WADJ"'


@query(
    "extract_available_stock",
    f"""
SELECT TRIM(w."WWHS") AS warehouse, TRIM(w."WPROD") AS item, TRIM(i."IDESC") AS item_desc, i."ISCST" AS cost, {W_HAND} AS on_hand, {W_HAND} - w."WCUSA" AS available, i."IONOD" AS on_order, ({W_HAND}) * i."ISCST" AS value
FROM iwi w JOIN iim i ON w."WPROD" = i."IPROD" WHERE ({W_HAND} <> 0 OR w."WCUSA" <> 0 OR i."IONOD" > 0) AND w."WWHS" IN ('5', '6')""",
    "cost on_hand available on_order value",
)
def _(t):
    return extract.available_stock(t.iwi, t.iim)


@query(
    "extract_item_master",
    """
SELECT i."IITYP" AS item_type, TRIM(i."IPROD") AS item, TRIM(i."IDESC") AS item_desc, TRIM(i."IDSCE") AS item_desc_local, CAST(i."IVEND" AS VARCHAR) AS vendor, TRIM(v."VNDNAM") AS vendor_name, i."ISCST" AS cost,
  TRIM(c."CXPPLC") AS plc, TRIM(c."CXATLC") AS pgc, TRIM(c."CXPGAC") AS gac, COALESCE(x."IXNWIG", 0) / 1000 AS weight_kg
FROM iim i LEFT JOIN icx c ON i."ICLAS" = c."CXCLAS" JOIN iix x ON i."IPROD" = x."IXITMN" JOIN avm v ON i."IVEND" = v."VENDOR"
WHERE i."IPROD" NOT LIKE 'FA%' AND i."IVEND" > 101 AND i."IITYP" IN ('S', 'E', 'K', 'A') AND c."CXPPLC" IN ('MRS', 'SMT', 'RDT', 'REX', 'RGU', 'EDB', 'HAT')""",
    "cost weight_kg",
)
def _(t):
    return extract.item_master(t.iim, t.icx, t.iix, t.avm)


@query(
    "extract_item_warehouse",
    """
SELECT TRIM(w."WWHS") AS warehouse, TRIM(w."WPROD") AS item, COALESCE(w."WLOTS", 1) AS moq, COALESCE(w."WLEAD", 1) AS lead_days, TRIM(w."WILOC") AS location FROM iwi w JOIN iim i ON w."WPROD" = i."IPROD"
WHERE w."WPROD" NOT LIKE 'FA%' AND w."WWHS" IN ('5', '6') AND NOT (w."WWHS" = '5' AND w."WILOC" = 'BARAKI')""",
)
def _(t):
    return extract.item_warehouse_master(t.iwi, t.iim)


@query(
    "extract_location_master",
    """
SELECT warehouse, location, description, CAST(TRIM(split_part(description, ',', 1)) AS DOUBLE) AS x, CAST(TRIM(split_part(description, ',', 2)) AS DOUBLE) AS y, CAST(TRIM(split_part(description, ',', 3)) AS DOUBLE) AS z,
  location_type, zone, volume_capacity, weight_capacity
FROM (SELECT TRIM("WWHS") AS warehouse, TRIM("WLOC") AS location, TRIM("WDESC") AS description, "WLTYP" AS location_type, "WZONE" AS zone, "WVOLC" AS volume_capacity, "WWGHC" AS weight_capacity FROM ilm
  QUALIFY ROW_NUMBER() OVER (PARTITION BY TRIM("WWHS"), TRIM("WLOC") ORDER BY TRIM("WDESC"), "WLTYP", "WVOLC", "WWGHC") = 1) x WHERE description LIKE '%,%,%'""",
    "x y z volume_capacity weight_capacity",
)
def _(t):
    return extract.location_master(t.ilm)


@query(
    "extract_replacement_links",
    """
SELECT TRIM("PSPITM") AS parent, TRIM("PSCITM") AS child, "PSCQTY" AS qty, "PSSTRF" AS type, "PSUSES" AS using_existing FROM dps
WHERE "PSSTRF" = '1' AND "PSCITM" NOT LIKE '97%' AND "PSPITM" NOT LIKE '97%' AND "PSCITM" IN (SELECT "IPROD" FROM iim) AND "PSPITM" IN (SELECT "IPROD" FROM iim)""",
    "qty",
)
def _(t):
    return extract.replacement_links(t.dps, t.iim)


EXCLUDED = ", ".join(f"'{v}'" for v in "EDII EDIA ACGA ACGB ACGC ACGH ACGS ACGI EXPC EXTI EXTS EXTH EXTA EXTB EXTC EDIC".split())
STEPS["o_vendor_rows"] = f"""
SELECT CAST(v."VENDOR" AS VARCHAR) AS vendor, TRIM(v."VNDNAM") AS vendor_name, {MODE_OF_CODE.format(c=VENDOR_CODE)} AS mode, d."STNMDY" AS days, v."VENDOR" AS number, v."VTYPE" AS vtype
FROM avm v JOIN avx x ON v."VENDOR" = x."VXVNDN" LEFT JOIN dst d ON x."VXSPCD" = d."STSPCD"
WHERE (v."VENDOR" BETWEEN 100 AND 999 OR v."VENDOR" BETWEEN 10000 AND 90000 AND v."VENDOR" % 10 = 5 OR v."VENDOR" IN (99908, 99909)) AND v."VTYPE" NOT IN ({EXCLUDED})
  OR v."VENDOR" IN (611, 624, 530, 103, 129, 170, 172, 186, 190, 372, 999) AND d."STORTC" = 'UR'"""


@query(
    "extract_vendor_master",
    """
SELECT vendor, vendor_name, mode, CAST(CASE WHEN mode = 'Truck' THEN 3 ELSE days END AS INTEGER) AS static_days,
  CASE WHEN vtype = 'EDIC' THEN 'OVERSEA_DC' WHEN vtype IN ('ACGC', 'EXTC') THEN 'OVERSEA_EXTERNAL' ELSE 'DOMESTIC_EXTERNAL' END AS vendor_type, 'Y' AS is_active FROM o_vendor_rows
QUALIFY ROW_NUMBER() OVER (PARTITION BY vendor, mode ORDER BY CASE WHEN mode = 'Truck' THEN 3 ELSE days END NULLS LAST, vendor_name, vtype) = 1""",
)
def _(t):
    return extract.vendor_master(t.avm, t.avx, t.dst)


@query(
    "extract_currency_rates",
    f"""
SELECT {date_of('"CCNVDT"')} AS valid_date, "CCNVFC" AS rate, "CCFRCR" AS from_currency, "CCTOCR" AS to_currency, TRIM("CCRTYP") AS usage_type, CASE WHEN TRIM("CCMETH") = '' THEN 'M' ELSE TRIM("CCMETH") END AS method
FROM gcc WHERE "CCNVDT" > 19941231""",
    "rate",
)
def _(t):
    return extract.currency_rates(t.gcc, MASTER)


STEPS["o_domestic"] = f"""
SELECT h."PWHSE" AS warehouse, h."PORD" AS ponum, h."PLINE" AS poline, TRIM(h."PPROD") AS item, CAST(h."PVEND" AS VARCHAR) AS vendor, h."PQORD" AS ordered_qty, h."PQREC" AS received_qty,
  {date_of('h."PEDTE"')} AS po_entry_date, {date_of('h."HVDUE"')} AS invoice_date, {date_of('r."TTDTE"')} AS delivery_date, r."TLOT" AS lot_number
FROM hpo h JOIN (SELECT "TREF", "TPROD", "TTDTE", "TLOT" FROM ith WHERE "TTYPE" = 'H' AND "TTDTE" > 19941231
  QUALIFY ROW_NUMBER() OVER (PARTITION BY "TREF", "TPROD" ORDER BY "TTDTE", "TLOT") = 1) r ON h."PORD" = r."TREF" AND h."PPROD" = r."TPROD"
WHERE h."PEDTE" > 19941231 AND h."PWHSE" IN ('5', '6') AND h."PVEND" > 10000 AND h."PQORD" = h."PQREC"
QUALIFY ROW_NUMBER() OVER (PARTITION BY h."PORD", TRIM(h."PPROD") ORDER BY r."TTDTE", h."PLINE", h."PWHSE", CAST(h."PVEND" AS VARCHAR), h."PQORD", h."HVDUE") = 1"""


@query(
    "extract_domestic_deliveries",
    """
SELECT warehouse, ponum, poline, item, vendor, ordered_qty, received_qty, po_entry_date, invoice_date, delivery_date, lot_number, 'Y' AS is_closed, 'Truck' AS mode,
  CAST(CASE WHEN tr < 0 THEN total WHEN tr > 7 THEN total - 7 ELSE total - tr END AS INTEGER) AS prepare_days, CAST(greatest(0, least(7, tr)) AS INTEGER) AS transport_days, CAST(total AS INTEGER) AS total_days,
  CASE WHEN tr < 0 THEN 'NEGATIVE_TRANSPORT_FIXED' WHEN tr > 7 THEN 'TRUCK_OVERSHOOT_CORRECTED' ELSE 'OK' END AS transport_flag
FROM (SELECT *, delivery_date - invoice_date AS tr, delivery_date - po_entry_date AS total FROM o_domestic) d""",
    "ordered_qty received_qty",
)
def _(t):
    return extract.domestic_deliveries(t.hpo, t.ith, AS_OF, PURCHASE)


def ranked(kind: str) -> str:
    return f"""(SELECT *, ROW_NUMBER() OVER (PARTITION BY "TREF", "TPROD", "THLIN", "TQTY" ORDER BY "TSEQ", "TTDTE") AS rn FROM ith WHERE "TTYPE" = '{kind}' AND "TTDTE" > 19941231)"""


STEPS["o_oversea"] = f"""
SELECT h."PWHSE" AS warehouse, h."PORD" AS ponum, h."PLINE" AS poline, TRIM(h."PPROD") AS item, CAST(h."PVEND" AS VARCHAR) AS vendor, MAX(h."PQORD") AS ordered_qty, SUM(i."TQTY") AS invoiced_qty, SUM(r."TQTY") AS received_qty,
  {date_of('h."PEDTE"')} AS po_entry_date, {date_of('i."TTDTE"')} AS invoice_date, {date_of('r."TTDTE"')} AS delivery_date, COALESCE(NULLIF(TRIM(d."POTPTC"), ''), '53') AS transport_code, d."POORTC" AS order_type,
  CASE WHEN h."PQORD" = h."PQREC" THEN 'Y' ELSE 'N' END AS is_closed
FROM hpo h JOIN {ranked('GI')} i ON h."PORD" = i."TREF" AND h."PPROD" = i."TPROD" AND h."PLINE" = i."THLIN"
JOIN {ranked('GA')} r ON h."PORD" = r."TREF" AND h."PPROD" = r."TPROD" AND h."PLINE" = r."THLIN" AND r.rn = i.rn AND r."TQTY" = i."TQTY" JOIN dpo d ON h."PORD" = d."POPORD"
WHERE h."PEDTE" > 19941231 AND h."PWHSE" IN ('5', '6') GROUP BY h."PWHSE", h."PORD", h."PLINE", h."PPROD", h."PVEND", h."PEDTE", i."TTDTE", r."TTDTE", d."POTPTC", d."POORTC", 14"""


@query(
    "extract_oversea_deliveries",
    f"""
SELECT warehouse, ponum, CASE WHEN n > 1 THEN poline || '-' || CAST(rn AS VARCHAR) ELSE poline END AS poline, item, vendor, ordered_qty, invoiced_qty, received_qty, po_entry_date, invoice_date, delivery_date, transport_code, order_type, is_closed,
  CAST(invoice_date - po_entry_date AS INTEGER) AS prepare_days, CAST(delivery_date - invoice_date AS INTEGER) AS transport_days, CAST(delivery_date - po_entry_date AS INTEGER) AS total_days, {MODE_OF_CODE.format(c='transport_code')} AS mode
FROM (SELECT *, COUNT(*) OVER (PARTITION BY ponum, poline) AS n, ROW_NUMBER() OVER (PARTITION BY ponum, poline ORDER BY invoice_date, delivery_date, warehouse, item, vendor) AS rn FROM o_oversea) x""",
    "ordered_qty invoiced_qty received_qty",
)
def _(t):
    return extract.oversea_deliveries(t.hpo, t.dpo, t.ith, PURCHASE)


STEPS["o_sent"] = f"""
SELECT TRIM(h."PWHSE") AS warehouse, CAST(h."PVEND" AS VARCHAR) AS vendor, {date_of('h."PEDTE"')} AS po_entry_date, h."PORD" AS ponum, h."PLINE" AS poline, COALESCE(NULLIF(TRIM(d."POTPTC"), ''), '53') AS transport_code,
  TRIM(h."PPROD") AS item, h."PQORD" AS ordered_qty, MAX(h."PQORD" - h."PCQTY") AS remaining_qty, COALESCE(SUM(i."TQTY"), 0) AS in_transit_qty, {date_of('i."TTDTE"')} AS invoice_date, d."POORTC" AS order_type, h."PCMT" AS comment
FROM hpo h LEFT JOIN (SELECT * FROM ith WHERE "TTYPE" = 'GI' AND "TTDTE" > 19941231) i ON h."PORD" = i."TREF" AND h."PPROD" = i."TPROD" AND h."PLINE" = i."THLIN"
LEFT JOIN (SELECT * FROM ith WHERE "TTYPE" = 'GA' AND "TTDTE" > 19941231) r ON h."PORD" = r."TREF" AND h."PPROD" = r."TPROD" AND h."PLINE" = r."THLIN" AND r."TQTY" = i."TQTY"
JOIN dpo d ON h."PORD" = d."POPORD" WHERE h."PEDTE" > 19941231 AND h."PWHSE" IN ('5', '6') AND h."PID" = 'PO' AND h."PQORD" > h."PQREC" {{more}}
GROUP BY h."PWHSE", h."PORD", h."PLINE", h."PPROD", h."PVEND", i."TTDTE", h."PQORD", h."PEDTE", d."POTPTC", d."POORTC", h."PCMT" """
STEPS["o_local"] = f"""
SELECT TRIM(h."PWHSE") AS warehouse, CAST(h."PVEND" AS VARCHAR) AS vendor, {date_of('h."PEDTE"')} AS po_entry_date, h."PORD" AS ponum, h."PLINE" AS poline, '40' AS transport_code, TRIM(h."PPROD") AS item,
  h."PQORD" AS ordered_qty, h."PQORD" - h."PQREC" AS remaining_qty, 0.0 AS in_transit_qty, {date_of('h."PDDTE"')} AS invoice_date, 'UR' AS order_type, h."PCMT" AS comment
FROM hpo h LEFT JOIN dpo d ON h."PORD" = d."POPORD" WHERE h."PPROD" NOT LIKE 'FA%' AND h."PQORD" > h."PQREC" AND h."PWHSE" IN ('5', '6') AND h."PEDTE" > 19941231 AND d."POPORD" IS NULL"""
STEPS["o_sent"] = STEPS["o_sent"].replace("{more}", "")


@query(
    "extract_in_transit",
    f"SELECT *, {MODE_OF_CODE.format(c='transport_code')} AS mode FROM (SELECT * FROM o_sent UNION ALL SELECT * FROM o_local) x",
    "ordered_qty remaining_qty in_transit_qty",
)
def _(t):
    return extract.in_transit_lines(t.hpo, t.hpo, t.dpo, t.ith, PURCHASE)


@query(
    "extract_open_orders",
    f"""
SELECT TRIM(h."PWHSE") AS warehouse, CAST(h."PVEND" AS VARCHAR) AS vendor, {date_of('h."PEDTE"')} AS po_entry_date, h."PORD" AS ponum, h."PLINE" AS poline, COALESCE(d."POTPTC", '40') AS transport_code, TRIM(h."PPROD") AS item,
  h."PQORD", h."PQREC", h."PQORD" - h."PQREC" AS "PQREM", h."PCQTY", h."PCQTY" - h."PQREC" AS "PQTRANSIT", {date_of('h."PDDTE"')} AS due_date, {date_of('h."HVDUE"')} AS acknowledged_date, h."PCMT" AS comment,
  {MODE_OF_CODE.format(c=OPEN_CODE)} AS mode
FROM hpo h LEFT JOIN dpo d ON h."PORD" = d."POPORD" WHERE h."PEDTE" > 20001101 AND h."PPROD" NOT LIKE 'FA%' AND h."PQORD" > h."PQREC" AND h."PWHSE" IN ('5', '6')""",
    '"PQORD" "PQREC" "PQREM" "PCQTY" "PQTRANSIT"',
)
def _(t):
    return extract.open_orders(t.hpo, t.dpo, PURCHASE)


@query(
    "extract_freight_charges",
    f"""
SELECT {date_of('h."IHINVD"')} AS invoice_date, {MODE_OF_CODE.format(c='''CASE WHEN TRIM(s."SHTPTC") = '' THEN '50' ELSE s."SHTPTC" END''')} AS mode, h."IHSHPN" AS shipment, h."IHSPCD" AS global_code, h."IHPRCC" AS currency,
  h."IHPRCT" AS invoice_total, g.item_total, TRIM(p."POWHCD") AS warehouse, k.gross_kg, h."IHPRCT" - g.item_total AS freight
FROM dih h JOIN (SELECT "ILPINN", "ILSPCD", SUM("ILINVP" * "ILQTYI") AS item_total, MAX("ILPORD") AS po FROM dil WHERE "ILDOFD" > 19941231 GROUP BY 1, 2) g ON h."IHPINN" = g."ILPINN" AND h."IHSPCD" = g."ILSPCD"
JOIN (SELECT "PKSPCD", "PKSHPN", SUM("PKPKGW") AS gross_kg FROM dpk GROUP BY 1, 2) k ON h."IHSHPN" = k."PKSHPN" AND h."IHSPCD" = k."PKSPCD"
JOIN dsh s ON h."IHSHPN" = s."SHSHPN" AND h."IHSPCD" = s."SHSPCD" JOIN dpo p ON g.po = p."POPORD" WHERE h."IHDOFD" > 19941231 AND TRIM(p."POWHCD") IN ('5', '6')""",
    "invoice_total item_total gross_kg freight",
)
def _(t):
    return extract.freight_charges(t.dil, t.dih, t.dpk, t.dsh, t.dpo, PURCHASE)


@query("active_warehouses", "SELECT DISTINCT warehouse FROM iwm WHERE status = 1")
def _(t):
    return extract.active_warehouses(t.iwm)


@query(
    "active_warehouses_of_a_country",
    "SELECT DISTINCT warehouse FROM iwm WHERE status = 1 AND country = 'JP' AND facility = 'F1'",
)
def _(t):
    return extract.active_warehouses(t.iwm, "JP", "F1")
