"""Extraction queries over the order system's tables.

Each query takes the tables it reads as DataFrames with their original column names and returns a
table with the names used by the other operators. A parameter that is empty or False adds no
predicate. Dates arrive as ``yyyyMMdd`` integers.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.modes import mode_of_code, static_days, vendor_type
from stowage.functions.running import first_rows, nulls_last, stacked
from stowage.operators.po import number_sublines, repair_truck_days, stage_days
from stowage.sources.readers import digits_to_date

# Codes and defaults of the order system.
ITEM_TYPES = ("S", "E", "K", "A")
WORK_TYPES = ("ASX", "ASY", "GW", "KIT", "REP", "SPW")
PRODUCT_LINES = ("MRS", "SMT", "RDT", "REX", "RGU", "EDB", "HAT")
WAREHOUSES = ("5", "6")
EXCLUDED_VENDOR_TYPES = (
    "EDII", "EDIA", "ACGA", "ACGB", "ACGC", "ACGH", "ACGS", "ACGI",
    "EXPC", "EXTI", "EXTS", "EXTH", "EXTA", "EXTB", "EXTC", "EDIC",
)
EXTRA_VENDORS = (611, 624, 530, 103, 129, 170, 172, 186, 190, 372, 999)
INTERNAL_VENDORS = (99908, 99909)
COORDINATES = r"^\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*$"


@dataclass(frozen=True)
class DemandExtract:
    min_order_date: int = 20240101
    only_recent: bool = True
    exclude_deleted: bool = True
    exclude_redistribution: bool = True
    exclude_internal: bool = False
    item_types: tuple[str, ...] = ITEM_TYPES
    work_types: tuple[str, ...] = WORK_TYPES
    warehouses: tuple[str, ...] = WAREHOUSES


@dataclass(frozen=True)
class OrderExtract:
    warehouses: tuple[str, ...] = ()
    entry_min: int = 20241001
    invoice_min: int = 20241001
    stock_in_min: int = 20241001
    freight_min: int = 20241231
    only_recent: bool = False
    exclude_received: bool = False


@dataclass(frozen=True)
class MasterExtract:
    item_types: tuple[str, ...] = ITEM_TYPES
    product_lines: tuple[str, ...] = PRODUCT_LINES
    warehouses: tuple[str, ...] = WAREHOUSES
    location_warehouses: tuple[str, ...] = ()
    excluded_locations: tuple[tuple[str, str], ...] = field(default=(("5", "BARAKI"),))
    order_type: str = "UR"
    rate_date_min: int = 20231231


def listed(df: DataFrame, column: Column, values: tuple) -> DataFrame:
    """Keep rows whose column is in a list; an empty list keeps all."""
    return df.where(column.isin(*values)) if values else df


def six_months_before(as_of: dt.date) -> Column:
    start = F.add_months(F.lit(as_of).cast("date"), -6)
    return F.date_format(start, "yyyyMMdd").cast("int")


def demand_lines(
    lines: DataFrame, headers: DataFrame, items: DataFrame, work: DataFrame, as_of: dt.date,
    params: DemandExtract = DemandExtract(),
) -> DataFrame:
    """E1 (E2 with ``exclude_deleted=False``): demand order lines of stocked items."""
    kept = lines.where((F.col("LODTE") > params.min_order_date) & ~F.col("LPROD").like("FA%"))
    if params.only_recent:
        kept = kept.where(F.col("LODTE") >= six_months_before(as_of))
    kept = listed(kept, F.trim("LWHS"), params.warehouses)
    wanted = listed(items.select("IPROD", "IITYP"), F.col("IITYP"), params.item_types).select("IPROD")
    joined = (
        kept.join(headers.select("HORD", "HDTYP", "HCUST", "HID"), F.col("LORD") == F.col("HORD"))
        .join(wanted, F.col("LPROD") == F.col("IPROD"))
        .join(work.select("SBHORD", "SBSWKT"), F.col("HORD") == F.col("SBHORD"), "left")
    )
    kind = F.rtrim("SBSWKT")
    no_work = F.col("SBSWKT").isNull()
    joined = joined.where(no_work | kind.isin(*params.work_types)) if params.work_types else joined.where(no_work)
    joined = joined.where(no_work | ~(kind.isin("ASY", "KIT") & (F.col("LQORD") < 0)))
    if params.exclude_deleted:
        deleted = (F.col("HID") == "CZ") | (F.col("LID") == "CZ")
        joined = joined.where(~(deleted & (F.col("LQSHP") == 0)))
    customer = F.col("HCUST")
    if params.exclude_redistribution:
        joined = joined.where(~((customer > 1000) & (customer < 10000) & (customer != 9125)))
    if params.exclude_internal:
        joined = joined.where(customer > 1000)
    return joined.select(
        F.col("HDTYP").alias("order_type"),
        F.col("HCUST").alias("customer"),
        digits_to_date(F.col("LODTE")).alias("order_date"),
        F.col("LORD").alias("lord"),
        F.col("LLINE").alias("lline"),
        F.trim("LPROD").alias("item"),
        F.col("LQORD").alias("qty"),
        digits_to_date(F.col("LRDTE")).alias("request_date"),
        digits_to_date(F.col("LSDTE")).alias("ship_date"),
        F.trim("LWHS").alias("warehouse"),
        F.col("SBSWKT").alias("work_type"),
    )


def _on_hand(opening: str, receipts: str, issues: str, adjustments: str) -> Column:
    return F.col(opening) + F.col(receipts) - F.col(issues) + F.col(adjustments)


def _or_text(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))


def stock_by_location(stock: DataFrame, items: DataFrame, warehouses: tuple[str, ...] = WAREHOUSES) -> DataFrame:
    """Stock per location and lot, where there is any."""
    on_hand = _on_hand("LOPB", "LRCT", "LISSU", "LADJU")
    kept = listed(stock, F.col("LWHS"), warehouses).where(on_hand != 0)
    return kept.join(items.select("IPROD", "IDESC", "ISCST", "ICUSA", "IONOD"), F.col("LPROD") == F.col("IPROD")).select(
        F.trim("LWHS").alias("warehouse"),
        _or_text("LLOC", "DEFAULT").alias("location"),
        F.trim("LPROD").alias("item"),
        F.trim("IDESC").alias("item_desc"),
        F.col("ISCST").alias("cost"),
        on_hand.alias("on_hand"),
        (on_hand - F.col("ICUSA")).alias("available"),
        F.col("LIALOC").alias("allocated"),
        F.col("IONOD").alias("on_order"),
        (on_hand * F.col("ISCST")).alias("value"),
        _or_text("LLOT", "NA").alias("serial"),
    )


def available_stock(
    item_warehouse: DataFrame, items: DataFrame, warehouses: tuple[str, ...] = WAREHOUSES
) -> DataFrame:
    """Stock per item and warehouse, where there is stock, allocation or an order."""
    on_hand = _on_hand("WOPB", "WRCT", "WISS", "WADJ")
    return (
        listed(item_warehouse, F.col("WWHS"), warehouses)
        .join(items.select("IPROD", "IDESC", "ISCST", "IONOD"), F.col("WPROD") == F.col("IPROD"))
        .where((on_hand != 0) | (F.col("WCUSA") != 0) | (F.col("IONOD") > 0))
        .select(
            F.trim("WWHS").alias("warehouse"),
            F.trim("WPROD").alias("item"),
            F.trim("IDESC").alias("item_desc"),
            F.col("ISCST").alias("cost"),
            on_hand.alias("on_hand"),
            (on_hand - F.col("WCUSA")).alias("available"),
            F.col("IONOD").alias("on_order"),
            (on_hand * F.col("ISCST")).alias("value"),
        )
    )


def item_master(
    items: DataFrame, classes: DataFrame, extension: DataFrame, vendors: DataFrame,
    params: MasterExtract = MasterExtract(),
) -> DataFrame:
    """E5: items with class codes, vendor name and weight."""
    kept = listed(items, F.col("IITYP"), params.item_types).where(~F.col("IPROD").like("FA%") & (F.col("IVEND") > 101))
    joined = (
        kept.join(classes.select("CXCLAS", "CXPPLC", "CXATLC", "CXPGAC"), F.col("ICLAS") == F.col("CXCLAS"), "left")
        .join(extension.select("IXITMN", "IXNWIG"), F.col("IPROD") == F.col("IXITMN"))
        .join(vendors.select("VENDOR", "VNDNAM"), F.col("IVEND") == F.col("VENDOR"))
    )
    return listed(joined, F.col("CXPPLC"), params.product_lines).select(
        F.col("IITYP").alias("item_type"),
        F.trim("IPROD").alias("item"),
        F.trim("IDESC").alias("item_desc"),
        F.trim("IDSCE").alias("item_desc_local"),
        F.trim(F.col("IVEND").cast("string")).alias("vendor"),
        F.trim("VNDNAM").alias("vendor_name"),
        F.col("ISCST").alias("cost"),
        F.trim("CXPPLC").alias("plc"),
        F.trim("CXATLC").alias("pgc"),
        F.trim("CXPGAC").alias("gac"),
        (F.coalesce(F.col("IXNWIG"), F.lit(0.0)) / 1000).alias("weight_kg"),
    )


def item_warehouse_master(
    item_warehouse: DataFrame, items: DataFrame, params: MasterExtract = MasterExtract()
) -> DataFrame:
    """Order quantity, lead time and location per item and warehouse, without excluded locations."""
    kept = listed(item_warehouse, F.col("WWHS"), params.warehouses).where(~F.col("WPROD").like("FA%"))
    for warehouse, location in params.excluded_locations:
        kept = kept.where(~((F.col("WWHS") == warehouse) & (F.col("WILOC") == location)))
    return kept.join(items.select("IPROD"), F.col("WPROD") == F.col("IPROD")).select(
        F.trim("WWHS").alias("warehouse"),
        F.trim("WPROD").alias("item"),
        F.coalesce(F.col("WLOTS"), F.lit(1)).alias("moq"),
        F.coalesce(F.col("WLEAD"), F.lit(1)).alias("lead_days"),
        F.trim("WILOC").alias("location"),
    )


def location_master(locations: DataFrame, params: MasterExtract = MasterExtract()) -> DataFrame:
    """Locations whose description holds three coordinates; the first row of a code counts."""
    trimmed = listed(locations, F.col("WWHS"), params.location_warehouses).select(
        F.trim("WWHS").alias("warehouse"),
        F.trim("WLOC").alias("location"),
        F.trim("WDESC").alias("description"),
        F.col("WLTYP").alias("location_type"),
        F.col("WZONE").alias("zone"),
        F.col("WVOLC").alias("volume_capacity"),
        F.col("WWGHC").alias("weight_capacity"),
    )
    order = nulls_last(["description", "location_type", "zone", "volume_capacity", "weight_capacity"])
    valid = first_rows(trimmed, ["warehouse", "location"], order).where(F.col("description").rlike(COORDINATES))
    parts = F.split(F.replace(F.col("description"), F.lit(" "), F.lit("")), ",")
    axes = {axis: F.try_element_at(parts, F.lit(i + 1)).try_cast("double") for i, axis in enumerate("xyz")}
    return valid.withColumns(axes).select(
        "warehouse", "location", "description", "x", "y", "z", "location_type", "zone", "volume_capacity",
        "weight_capacity",
    )


def replacement_links(links: DataFrame, items: DataFrame) -> DataFrame:
    """Replacement links between known items."""
    known = items.select("IPROD").distinct()
    kept = links.where(
        (F.col("PSSTRF") == "1") & ~F.col("PSCITM").like("97%") & ~F.col("PSPITM").like("97%")
    )
    return (
        kept.join(known, F.col("PSCITM") == F.col("IPROD"), "left_semi")
        .join(known, F.col("PSPITM") == F.col("IPROD"), "left_semi")
        .select(
            F.trim("PSPITM").alias("parent"),
            F.trim("PSCITM").alias("child"),
            F.col("PSCQTY").alias("qty"),
            F.col("PSSTRF").alias("type"),
            F.col("PSUSES").alias("using_existing"),
        )
    )


def vendor_master(
    vendors: DataFrame, extension: DataFrame, transport: DataFrame, params: MasterExtract = MasterExtract()
) -> DataFrame:
    """Vendors by mode with type and static days, the shortest days per vendor and mode."""
    number = F.col("VENDOR")
    numbered_range = number.between(100, 999) | (
        (number.between(10000, 90000) & (number % 10 == 5)) | number.isin(*INTERNAL_VENDORS)
    )
    regular = numbered_range & ~F.col("VTYPE").isin(*EXCLUDED_VENDOR_TYPES)
    extra = number.isin(*EXTRA_VENDORS) & (F.col("STORTC") == params.order_type)
    mode = mode_of_code(F.col("STTPTC"))
    rows = (
        vendors.join(extension.select("VXVNDN", "VXSPCD"), F.col("VENDOR") == F.col("VXVNDN"))
        .join(transport, F.col("VXSPCD") == F.col("STSPCD"), "left")
        .where(regular | extra)
        .select(
            number.cast("string").alias("vendor"),
            F.trim("VNDNAM").alias("vendor_name"),
            mode.alias("mode"),
            static_days(mode, F.col("STNMDY")).alias("static_days"),
            vendor_type(F.col("VTYPE"), number).alias("vendor_type"),
            F.lit("Y").alias("is_active"),
        )
    )
    return first_rows(rows, ["vendor", "mode"], nulls_last(["static_days", "vendor_name", "vendor_type"]))


def currency_rates(rates: DataFrame, params: MasterExtract = MasterExtract()) -> DataFrame:
    """Exchange rates; a blank method multiplies."""
    method = F.trim("CCMETH")
    return rates.where(F.col("CCNVDT") > params.rate_date_min).select(
        digits_to_date(F.col("CCNVDT")).alias("valid_date"),
        F.col("CCNVFC").alias("rate"),
        F.col("CCFRCR").alias("from_currency"),
        F.col("CCTOCR").alias("to_currency"),
        F.trim("CCRTYP").alias("usage_type"),
        F.when(method == "", "M").otherwise(method).alias("method"),
    )


def domestic_deliveries(
    orders: DataFrame, transactions: DataFrame, as_of: dt.date, params: OrderExtract = OrderExtract()
) -> DataFrame:
    """Fully received domestic lines with their earliest receipt, one per order and item."""
    receipts = transactions.where((F.col("TTYPE") == "H") & (F.col("TTDTE") > params.stock_in_min))
    earliest = first_rows(
        receipts.select("TREF", "TPROD", "TTDTE", "TLOT"), ["TREF", "TPROD"], nulls_last(["TTDTE", "TLOT"])
    )
    kept = listed(orders, F.col("PWHSE"), params.warehouses).where(
        (F.col("PEDTE") > params.entry_min) & (F.col("PVEND") > 10000) & (F.col("PQORD") == F.col("PQREC"))
    )
    joined = kept.join(earliest, (F.col("PORD") == F.col("TREF")) & (F.col("PPROD") == F.col("TPROD")))
    if params.only_recent:
        joined = joined.where(F.col("TTDTE") >= six_months_before(as_of))
    named = joined.select(
        F.col("PWHSE").alias("warehouse"),
        F.col("PORD").alias("ponum"),
        F.col("PLINE").alias("poline"),
        F.trim("PPROD").alias("item"),
        F.col("PVEND").cast("string").alias("vendor"),
        F.col("PQORD").alias("ordered_qty"),
        F.col("PQREC").alias("received_qty"),
        digits_to_date(F.col("PEDTE")).alias("po_entry_date"),
        digits_to_date(F.col("HVDUE")).alias("invoice_date"),
        digits_to_date(F.col("TTDTE")).alias("delivery_date"),
        F.col("TLOT").alias("lot_number"),
        F.lit("Y").alias("is_closed"),
        F.lit("Truck").alias("mode"),
    )
    first = first_rows(
        named, ["ponum", "item"], nulls_last(["delivery_date", "poline", "warehouse", "vendor", "ordered_qty", "invoice_date"])
    )
    return repair_truck_days(stage_days(first))


def paired_transactions(transactions: DataFrame, params: OrderExtract = OrderExtract()) -> DataFrame:
    """The k-th invoice of an order line with the k-th receipt of the same quantity."""
    keys = ["TREF", "TPROD", "THLIN", "TQTY"]

    def side(kind: str, since: int, date: str) -> DataFrame:
        rows = transactions.where((F.col("TTYPE") == kind) & (F.col("TTDTE") > since)).select(*keys, "TTDTE", "TSEQ")
        # A quantity of an order line is invoiced and received a handful of times.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*nulls_last(["TSEQ", "TTDTE"])))
        return rows.select(*keys, place.alias("_k"), F.col("TTDTE").alias(date))

    invoices = side("GI", params.invoice_min, "invoice_digits")
    receipts = side("GA", params.stock_in_min, "delivery_digits")
    return invoices.join(receipts, [*keys, "_k"]).drop("_k")


def oversea_deliveries(
    orders: DataFrame, headers: DataFrame, transactions: DataFrame, params: OrderExtract = OrderExtract()
) -> DataFrame:
    """Oversea deliveries by invoice and receipt, as numbered sub-lines with stage days and mode."""
    pairs = (
        paired_transactions(transactions, params)
        .groupBy("TREF", "TPROD", "THLIN", "invoice_digits", "delivery_digits")
        .agg(F.sum("TQTY").alias("_qty"))
    )
    kept = listed(orders, F.col("PWHSE"), params.warehouses).where(F.col("PEDTE") > params.entry_min)
    joined = kept.join(
        pairs,
        (F.col("PORD") == F.col("TREF")) & (F.col("PPROD") == F.col("TPROD")) & (F.col("PLINE") == F.col("THLIN")),
    ).join(headers.select("POPORD", "POTPTC", "POORTC"), F.col("PORD") == F.col("POPORD"))
    closed = F.when(F.col("PQORD") == F.col("PQREC"), "Y").otherwise("N")
    grouped = joined.groupBy(
        "PWHSE", "PORD", "PLINE", "PPROD", "PVEND", "PEDTE", "invoice_digits", "delivery_digits", "POTPTC", "POORTC",
        closed.alias("is_closed"),
    ).agg(F.max("PQORD").alias("ordered_qty"), F.sum("_qty").alias("_qty"))
    named = grouped.select(
        F.col("PWHSE").alias("warehouse"),
        F.col("PORD").alias("ponum"),
        F.col("PLINE").alias("poline"),
        F.trim("PPROD").alias("item"),
        F.col("PVEND").cast("string").alias("vendor"),
        "ordered_qty",
        F.col("_qty").alias("invoiced_qty"),
        F.col("_qty").alias("received_qty"),
        digits_to_date(F.col("PEDTE")).alias("po_entry_date"),
        digits_to_date(F.col("invoice_digits")).alias("invoice_date"),
        digits_to_date(F.col("delivery_digits")).alias("delivery_date"),
        _or_text("POTPTC", "53").alias("transport_code"),
        F.col("POORTC").alias("order_type"),
        "is_closed",
    )
    lines = stage_days(number_sublines(named, ("invoice_date", "delivery_date")))
    return lines.withColumn("mode", mode_of_code(F.col("transport_code")))


def in_transit_lines(
    oversea: DataFrame, domestic: DataFrame, headers: DataFrame, transactions: DataFrame,
    params: OrderExtract = OrderExtract(),
) -> DataFrame:
    """Open lines with what is under way: oversea by invoice, domestic where no oversea header exists.

    An invoice counts once per receipt of the same quantity on its line, at least once. Both sides
    are counted before they meet.
    """
    line = ["TREF", "TPROD", "THLIN"]
    moves = transactions.where(F.col("TTDTE") > params.invoice_min)
    invoices = moves.where(F.col("TTYPE") == "GI").groupBy(*line, "TTDTE", "TQTY").agg(F.count(F.lit(1)).alias("_gi"))
    receipts = moves.where(F.col("TTYPE") == "GA").groupBy(*line, "TQTY").agg(F.count(F.lit(1)).alias("_ga"))
    matched = invoices.join(receipts, [*line, "TQTY"], "left")
    if params.exclude_received:
        matched = matched.where(F.col("_ga").isNull())
    shipped = matched.groupBy(*line, "TTDTE").agg(
        F.sum(F.col("TQTY") * F.col("_gi") * F.coalesce(F.col("_ga"), F.lit(1))).alias("_qty")
    )
    sent = (
        listed(oversea, F.col("PWHSE"), params.warehouses)
        .where((F.col("PEDTE") > params.entry_min) & (F.col("PID") == "PO") & (F.col("PQORD") > F.col("PQREC")))
        .join(headers.select("POPORD", "POTPTC", "POORTC"), F.col("PORD") == F.col("POPORD"))
        .join(
            shipped,
            (F.col("PORD") == F.col("TREF")) & (F.col("PPROD") == F.col("TPROD")) & (F.col("PLINE") == F.col("THLIN")),
            "left",
        )
        .groupBy(
            "PWHSE", "PORD", "PLINE", "PPROD", "PVEND", "TTDTE", "PQORD", "PEDTE", "POTPTC", "POORTC", "PCMT"
        )
        .agg(F.max(F.col("PQORD") - F.col("PCQTY")).alias("_left"), F.coalesce(F.sum("_qty"), F.lit(0.0)).alias("_qty"))
        .select(
            F.trim("PWHSE").alias("warehouse"),
            F.col("PVEND").cast("string").alias("vendor"),
            digits_to_date(F.col("PEDTE")).alias("po_entry_date"),
            F.col("PORD").alias("ponum"),
            F.col("PLINE").alias("poline"),
            _or_text("POTPTC", "53").alias("transport_code"),
            F.trim("PPROD").alias("item"),
            F.col("PQORD").alias("ordered_qty"),
            F.col("_left").alias("remaining_qty"),
            F.col("_qty").alias("in_transit_qty"),
            digits_to_date(F.col("TTDTE")).alias("invoice_date"),
            F.col("POORTC").alias("order_type"),
            F.col("PCMT").alias("comment"),
        )
    )
    local = (
        listed(domestic, F.col("PWHSE"), params.warehouses)
        .where(
            ~F.col("PPROD").like("FA%") & (F.col("PQORD") > F.col("PQREC")) & (F.col("PEDTE") > params.entry_min)
        )
        .join(headers, F.col("PORD") == F.col("POPORD"), "left_anti")
        .select(
            F.trim("PWHSE").alias("warehouse"),
            F.col("PVEND").cast("string").alias("vendor"),
            digits_to_date(F.col("PEDTE")).alias("po_entry_date"),
            F.col("PORD").alias("ponum"),
            F.col("PLINE").alias("poline"),
            F.lit("40").alias("transport_code"),
            F.trim("PPROD").alias("item"),
            F.col("PQORD").alias("ordered_qty"),
            (F.col("PQORD") - F.col("PQREC")).alias("remaining_qty"),
            F.lit(0.0).alias("in_transit_qty"),
            digits_to_date(F.col("PDDTE")).alias("invoice_date"),
            F.lit("UR").alias("order_type"),
            F.col("PCMT").alias("comment"),
        )
    )
    return stacked(sent, local).withColumn("mode", mode_of_code(F.col("transport_code")))


def open_orders(orders: DataFrame, headers: DataFrame, params: OrderExtract = OrderExtract()) -> DataFrame:
    """Lines not fully received, with what remains and what is under way."""
    kept = listed(orders, F.col("PWHSE"), params.warehouses).where(
        (F.col("PEDTE") > 20001101) & ~F.col("PPROD").like("FA%") & (F.col("PQORD") > F.col("PQREC"))
    )
    code = F.coalesce(F.col("POTPTC").cast("string"), F.lit("40"))
    return kept.join(headers.select("POPORD", "POTPTC"), F.col("PORD") == F.col("POPORD"), "left").select(
        F.trim("PWHSE").alias("warehouse"),
        F.col("PVEND").cast("string").alias("vendor"),
        digits_to_date(F.col("PEDTE")).alias("po_entry_date"),
        F.col("PORD").alias("ponum"),
        F.col("PLINE").alias("poline"),
        code.alias("transport_code"),
        F.trim("PPROD").alias("item"),
        "PQORD", "PQREC",
        (F.col("PQORD") - F.col("PQREC")).alias("PQREM"),
        "PCQTY",
        (F.col("PCQTY") - F.col("PQREC")).alias("PQTRANSIT"),
        digits_to_date(F.col("PDDTE")).alias("due_date"),
        digits_to_date(F.col("HVDUE")).alias("acknowledged_date"),
        F.col("PCMT").alias("comment"),
        mode_of_code(code).alias("mode"),
    )


def freight_charges(
    details: DataFrame, invoices: DataFrame, packages: DataFrame, shipments: DataFrame, headers: DataFrame,
    params: OrderExtract = OrderExtract(),
) -> DataFrame:
    """Freight per shipment invoice: what was charged beyond the goods."""
    goods = (
        details.where(F.col("ILDOFD") > params.freight_min)
        .groupBy("ILPINN", "ILSPCD")
        .agg(F.sum(F.col("ILINVP") * F.col("ILQTYI")).alias("item_total"), F.max("ILPORD").alias("_po"))
    )
    weights = packages.groupBy("PKSPCD", "PKSHPN").agg(F.sum("PKPKGW").alias("gross_kg"))
    joined = (
        invoices.where(F.col("IHDOFD") > params.freight_min)
        .join(goods, (F.col("IHPINN") == F.col("ILPINN")) & (F.col("IHSPCD") == F.col("ILSPCD")))
        .join(weights, (F.col("IHSHPN") == F.col("PKSHPN")) & (F.col("IHSPCD") == F.col("PKSPCD")))
        .join(
            shipments.select("SHSHPN", "SHSPCD", "SHTPTC"),
            (F.col("IHSHPN") == F.col("SHSHPN")) & (F.col("IHSPCD") == F.col("SHSPCD")),
        )
        .join(headers.select("POPORD", "POWHCD"), F.col("_po") == F.col("POPORD"))
    )
    code = F.when(F.trim("SHTPTC") == "", "50").otherwise(F.col("SHTPTC"))
    return listed(joined, F.trim("POWHCD"), params.warehouses).select(
        digits_to_date(F.col("IHINVD")).alias("invoice_date"),
        mode_of_code(code).alias("mode"),
        F.col("IHSHPN").alias("shipment"),
        F.col("IHSPCD").alias("global_code"),
        F.col("IHPRCC").alias("currency"),
        F.col("IHPRCT").alias("invoice_total"),
        "item_total",
        F.trim("POWHCD").alias("warehouse"),
        "gross_kg",
        (F.col("IHPRCT") - F.col("item_total")).alias("freight"),
    )


def active_warehouses(
    warehouses: DataFrame, country: str | None = None, facility: str | None = None
) -> DataFrame:
    """Warehouses in use, optionally of one country or facility."""
    kept = warehouses.where(F.col("status") == 1)
    if country:
        kept = kept.where(F.col("country") == country)
    if facility:
        kept = kept.where(F.col("facility") == facility)
    return kept.select("warehouse").distinct()
