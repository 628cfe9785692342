"""Reading, typing and change detection."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import AS_OF
from stowage.sources import readers, tables

RAW_TEXT = """SELECT o_orderkey, CONCAT('  ', o_orderpriority, ' ') AS priority, o_totalprice AS total,
  CAST(YEAR(o_orderdate) * 10000 + MONTH(o_orderdate) * 100 + DAY(o_orderdate) + CASE WHEN o_custkey % 10 = 0 THEN 77 ELSE 0 END AS INT) AS entered FROM orders"""


def raw_orders(t):
    d = F.col("o_orderdate")
    digits = F.year(d) * 10000 + F.month(d) * 100 + F.day(d) + F.when(F.col("o_custkey") % 10 == 0, 77).otherwise(0)
    return t.orders.select(
        "o_orderkey", F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("priority"),
        F.col("o_totalprice").alias("total"), digits.alias("entered"),
    )


@query(
    "cleaned_source",
    f"""
SELECT o_orderkey, TRIM(priority) AS priority, total, CAST(try_strptime(CAST(entered AS VARCHAR), '%Y%m%d') AS DATE) AS entered FROM ({RAW_TEXT}) r""",
    "total",
)
def _(t):
    return readers.cleaned(raw_orders(t), dates=("entered",))


@query(
    "narrowed_read",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'",
    "o_totalprice",
)
def _(t):
    return readers.narrowed(
        t.orders,
        {"o_orderstatus": ("F", "O"), "o_orderpriority": "1-URGENT", "o_custkey": None},
        ("o_orderkey", "o_orderstatus", "o_totalprice"),
    )


@query(
    "sql_statement",
    "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY l_returnflag",
    "qty",
)
def _(t):
    text = "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty FROM {lines} WHERE l_shipdate >= :day GROUP BY l_returnflag"
    return readers.run_sql(t.spark, text, {"lines": t.lineitem}, day=dt.datetime(1996, 1, 1))


@query(
    "enforced_types",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, TRY_CAST(LEFT(o_orderpriority, 1) AS INTEGER) AS first, CAST(NULL AS INTEGER) AS word, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("first"),
        F.col("o_orderpriority").alias("word"), "o_orderdate",
    )
    return readers.enforce_types(
        rows, {"o_custkey": "string", "first": "int", "word": "int", "o_orderdate": "date", "absent": "int"}
    )


@query(
    "narrowed_types",
    "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
    "o_totalprice",
)
def _(t):
    """Keys that come as doubles and midnights are narrowed, prices and words are not."""
    rows = t.orders.select(
        F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double"), "o_totalprice", F.col("o_orderdate").cast("timestamp"), "o_orderpriority"
    )
    kinds = {"o_orderkey": "bigint", "o_custkey": "int", "o_totalprice": "bigint", "o_orderdate": "date", "o_orderpriority": "int", "absent": "int"}
    return readers.narrow_types(rows, kinds, strict=False)


DIFFERENT = "s.item IS NOT NULL AND (s.cost IS DISTINCT FROM n.cost OR s.vendor IS DISTINCT FROM n.vendor)"


@query(
    "changed_rows",
    f"""
SELECT n.item, n.cost, n.vendor FROM item_master n LEFT JOIN stored_items s ON s.item = n.item WHERE s.item IS NULL OR ({DIFFERENT})""",
    "cost",
)
def _(t):
    return tables.changed_rows(t.item_master.select("item", "cost", "vendor"), t.stored_items, ["item"])


@query(
    "change_log",
    """
SELECT n.item, 'vendor' AS field_name, s.vendor AS old_value, n.vendor AS new_value, DATE '2001-08-01' AS change_date, 'Table update' AS change_reason
FROM item_master n JOIN stored_items s ON s.item = n.item WHERE s.vendor IS DISTINCT FROM n.vendor""",
)
def _(t):
    return tables.change_log(
        t.item_master.select("item", "cost", "vendor"), t.stored_items, ["item"], AS_OF, monitor=("vendor",)
    )


@query(
    "upserted_rows",
    """
SELECT item, cost, vendor FROM item_master WHERE vendor < '2' UNION ALL SELECT item, cost, vendor FROM stored_items WHERE item NOT IN (SELECT item FROM item_master WHERE vendor < '2')""",
    "cost",
)
def _(t):
    new = t.item_master.select("item", "cost", "vendor").where(F.col("vendor") < "2")
    return tables.upserted(t.stored_items, new, ["item"])


@query(
    "upserted_columns",
    """
SELECT coalesce(s.item, n.item) AS item, CASE WHEN n.item IS NOT NULL THEN n.cost ELSE s.cost END AS cost, s.vendor
FROM stored_items s FULL JOIN (SELECT item, MAX(cost) + 1 AS cost FROM item_master GROUP BY item) n ON s.item = n.item""",
    "cost",
)
def _(t):
    # Each key comes twice, without the vendor.
    new = t.item_master.select("item", "cost")
    return tables.upserted(t.stored_items, new.union(new.withColumn("cost", F.col("cost") + 1)), ["item"], order=["cost"])


KEYED_LINES = "SELECT lord, lline, warehouse, item, order_date, MAX(qty) AS qty FROM demand_lines GROUP BY lord, lline, warehouse, item, order_date"


@query(
    "hot_zone_replaced",
    f"""
SELECT lord, lline, warehouse, item, order_date, CASE WHEN order_date >= DATE '2000-12-01' THEN qty + 1 ELSE qty END AS qty FROM ({KEYED_LINES}) d""",
    "qty",
)
def _(t):
    # New rows reach two months behind the zone: those replace their stored rows by key.
    keys = ["lord", "lline", "warehouse", "item", "order_date"]
    stored = t.demand_lines.groupBy(*keys).agg(F.max("qty").alias("qty"))
    new = stored.where(F.col("order_date") >= "2000-12-01").withColumn("qty", F.col("qty") + 1)
    return tables.hot_zone_replaced(stored, new, "order_date", AS_OF, keys=keys)


def new_table(t, name: str, date: str | None = None, keys=()) -> tables.StoredTable:
    """A stored table of its own under the session's warehouse."""
    unique = f"{name}_{uuid.uuid4().hex}"
    return tables.StoredTable(t.spark, unique, f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{unique}", date, keys)


@query(
    "stored_orders",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  o_totalprice + CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' THEN 2 WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS total FROM orders""",
    "total",
)
def _(t):
    """S9-S12 on a table by month: append, upsert, hot zone, and empty inputs in between."""
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("day"),
        F.col("o_totalprice").alias("total"), "o_custkey",
    )
    plain = rows.drop("o_custkey")
    table = new_table(t, "stored_orders", "day")
    table.append(plain.where("o_orderkey % 2 = 0"))
    table.append(plain.where("o_orderkey % 2 = 1"))
    changed = rows.where("o_custkey % 7 = 0").withColumn("total", F.col("total") + 1).drop("o_custkey")
    table.upsert(changed, ["o_orderkey"])
    table.upsert(plain.where("o_orderkey < 0"), ["o_orderkey"])
    hot = plain.where("day >= '1998-01-01'").withColumn("total", F.col("total") + 2)
    table.replace_hot_zone(hot, "day", dt.date(1998, 8, 2), 100, ["o_orderkey"])
    table.replace_hot_zone(hot.where("o_orderkey < 0"), "day", dt.date(1998, 8, 2), 100, ["o_orderkey"])
    table.overwrite(plain.where("o_orderkey < 0"))
    return table.read()


NULL_KEYED = "SELECT CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey END AS k, o_orderpriority AS part, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total, o_orderkey FROM orders"


@query(
    "upserted_null_keys",
    f"""
WITH rows_ AS ({NULL_KEYED}), first AS (
  SELECT k, part, day, total FROM rows_ WHERE k IS NOT NULL UNION ALL SELECT NULL, part, MIN(day), MIN(total) FROM rows_ WHERE k IS NULL GROUP BY part)
SELECT k, part, CASE WHEN k IS NULL THEN CAST(day + INTERVAL 62 DAY AS DATE) ELSE day END AS day, CASE WHEN k IS NULL OR k % 4 = 0 THEN total + 1 ELSE total END AS total FROM first""",
    "total",
)
def _(t):
    """S12 by month: rows whose key holds a null move to another month and stay single."""
    rows = t.orders.select(
        F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderkey")).alias("k"), F.col("o_orderpriority").alias("part"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("total"),
    )
    keyless = rows.where("k IS NULL").groupBy("k", "part").agg(F.min("day").alias("day"), F.min("total").alias("total"))
    table = new_table(t, "null_keys", "day", ("k", "part"))
    table.append(rows.where("k IS NOT NULL"))
    table.append(keyless)
    later = keyless.withColumns({"day": F.date_add("day", 62), "total": F.col("total") + 1})
    table.upsert(later, ["k", "part"])
    table.upsert(rows.where("k % 4 = 0").withColumn("total", F.col("total") + 1), ["k", "part"])
    return table.read()


@query(
    "dated_read",
    """
SELECT o_orderkey, day, total FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, o_totalprice AS total FROM orders) o
WHERE day BETWEEN DATE '1996-02-11' AND DATE '1996-09-05' AND p IN ('1-URGENT', '2-HIGH')""",
    "total",
)
def _(t):
    """S3 on a table by month: a range of dates and a list."""
    table = new_table(t, "dated_orders", "day")
    table.append(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("total")))
    return table.read({"p": ["1-URGENT", "2-HIGH"]}, ["o_orderkey", "day", "total"], dt.date(1996, 2, 11), dt.date(1996, 9, 5))


@query(
    "written_changes",
    """
SELECT o_orderkey, 'o_orderstatus' AS field_name, o_orderstatus AS old_value, 'X' AS new_value, DATE '2001-08-01' AS change_date, 'Table update' AS change_reason, 'X' AS stored
FROM orders WHERE o_custkey % 5 = 0""",
)
def _(t):
    """A dry run and an unchanged input leave no trace, the changed input one log entry per field."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    table, log = new_table(t, "kept_orders"), new_table(t, "order_log")
    table.overwrite(rows)
    changed = rows.withColumn("o_orderstatus", F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    table.write_changes(changed, ["o_orderkey"], AS_OF, log, dry_run=True)
    table.write_changes(rows, ["o_orderkey"], AS_OF, log)
    table.write_changes(changed, ["o_orderkey"], AS_OF, log)
    table.write_changes(changed, ["o_orderkey"], AS_OF, log)
    now = table.read().select("o_orderkey", F.col("o_orderstatus").alias("stored"))
    return log.read().join(now, "o_orderkey")


@query("csv_round_trip", "SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders")
def _(t):
    """An export read again."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_custkey").cast("bigint").alias("o_custkey"))
    folder = f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/orders_{uuid.uuid4().hex}"
    tables.export_csv(rows, folder)
    return t.spark.read.csv(folder, header=True, schema=rows.schema)


@query("required_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    """Present and filled columns pass; the check reads the whole table."""
    return readers.require_columns(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey", "o_orderstatus"])


@query(
    "rows_with_values",
    "SELECT * FROM (SELECT NULLIF(vendor, '1') AS vendor, CASE WHEN cost < 1000 THEN NULL ELSE cost END AS cost FROM stored_items) s WHERE vendor IS NOT NULL OR cost IS NOT NULL",
    "cost",
)
def _(t):
    # One vendor and small costs are blanked, so that some rows hold nothing.
    rows = t.stored_items.select(F.nullif(F.col("vendor"), F.lit("1")).alias("vendor"), F.when(F.col("cost") >= 1000, F.col("cost")).alias("cost"))
    return tables.without_blank_rows(rows)
