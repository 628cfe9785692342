"""Purchase-order lines: stage days, repairs, sub-lines and snapshot events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.numeric import is_true
from stowage.functions.running import nulls_last
from stowage.functions.weeks import as_of_column

PO_LINE = ("ponum", "poline")
TRUCK_LIMIT = 7
TAIL_MARK = "[VIRTUAL_TAIL]"
# Tracked snapshot fields and the event a rise in them means.
TRACKED = {"PCQTY": "INVOICE", "PQREC": "RECEIPT"}


def base_line(poline: str = "poline") -> Column:
    """The line number without its sub-line suffix."""
    return F.split_part(F.trim(F.col(poline)), F.lit("-"), F.lit(1))


def _known(columns: Sequence[str]) -> Column:
    return reduce(lambda known, c: known & F.col(c).isNotNull(), columns, F.lit(True))


def stage_days(
    df: DataFrame,
    entry: str = "po_entry_date",
    invoice: str = "invoice_date",
    delivery: str = "delivery_date",
) -> DataFrame:
    """T4: days spent preparing, in transport, and in total."""
    return df.withColumns(
        {
            "prepare_days": F.datediff(invoice, entry),
            "transport_days": F.datediff(delivery, invoice),
            "total_days": F.datediff(delivery, entry),
        }
    )


def repair_truck_days(df: DataFrame) -> DataFrame:
    """T5: truck transport below zero or above a week is charged to preparation instead."""
    negative = is_true(F.col("transport_days") < 0)
    over = is_true(F.col("transport_days") > TRUCK_LIMIT)
    prepare = (
        F.when(negative, F.col("total_days"))
        .when(over, F.col("prepare_days") + F.col("transport_days") - TRUCK_LIMIT)
        .otherwise(F.col("prepare_days"))
    )
    transport = F.when(negative, 0).when(over, TRUCK_LIMIT).otherwise(F.col("transport_days"))
    flag = (
        F.when(negative, "NEGATIVE_TRANSPORT_FIXED").when(over, "TRUCK_OVERSHOOT_CORRECTED").otherwise("OK")
    )
    return df.withColumns({"prepare_days": prepare, "transport_days": transport, "transport_flag": flag})


def repair_remaining(df: DataFrame, keys: Sequence[str] = PO_LINE) -> DataFrame:
    """The open quantity of a line cannot exceed what is ordered and not yet under way."""
    moving = F.coalesce(F.sum("in_transit_qty").over(Window.partitionBy(*keys)), F.lit(0.0))
    # A line that is not known in full is left as it is.
    left = F.when(_known(keys), F.col("ordered_qty") - F.col("_moving"))
    wrong = is_true(F.col("remaining_qty") > left)
    return (
        df.withColumn("_moving", moving)
        .withColumns(
            {
                "remaining_qty": F.when(wrong, left).otherwise(F.col("remaining_qty")),
                "remaining_corrected": wrong.cast("int"),
            }
        )
        .select(*df.columns, "remaining_corrected")
    )


def add_tail_lines(df: DataFrame, keys: Sequence[str] = PO_LINE) -> DataFrame:
    """A partly shipped line gets one extra row for what is still to be shipped.

    The first row of a line (earliest invoice) decides; the open quantity moves from the shipped
    rows to the tail row.
    """
    keys = list(keys)
    order = nulls_last(["invoice_date", *[c for c in df.columns if c not in {*keys, "invoice_date"}]])
    group = Window.partitionBy(*keys)
    partly = is_true((F.col("remaining_qty") > 0) & (F.col("remaining_qty") < F.col("ordered_qty")))
    # One shuffle for T6 to T8: rows are marked in windows over their line, and the row that decides appears twice.
    marked = (
        df.withColumn("_tail", (F.row_number().over(group.orderBy(*order)) == 1) & partly)
        .withColumn("_tailed", F.max("_tail").over(group) & _known(keys))
        .withColumn("_virtual", F.explode(F.when(F.col("_tail"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    )
    virtual = F.col("_virtual")
    changed = {
        "in_transit_qty": F.when(virtual, 0.0).otherwise(F.col("in_transit_qty")),
        "remaining_qty": F.when(F.col("_tailed") & ~virtual, 0.0).otherwise(F.col("remaining_qty")),
        "invoice_date": F.when(~virtual, F.col("invoice_date")),
        "comment": F.when(virtual, F.concat(F.coalesce(F.col("comment"), F.lit("")), F.lit(TAIL_MARK))).otherwise(F.col("comment")),
    }
    if "remaining_corrected" in df.columns:
        changed["remaining_corrected"] = F.when(virtual, 0).otherwise(F.col("remaining_corrected"))
    return marked.withColumns(changed).select(*df.columns)


def number_sublines(
    df: DataFrame,
    order: Sequence[str] = ("invoice_date", "delivery_date"),
    po: str = "ponum",
    line: str = "poline",
    out: str | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Repeated (order, line) rows become ``line-1``, ``line-2``...; single rows keep their line.

    ``order`` starts with a date column and is completed by the remaining columns as tie-break. ``within`` names columns that
    follow from order and line; rows that lie together by them are numbered where they are.
    """
    out = out or line
    rest = [c for c in df.columns if c not in {po, line, *order, *within}]
    # A line of an order holds a handful of rows by nature: one shuffle, one sort and one window number them.
    placing = Window.partitionBy(po, *within, line).orderBy(*nulls_last([*order, *rest]))
    whole = placing.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = df.withColumns({"_position": F.row_number().over(placing), "_size": F.count(F.lit(1)).over(whole)})
    label = F.when(F.col("_size") > 1, F.concat_ws("-", F.col(line), F.col("_position").cast("string")))
    return placed.withColumn(out, label.otherwise(F.col(line).cast("string"))).drop("_position", "_size")


def tail_subline(poline: Column, batch: Column, base_index: Column | None = None) -> Column:
    """The label of a further batch, counting on from the largest suffix in use."""
    pattern = r"^(.*)-(\d+)$"
    suffixed = poline.rlike(pattern)
    prefix = F.when(suffixed, F.regexp_extract(poline, pattern, 1)).otherwise(poline)
    if base_index is None:
        base_index = F.when(suffixed, F.regexp_extract(poline, pattern, 2).try_cast("int")).otherwise(0)
    return F.concat_ws("-", prefix, (base_index + batch).cast("string"))


def snapshot_events(
    previous: DataFrame, current: DataFrame, deliveries: DataFrame, as_of: dt.date
) -> DataFrame:
    """What happened between two snapshots of the open orders.

    A rise in a tracked quantity is an event. A line that vanished was received if it was under way
    or has a delivery on its base line, and cancelled otherwise. Lines seen first now give no event.
    """
    keys = list(PO_LINE)
    fields = [*TRACKED, "PQTRANSIT", "PQORD"]
    old = previous.select(
        *keys, F.col("item").alias("_item_old"), F.col("warehouse").alias("_warehouse_old"),
        *[F.col(f).alias(f"{f}_old") for f in fields],
    )
    new = current.select(*keys, "item", "warehouse", *TRACKED)
    merged = new.join(old, keys, "full")

    def event(kind: Column, qty: Column, total: Column, name: str) -> Column:
        return F.struct(
            kind.alias("event_type"),
            qty.cast("double").alias("qty_delta"),
            total.cast("double").alias("qty_total"),
            F.lit(name).alias("field_name"),
        )

    candidates = []
    for name, kind in TRACKED.items():
        rise = F.col(name) - F.col(f"{name}_old")
        candidates.append(event(F.when(rise > 0, F.lit(kind)), rise, F.col(name), name))
    vanished = F.col("item").isNull() & F.col("_item_old").isNotNull()
    under_way = is_true(F.col("PQTRANSIT_old") > 0)
    candidates.append(
        event(
            F.when(vanished & under_way, "RECEIPT").when(vanished, "GONE"),
            F.when(under_way, F.col("PQTRANSIT_old")).otherwise(F.col("PQORD_old")),
            F.when(under_way, F.col("PQREC_old") + F.col("PQTRANSIT_old")).otherwise(F.col("PQREC_old")),
            "PQREC",
        )
    )
    events = (
        merged.select(
            *keys,
            F.coalesce("item", "_item_old").alias("item"),
            F.coalesce("warehouse", "_warehouse_old").alias("warehouse"),
            F.explode(F.array(*candidates)).alias("_event"),
        )
        .select(*keys, "item", "warehouse", "_event.*")
        .where(F.col("event_type").isNotNull())
        .withColumn("_base", base_line())
    )
    delivered = deliveries.select("ponum", base_line().alias("_base")).distinct().withColumn("_seen", F.lit(True))
    kind = F.when(F.col("event_type") != "GONE", F.col("event_type")).otherwise(
        F.when(F.col("_seen"), "RECEIPT").otherwise("CANCEL")
    )
    return events.join(delivered, ["ponum", "_base"], "left").select(
        as_of_column(as_of).alias("snapshot_date"),
        *keys, "item", "warehouse",
        kind.alias("event_type"), "qty_delta", "qty_total", "field_name",
    )
