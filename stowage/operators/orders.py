"""Order lines and master data after an extract: changes, inheritance, flags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import ratio
from stowage.functions.running import stacked
from stowage.functions.weeks import as_of_column

ORDER_LINE = ("lord", "lline", "warehouse")
GONE = "Order line missing (deleted or cancelled)"


def _compared(raw: DataFrame, clean: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Open raw lines beside their clean line, with the list of differing fields."""
    kept = clean.select(*keys, *[F.col(f).alias(f"_clean_{f}") for f in fields], F.lit(True).alias("_found"))
    joined = raw.where(F.coalesce(F.col("is_changed"), F.lit(0)) == 0).join(kept, list(keys), "left")
    missing = F.col("_found").isNull()
    differing = [
        F.when(~missing & ~F.col(f).eqNullSafe(F.col(f"_clean_{f}")), F.lit(f)) for f in fields
    ]
    return joined.withColumn("_changed", F.array_compact(F.array(F.when(missing, F.lit("ROW")), *differing)))


def order_changes(
    raw: DataFrame,
    clean: DataFrame,
    as_of: dt.date,
    fields: Sequence[str] = ("qty",),
    keys: Sequence[str] = ORDER_LINE,
) -> DataFrame:
    """One log row per changed field; the old value is the clean one, the new value the raw one."""

    def text(prefix: str) -> Column:
        chosen = F.lit(None).cast("string")
        for f in fields:
            chosen = F.when(F.col("field_name") == f, F.col(f"{prefix}{f}").cast("string")).otherwise(chosen)
        return chosen

    exploded = _compared(raw, clean, fields, keys).withColumn("field_name", F.explode("_changed"))
    reason = F.when(F.col("field_name") == "ROW", GONE).otherwise(F.concat("field_name", F.lit(" changed")))
    return exploded.select(
        *keys,
        as_of_column(as_of).alias("change_date"),
        "field_name",
        text("_clean_").alias("old_value"),
        text("").alias("new_value"),
        reason.alias("change_reason"),
    )


def mark_order_changes(
    raw: DataFrame,
    clean: DataFrame,
    as_of: dt.date,
    fields: Sequence[str] = ("qty",),
    keys: Sequence[str] = ORDER_LINE,
) -> DataFrame:
    """The raw table with changed lines marked; lines marked earlier pass through."""
    compared = _compared(raw, clean, fields, keys)
    changed = F.size("_changed") > 0
    marked = compared.withColumns(
        {
            "is_changed": F.when(changed, 1).otherwise(F.col("is_changed")),
            "change_date": F.when(changed, as_of_column(as_of)).otherwise(F.col("change_date")),
            "reason": F.when(
                changed, F.concat(F.lit("Field(s) changed: "), F.array_join(F.array_sort("_changed"), ", "))
            ).otherwise(F.col("reason")),
        }
    ).select(*raw.columns)
    return stacked(marked, raw.where(F.col("is_changed") != 0))


def safety_transfers(item_warehouse: DataFrame, links: DataFrame) -> DataFrame:
    """Which child takes over how much safety stock from which parent.

    With several stocked parents the smallest parent id is used.
    """
    holding = item_warehouse.select("item", "warehouse", "safety")
    usable = links.where((F.col("type") == "1") & (F.col("qty") > 0))
    parents = holding.where(F.col("safety") > 0).select(
        F.col("item").alias("parent"), "warehouse", F.col("safety").alias("parent_safety")
    )
    children = holding.where(F.coalesce(F.col("safety"), F.lit(0)) <= 0).select(
        F.col("item").alias("child"), "warehouse", F.col("safety").alias("child_safety_before")
    )
    offers = usable.join(parents, "parent").join(children, ["child", "warehouse"])
    chosen = F.min_by(
        F.struct("parent_safety", "child_safety_before", "qty"), F.col("parent")
    ).alias("_offer")
    return (
        offers.groupBy("warehouse", "child")
        .agg(F.min("parent").alias("parent"), chosen)
        .select(
            "warehouse", "parent", "child", "_offer.parent_safety", "_offer.child_safety_before",
            F.round(ratio(F.col("_offer.parent_safety"), F.col("_offer.qty")), 2).alias("child_safety_after"),
            "_offer.qty",
        )
    )


def inherit_safety(item_warehouse: DataFrame, links: DataFrame) -> DataFrame:
    """Item by warehouse with the transfers applied and the giving parents set to zero."""
    transfers = safety_transfers(item_warehouse, links)
    taken = transfers.select(F.col("child").alias("item"), "warehouse", F.col("child_safety_after").alias("_taken"))
    given = transfers.select(F.col("parent").alias("item"), "warehouse", F.lit(0.0).alias("_given")).distinct()
    return (
        item_warehouse.join(taken, ["item", "warehouse"], "left")
        .join(given, ["item", "warehouse"], "left")
        .withColumn("safety", F.coalesce("_taken", "_given", F.col("safety").cast("double")))
        .select(*item_warehouse.columns)
    )


def flag_replaced(items: DataFrame, links: DataFrame) -> DataFrame:
    """T13: 'Y' on every item that is the parent of a type-1 link, null elsewhere."""
    replaced = (
        links.where(F.col("type") == "1").select(F.col("parent").alias("item")).distinct()
        .withColumn("_flag", F.lit("Y"))
    )
    return (
        items.join(replaced, "item", "left").withColumn("rpflag", F.col("_flag")).select(*items.columns)
        if "rpflag" in items.columns
        else items.join(replaced.withColumnRenamed("_flag", "rpflag"), "item", "left")
    )
