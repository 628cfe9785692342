"""Delivery records and the batching habits read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.distribution import quantile
from stowage.functions.numeric import ratio
from stowage.functions.running import stacked
from stowage.operators.leadtime import correct_modes, fallback_means, lead_time_ranges
from stowage.operators.po import base_line, number_sublines
from stowage.session import materialised

GROUP = ("vendor", "mode", "warehouse", "item")


def combined_deliveries(
    history: DataFrame, in_transit: DataFrame, stats: DataFrame | None = None, tolerance: float = 2
) -> DataFrame:
    """A4: finished and invoiced open deliveries in one shape, with corrected mode."""
    ranges = lead_time_ranges(stats, fallback_means(history))
    corrected = correct_modes(history, ranges, tolerance, courier_to_air=True)
    shape = ["ponum", "poline", "item", "vendor", "warehouse", "ordered_qty"]
    done = corrected.select(
        *shape,
        F.col("received_qty").alias("shipped_qty"),
        "po_entry_date", "invoice_date", "delivery_date",
        F.when(F.col("mode") == "Courier", "Air").otherwise(F.col("mode")).alias("mode"),
        F.lit("HIST").alias("source"),
        "is_closed",
    )
    moving = in_transit.where(F.col("invoice_date").isNotNull()).select(
        *shape,
        F.col("in_transit_qty").alias("shipped_qty"),
        "po_entry_date", "invoice_date",
        F.lit(None).cast("date").alias("delivery_date"),
        "mode",
        F.lit("GIT").alias("source"),
        F.lit("N").alias("is_closed"),
    )
    return stacked(done, moving)


def delivery_records(
    history: DataFrame, in_transit: DataFrame, stats: DataFrame | None = None, tolerance: float = 2
) -> DataFrame:
    """A4: the combined deliveries with unified sub-lines, base line and split flag."""
    combined = combined_deliveries(history, in_transit, stats, tolerance)
    line = ["ponum", "base_poline"]
    # Rows come to their order lines once; sub-lines are numbered and lines are counted there.
    based = combined.withColumn("base_poline", base_line()).repartition(*line)
    numbered = number_sublines(based, ("invoice_date", "delivery_date"), out="unified_poline", within=line[1:])
    # A line that is not known in full is not counted.
    known = F.col("ponum").isNotNull() & F.col("base_poline").isNotNull()
    split = F.when(known, F.count(F.lit(1)).over(Window.partitionBy(*line)) > 1)
    return numbered.withColumn("is_split", split).select(*combined.columns, "unified_poline", *line[1:], "is_split")


def delivery_behaviour(records: DataFrame, closed_only: bool = True) -> DataFrame:
    """A5: how a vendor splits deliveries of an item: from invoice dates to order lines to groups.

    Takes the combined deliveries or the numbered records. An order line takes vendor, mode,
    warehouse and item from its first row.
    """
    rows = records.where(F.col("is_closed") == "Y") if closed_only else records
    rows = rows.withColumn("_base", base_line())
    line = ["ponum", "_base"]
    # The first row of a line: sorted by these columns with nulls last, it is the least struct.
    rest = [c for c in ("delivery_date", *GROUP) if c in rows.columns]
    order = [x for c in ("poline", "invoice_date", *rest) for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c).alias(c))]
    # Rows come to their order lines once; invoice dates and lines are both summed up there.
    batches = rows.repartition(*line).groupBy(*line, "invoice_date").agg(
        F.coalesce(F.sum("shipped_qty"), F.lit(0.0)).alias("_all"), F.min(F.struct(*order)).alias("_head")
    ).withColumn("_qty", F.when(F.col("invoice_date").isNotNull(), F.col("_all")))
    count, total = F.col("_batches"), F.col("_total")
    lines = (
        batches.groupBy(*line)
        .agg(
            F.count("invoice_date").alias("_batches"),
            F.sum("_qty").alias("_total"),
            F.max("_qty").alias("_largest"),
            F.avg("_qty").alias("_average"),
            F.datediff(F.max("invoice_date"), F.min("invoice_date")).alias("_spread"),
            F.max_by("_qty", "invoice_date").alias("_tail"),
            F.min("_head").alias("_head"),
        )
        .where(count > 0)
        .withColumns(
            {
                "_interval": F.coalesce(ratio(F.col("_spread"), count - 1), F.lit(0.0)),
                "_tail_share": F.when(total > 0, F.col("_tail") / total).otherwise(0.0),
                **{c: F.col(f"_head.{c}") for c in GROUP},
            }
        )
    )
    whole = F.col("vendor").isNotNull() & F.col("mode").isNotNull() & F.col("warehouse").isNotNull() & F.col("item").isNotNull()
    # Order lines are worked out once, for the means and for the quantile.
    known = materialised(lines.where(whole).select(*GROUP, "_batches", "_average", "_spread", "_interval", "_tail_share", "_largest"))

    def mean_if(condition: Column, value: str, otherwise: float) -> Column:
        return F.coalesce(F.avg(F.when(condition, F.col(value))), F.lit(otherwise))

    habits = known.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("total_pos"),
        F.avg((count > 1).cast("double")).alias("split_rate"),
        mean_if(count > 1, "_batches", 1.0).alias("avg_batch_count"),
        F.avg("_average").alias("typical_batch_qty"),
        mean_if(F.col("_spread") > 0, "_spread", 0.0).alias("avg_spread_days"),
        mean_if(F.col("_interval") > 0, "_interval", 0.0).alias("avg_interval_days"),
        F.avg("_tail_share").alias("avg_tail_share"),
    )
    return habits.join(quantile(known, GROUP, "_largest", 0.9, "max_batch_qty"), list(GROUP), "left")


def batch_profile(behaviour: DataFrame) -> DataFrame:
    """Whether a group tends to split deliveries, and the batches to expect."""
    prone = (
        (F.col("split_rate") > 0.5) & (F.col("avg_batch_count") >= 2) & (F.col("avg_spread_days") >= 7)
    )
    return behaviour.select(
        *GROUP,
        F.when(prone, "Y").otherwise("N").alias("is_batch_prone"),
        F.col("max_batch_qty").alias("batch_trigger_qty"),
        F.ceil("avg_batch_count").cast("int").alias("predicted_batch_count"),
        F.col("typical_batch_qty").alias("predicted_batch_qty"),
        F.col("avg_interval_days").alias("predicted_interval_days"),
        F.col("avg_tail_share").alias("predicted_tail_share"),
    )
