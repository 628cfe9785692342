"""Positions and running sums inside groups of any size.

A plain window over a group runs in one task. Here a group is first cut into levels by a leading
sort column: level totals are pre-aggregated (map side), the short list of levels is cumulated, and
only the rows inside one level are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_DATE = "9999-12-31"
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def dated(column: str) -> Column:
    """A date level that sorts missing dates last."""
    return F.coalesce(F.col(column).cast("date"), F.lit(LAST_DATE).cast("date"))


def nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    level: Column,
    order: Sequence[Column],
    before: str,
    total: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add the weight sorted ahead of each row in its group, and the group's whole weight.

    ``level`` must be non-null and non-decreasing in the wanted order; ``order`` sorts inside a
    level and must be total for a repeatable result.
    """
    keys = list(keys)
    columns = df.columns
    weighted = df.withColumns({"_level": level, "_weight": F.lit(1) if weight is None else weight})
    in_group = Window.partitionBy(*keys)
    levels = (
        weighted.groupBy(*keys, "_level")
        .agg(F.sum("_weight").alias("_level_weight"))
        .withColumns(
            {
                "_ahead": F.sum("_level_weight").over(
                    in_group.orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
                ),
                total: F.sum("_level_weight").over(in_group),
            }
        )
        .drop("_level_weight")
    )
    in_level = (
        Window.partitionBy(*keys, "_level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = F.coalesce(F.col("_ahead"), F.lit(0)) + F.coalesce(F.sum("_weight").over(in_level), F.lit(0))
    return (
        weighted.join(levels, [*keys, "_level"], "left").withColumn(before, ahead).select(*columns, before, total)
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    level: Column,
    order: Sequence[Column],
    position: str,
    size: str,
) -> DataFrame:
    """Add the 1-based position of each row in its group and the group size."""
    return running_sum(df, keys, level, order, position, size).withColumn(position, F.col(position) + 1)


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several tables by column name.

    Spark 4.1 may report a partitioning for a union that its rows do not have after adaptive
    replanning; a window or grouping on top then misses its shuffle and counts wrongly. A session that
    ``session.configure`` has set up takes the union back to an unknown partitioning; in another one this is refused.
    """
    if first.sparkSession.conf.get(UNION_PARTITIONING, "true") != "false":
        raise ValueError(f"set {UNION_PARTITIONING} to false first (stowage.session.configure)")
    for other in others:
        first = first.unionByName(other)
    return first


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. Spark limits every map task to one row per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
