"""Statistics of a value inside groups, computed from counts of distinct values.

Counts are combined on the map side, so a group's size never matters: only its distinct values
reach one task, and for whole days their number is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Per group: samples, mean, std (sample), typical (most frequent, smallest on ties) and interpolated quantiles.

    The mode and the quantiles keep a count per distinct value and are combined before the shuffle.
    ``weight`` counts the rows behind a pre-aggregated row.
    """
    v = F.col(value).cast("double")
    known = df.where(F.col(value).isNotNull())
    if weight is not None:
        return _described_counts(known.groupBy(*keys, v.alias("_v")).agg(F.sum(weight).alias("_n")), keys, quantiles)
    return known.groupBy(*keys).agg(
        F.count(v).alias("samples"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.mode(v, True).alias("typical"),
        *[F.percentile(v, F.lit(float(p))).alias(name) for name, p in quantiles.items()],
    )


def _described_counts(counts: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """The same statistics of counted values."""
    v, n = F.col("_v"), F.col("_n")
    total, mean = F.sum(n), F.sum(v * n) / F.sum(n)
    # Around a value of the group, so that equal values have no spread left over from rounding.
    moved = counts.withColumn("_d", v - F.min(v).over(Window.partitionBy(*keys)))
    d = F.col("_d")
    spread = F.greatest(F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / F.sum(n), F.lit(0.0))
    return moved.groupBy(*keys).agg(
        total.alias("samples"),
        mean.alias("mean"),
        F.when(total > 1, F.sqrt(spread / (total - 1))).alias("std"),
        F.max_by("_v", F.struct(n, -v)).alias("typical"),
        *[F.percentile(v, F.lit(float(p)), n).alias(name) for name, p in quantiles.items()],
    )


def described(
    df: DataFrame, keys: Sequence[str], date: str, value: str, quantiles: Mapping[str, float], alpha: float, weight: str | None = None
) -> DataFrame:
    """What ``describe`` and ``smoothed`` (as ``recent``) give, from one table of counts by date and value.

    The counts are shuffled to their groups once. There they get cumulated positions in sorted windows, which spill; no group is held in one
    buffer, however many groups there are. A group without values gives no row.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(date).alias("_date"), F.col(value).cast("double").alias("_v"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    group = Window.partitionBy(*keys)
    ahead = lambda *order: group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v, n, total = F.col("_v"), F.col("_n"), F.max("_total")
    # Sorted by date once and by value once, two windows in all: whatever is asked of the order by value, frames of one window answer.
    # Among equal values any order gives the same quantiles.
    by_value = group.orderBy("_v")
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.withColumn("_aged", F.sum("_n").over(ahead("_date", "_v"))).withColumns(
        {
            "_upto": F.sum("_n").over(ahead("_v")),
            "_total": F.sum("_n").over(whole),
            "_d": v - F.min("_v").over(whole),
            "_same": F.sum("_n").over(by_value.rangeBetween(Window.currentRow, Window.currentRow)),
        }
    )

    def quantile_at(p: float) -> Column:
        place = (total - 1) * F.lit(float(p))
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.min(F.when(F.col("_upto") > F.floor(at), v)), F.min(F.when(F.col("_upto") > F.ceil(at), v))
        return F.when(low == high, low).otherwise(low * (F.ceil(place) - place) + high * (place - F.floor(place)))

    d, keep = F.col("_d"), F.lit(1.0 - alpha)
    # Around a value of the group, so that equal values have no spread left over from rounding.
    spread = F.greatest(F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / total, F.lit(0.0))
    folded = v * (F.lit(1.0) - F.pow(keep, n)) * F.pow(keep, F.col("_total") - F.col("_aged"))
    start = F.when(F.col("_aged") == n, v * F.pow(keep, F.col("_total"))).otherwise(0.0)
    return placed.groupBy(*keys).agg(
        total.alias("samples"),
        (F.sum(v * n) / total).alias("mean"),
        F.when(total > 1, F.sqrt(spread / (total - 1))).alias("std"),
        F.max(F.struct("_same", (-v).alias("_low"))).alias("_typical"),
        *[quantile_at(p).alias(name) for name, p in quantiles.items()],
        F.sum(folded + start).alias("recent"),
    ).select("*", (F.lit(0.0) - F.col("_typical._low")).alias("typical")).drop("_typical")


def quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """Per group the interpolated quantile of a value with any number of distinct values.

    Counted values get their cumulated positions in a sorted window, which spills; no group is held in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    by_value = Window.partitionBy(*keys).orderBy("_v")
    upto = F.sum("_n").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.withColumns({"_upto": upto, "_at": (F.sum("_n").over(whole) - 1) * F.lit(float(p))})

    def value_at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))

    share = F.max(F.col("_at") - F.floor("_at"))
    low, high = value_at(F.floor("_at")), value_at(F.ceil("_at"))
    return placed.groupBy(*keys).agg((low * (1 - share) + high * share).alias(out))


def smoothed(
    df: DataFrame, keys: Sequence[str], date: str, value: str, alpha: float, out: str, weight: str | None = None
) -> DataFrame:
    """The last value of ``s = a*x + (1-a)*s`` over rows ordered by date, then value; ``s`` starts at the first x.

    Equal (date, value) rows fold in closed form, so rows are counted, not sorted. A row without a value is passed over: it neither moves the mean nor
    ages what came before (A7 and A8 alike); a group without values gives no row.
    """
    keys = list(keys)
    keep = F.lit(1.0 - alpha)
    steps = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, date, F.col(value).cast("double").alias("_v"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy(date, "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = steps.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(group)})
    folded = F.col("_v") * (F.lit(1.0) - F.pow(keep, F.col("_n"))) * F.pow(keep, F.col("_total") - F.col("_upto"))
    start = F.when(F.col("_upto") == F.col("_n"), F.col("_v") * F.pow(keep, F.col("_total"))).otherwise(0.0)
    return placed.groupBy(*keys).agg(F.sum(folded + start).alias(out))
