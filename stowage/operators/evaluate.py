"""Backtest of the forecast chain and its summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import half_even, ratio
from stowage.functions.weeks import monday_of
from stowage.operators import classify as kinds
from stowage.params import KEYS

TINY = 1e-6


def backtest_windows(
    filled: DataFrame, cutoff: dt.date, weeks: int = 4, start: dt.date | None = None
) -> DataFrame:
    """demand after the cut-off, before it, and a year earlier, in one scan.

    A key without a week between ``start`` and the cut-off is not evaluated.
    """
    c = F.lit(monday_of(cutoff)).cast("date")
    end, before = F.date_add(c, 7 * weeks), F.date_sub(c, 7 * weeks)
    week = F.col("week_start")

    def within(low: Column, high: Column) -> Column:
        return F.coalesce(F.sum(F.when((week >= low) & (week < high), F.col("qty"))), F.lit(0.0))

    analysed = week <= c if start is None else (week <= c) & (week >= F.lit(start).cast("date"))
    return (
        filled.groupBy(*KEYS)
        .agg(
            within(c, end).alias("actual"),
            within(before, c).alias("last_period"),
            within(F.add_months(c, -12), F.add_months(end, -12)).alias("last_year"),
            F.count(F.when(analysed, 1)).alias("_analysed"),
        )
        .where(F.col("_analysed") > 0)
        .drop("_analysed")
    )


def score_forecast(planned: DataFrame, windows: DataFrame, quarterly: bool = False) -> DataFrame:
    """forecasts made at the cut-off against what was ordered afterwards."""
    months = 3 if quarterly else 1
    predicted = F.greatest(F.coalesce(F.col("forecast_monthly"), F.lit(0.0)) * months, F.lit(0.0))
    joined = planned.join(windows, list(KEYS)).withColumns(
        {"predicted": predicted, "dynamic_safety": F.coalesce(F.col("dynamic_safety"), F.lit(0.0))}
    )
    actual = F.col("actual")
    known = joined.withColumns(
        {
            "error": F.col("predicted") - actual,
            "absolute_error": F.abs(F.col("predicted") - actual),
            "ape": F.when(actual > 0, F.abs(F.col("predicted") - actual) / actual),
            "mom_growth": F.coalesce(
                F.when(F.col("last_period") > 0, (actual - F.col("last_period")) / F.col("last_period")), F.lit(0.0)
            ),
            "yoy_growth": F.coalesce(
                F.when(F.col("last_year") > 0, (actual - F.col("last_year")) / F.col("last_year")), F.lit(0.0)
            ),
            "forecast_plus_safety": F.col("predicted") + F.col("dynamic_safety"),
        }
    ).withColumns(
        {
            "coverage_gap": F.col("forecast_plus_safety") - actual,
            "covered": actual <= F.col("forecast_plus_safety"),
        }
    )
    closeness = F.coalesce(1 / (1 + F.col("ape")), F.lit(0.0))
    stability = 1 / (1 + F.abs("mom_growth") + F.abs("yoy_growth"))
    coverage = F.when(F.col("covered"), 1.0).otherwise(
        F.greatest(F.lit(0.5), 1 - F.abs("coverage_gap") / (actual + TINY))
    )
    excess = F.greatest(F.lit(0.0), (F.col("predicted") - actual) / (actual + TINY))
    restraint = F.greatest(F.lit(0.5), 1 - excess)
    score = half_even(closeness * 0.4 + stability * 0.2 + coverage * 0.2 + restraint * 0.2, 3)
    level = F.when(F.col("service_level") != 0, F.col("service_level")).otherwise(0.85)
    final = F.when(F.col("final_safety") != 0, F.col("final_safety")).otherwise(F.col("dynamic_safety"))
    return known.select(
        *KEYS, "predicted", "actual", "last_year", "last_period", "yoy_growth", "mom_growth", "error",
        "absolute_error", "ape", score.alias("score"), "demand_type", "activity_level", "cost", "dynamic_safety",
        final.alias("final_safety"), "forecast_plus_safety", "coverage_gap", "covered", level.alias("service_level"),
    )


def evaluation_rows(
    scored: DataFrame, cutoff: dt.date, start: dt.date, weeks: int = 4
) -> DataFrame:
    """the stored evaluation row, coverage as Y/N."""
    return scored.select(
        *KEYS,
        F.lit(start).cast("date").alias("eval_start"),
        F.lit(monday_of(cutoff)).cast("date").alias("eval_end"),
        F.lit(weeks).alias("backtest_weeks"),
        "predicted", "dynamic_safety", "actual", "ape", "mom_growth", "yoy_growth", "score",
        F.when(F.col("covered"), "Y").otherwise("N").alias("covered"),
        "coverage_gap", "demand_type", "activity_level",
    )


def _reported(rows: DataFrame, ignore_inactive: bool) -> DataFrame:
    if not ignore_inactive:
        return rows
    idle = F.coalesce(F.col("activity_level").isin(kinds.INACTIVE, kinds.DORMANT), F.lit(False))
    unfit = F.coalesce(F.col("demand_type").isin(kinds.NEW, kinds.REPLACED, kinds.STOCK_ONLY), F.lit(False))
    return rows.where(~idle & ~unfit)


def forecast_report(rows: DataFrame, ignore_inactive: bool = True) -> DataFrame:
    """accuracy, coverage and bias overall, by demand type and by activity level."""
    kept = _reported(rows, ignore_inactive)
    gap = F.col("actual") - F.col("predicted")
    total = F.sum("actual")
    level = F.grouping_id("demand_type", "activity_level")
    summary = kept.groupingSets(
        [[], ["demand_type"], ["activity_level"]], "demand_type", "activity_level"
    ).agg(
        level.alias("_level"),
        F.count(F.lit(1)).alias("items"),
        F.avg(F.coalesce(F.col("ape"), F.lit(0.0))).alias("_mape"),
        ratio(F.sum(F.abs(gap)), total).alias("_wape"),
        F.sqrt(F.avg(gap * gap)).alias("_rmse"),
        F.avg("score").alias("_score"),
        F.avg((F.col("covered") == "Y").cast("double")).alias("_coverage"),
        F.when(total > 0, ratio(F.sum("predicted") - total, total)).alias("_bias"),
    )
    overall = F.col("_level") == 3
    name = F.when(overall, "Overall").when(F.col("_level") == 1, "DemandType").otherwise("ActivityLevel")
    group = F.when(overall, "All").when(F.col("_level") == 1, F.col("demand_type")).otherwise(F.col("activity_level"))
    return summary.select(
        name.alias("level"),
        group.alias("group_name"),
        "items",
        half_even(F.col("_mape"), 4).alias("mape"),
        half_even(F.col("_wape"), 4).alias("wape"),
        F.when(overall, half_even(F.col("_rmse"), 4)).alias("rmse"),
        half_even(F.col("_score"), 4).alias("score"),
        half_even(F.col("_coverage"), 4).alias("coverage_rate"),
        half_even(F.col("_bias"), 4).alias("bias"),
    )


def worst_forecasts(rows: DataFrame, count: int = 20, ignore_inactive: bool = True) -> DataFrame:
    """the items with the largest percentage error."""
    return (
        _reported(rows, ignore_inactive)
        .withColumn("ape", F.coalesce(F.col("ape"), F.lit(0.0)))
        .orderBy(F.col("ape").desc(), *KEYS)
        .limit(count)
        .select(
            *KEYS, "demand_type", "activity_level", "actual", "predicted", "ape", "score", "coverage_gap", "covered"
        )
    )
