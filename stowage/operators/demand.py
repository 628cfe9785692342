"""Demand series, item universe and master data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.numeric import half_even
from stowage.functions.running import first_rows, stacked
from stowage.functions.weeks import history_label, monday, monday_of, next_weeks, parse_week, week_label, week_number
from stowage.params import KEYS


def weekly_demand(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ordered quantity per key and ISO week."""
    return lines.groupBy(*keys, monday(F.col("order_date")).alias("week_start")).agg(F.sum("qty").alias("qty"))


def week_renderings(df: DataFrame, date: str, horizon: int = 12) -> DataFrame:
    """The labels of a date's week, the Monday parsed back from each, and the weeks that follow."""
    d = F.col(date)
    rendered = df.withColumns(
        {"history_label": history_label(d), "week_label": week_label(d), "week_number": week_number(d)}
    )
    return rendered.withColumns(
        {
            "from_history": parse_week(F.col("history_label")),
            "from_label": parse_week(F.col("week_label")),
            "from_number": parse_week(F.col("week_number")),
            "following": F.transform(next_weeks(d, horizon), week_number),
        }
    )


def fill_weeks(weekly: DataFrame, as_of: dt.date, keys: Sequence[str] = KEYS) -> DataFrame:
    """D3: every Monday from a key's first demand to ``as_of``, zero where nothing was ordered.

    Each row fills the gap up to the key's next row, so no calendar join is needed.
    """
    last = F.lit(monday_of(as_of)).cast("date")
    following = F.lead("week_start").over(Window.partitionBy(*keys).orderBy("week_start"))
    gap = F.floor(F.datediff(F.coalesce(F.date_sub(following, 7), last), F.col("week_start")) / 7).cast("int")
    return (
        weekly.where(F.col("week_start") <= last)
        .withColumn("_gap", gap)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_gap"))).alias("_k"))
        .select(
            *keys,
            F.date_add("week_start", F.col("_k") * 7).alias("week_start"),
            F.when(F.col("_k") == 0, F.coalesce(F.col("qty"), F.lit(0.0))).otherwise(0.0).alias("qty"),
        )
    )


def replacement_map(links: DataFrame, kind: str = "1") -> DataFrame:
    """Child, parent, and whether the parent's stock and demand are used up under the child."""
    return links.where(F.col("type") == kind).select(
        "child", "parent", (F.coalesce(F.col("using_existing"), F.lit("N")) == "Y").alias("using_existing")
    )


def merge_parent_demand(weekly: DataFrame, links: DataFrame, universe: DataFrame) -> DataFrame:
    """Demand of a replaced parent counted under its child; a shared parent goes to the smallest child."""
    usable = replacement_map(links).where("using_existing")
    redirect = (
        universe.join(usable, universe["item"] == usable["child"])
        .groupBy(F.col("parent").alias("item"), "warehouse")
        .agg(F.min("child").alias("_child"))
    )
    items = stacked(universe.select("item"), redirect.select("item")).distinct()
    places = universe.select("warehouse").distinct()
    return (
        weekly.join(items, "item", "left_semi")
        .join(places, "warehouse", "left_semi")
        .join(redirect, ["item", "warehouse"], "left")
        .groupBy(F.coalesce("_child", "item").alias("item"), "warehouse", "week_start")
        .agg(F.sum(F.coalesce(F.col("qty"), F.lit(0.0))).alias("qty"))
    )


def merge_parent_stock(stock: DataFrame, links: DataFrame, universe: DataFrame) -> DataFrame:
    """Available and incoming stock of each key, plus that of the parents it uses up."""
    held = stock.groupBy(F.col("item").alias("_source"), "warehouse").agg(
        F.sum(F.coalesce(F.col("available"), F.lit(0.0))).alias("available"),
        F.sum(F.coalesce(F.col("on_order"), F.lit(0.0))).alias("on_order"),
    )
    usable = replacement_map(links).where("using_existing")
    own = universe.select("item", "warehouse", F.col("item").alias("_source"))
    borrowed = universe.join(usable, universe["item"] == usable["child"]).select(
        "item", "warehouse", F.col("parent").alias("_source")
    )

    def total(name: str):
        return half_even(F.coalesce(F.sum(name), F.lit(0.0)), 2)

    return (
        stacked(own, borrowed)
        .join(held, ["_source", "warehouse"], "left")
        .groupBy("item", "warehouse")
        .agg(total("available").alias("available"), total("on_order").alias("in_transit"))
    )


def stock_by_location(locations: DataFrame) -> DataFrame:
    """Stock of an item at each of its locations."""
    return locations.groupBy("item", "warehouse", "location").agg(
        F.sum("on_hand").alias("on_hand"), F.sum("available").alias("available")
    )


def universe_from_demand(weekly: DataFrame) -> DataFrame:
    """Keys with demand history."""
    return weekly.select(*KEYS).distinct()


def universe_from_safety(item_warehouse: DataFrame) -> DataFrame:
    """Keys with a manual safety stock."""
    return item_warehouse.where(F.col("safety") > 0).select(*KEYS).distinct()


def item_universe(weekly: DataFrame, item_warehouse: DataFrame) -> DataFrame:
    """Keys with demand or with a manual safety stock."""
    demand = weekly.select(*KEYS)
    safety = item_warehouse.where(F.col("safety") > 0).select(*KEYS)
    return stacked(demand, safety).distinct()


def master_data(universe: DataFrame, items: DataFrame, item_warehouse: DataFrame) -> DataFrame:
    """Item and item-by-warehouse attributes of every key."""
    return universe.join(items, "item", "left").join(item_warehouse, list(KEYS), "left")


def best_lead_time(smart: DataFrame, items: DataFrame, preference: DataFrame) -> DataFrame:
    """Per key, the default vendor's lead time with the best preference rank."""
    defaults = items.select("item", "vendor").distinct()
    ranks = preference.select("item", "warehouse", "vendor", "mode", "rank")
    ranked = smart.join(defaults, ["item", "vendor"]).join(ranks, ["item", "warehouse", "vendor", "mode"], "left")
    best = first_rows(ranked, KEYS, [F.col("rank").asc_nulls_last(), F.col("mode")])
    return best.select(
        *KEYS, "vendor", "mode", "source", "p60_lead", "p60_prep", "p60_transport"
    )


def stock_snapshot(stock: DataFrame) -> DataFrame:
    """Stock with missing quantities as zero."""
    return stock.select(
        *KEYS,
        F.coalesce(F.col("available"), F.lit(0.0)).alias("available"),
        F.coalesce(F.col("on_order"), F.lit(0.0)).alias("in_transit"),
    )


def stored_demand_types(table: DataFrame, universe: DataFrame) -> DataFrame:
    """Stored classification of the given keys."""
    return table.join(universe.select(*KEYS).distinct(), list(KEYS), "left_semi").select(
        *KEYS, "demand_type", "activity_level", "weeks_with_demand", "zero_ratio", "cv", "trend_slope",
        "seasonal_strength",
    )


def stored_forecasts(table: DataFrame, universe: DataFrame) -> DataFrame:
    """Stored forecasts of the given keys, parsed; a missing monthly value is the first four weeks."""
    parsed = F.coalesce(F.from_json("forecast_json", "array<double>"), F.array().cast("array<double>"))
    month = F.aggregate(F.slice("forecast", 1, 4), F.lit(0.0), lambda a, x: a + x)
    return (
        table.join(universe.select(*KEYS).distinct(), list(KEYS), "left_semi")
        .withColumn("forecast", parsed)
        .select(
            *KEYS, "forecast", F.coalesce(F.col("forecast_monthly"), month).alias("forecast_monthly"), "model"
        )
    )


def stored_safety(table: DataFrame, universe: DataFrame) -> DataFrame:
    """Stored safety stock of the given keys."""
    return table.join(universe.select(*KEYS).distinct(), list(KEYS), "left_semi").select(
        *KEYS, "service_level", "dynamic_safety", "final_safety"
    )
