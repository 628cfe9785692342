"""The planning run (M7) and the backtest of it (F1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import whole
from stowage.operators.classify import classify_items, run_lengths, run_metrics
from stowage.operators.demand import fill_weeks, item_universe, master_data, merge_parent_demand, merge_parent_stock
from stowage.operators.evaluate import backtest_windows, score_forecast
from stowage.operators.forecast import forecast
from stowage.operators.mrp import all_orders, static_orders
from stowage.operators.safety import dynamic_safety_stock, safety_stock
from stowage.session import cut_lineage, materialised
from stowage.params import KEYS, ClassifierParams, ForecastParams, OrderParams, SafetyParams, SeriesParams


def planned_items(
    weekly: DataFrame,
    items: DataFrame,
    item_warehouse: DataFrame,
    links: DataFrame,
    as_of: dt.date,
    smart: DataFrame | None = None,
    series: SeriesParams = SeriesParams(),
    classes: ClassifierParams = ClassifierParams(),
    models: ForecastParams = ForecastParams(),
    safety: SafetyParams = SafetyParams(),
    universe: DataFrame | None = None,
) -> DataFrame:
    """Classification, forecast and safety stock of every key, in one row each.

    With ``smart`` (best learned lead times) the safety stock covers the learned lead time. ``universe`` is taken
    over from a caller that has it.
    """
    universe = item_universe(weekly, item_warehouse) if universe is None else universe
    runs = run_lengths(merge_parent_demand(weekly, links, universe), as_of, params=series)
    metrics = run_metrics(runs, series=series, params=classes, models=models)
    master = master_data(universe, items, item_warehouse)
    forecasts = forecast(classify_items(master, metrics, classes), models)
    if smart is None:
        return safety_stock(forecasts, safety)
    learned = smart.select(*KEYS, whole(F.col("p60_lead")).alias("smart_days"))
    return dynamic_safety_stock(forecasts.join(learned, list(KEYS), "left"), safety).drop("smart_days")


def plan_orders(
    weekly: DataFrame,
    items: DataFrame,
    item_warehouse: DataFrame,
    links: DataFrame,
    stock: DataFrame,
    as_of: dt.date,
    best_leads: DataFrame | None = None,
    dynamic_safety: bool = False,
    orders: OrderParams = OrderParams(),
    **params,
) -> DataFrame:
    """M7: static orders for every key, and dynamic orders for keys with a learned lead time.

    ``dynamic_safety`` sizes the safety stock by the learned lead time as well. The weekly demand and the keys it is
    planned for are materialised once.
    """
    smart = best_leads if dynamic_safety else None
    weekly = materialised(weekly)
    universe = cut_lineage(item_universe(weekly, item_warehouse))
    planned = planned_items(weekly, items, item_warehouse, links, as_of, smart, universe=universe, **params)
    stocked = planned.join(merge_parent_stock(stock, links, universe), list(KEYS), "left")
    if best_leads is None:
        return static_orders(stocked, orders, as_of)
    return all_orders(stocked, best_leads, orders, as_of)


def backtest(
    weekly: DataFrame,
    items: DataFrame,
    item_warehouse: DataFrame,
    links: DataFrame,
    cutoff: dt.date,
    as_of: dt.date,
    start: dt.date | None = None,
    weeks: int = 4,
    quarterly: bool = False,
    **params,
) -> DataFrame:
    """F1: the chain run as of the cut-off, scored against what followed.

    Demand of replaced items counts under the item that replaces them, as in the plan. The forecast sees the
    cut-off week itself, which is also the first week of the actual window.
    """
    weekly = materialised(weekly)
    universe = cut_lineage(item_universe(weekly, item_warehouse))
    merged = materialised(merge_parent_demand(weekly, links, universe))
    filled = fill_weeks(merged, as_of)
    series = params.get("series", SeriesParams())
    seen = run_lengths(merged, min(cutoff, as_of), params=series)
    metrics = run_metrics(seen, series=series, params=params.get("classes", ClassifierParams()), models=params.get("models", ForecastParams()))
    master = master_data(merged.select(*KEYS).distinct(), items, item_warehouse)
    classes = classify_items(master, metrics, params.get("classes", ClassifierParams()))
    forecasts = forecast(classes, params.get("models", ForecastParams()))
    planned = safety_stock(forecasts, params.get("safety", SafetyParams()))
    return score_forecast(planned, backtest_windows(filled, cutoff, weeks, start), quarterly)
