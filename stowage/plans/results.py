"""Writing a planning run back: classes, forecasts, safety stocks and orders, each with what is compared and logged of it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.params import KEYS
from stowage.session import materialised
from stowage.sources.tables import StoredTable


class Result(NamedTuple):
    """``columns`` are stored under ``keys`` with the run's date as ``stamp``, which alone is no change; ``monitored`` fields are logged if there is a log."""

    columns: Sequence[str]
    monitored: Sequence[str]
    stamp: str
    keys: Sequence[str] = KEYS
    reason: str = "Table update"
    logged: bool = False


METRICS = ("demand_type", "activity_level", "weeks_with_demand", "zero_ratio", "cv", "trend_slope", "seasonal_strength")
LEVELS = ("service_level", "final_safety")
# What is stored and monitored of each result.
TYPES, FORECASTS, SAFETY, ORDERS = "demand_types", "forecasts", "safety_stocks", "orders"
RESULTS = {
    TYPES: Result(METRICS, METRICS, "classify_date", reason="Classify Update", logged=True),
    FORECASTS: Result(("model", "forecast_json", "forecast_monthly"), ("model", "forecast_json"), "forecast_date"),
    SAFETY: Result(("service_level", "dynamic_safety", "final_safety"), LEVELS, "safety_date"),
    ORDERS: Result(
        ("mode", "lead_days", "demand_type", "activity_level", "service_level", "forecast_in_lead", "final_safety", "available", "in_transit", "net_requirement", "recommended_qty", "order_reason"),
        LEVELS,
        "calc_date",
        (*KEYS, "algorithm"),
    ),
}


def write_plan(
    planned: DataFrame, orders: DataFrame, table_of: Callable[[str], StoredTable], as_of: dt.date, dry_run: bool = False
) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """Store the results of a run: rows that changed since the last one, and a log of changed classes.

    ``planned`` has class, forecast and safety stock in one row a key (``planning.planned_items``), ``orders`` the orders of the same run. ``table_of`` gives the table of a
    name; the log of the classes is asked for as ``demand_types_log``. A dry run writes nothing and returns the changes and log entries of every result.
    """
    planned = materialised(planned)
    out = {}
    for name, result in RESULTS.items():
        rows = (orders if name == ORDERS else planned).select(*result.keys, *result.columns).withColumn(result.stamp, F.lit(as_of))
        log = table_of(f"{name}_log") if result.logged else None
        out[name] = table_of(name).write_changes(rows, result.keys, as_of, log, result.monitored, (result.stamp,), dry_run, result.reason)
    return out
