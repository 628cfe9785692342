"""Import every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = (
    "sources", "extract", "orders", "leadtime", "demand", "classes", "forecasts", "replenish", "arrivals", "reports", "shapes",
)


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"checks.{module}")
