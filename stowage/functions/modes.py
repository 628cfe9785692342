"""Transport modes: the constant dimension and the rules that move between modes."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")


class Mode(NamedTuple):
    ord: int
    name: str
    low: float
    high: float
    group: str
    assignable: bool
    default_days: int


# Mode names, day ranges, groups and default days.
MODES = [
    Mode(0, "Vessel", 15.0, INF, "SLOW", True, 22),
    Mode(1, "Air", 0.0, 14.0, "INTERNATIONAL_FAST", True, 7),
    Mode(2, "Courier", 0.0, 7.0, "INTERNATIONAL_FAST", True, 3),
    Mode(3, "Truck", 0.0, 7.0, "DOMESTIC", True, 3),
    Mode(4, "Train", 5.0, 10.0, "DOMESTIC", True, 7),
    Mode(5, "Teleportation", 0.0, 0.1, "UNKNOWN", False, 0),
    Mode(6, "Internal Transfer", 0.0, 5.0, "UNKNOWN", False, 2),
    Mode(7, "Unknown", 0.0, INF, "UNKNOWN", False, 7),
    Mode(8, "International Truck", 5.0, 10.0, "INTERNATIONAL_FAST", False, 7),
    Mode(9, "International Train", 15.0, 40.0, "INTERNATIONAL_MIDDLE", False, 27),
    Mode(10, "Default", 0.0, INF, "UNKNOWN", False, 7),
]
ASSIGNABLE = [m for m in MODES if m.assignable]
FAST_GROUP = "INTERNATIONAL_FAST"

# Days charged for a change from the first group into the second; changes not listed are never made.
MOVE_DAYS = {
    "DOMESTIC": {"UNKNOWN": 100},
    "INTERNATIONAL_FAST": {"INTERNATIONAL_MIDDLE": 50, "SLOW": 50, "UNKNOWN": 50},
    "INTERNATIONAL_MIDDLE": {"DOMESTIC": 50, "INTERNATIONAL_FAST": 50, "SLOW": 50, "UNKNOWN": 50},
    "SLOW": {"INTERNATIONAL_FAST": 50, "INTERNATIONAL_MIDDLE": 50, "UNKNOWN": 100},
    "UNKNOWN": {"DOMESTIC": 100, "INTERNATIONAL_FAST": 50, "INTERNATIONAL_MIDDLE": 50, "SLOW": 100},
}

# Transport codes of the order system; every other code is a truck.
CODE_TO_MODE = {20: "Vessel", 40: "Truck", 50: "Air", 53: "Air", 55: "Courier", 60: "Air"}


def mode_table(spark: SparkSession) -> DataFrame:
    """The eleven-row dimension as a DataFrame (a constant, so safe to broadcast)."""
    rows = [tuple(m) for m in MODES]
    schema = (
        "mode_ord int, mode string, days_low double, days_high double, "
        "mode_group string, assignable boolean, default_days int"
    )
    return spark.createDataFrame(rows, schema)


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a constant text-keyed map; null for an unknown key. One small expression, whatever the map."""

    def literal(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"double('{'Infinity' if value == INF else value}')"
        return f"'{value}'" if isinstance(value, str) else str(value)

    entries = ", ".join(f"'{k}', {literal(v)}" for k, v in values.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def attribute(mode: Column, field: str) -> Column:
    """One attribute of a mode column; null for a name outside the dimension."""
    return lookup({m.name: getattr(m, field) for m in MODES}, mode)


def move_days(mode: Column, target: Mode) -> Column:
    """Days charged for changing a mode into another; null where the change is not made."""
    priced = {m.name: MOVE_DAYS[m.group][target.group] for m in MODES if target.group in MOVE_DAYS[m.group]}
    return lookup(priced, mode)


def mode_of_code(code: Column) -> Column:
    """Transport code to mode; blank, unreadable or unlisted codes are trucks."""
    number = F.trim(code.cast("string")).try_cast("double").cast("int")
    chosen = F
    for value, name in CODE_TO_MODE.items():
        chosen = chosen.when(number == value, F.lit(name))
    return chosen.otherwise(F.lit("Truck"))


def vendor_type(vtype: Column, vendor: Column) -> Column:
    """Vendor type; two vendor numbers are internal whatever their type says."""
    # Vendor numbers, type codes and labels.
    return (
        F.when(vendor.cast("int").isin(99908, 99909), "INTERNAL")
        .when(F.trim(vtype) == "EDIC", "OVERSEA_DC")
        .when(F.trim(vtype).isin("ACGC", "EXTC"), "OVERSEA_EXTERNAL")
        .otherwise("DOMESTIC_EXTERNAL")
    )


def static_days(mode: Column, days: Column) -> Column:
    """Trucks take three days, other modes the stated days."""
    return F.when(mode == "Truck", F.lit(3)).otherwise(days.cast("int"))
