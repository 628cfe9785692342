"""Weekly demand forecasts (C9-C17), as array expressions over one row of metrics per key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import half_even, ratio
from stowage.operators import classify as kinds
from stowage.params import KEYS, ForecastParams

EMPTY = "empty"
COLD_START = "cold_start"


def flat(level: Column, horizon: int) -> Column:
    return F.array_repeat(F.coalesce(level.cast("double"), F.lit(0.0)), horizon)


def steady(p: ForecastParams) -> Column:
    """C11: flat at the weighted quantile that a large bootstrap sample converges to.

    Drawing samples would give this value plus noise; the limit is exact and repeatable.
    """
    return flat(F.col("steady_level"), p.horizon_weeks)


def seasonal(p: ForecastParams) -> Column:
    """The ISO-week profile scaled to the recent weighted mean. Week 53 takes the default factor."""
    means = F.map_values("week_means")
    centre = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means)
    scale = F.when(centre != 0, centre).otherwise(1.0)

    def weeks(s: Column) -> Column:
        def week(k: Column) -> Column:
            number = F.weekofyear(F.date_add("last_week", (k * 7).cast("int")))
            known = F.when(number <= 52, F.try_element_at("week_means", number) / s)
            return F.coalesce(known, F.lit(p.seasonal_default)) * F.col("seasonal_base")

        return F.transform(F.sequence(F.lit(1), F.lit(p.horizon_weeks)), week)

    # The scale is bound as a variable: inside the lambda over the weeks it would be summed for each.
    return F.transform(F.array(scale), weeks)[0]


def trended(p: ForecastParams) -> Column:
    """The fitted line carried on; it may fall below zero."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(p.horizon_weeks)),
        lambda k: F.col("line_start") + F.col("line_slope") * (F.col("weeks") - 1 + k),
    )


def intermittent(p: ForecastParams) -> Column:
    """C14: smoothed size over smoothed interval with the bias correction; zero without demand."""
    level = ratio(F.col("croston_size"), F.col("croston_interval")) * (1 - p.croston_alpha / 2)
    return flat(level, p.horizon_weeks)


def burst(p: ForecastParams) -> Column:
    """Flat at a high quantile."""
    return flat(F.col("burst_level"), p.horizon_weeks)


def default(p: ForecastParams) -> Column:
    """Flat at the weighted mean."""
    return flat(F.col("weighted_mean"), p.horizon_weeks)


MODELS = {
    kinds.STEADY: steady,
    kinds.SEASONAL: seasonal,
    kinds.TRENDED: trended,
    kinds.INTERMITTENT: intermittent,
    kinds.BURST: burst,
}


@dataclass(frozen=True)
class GroupedModel:
    """A model of the user that needs a key's series: ``function(rows, params)`` gives the horizon's values.

    ``rows`` are the weeks of one key as an Arrow table with ``columns``, in order of the first of them. A key's weeks are bounded by the
    calendar, so a key is safely one group. Only keys of the model's type go through Python.
    """

    function: Callable[[pa.Table, ForecastParams], Sequence[float]]
    columns: Sequence[str] = ("week_start", "demand")


Model = Callable[[ForecastParams], Column] | GroupedModel


def _of_groups(kind: Column, chosen: DataFrame, series: DataFrame, models: Mapping[str, GroupedModel], p: ForecastParams) -> DataFrame:
    """(keys, _grouped): what grouped models give for the keys of their type."""
    keys = list(KEYS)
    wanted = chosen.where(kind.isin(*models)).select(*keys, kind.alias("_kind"))
    columns = list(dict.fromkeys(c for m in models.values() for c in m.columns))
    rows = series.select(*keys, *columns).join(wanted, keys)
    types = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        item, warehouse, label = (k.as_py() for k in key)
        model = models[label]
        values = [float(v) for v in model.function(table.select(list(model.columns)).sort_by(model.columns[0]), p)]
        if len(values) != p.horizon_weeks:
            raise ValueError(f"the model of {label} gives {len(values)} values for {p.horizon_weeks} weeks")
        return pa.table({keys[0]: pa.array([item]), keys[1]: pa.array([warehouse]), "_grouped": pa.array([values], pa.list_(pa.float64()))})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _grouped array<double>"
    return rows.groupBy(*keys, "_kind").applyInArrow(run, schema)


def _packed(df: DataFrame, series: Column, model: Column) -> DataFrame:
    """C17: the series, its stored form (two decimals, as an array and as text) and its first month."""
    packed = df.withColumn("forecast", series)
    month = F.aggregate(F.slice("forecast", 1, 4), F.lit(0.0), lambda a, x: a + x)
    return packed.withColumns(
        {
            "forecast_rounded": F.transform("forecast", lambda v: half_even(v, 2)),
            "forecast_monthly": half_even(month, 2),
            "model": model,
        }
    ).withColumn("forecast_json", F.to_json("forecast_rounded"))


def _series_of(df: DataFrame, kind: Column, cold: Column, models: Mapping[str, Model], series: DataFrame | None, p: ForecastParams) -> tuple[DataFrame, Column]:
    """The keys, with what grouped models give them, and their forecast as a column."""
    empty = F.col("weeks").isNull()
    grouped = {label: m for label, m in models.items() if isinstance(m, GroupedModel)}
    if grouped:
        if series is None:
            raise ValueError("grouped models need the series of the keys")
        made = _of_groups(kind, df.where(~empty & ~F.coalesce(cold, F.lit(False))), series, grouped, p)
        df = df.join(made, list(KEYS), "left")
    chosen = F.when(empty | cold, flat(F.lit(0.0), p.horizon_weeks))
    for label, model in models.items():
        chosen = chosen.when(kind == label, F.col("_grouped") if label in grouped else model(p))
    return df, chosen.otherwise(default(p))


def forecast(
    classified: DataFrame,
    params: ForecastParams = ForecastParams(),
    models: Mapping[str, Model] | None = None,
    series: DataFrame | None = None,
) -> DataFrame:
    """Dispatch on the demand type; no history or a cold start forecasts zero.

    ``models`` adds to or replaces the models by type: functions of the parameters that give a column, and ``GroupedModel``s over ``series``
    (weeks of the keys, such as ``prepare_series`` gives).
    """
    cold = F.col("demand_type").isin(kinds.SINGLE, kinds.NEW) | F.col("activity_level").isin(
        kinds.DORMANT, kinds.INACTIVE
    )
    known, values = _series_of(classified, F.col("demand_type"), cold, MODELS | dict(models or {}), series, params)
    name = F.when(F.col("weeks").isNull(), EMPTY).when(cold, COLD_START).otherwise(F.col("demand_type"))
    return _packed(known, values, name).drop("_grouped")


def forecast_with(
    metrics: DataFrame,
    method: str,
    params: ForecastParams = ForecastParams(),
    models: Mapping[str, Model] | None = None,
    series: DataFrame | None = None,
) -> DataFrame:
    """One model for every key. Takes the label or its first word in any case; other names mean the default."""
    known = MODELS | dict(models or {})
    names = {label.split()[0].upper(): label for label in known}
    label = names.get(method.upper(), method)
    chosen = {label: known[label]} if label in known else {}
    rows, values = _series_of(metrics, F.lit(label), F.lit(False), chosen, series, params)
    name = F.when(F.col("weeks").isNull(), EMPTY).otherwise(F.lit(label))
    return _packed(rows, values, name).drop("_grouped")
