"""Freight charges: currency, plausibility and a cost line per supply path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.numeric import half_even, is_true, ratio

PATH = ("global_code", "warehouse", "mode")
AMOUNTS = ("invoice_total", "item_total", "freight")
# Highest plausible freight share of the goods value, by mode.
MAX_SHARE = {"Vessel": 0.2}


def convert_amount(amount: Column, currency: Column, rate: Column, method: Column, base: str) -> Column:
    """An amount in the base currency: by multiplying ('M') or dividing ('D'); null without a rate."""
    return (
        F.when(currency == base, amount)
        .when(method == "M", amount * rate)
        .when(method == "D", ratio(amount, rate))
    )


def in_base_currency(charges: DataFrame, rates: DataFrame, base: str = "JPY") -> DataFrame:
    """Amounts converted at the latest rate of the invoice month."""
    monthly = (
        rates.where((F.col("to_currency") == base) & (F.col("usage_type") == "SPOT"))
        .groupBy(
            F.date_trunc("month", "valid_date").cast("date").alias("_month"),
            F.col("from_currency").alias("currency"),
        )
        .agg(F.max_by(F.struct("rate", "method"), F.struct("valid_date", "rate")).alias("_fx"))
    )
    month = F.date_trunc("month", "invoice_date").cast("date")
    joined = charges.withColumn("_month", month).join(monthly, ["_month", "currency"], "left")
    converted = {
        f"{name}_base": convert_amount(
            F.col(name), F.col("currency"), F.col("_fx.rate"), F.col("_fx.method"), base
        )
        for name in AMOUNTS
    }
    return joined.withColumns(converted).select(*charges.columns, *converted)


def plausible_charges(converted: DataFrame) -> DataFrame:
    """Without charges whose freight share is too high, or unknown, for a mode that has a limit."""
    share = ratio(F.col("freight_base"), F.col("item_total_base"))
    limit = F
    for mode, value in MAX_SHARE.items():
        limit = limit.when(F.col("mode") == mode, F.lit(value))
    return (
        converted.withColumns({"freight_share": share, "_limit": limit})
        .where(F.col("_limit").isNull() | is_true(F.col("freight_share") <= F.col("_limit")))
        .drop("_limit")
    )


def freight_model(charges: DataFrame) -> DataFrame:
    """freight = base_charge + cost_per_kg * weight per path, neither below zero.

    Least squares when it satisfies both bounds, otherwise the better of the two one-parameter fits.
    Paths need three charges and more than one weight.
    """
    x, y = "gross_kg", "freight_base"
    sums = (
        charges.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*PATH)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.avg(x).alias("_x"),
            F.avg(y).alias("_y"),
            F.regr_sxx(y, x).alias("_sxx"),
            F.regr_syy(y, x).alias("_syy"),
            F.regr_sxy(y, x).alias("_sxy"),
        )
        .where((F.col("samples") >= 3) & (F.col("_sxx") > 0))
    )
    n, mx, my = F.col("samples"), F.col("_x"), F.col("_y")
    sxx, syy, sxy = F.col("_sxx"), F.col("_syy"), F.col("_sxy")

    def residual(base: Column, rate: Column) -> Column:
        return syy - 2 * rate * sxy + rate * rate * sxx + n * F.pow(my - base - rate * mx, 2)

    free_rate = sxy / sxx
    free_base = my - free_rate * mx
    flat_base = F.greatest(my, F.lit(0.0))
    origin_rate = F.greatest(ratio(sxy + n * mx * my, sxx + n * mx * mx), F.lit(0.0))
    inside = (free_rate >= 0) & (free_base >= 0)
    flat_wins = residual(flat_base, F.lit(0.0)) <= residual(F.lit(0.0), origin_rate)
    fitted = sums.withColumns(
        {
            "base_charge": F.when(inside, free_base).when(flat_wins, flat_base).otherwise(0.0),
            "cost_per_kg": F.when(inside, free_rate).when(flat_wins, 0.0).otherwise(origin_rate),
        }
    )
    r_square = F.when(syy > 0, 1 - residual(F.col("base_charge"), F.col("cost_per_kg")) / syy)
    return fitted.select(*PATH, "base_charge", "cost_per_kg", "samples", r_square.alias("r_square"))


def freight_by_vendor(model: DataFrame, vendors: DataFrame) -> DataFrame:
    """The model under vendor codes, rounded."""
    codes = vendors.select("global_code", "vendor").distinct()
    return model.join(codes, "global_code", "left").select(
        "vendor", *PATH,
        half_even(F.col("base_charge"), 2).alias("base_charge"),
        half_even(F.col("cost_per_kg"), 2).alias("cost_per_kg"),
        "samples",
        half_even(F.col("r_square"), 4).alias("r_square"),
    )


def analyse_freight(charges: DataFrame, rates: DataFrame, vendors: DataFrame, base: str = "JPY") -> DataFrame:
    """A11-A14 in order."""
    return freight_by_vendor(freight_model(plausible_charges(in_base_currency(charges, rates, base))), vendors)


def with_freight_cost(stats: DataFrame, costs: DataFrame) -> DataFrame:
    """Transport statistics with the cost columns of the freight model."""
    priced = costs.select(
        "vendor", "warehouse", "mode",
        F.col("cost_per_kg").alias("_rate"), F.col("base_charge").alias("_base"),
    )
    return (
        stats.join(priced, ["vendor", "warehouse", "mode"], "left")
        .withColumns({"cost_per_kg": F.col("_rate"), "base_charge": F.col("_base")})
        .select(*stats.columns)
    )
