"""Arithmetic that must not raise, produce NaN, or round the wrong way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even after scaling, the way array libraries do it."""
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, null where the divisor is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def is_true(predicate: Column) -> Column:
    """A predicate in which null counts as false."""
    return F.coalesce(predicate, F.lit(False))


def no_nan(value: Column) -> Column:
    """NaN becomes null, so that comparisons treat it as unknown."""
    return F.when(~F.isnan(value), value)


def whole(value: Column) -> Column:
    """Drop the fraction, as an integer; noise below 1e-9 does not turn 40 into 39."""
    return (F.rint(value * 1e9) / 1e9).cast("int")


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner evaluation; coefficients ascend by power."""
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


# Wichura's AS 241 coefficients for the inverse normal distribution.
CENTRE_TOP = [
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
]
CENTRE_BOTTOM = [
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
]
TAIL_TOP = [
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4,
]
TAIL_BOTTOM = [
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of ``p`` (accurate to about 1e-15 for 1e-10 < p < 1 - 1e-10)."""
    q = p - F.lit(0.5)
    near = F.lit(0.180625) - q * q
    centre = q * polynomial(near, CENTRE_TOP) / polynomial(near, CENTRE_BOTTOM)
    far = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p))) - F.lit(1.6)
    tail = F.signum(q) * polynomial(far, TAIL_TOP) / polynomial(far, TAIL_BOTTOM)
    return F.when(F.abs(q) <= F.lit(0.425), centre).otherwise(tail)
