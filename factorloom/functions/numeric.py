"""Column arithmetic with the engine's one rule for missing values: NaN and infinities are NULL, and nothing raises.

Spark compares NaN as the largest value, so a NaN that slips in passes every gate; these helpers keep it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """x, or NULL where it is NaN or infinite."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def is_finite(x: Column | str) -> Column:
    return F.coalesce(~F.isnan(c(x)) & (F.abs(c(x)) < float("inf")), F.lit(False))


def number(x: Column | str) -> Column:
    """A double from anything; NULL where it is none."""
    return finite(F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.try_cast("double"))


def sdiv(a: Column, b: Column) -> Column:
    """a / b, NULL for b = 0."""
    return F.try_divide(a, b)


def zero(x: Column | str) -> Column:
    """x with 0 for missing values."""
    return F.coalesce(finite(x), F.lit(0.0))


def at_least(x: Column | str, least: float) -> Column:
    """The larger of x and least; NULL stays NULL, which greatest() alone would drop."""
    return F.when(c(x).isNotNull(), F.greatest(c(x), F.lit(float(least))))


def at_most(x: Column | str, most: float) -> Column:
    return F.when(c(x).isNotNull(), F.least(c(x), F.lit(float(most))))


def clip(x: Column | str, least: float, most: float) -> Column:
    return at_most(at_least(x, least), most)


def clamp01(x: Column | str) -> Column:
    """x within 0 and 1, 0 where it is missing."""
    return F.coalesce(clip(finite(x), 0, 1), F.lit(0.0))


def corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's correlation from centred second moments; NULL for a constant side."""
    return sdiv(sxy - sdiv(sx * sy, n), F.sqrt((sxx - sdiv(sx * sx, n)) * (syy - sdiv(sy * sy, n))))
