"""Trailing windows of exactly w rows.

Sums, means, spreads and correlations over long windows are put together from blocks of 1, 2, 4, ... rows: a
block of twice the size merges two neighbours (lag), so a window costs log2(w) lags a row and not w updates, and
merging means and second moments keeps full precision where differences of running sums would cancel.
Short windows use plain frames. Both need one exchange and one sort for all windows of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, c, sdiv

#: Up to here a plain frame is as cheap as blocks.
SHORT = 34


class Rolling:
    """Window columns over the rows of a series: keys part it, datetime orders it."""

    def __init__(self, keys=("symbol",), order: str = "datetime"):
        self.series = Window.partitionBy(*keys).orderBy(order)

    def frame(self, w: int):
        return self.series.rowsBetween(-(w - 1), 0)

    def full(self, agg: Column, x: Column | str, w: int) -> Column:
        """agg over the last w rows where all of them have x."""
        return F.when(F.count(c(x)).over(self.frame(w)) == w, agg.over(self.frame(w)))

    def mean(self, x, w: int) -> Column:
        return self.full(F.avg(c(x)), x, w)

    def sum(self, x, w: int) -> Column:
        return self.full(F.sum(c(x)), x, w)

    def std(self, x, w: int) -> Column:
        return self.full(F.stddev_samp(c(x)), x, w)

    def max(self, x, w: int) -> Column:
        return self.full(F.max(c(x)), x, w)

    def min(self, x, w: int) -> Column:
        return self.full(F.min(c(x)), x, w)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(c(x), k).over(self.series)

    def z(self, x, w: int) -> Column:
        return (c(x) - self.mean(x, w)) / (self.std(x, w) + EPS)

    def corr(self, a, b, w: int) -> Column:
        """Pearson's correlation of the last w rows; NULL where a side is constant (corr() itself would raise there)."""
        both = F.when(c(a).isNotNull() & c(b).isNotNull(), c(a))
        other = F.when(c(a).isNotNull(), c(b))
        f = self.frame(w)
        r = sdiv(F.covar_samp(both, other).over(f), F.stddev_samp(both).over(f) * F.stddev_samp(other).over(f))
        return F.when(F.count(both).over(f) == w, r)

    def _shape(self, agg, x, w: int, fix, constant: float) -> Column:
        f = self.frame(w)
        flat = F.max(c(x)).over(f) == F.min(c(x)).over(f)
        return F.when(F.count(c(x)).over(f) == w, F.when(flat, F.lit(constant)).otherwise(fix(agg(c(x)).over(f))))

    def skew(self, x, w: int) -> Column:
        """Bias-corrected skewness, 0 for a constant window."""
        return self._shape(F.skewness, x, w, lambda s: s * ((w * (w - 1)) ** 0.5 / (w - 2)), 0.0)

    def kurt(self, x, w: int) -> Column:
        """Bias-corrected excess kurtosis, -3 for a constant window."""
        return self._shape(F.kurtosis, x, w, lambda k: ((w + 1) * k + 6) * ((w - 1) / ((w - 2) * (w - 3))), -3.0)

    def smooth(self, x, w: int, least: int) -> Column:
        """Mean over the last w rows where at least so many of them have x."""
        return F.when(F.count(c(x)).over(self.frame(w)) >= least, F.avg(c(x)).over(self.frame(w)))


def _merge(a: dict[str, Column], na: int, b: dict[str, Column], nb: int) -> dict[str, Column]:
    """Moments of two neighbouring blocks of na and nb rows as one."""
    n, out = na + nb, {}
    for k in a:
        kind, _, names = k.partition(":")
        if kind == "mean":
            out[k] = a[k] + (b[k] - a[k]) * (nb / n)
        elif kind == "co":
            x, y = names.split(",")
            out[k] = a[k] + b[k] + (b[f"mean:{x}"] - a[f"mean:{x}"]) * (b[f"mean:{y}"] - a[f"mean:{y}"]) * (na * nb / n)
        else:
            out[k] = (F.greatest if kind == "max" else F.least)(a[k], b[k])
            out[k] = F.when(a[k].isNotNull() & b[k].isNotNull(), out[k])
    return out


def long_windows(df: DataFrame, widths: list[int], moments: list[str], keys=("symbol",)) -> DataFrame:
    """Adds `<moment>_<w>` for each width: moments are mean:x, co:x,y (centred products, needs both means), max:x, min:x.

    All rows of a window must have the value, else it is NULL. Blocks of 2**k rows live in columns _b<k>_<moment>; each
    level is one projection of lags over the same sorted partition, so all levels share one exchange.
    """
    roll = Rolling(keys)
    name = lambda k, m: f"_b{k}_{m.replace(':', '_').replace(',', '_')}"
    start = {}
    for m in moments:
        kind, _, names = m.partition(":")
        x = names.split(",")
        known = F.col(x[0]).isNotNull() & F.col(x[-1]).isNotNull()
        start[name(0, m)] = F.when(known, F.lit(0.0)) if kind == "co" else F.col(x[0]).cast("double")
    df = df.withColumns(start)
    top = max(widths).bit_length() - 1
    for k in range(top):
        half = 1 << k
        a = {m: roll.lag(name(k, m), half) for m in moments}
        b = {m: F.col(name(k, m)) for m in moments}
        df = df.withColumns({name(k + 1, m): v for m, v in _merge(a, half, b, half).items()})
    out = {}
    for w in widths:
        have, done = None, 0
        for k in range(top + 1):
            size = 1 << k
            if w & size:
                part = {m: roll.lag(name(k, m), done) if done else F.col(name(k, m)) for m in moments}
                have = part if have is None else _merge(part, size, have, done)
                done += size
        for m in moments:
            out[f"{m.replace(':', '_').replace(',', '_')}_{w}"] = have[m]
    return df.withColumns(out).drop(*(name(k, m) for k in range(top + 1) for m in moments))
