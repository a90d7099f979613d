"""Normalised views: along a symbol (tsz) and across the symbols of one time (csz, csr and kin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import at_least, c, clip, finite, sdiv, zero

#: Each view has its own guard against a spread of zero.
EPS_VIEW, EPS_PRED = 1e-8, 1e-9


def xzscore(x: Column | str, eps: float = EPS_VIEW, by=("datetime",)) -> Column:
    """(x - mean) / (std + eps) across; NULL for a single value, 0 where all are equal."""
    over = Window.partitionBy(*by)
    return (c(x) - F.avg(c(x)).over(over)) / (F.stddev_samp(c(x)).over(over) + eps)


def xrank(x: Column | str, by=("datetime",)) -> Column:
    """Average percentile rank across, less one half: ties share the mean of their places, missing values have none."""
    ordered = Window.partitionBy(*by).orderBy(c(x).asc_nulls_last())
    ties = Window.partitionBy(*by, c(x))
    mean = F.rank().over(ordered) + (F.count(c(x)).over(ties) - 1) / 2
    return F.when(c(x).isNotNull(), mean / F.count(c(x)).over(Window.partitionBy(*by)) - 0.5)


def tsz(x: Column | str, window: int = 120, least: int = 30, keys=("symbol",), eps: float = EPS_VIEW) -> Column:
    """z over the trailing rows, sessions included, where at least so many have a value."""
    f = Window.partitionBy(*keys).orderBy("datetime").rowsBetween(-(window - 1), 0)
    return F.when(F.count(c(x)).over(f) >= least, (c(x) - F.avg(c(x)).over(f)) / (F.stddev_samp(c(x)).over(f) + eps))


def add_views(df: DataFrame, tsz_of=(), csz_of=(), csr_of=()) -> DataFrame:
    """Adds tsz_*, then csz_* and csr_*: one exchange by symbol, one by time."""
    df = df.withColumns({f"tsz_{x}": tsz(x) for x in tsz_of}) if tsz_of else df
    return df.withColumns({**{f"csz_{x}": xzscore(x) for x in csz_of}, **{f"csr_{x}": xrank(x) for x in csr_of}})


def prediction_views(df: DataFrame, pred: str = "pred") -> DataFrame:
    return df.withColumns({f"{pred}_xsz": xzscore(pred, EPS_PRED), f"{pred}_xrank": xrank(pred)})


def label_views(df: DataFrame) -> DataFrame:
    return df.withColumns({"label_xsz": clip(xzscore("label", EPS_PRED), -8, 8), "label_xrank": xrank("label")})


def event_scores(df: DataFrame) -> DataFrame:
    """label_views() with event_score, the sum of clipped |z| across of the bar's move, range and half its log amount, and
    bars_to_month_end (needs month)."""
    size = lambda x: at_least(F.abs(c(x)), 1e-12)
    df = label_views(df).withColumns({"_move": zero(F.ln(size("close") / size("open"))), "_range": zero(sdiv(F.col("high") - F.col("low"), size("close"))), "_amount": F.log1p(at_least("amount", 0))})
    far = lambda x: clip(F.abs(xzscore(x, EPS_PRED)), 0, 8)
    rows = Window.partitionBy("symbol", "month")
    left = F.count("*").over(rows) - F.row_number().over(rows.orderBy("datetime"))
    return df.withColumns({"event_score": far("_move") + far("_range") + 0.5 * far("_amount"), "bars_to_month_end": left.cast("int")}).drop("_move", "_range", "_amount")


def product_code(symbol: Column | str = "symbol") -> Column:
    """The letters a symbol starts with, in capitals; the whole symbol where it starts with none."""
    found = F.upper(F.regexp_extract(c(symbol), "^([A-Za-z]+)", 1))
    return F.when(found != "", found).otherwise(F.upper(c(symbol)))


def terciles(df: DataFrame, x: Column, name: str, words: tuple[str, str, str], ties: list[str], chunks: int = 64) -> DataFrame:
    """Adds name: the pooled tercile of x, ties in order of the tie columns, missing values as 'nan'.

    Values are ranked in ranges between pooled quantiles and shifted by the counts below, so no task ranks all rows.
    """
    df = df.withColumn("_x", finite(x))
    cuts = sorted(set(df.approxQuantile("_x", [i / chunks for i in range(1, chunks)], 0.005)))
    part = F.size(F.filter(F.lit([float(v) for v in cuts]), lambda q: q <= F.col("_x"))) if cuts else F.lit(0)
    df = df.withColumn("_part", F.when(F.col("_x").isNotNull(), part).otherwise(F.lit(-1)).cast("int"))
    counts = {r["_part"]: r["n"] for r in df.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # chunks + 1 rows
    m, below, shift = sum(n for p, n in counts.items() if p >= 0), 0, {}
    for p in sorted(k for k in counts if k >= 0):
        shift[p], below = below, below + counts[p]
    before = F.lit(0)
    for p, n in shift.items():
        before = F.when(F.col("_part") == p, n).otherwise(before)
    r = before + F.row_number().over(Window.partitionBy("_part").orderBy("_x", *ties)) - 1
    label = F.when(F.col("_x").isNull(), "nan").when(3 * r < m - 1, words[0]).when(3 * r < 2 * (m - 1), words[1]).otherwise(words[2])
    return df.withColumn(name, label).drop("_x", "_part")


def regimes(df: DataFrame) -> DataFrame:
    """Adds liquidity and volatility: pooled terciles of volume and of range over price."""
    ties = ["datetime", "symbol"]
    df = terciles(df, F.col("volume"), "liquidity", ("low_liq", "mid_liq", "high_liq"), ties)
    spread = sdiv(F.abs(F.col("high") - F.col("low")), F.abs(F.col("close")))
    return terciles(df, spread, "volatility", ("low_vol", "mid_vol", "high_vol"), ties)


def turnover(df: DataFrame, x: str, quantile: float = 0.2, least: int = 100) -> DataFrame:
    """turnover_proxy: the mean change of a -1/0/1 signal, taken from percentile ranks across, from one row of a symbol to its next."""
    rows = df.where(finite(x).isNotNull()).select("symbol", "datetime", x)
    pct = xrank(x) + 0.5
    rows = rows.withColumn("_s", F.when(pct >= 1 - quantile, 1.0).when(pct <= quantile, -1.0).otherwise(0.0))
    step = F.abs(F.col("_s") - F.lag("_s").over(Window.partitionBy("symbol").orderBy("datetime")))
    return rows.withColumn("_d", step).agg(F.when(F.count("*") >= least, F.avg("_d")).alias("turnover_proxy"))
