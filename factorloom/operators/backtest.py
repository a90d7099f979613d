"""Long-short returns per time, their summary, and prediction ICs across one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EPS, finite, sdiv

LEAST_RAW = 10


def long_short(df: DataFrame, pred: str = "pred_xrank", label: str = "label", quantile: float = 0.2) -> DataFrame:
    """datetime, ls_return, n: mean label of the top quantile less that of the bottom.

    A *_xrank column is cut at fixed ranks; times without both sides drop out. Any other column is cut at its exact
    quantiles within each time of at least LEAST_RAW rows.
    """
    rows = df.where(finite(pred).isNotNull() & finite(label).isNotNull()).select("datetime", F.col(pred).alias("p"), F.col(label).alias("y"))
    if pred.endswith("_xrank"):
        top, low = F.avg(F.when(F.col("p") >= 0.5 - quantile, F.col("y"))), F.avg(F.when(F.col("p") <= quantile - 0.5, F.col("y")))
        return rows.groupBy("datetime").agg((top - low).alias("ls_return"), F.count("*").alias("n")).where("ls_return is not null")
    cuts = rows.groupBy("datetime").agg(F.percentile("p", F.lit(quantile)).alias("lo"), F.percentile("p", F.lit(1 - quantile)).alias("hi"), F.count("*").alias("n")).where(F.col("n") >= LEAST_RAW)
    sides = rows.join(cuts, "datetime").groupBy("datetime", "n").agg((F.avg(F.when(F.col("p") >= F.col("hi"), F.col("y"))) - F.avg(F.when(F.col("p") <= F.col("lo"), F.col("y")))).alias("ls_return"))
    return sides.select("datetime", "ls_return", "n")


def summarize(bt: DataFrame) -> DataFrame:
    """rows, mean, std, tstat, hit_rate, cum_return (an additive sum). The t-value takes bars as independent, which labels that overlap are not."""
    r = F.col("ls_return")
    s = bt.agg(F.count("*").alias("rows"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.sum(r).alias("cum_return"))
    t = F.when(F.col("std") > 0, F.col("mean") / (F.col("std") / F.sqrt("rows")))
    return s.select("rows", "mean", "std", t.alias("tstat"), "hit_rate", "cum_return")


def pred_xsz_sums(df: DataFrame, preds: list[str], label: str = "label", least_std: float = 1e-12) -> DataFrame:
    """pred_col, xy, xx, yy, n over times: each prediction is standardised across its time; times of fewer than 2 rows or
    without spread are left out for that column alone."""
    parts = []
    for p in preds:
        x = F.when(finite(p).isNotNull() & finite(label).isNotNull(), finite(p))
        y = F.when(x.isNotNull(), finite(label))
        parts.append(F.struct(F.lit(p).alias("pred_col"), F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.sum(x * y).alias("sxy"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy")))
    per = df.groupBy("datetime").agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*").where((F.col("n") >= 2) & (F.col("sd") > least_std))
    scale = F.col("sd") + EPS
    xx = (F.col("n") - 1) * F.col("sd") * F.col("sd") / (scale * scale)  # of standardised values
    return per.groupBy("pred_col").agg(F.sum((F.col("sxy") - F.col("m") * F.col("sy")) / scale).alias("xy"), F.sum(xx).alias("xx"), F.sum("yy").alias("yy"), F.sum("n").alias("n"))


def pred_xsz_ic(df: DataFrame, preds: list[str], label: str = "label") -> DataFrame:
    ic: Column = sdiv(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return pred_xsz_sums(df, preds, label).select("pred_col", ic.alias("ic"), "n")
