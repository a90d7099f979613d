"""Information coefficients and their mergeable statistics. The main IC is an uncentred cosine; the scorecard's is Pearson's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.numeric import c, finite, sdiv

TINY, FLOOR = 1e-18, 1e-30
#: More factors than this are summed by the tasks in Arrow batches.
WIDE = 64


def cosine_ic(pred: Column | str, label: Column | str) -> Column:
    """An aggregate: sum(py) / sqrt(sum(pp) sum(yy)) over finite pairs; NULL for fewer than 2 or without spread."""
    p, y = finite(pred), finite(label)
    both = p.isNotNull() & y.isNotNull()
    p, y = F.when(both, p), F.when(both, y)
    n, pp, yy = F.count(p), F.sum(p * p), F.sum(y * y)
    return F.when((n >= 2) & (F.sqrt((pp / n) * (yy / n)) > TINY), sdiv(F.sum(p * y), F.sqrt(pp * yy)))


def pearson(x: Column | str, y: Column | str) -> Column:
    """An aggregate: Pearson's correlation over finite pairs; NULL for fewer than 3 or a constant side."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((n >= 3) & (spread * n > TINY), sdiv(F.covar_pop(x, y), spread))


def month(x: Column | str = "datetime") -> Column:
    return F.date_format(x, "yyyy-MM")


def long_form(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """One row per row and factor: factor, value and the kept columns."""
    return df.unpivot(keep, factors, "factor", "value")


def sufficient_stats(df: DataFrame, factors: list[str], by: list[str] = ["month"], label: str = "label") -> DataFrame:  # noqa: B006
    """xy, xx, yy, count per group and factor: sums that add up over any split of the rows.

    All factors are summed in one aggregate over the wide rows, partial in each task, and only the sums are unpivoted. For
    more than WIDE factors, four buffers each would be too many: tasks then sum Arrow batches themselves.
    """
    if len(factors) > WIDE:
        return _wide_stats(df, factors, by, label)
    y = finite(label)
    aggs = []
    for f in factors:
        x = finite(f)
        ok = x.isNotNull() & y.isNotNull()
        aggs.append(F.struct(F.lit(f).alias("factor"), F.sum(F.when(ok, x * y)).alias("xy"), F.sum(F.when(ok, x * x)).alias("xx"), F.sum(F.when(ok, y * y)).alias("yy"), F.count(F.when(ok, 1)).alias("count")))
    return df.groupBy(*by).agg(F.array(*aggs).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def _wide_stats(df: DataFrame, factors: list[str], by: list[str], label: str) -> DataFrame:
    rows = df.select(*(F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)), finite(label).cast("double").alias("_y"), *(finite(f).cast("double").alias(f"_x_{i}") for i, f in enumerate(factors)))
    groups = [x for x in rows.schema.fields if x.name.startswith("_by_")]
    schema = StructType([*groups, *(StructField(k, ArrayType(DoubleType())) for k in ("xy", "xx", "yy")), StructField("n", ArrayType(LongType()))])

    def run(batches):
        sums: dict = {}
        for b in batches:
            keys = list(zip(*(c.to_pylist() for c in b.columns[: len(groups)])))
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            place = np.fromiter((names[k] for k in keys), np.int64, len(keys))
            y = b.column(len(groups)).to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[len(groups) + 1 :]])
            ok = ~np.isnan(x) & ~np.isnan(y)[:, None]
            x, y = np.where(ok, x, 0.0), np.where(np.isnan(y), 0.0, y)[:, None]
            for k, i in names.items():
                m = place == i
                got = np.stack([(x[m] * y[m]).sum(0), (x[m] ** 2).sum(0), (ok[m] * y[m] ** 2).sum(0), ok[m].sum(0)])
                sums[k] = sums[k] + got if k in sums else got
        if sums:
            cols = [pa.array(c, t) for c, t in zip(zip(*sums), kinds)]
            values = [pa.array([list(v[i]) for v in sums.values()], pa.list_(pa.float64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, *values, pa.array([v[3].astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=schema.names)

    kinds = [to_arrow_type(x.dataType) for x in groups]
    parts = rows.mapInArrow(run, schema).select(*(x.name for x in groups), F.posexplode(F.arrays_zip("xy", "xx", "yy", "n")).alias("j", "s"))
    total = parts.groupBy(*(x.name for x in groups), "j").agg(*(F.sum(f"s.{k}").alias(k) for k in ("xy", "xx", "yy", "n")))
    kept = (F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("xy", "xx", "yy"))
    return total.select(*(F.col(x.name).alias(b) for x, b in zip(groups, by)), F.get(F.array(*map(F.lit, factors)), F.col("j")).alias("factor"), *kept, F.col("n").alias("count"))


def merge_stats(stats: DataFrame, prefix: str = "", by: list[str] = ["factor"]) -> DataFrame:  # noqa: B006
    """IC, rows and the share of the best covered factor, from sums of any grain. A factor without spread has IC 0."""
    s = stats.groupBy(*by).agg(*(F.sum(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in ("xy", "xx", "yy", "count")))
    most = F.max("count").over(Window.partitionBy(F.lit(1)))  # over one row a factor
    return s.select(*by, ic_from_totals("xy", "xx", "yy").alias(f"{prefix}ic"), F.col("count").alias(f"{prefix}n"), sdiv(F.col("count").cast("double"), most.cast("double")).alias(f"{prefix}coverage_proxy"))


def ic_from_totals(xy: str, xx: str, yy: str) -> Column:
    return c(xy) / F.sqrt(F.greatest(c(xx) * c(yy), F.lit(FLOOR)))


def factor_ic(df: DataFrame, factors: list[str], start: str, end: str, prefix: str = "") -> DataFrame:
    """merge_stats() of the months from start to end, both whole; df has month, its partition column."""
    return merge_stats(sufficient_stats(df.where(F.col("month").between(start, end)), factors), prefix)


def effective_factors(is_ic: DataFrame, oos_ic: DataFrame, min_is: float = 0.002, min_oos: float = 0.001, min_coverage: float = 0.7, ordered: bool = True) -> DataFrame:
    """Joins the two ranges on factor; effective are those of enough IC in both, one sign and enough coverage."""
    s = is_ic.join(oos_ic, "factor")
    s = s.withColumns({"same_sign": F.coalesce(F.signum("is_ic") == F.signum("oos_ic"), F.lit(False)), "abs_is_ic": F.abs("is_ic"), "abs_oos_ic": F.abs("oos_ic")})
    ok = F.col("same_sign") & (F.col("abs_is_ic") >= min_is) & (F.col("abs_oos_ic") >= min_oos) & (F.least("is_coverage_proxy", "oos_coverage_proxy") >= min_coverage)
    s = s.withColumn("effective", F.coalesce(ok, F.lit(False)))
    return s.orderBy(F.desc("effective"), F.desc_nulls_last("abs_oos_ic"), F.desc_nulls_last("abs_is_ic"), "factor") if ordered else s


def attach_catalog(scores: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Family and view of each factor: from a catalogue where there is one, else from the name."""
    if catalog is not None:
        return scores.join(catalog.select("factor", "family", "view"), "factor", "left")
    view = F.regexp_extract("factor", "^(tsz|csz|csr)_", 1)
    base = F.regexp_replace("factor", "^(tsz|csz|csr)_", "")
    return scores.withColumns({"family": F.regexp_replace(base, r"(_\d+)+(_lag\d+)?$", ""), "view": F.when(view == "", "raw").otherwise(view)})


def ic_by_period(df: DataFrame, pred: str = "pred", label: str = "label", period: str = "M") -> DataFrame:
    key = F.date_format("datetime", "yyyy-MM" if period == "M" else "yyyy")
    rows = df.where(finite(pred).isNotNull() & finite(label).isNotNull())
    return rows.groupBy(key.alias("period")).agg(cosine_ic(pred, label).alias("ic"))


def prediction_stats(df: DataFrame, preds: list[str], by: list[str] = ["month"], label: str = "label") -> DataFrame:  # noqa: B006
    """sufficient_stats() of predictions with the rows seen, for roll-ups over months and models."""
    seen = df.groupBy(*by).agg(F.count("*").alias("rows"))
    return sufficient_stats(df, preds, by, label).withColumnRenamed("factor", "pred_col").join(seen, by)


def roll_up(stats: DataFrame, by: list[str] = ["pred_col"]) -> DataFrame:  # noqa: B006
    """Totals and monthly moments per model column: ic_total_range, n, coverage, monthly mean, std and IR."""
    monthly = stats.withColumn("ic", F.when(F.col("count") >= 2, ic_from_totals("xy", "xx", "yy")))
    s = monthly.groupBy(*by).agg(*(F.sum(k).alias(k) for k in ("xy", "xx", "yy", "count", "rows")), F.avg("ic").alias("monthly_mean"), F.stddev_samp("ic").alias("monthly_std"), F.count("ic").alias("months"))
    ir = F.when(F.col("monthly_std") > 0, F.col("monthly_mean") / F.col("monthly_std"))
    return s.select(*by, ic_from_totals("xy", "xx", "yy").alias("ic_total_range"), F.col("count").alias("n"), sdiv(F.col("count").cast("double"), F.col("rows").cast("double")).alias("coverage"), "monthly_mean", "monthly_std", ir.alias("monthly_ir"), "months")


def summarize_predictions(df: DataFrame, preds: list[str], label: str = "label") -> DataFrame:
    """Per prediction column: roll_up() over months, and the IC of each year as ic_<year>."""
    months = prediction_stats(df.withColumn("month", month()), preds, ["month"], label)
    years = sufficient_stats(df.withColumn("year", F.date_format("datetime", "yyyy")), preds, ["year"], label)
    wide = years.groupBy(F.col("factor").alias("pred_col")).pivot("year").agg(F.first(ic_from_totals("xy", "xx", "yy")))
    return roll_up(months).join(wide.withColumnsRenamed({y: f"ic_{y}" for y in wide.columns[1:]}), "pred_col")


def block_stats(df: DataFrame, factors: list[str], label: str = "label") -> DataFrame:
    """Per factor on a sample: Pearson's IC with the label, rows, coverage and population spread; NULL where nothing is known."""
    n = F.count("*")
    aggs = [F.struct(F.lit(f).alias("factor"), pearson(f, label).alias("ic"), F.count(finite(f)).alias("n"), sdiv(F.count(finite(f)).cast("double"), n.cast("double")).alias("coverage"), F.stddev_pop(finite(f)).alias("std")) for f in factors]
    return df.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def prefilter(stats: DataFrame, candidates: DataFrame, top: int, min_coverage: float = 0.7, min_std: float = 1e-8) -> DataFrame:
    """The top candidates by |IC| of a sample, of enough coverage and spread. oos_ic and same_sign repeat the sample's: marked synthetic."""
    best = stats.where((F.col("coverage") >= min_coverage) & (F.col("std") > min_std) & F.col("ic").isNotNull()).orderBy(F.desc(F.abs("ic")), "factor").limit(top)
    rows = candidates.join(best.withColumnRenamed("factor", "name"), "name")
    return rows.select(*candidates.columns, F.col("ic").alias("is_ic"), F.abs("ic").alias("abs_is_ic"), F.col("ic").alias("oos_ic"), F.lit(True).alias("same_sign"), "n", "coverage", "std", F.lit(True).alias("oos_is_synthetic"))
