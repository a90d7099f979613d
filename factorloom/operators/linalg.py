"""Cross products of many columns: partial sums of a matrix product in each task, one small matrix on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, is_finite


def gram(df: DataFrame, columns: list[str], batch_rows: int = 5_000) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, column sums, rows) of the columns, missing values as 0.

    Each task adds up its own rows and hands on one matrix as rows of (i, values); tasks are summed by an aggregate
    on i, so what reaches the driver is columns x columns whatever the rows.
    """
    k = len(columns)

    def run(batches):
        total, n = np.zeros((k + 1, k)), 0
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64)
            total[:k] += x.T @ x
            total[k] += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(np.full(k + 1, n), pa.int64())], names=["i", "v", "n"])

    rows = df.select(*(F.when(is_finite(c), F.col(c).cast("double")).otherwise(0.0).alias(c) for c in columns))
    parts = rows.mapInArrow(run, "i int, v array<double>, n long")
    sums = parts.groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(k))).alias("v"), F.sum("n").alias("n")) if k <= 64 else _long_sums(parts)
    m, n = np.zeros((k + 1, k)), 0
    for r in sums.collect():
        m[r["i"]], n = r["v"], r["n"]
    return m[:k], m[k], n


def _long_sums(parts: DataFrame) -> DataFrame:
    """The same sums for many columns, by entry: no aggregate has more than one buffer."""
    entry = parts.select("i", "n", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return entry.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))


def standardised(df: DataFrame, columns: list[str], least_std: float = 1e-8) -> DataFrame:
    """The columns as (x - mean) / population std over all rows; 0 for missing values and for columns without spread."""
    stats = df.agg(*(F.struct(F.avg(finite(c)).alias("m"), F.stddev_pop(finite(c)).alias("s")).alias(c) for c in columns)).first()
    out = {}
    for c in columns:
        m, s = stats[c]["m"], stats[c]["s"]
        out[c] = F.coalesce((finite(c) - F.lit(m)) / F.lit(s), F.lit(0.0)) if s is not None and s > least_std else F.lit(0.0)
    return df.withColumns(out)


def correlations(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """left x right: mean products of standardised columns over all rows, so a sparse column's correlations shrink."""
    both = list(dict.fromkeys([*left, *right]))
    g, _, n = gram(standardised(df, both).select(*both), both)
    at = {c: i for i, c in enumerate(both)}
    return g[np.ix_([at[c] for c in left], [at[c] for c in right])] / max(n, 1)
