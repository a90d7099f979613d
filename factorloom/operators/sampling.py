"""Reproducible samples: rows are ordered by the MD5 of their key and a seed, so no random state and no order of rows matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .views import event_scores

BINS = 8
EVENT_SHARES = {"soft_event": 0.25, "event35": 0.35, "event50": 0.50}


def lot(*key: str, seed: int = 0) -> Column:
    """The sort key of a row: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))).cast("binary"))


def uniform(lot_column: Column) -> Column:
    """A number above 0 and up to 1 from the first 12 digits."""
    return (F.conv(F.substring(lot_column, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def _first(df: DataFrame, by: list[str], order: list[Column], k: Column | int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def sample_rows(df: DataFrame, per_month: int, most: int | None = None, seed: int = 0, key=("symbol", "datetime")) -> DataFrame:
    """Labelled rows: per_month of each month, then most of all, without replacement."""
    rows = df.where("label is not null").withColumn("_lot", lot(*key, seed=seed))
    rows = _first(rows, ["month"], [F.col("_lot")], per_month)
    return (rows.orderBy("_lot").limit(most) if most else rows).drop("_lot")


def sample_times(df: DataFrame, rows_per_month: int, seed: int = 0) -> DataFrame:
    """Whole cross-sections: as many times of each month as make rows_per_month at the month's median breadth."""
    times = df.groupBy("month", "datetime").agg(F.count("*").alias("n"))
    need = times.groupBy("month").agg(F.ceil(F.lit(float(rows_per_month)) / F.greatest(F.percentile("n", F.lit(0.5)), F.lit(1.0))).alias("need"))
    chosen = _first(times.join(need, "month").withColumn("_lot", lot("datetime", seed=seed)), ["month"], [F.col("_lot")], F.col("need")).select("datetime")
    return df.join(chosen, "datetime", "left_semi").select(df.columns)


def stratified(df: DataFrame, need: int, seed: int = 0, key=("symbol", "datetime")) -> DataFrame:
    """need rows spread over BINS bins of label_xrank: an equal share of each, filled up from the rest."""
    bin_ = F.least(F.greatest(F.floor((F.coalesce("label_xrank", F.lit(0.0)) + 0.5) * BINS), F.lit(0)), F.lit(BINS - 1))
    rows = df.withColumns({"_lot": lot(*key, seed=seed), "_bin": bin_.cast("int")})
    share = max(1, need // BINS)
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_lot"))
    rows = rows.withColumn("_more", (place > share).cast("int"))
    return rows.orderBy("_more", "_lot").limit(need).drop("_lot", "_bin", "_more")


def sample_training(df: DataFrame, cap: int, mode: str = "random", seed: int = 0, key=("symbol", "datetime")) -> DataFrame:
    """cap labelled rows by mode: random, stratified, or an event mode, which draws its share without replacement by
    weights sqrt(event_score + .05) and stratifies the rest. df has event_scores()."""
    pool = df.where("label is not null and label_xrank is not null")
    if mode == "random":
        return pool.withColumn("_lot", lot(*key, seed=seed)).orderBy("_lot").limit(cap).drop("_lot")
    if mode == "stratified":
        return stratified(pool, cap, seed, key)
    if mode not in EVENT_SHARES:
        raise ValueError(f"no such sample mode: {mode}")
    weight = F.sqrt(F.greatest(F.coalesce("event_score", F.lit(0.0)), F.lit(0.0)) + 0.05)
    drawn = pool.withColumn("_key", -F.ln(uniform(lot(*key, seed=seed))) / weight).orderBy("_key").limit(int(cap * EVENT_SHARES[mode])).drop("_key")
    rest = pool.join(drawn.select(*key), list(key), "left_anti").select(pool.columns)
    return drawn.unionByName(stratified(rest, cap - int(cap * EVENT_SHARES[mode]), seed + 1, key))


def training_frame(df: DataFrame) -> DataFrame:
    return event_scores(df)


def recency_weight(test_month: str, half_life_months: float) -> Column:
    """2 ** (-age / half life) by whole months before test_month; 1 without a half life."""
    if half_life_months <= 0:
        return F.lit(1.0)
    year, month = map(int, test_month.split("-"))
    age = (F.lit(year * 12 + month) - F.year("datetime") * 12 - F.month("datetime")).cast("double")
    return F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / half_life_months)


def weighted_mean_scale(df: DataFrame, columns: list[str], weight: Column) -> DataFrame:
    """column, mean, scale: weighted moments, the scale at least 1e-6."""
    total = F.greatest(F.sum(weight), F.lit(1e-12))
    aggs = [F.struct(F.lit(c).alias("column"), (F.sum(weight * F.col(c)) / total).alias("mean"), (F.sum(weight * F.col(c) * F.col(c)) / total).alias("sq")).alias(f"s{i}") for i, c in enumerate(columns)]
    s = df.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return s.select("column", "mean", F.greatest(F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(1e-6)).alias("scale"))
