"""The frames that the registered queries start from, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors, sessions
from ..sources import bars
from .sqlbase import DAY_BLANK, DAY_GAP, DAY_HORIZON, PANEL_FACTORS

PANEL_NAMES = list(PANEL_FACTORS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily_bars(table(spark, sf_dir, "lineitem"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.minute_bars(table(spark, sf_dir, "events"))


def day_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(day_bars(spark, sf_dir), DAY_GAP)


def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.labels(day_sessions(spark, sf_dir), DAY_HORIZON, DAY_BLANK)


def day_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.base_series(day_labels(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    df = factors.add_factors(day_frame(spark, sf_dir), names or PANEL_NAMES)
    return df.withColumn("month", F.date_format("datetime", "yyyy-MM"))


def day(x: str = "datetime") -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def minute(x: str = "datetime") -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm")


def r6(x: Column, name: str, digits: int = 6) -> Column:
    """Rounded, without a negative zero: what both engines agree on."""
    return (F.round(x, digits) + F.lit(0.0)).alias(name)
