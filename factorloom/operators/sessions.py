"""Trading sessions and labels of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import sdiv

#: Minutes without a bar that end a session, and bars before a break that get no label.
LONG_BREAK = 60
BLANK_BARS = 30
HORIZON = 30


def series(keys=("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("datetime")


def minutes(x: Column) -> Column:
    """A time as minutes since 1970."""
    return F.unix_seconds(x.cast("timestamp")) / 60


def sessions(bars: DataFrame, gap_minutes: float = LONG_BREAK, keys=("symbol",)) -> DataFrame:
    """Adds gap_min, is_long_break_before, session_id, bars_to_next_long_break and bss, the bars since the session began:
    counted from 1 in the first session and from 0 in later ones, so that later windows never hold the bar of the break.
    """
    ws = series(keys)
    gap = F.coalesce(minutes(F.col("datetime")) - minutes(F.lag("datetime").over(ws)), F.lit(0.0))
    df = bars.withColumn("gap_min", gap).withColumn("is_long_break_before", F.col("gap_min") >= gap_minutes)
    running = ws.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("session_id", F.sum(F.col("is_long_break_before").cast("int")).over(running).cast("int"))
    one = Window.partitionBy(*keys, "session_id")
    place = F.row_number().over(one.orderBy("datetime"))
    return df.withColumns({"bars_to_next_long_break": (F.count("*").over(one) - place).cast("int"), "bss": (place - F.when(F.col("session_id") > 0, 1).otherwise(0)).cast("int")})


def labels(df: DataFrame, horizon: int = HORIZON, blank: int = BLANK_BARS, keys=("symbol",)) -> DataFrame:
    """Adds label: the return over the next horizon bars of the session; NULL within blank bars before a break, whatever the horizon."""
    one = Window.partitionBy(*keys, "session_id").orderBy("datetime")
    near = F.max("is_long_break_before").over(series(keys).rowsBetween(1, blank))
    forward = sdiv(F.lead("close", horizon).over(one), F.col("close")) - 1
    return df.withColumn("label", F.when(~F.coalesce(near, F.lit(False)), forward))
