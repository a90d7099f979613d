"""Sinks for results: CSV, JSON and Markdown tables of small frames, and predictions by model and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """symbol, datetime, label, pred by model and month."""
    rows = df.withColumn("month", F.date_format("datetime", "yyyy-MM")).select("symbol", "datetime", "label", "pred", "model", "month")
    rows.repartition("model", "month").write.mode(mode).partitionBy("model", "month").parquet(path)


def markdown(df: DataFrame, digits: int = 6, rows: int = 200) -> str:
    """A report table of the first rows: a report's length is its feature."""
    say = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    got = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(say, r)) + " |" for r in got)])


def report(title: str, parts: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{markdown(v)}" for k, v in parts.items())]) + "\n"
