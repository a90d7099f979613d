"""Bars: symbol, datetime, open, high, low, close, volume, amount, oi, from files or from event-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import number

COLUMNS = ["symbol", "datetime", "open", "high", "low", "close", "volume", "amount", "oi"]
#: Spellings of open interest in raw files.
OI_NAMES = ["open_interest", "openinterest", "position"]
META = [*COLUMNS[:2], "label", "is_long_break_before", "session_id", *COLUMNS[2:]]


def symbol_of(path: Column) -> Column:
    """A file's stem is its symbol."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def symbols(bars: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Distinct symbols without the excluded ones, in order."""
    return bars.select("symbol").distinct().where(~F.col("symbol").isin(excluded or [])).orderBy("symbol")


def normalise(raw: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Raw rows (a symbol, text columns of any case, a time column of any name) as bars: minutes as times, numbers or NULL,
    the first of rows with the same symbol and minute in file order. Absent amount is volume * close, absent oi NULL.

    needs: symbol, and _order for the order of rows in their file.
    """
    names = {x: x.strip().lower() for x in raw.columns}
    df = raw.withColumnsRenamed(names)
    free = [x for x in df.columns if x not in ("symbol", "_order")]
    time = next((x for x in free if "time" in x or "date" in x), free[0])
    oi = next((x for x in ["oi", *OI_NAMES] if x in free), None)
    pick = {x: number(x) for x in COLUMNS[2:7]}
    pick["amount"] = number("amount") if "amount" in free else pick["volume"] * pick["close"]
    pick["oi"] = number(oi) if oi else F.lit(None).cast("double")
    when = F.try_to_timestamp(F.substring(F.col(time).cast("string"), 1, 16), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    df = df.select("symbol", when.alias("datetime"), *(v.alias(k) for k, v in pick.items()), "_order")
    df = df.where(F.col("datetime").isNotNull() & ~F.col("symbol").isin(excluded or []))
    first = F.row_number().over(Window.partitionBy("symbol", "datetime").orderBy("_order"))
    return df.withColumn("_first", first).where("_first = 1").drop("_first", "_order")


def read_csv(spark: SparkSession, path: str, header: list[str], excluded: list[str] | None = None) -> DataFrame:
    """A folder of CSV files with the named columns, one file a symbol. Columns stay text until number() makes them
    numbers, so a bad field is NULL and no file is read twice to infer a schema."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{x}` string" for x in header))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return normalise(raw.select("*", symbol_of(F.col("_metadata.file_path")).alias("symbol"), place.alias("_order")), excluded)


def _ohlc(rows: DataFrame, price: Column, order: Column, volume: Column, amount: Column) -> DataFrame:
    bars = rows.groupBy("symbol", "datetime").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.alias("volume"), amount.alias("amount")
    )
    running = Window.partitionBy("symbol").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("oi", F.sum("volume").over(running))


def minute_bars(events: DataFrame) -> DataFrame:
    """Minute bars of a stream of (event_type, ts, event_id, value): volume counts events, oi is its running sum."""
    rows = events.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("datetime"), "value", "ts", "event_id")
    return _ohlc(rows, F.col("value"), F.struct("ts", "event_id"), F.count("*").cast("double"), F.sum("value"))


def daily_bars(lineitem: DataFrame, products: int = 20) -> DataFrame:
    """Daily bars of line items: a symbol is a class of suppliers, the price is that of one piece."""
    order = [x for x in lineitem.columns if x.startswith("l_")]
    rows = lineitem.withColumns({"symbol": F.concat(F.lit("S"), F.col("l_suppkey") % products), "datetime": F.date_trunc("day", "l_shipdate").cast("timestamp_ntz"), "price": F.col("l_extendedprice") / F.col("l_quantity")})
    return _ohlc(rows, F.col("price"), F.struct(*order), F.sum("l_quantity"), F.sum("l_extendedprice"))


def with_index(bars: DataFrame) -> DataFrame:
    """Adds idx: a bar's place in its symbol. Places are counted within days and shifted by the days before, so no task
    orders a whole symbol; the table of days is small."""
    day = F.to_date("datetime")
    df = bars.withColumn("_day", day)
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("symbol", "_day").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("datetime"))
    return df.withColumn("_rank", place).join(counts.drop("_n"), ["symbol", "_day"]).withColumn("idx", F.col("_shift") + F.col("_rank") - 1).drop("_day", "_rank", "_shift")


def in_chunks(bars: DataFrame, chunk_rows: int = 50_000, halo: int = 400) -> DataFrame:
    """Cuts each symbol's series into chunks of equal length, each led in by the last halo rows of the one before.

    Adds chunk and is_halo. Windows over (symbol, chunk) of at most halo rows then give for all rows outside the halo
    what windows over the symbol give, and a symbol with a third of all rows is spread over many tasks.
    """
    df = with_index(bars)
    own = (F.col("idx") / chunk_rows).cast("int")
    again = F.col("idx") % chunk_rows >= chunk_rows - halo
    df = df.withColumn("chunk", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))))
    return df.withColumn("is_halo", F.col("chunk") > own)
