"""Where bars come from: event and trade tables, positional CSV, Parquet, memory; and how good they are.

A bar is (symbol, ts, open, high, low, close, volume, openinterest); missing values are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, openinterest double"
COLUMNS = [x.split()[0] for x in BAR.split(", ")]


def _utc(c: Column) -> Column:
    return c.cast("timestamp")


def bars_of(rows: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, bucket: Column, tie: list[str]) -> DataFrame:
    """Bars from priced rows: first, highest, lowest and last price and summed volume per symbol and bucket.

    Rows of one moment are ordered by ``tie``. All five are aggregates with partial sums, so a hot symbol or
    bucket costs one row per task in the shuffle.
    """
    at = F.struct(ts.alias("ts"), *tie)
    df = rows.select(symbol.alias("symbol"), _utc(bucket).alias("ts"), at.alias("at"), price.cast("double").alias("price"), volume.cast("double").alias("volume"))
    df = df.groupBy("symbol", "ts").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("volume").alias("volume")
    )
    return df.withColumn("openinterest", F.lit(0.0))


def event_bars(spark: SparkSession, sf_dir: str, bucket: str = "hour") -> DataFrame:
    """``events`` as bars: symbol is the event type, price its value, volume the number of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_of(e, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), F.date_trunc(bucket, "ts"), ["event_id"])


def shipment_bars(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """``lineitem`` as daily bars: price is the extended price, volume the quantity."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return bars_of(li, F.col(symbol).cast("string"), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), F.date_trunc("day", "l_shipdate"), ["l_orderkey", "l_linenumber", "l_extendedprice"])


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with t, their number from 1 within the symbol: the order all series functions go by."""
    return bars.withColumn("t", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))


#: The same bars in SQL, for the oracle.
EVENT_BARS_SQL = """SELECT event_type AS symbol, date_trunc('{bucket}', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, 0.0::DOUBLE AS openinterest FROM events GROUP BY ALL"""
SHIPMENT_BARS_SQL = """SELECT {symbol}::VARCHAR AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)::DOUBLE AS open, max(l_extendedprice)::DOUBLE AS high,
 min(l_extendedprice)::DOUBLE AS low, last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)::DOUBLE AS close, sum(l_quantity)::DOUBLE AS volume, 0.0::DOUBLE AS openinterest FROM lineitem GROUP BY 1, 2"""


def numbered_sql(bars_sql: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS t FROM ({bars_sql})"


@dataclass
class CsvFormat:
    """Positions of the fields and how they are written; -1 for a field that is not there."""

    separator: str = ","
    header: bool = True
    date_format: str = "yyyy-MM-dd"
    time_format: str | None = None
    columns: dict[str, int] = field(default_factory=lambda: {"datetime": 0, "time": -1, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "openinterest": 6})


def _prefix_number(c: Column) -> tuple[Column, Column]:
    """The leading number of a text, and whether the text begins with none; text after a number is ignored."""
    lead = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]))", 1)
    return F.when(lead != "", lead.try_cast("double")), lead == ""


def read_csv(spark: SparkSession, path: str, symbol: str, fmt: CsvFormat | None = None, fromdate: str | None = None, todate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, diagnostics) of a positional CSV file.

    A byte-order mark and carriage returns are dropped. Rows too short for the price columns are skipped; a
    number that does not parse is 0.0 and counted; a date that does not parse is the epoch and the row stays;
    volume and open interest default to 0. Both ends of the date window are included. Diagnostics is one row:
    rows_seen, rows_loaded, rows_short, bad_numbers, bad_dates, outside_window, duplicate_ts, out_of_order.
    """
    fmt = fmt or CsvFormat()
    pos = fmt.columns
    raw = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("line"), F.monotonically_increasing_id().alias("n"))
    if fmt.header:
        first = raw.agg(F.min("n")).first()[0]
        raw = raw.where(F.col("n") > (first if first is not None else -1))
    raw = raw.where(F.trim("line") != "")
    need = 1 + max(pos[k] for k in ("datetime", "open", "high", "low", "close"))
    f = raw.select("n", F.split("line", f"\\Q{fmt.separator}\\E").alias("f")).withColumn("short", F.size("f") < need)
    text = lambda k: F.trim(F.get("f", F.lit(pos[k]))) if pos.get(k, -1) >= 0 else F.lit(None).cast("string")
    stamp, pattern = text("datetime"), fmt.date_format
    if pos.get("time", -1) >= 0 and fmt.time_format:
        stamp, pattern = F.concat_ws(" ", stamp, text("time")), f"{fmt.date_format} {fmt.time_format}"
    when = F.try_to_timestamp(stamp, F.lit(pattern))
    parsed = {k: _prefix_number(text(k)) for k in ("open", "high", "low", "close", "volume", "openinterest")}
    there = {k: F.coalesce(text(k), F.lit("")) != "" for k in ("volume", "openinterest")}
    bad = sum((F.coalesce(p[1], F.lit(True)).cast("int") * (there[k].cast("int") if k in there else F.lit(1)) for k, p in parsed.items()), F.lit(0))
    rows = f.select(
        "n", "short", F.coalesce(when, F.timestamp_seconds(F.lit(0))).alias("ts"), (when.isNull() & ~F.col("short")).alias("bad_date"),
        *[F.coalesce(p[0], F.lit(0.0)).alias(k) for k, p in parsed.items()], F.when(F.col("short"), 0).otherwise(bad).alias("bad"),
    )
    inside = F.lit(True)
    if fromdate:
        inside = inside & (F.col("ts") >= F.lit(fromdate).cast("timestamp"))
    if todate:
        inside = inside & (F.col("ts") <= F.lit(todate).cast("timestamp"))
    rows = rows.withColumn("inside", inside)
    loaded = rows.where("not short and inside")
    bars = loaded.select(F.lit(symbol).alias("symbol"), "ts", "open", "high", "low", "close", "volume", "openinterest")
    # rows are held against the row before them within a split of the file, the first of a split against the last of the split before
    cut = loaded.select(F.shiftright("n", 33).alias("split"), "n", "ts")
    inner = cut.select("ts", F.lag("ts").over(Window.partitionBy("split").orderBy("n")).alias("before"))
    ends = cut.groupBy("split").agg(F.min_by("ts", "n").alias("ts"), F.max_by("ts", "n").alias("last"))
    seams = ends.select("ts", F.lag("last").over(Window.orderBy("split")).alias("before"))  # one row per split
    order = inner.union(seams).agg(F.count_if(F.expr("ts = before")).alias("duplicate_ts"), F.count_if(F.expr("ts < before")).alias("out_of_order"))
    report = rows.agg(
        F.count("*").alias("rows_seen"), F.count_if(F.expr("not short and inside")).alias("rows_loaded"), F.count_if("short").alias("rows_short"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_numbers"), F.count_if("bad_date").alias("bad_dates"), F.count_if(F.expr("not short and not inside")).alias("outside_window"),
    )
    return bars, report.crossJoin(F.broadcast(order))  # one row each


def read_parquet(spark: SparkSession, path: str, fromdate: str | None = None, todate: str | None = None) -> DataFrame:
    """Bars of a Parquet file; the window, both ends included, reaches the scan."""
    df = spark.read.parquet(path)
    if fromdate:
        df = df.where(F.col("ts") >= F.lit(fromdate).cast(df.schema["ts"].dataType))
    if todate:
        df = df.where(F.col("ts") <= F.lit(todate).cast(df.schema["ts"].dataType))
    return df


def in_memory(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, BAR)


def quality(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, adjacent duplicate and backward times, missing or non-finite cells, negative prices, crossed bars."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    cells = [F.col(x) for x in ("open", "high", "low", "close", "volume")]
    odd = sum((F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)).cast("int") for c in cells), F.lit(0))
    negative = sum((F.coalesce(c < 0, F.lit(False)).cast("int") for c in cells[:4]), F.lit(0))
    df = bars.select("symbol", "ts", (F.col("ts") == before).alias("dup"), odd.alias("odd"), negative.alias("negative"), (F.col("high") < F.col("low")).alias("crossed"))
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count_if("dup").alias("duplicate_ts"), F.sum("odd").cast("long").alias("not_finite"),
        F.sum("negative").cast("long").alias("negative_prices"), F.count_if("crossed").alias("crossed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
