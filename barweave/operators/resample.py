"""Coarser bars, replayed bars, and clocks that are aligned without looking ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import Interval, period_end, period_start


def _bucket(over: Interval) -> Column:
    """The number of a bar's period: minutes count within the day, weeks from Monday, months and weeks singly."""
    day = F.datediff("ts", F.lit("1970-01-01"))
    match over.unit:
        case "minutes":
            minute = F.hour("ts") * 60 + F.minute("ts")
            return day * 1440 + F.floor(minute / over.count)
        case "days":
            return F.floor(day / over.count)
        case "weeks":
            return F.floor((day + 3) / 7)
        case "months":
            return F.year("ts") * 12 + F.month("ts")
        case "years":
            return F.year("ts")
    return F.monotonically_increasing_id()


def _aggregates() -> list[Column]:
    return [
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.lit(0.0).alias("openinterest"), F.count("*").alias("n_bars"), F.max("ts").alias("last_ts"),
    ]


def resample(bars: DataFrame, over: Interval) -> DataFrame:
    """One bar per period, labelled by its end: for minutes the end of the bucket, else the last bar's day at 23:59:59.

    A minute bucket that is its day's last, but for the series' last, is labelled with the end of the day.
    """
    df = bars.withColumn("bucket", _bucket(over)).groupBy("symbol", "bucket").agg(*_aggregates())
    day_end = F.date_trunc("day", "last_ts") + F.expr("interval 86399 seconds")
    if over.unit != "minutes":
        return df.select("symbol", day_end.alias("ts"), "open", "high", "low", "close", "volume", "openinterest", "n_bars")
    end = F.date_trunc("day", "last_ts") + F.make_interval(mins=((F.floor((F.hour("last_ts") * 60 + F.minute("last_ts")) / over.count) + 1) * over.count).cast("int"))
    after = F.lead("last_ts").over(Window.partitionBy("symbol").orderBy("last_ts"))
    label = F.when(after.isNotNull() & (F.to_date(after) != F.to_date("last_ts")), day_end).otherwise(end)
    return df.withColumn("ts", label).select("symbol", "ts", "open", "high", "low", "close", "volume", "openinterest", "n_bars")


def resample_to_start(bars: DataFrame, over: Interval) -> DataFrame:
    """One bar per period, labelled by the period's start."""
    df = bars.withColumn("start", period_start(F.col("ts"), over)).groupBy("symbol", "start").agg(*_aggregates())
    return df.select("symbol", F.col("start").alias("ts"), "open", "high", "low", "close", "volume", "openinterest", "n_bars")


def replay(bars: DataFrame, over: Interval) -> DataFrame:
    """Every source bar with its period's bar so far, and whether the period ends there (unknown ends are ends)."""
    df = bars.withColumn("bucket", _bucket(over))
    so_far = Window.partitionBy("symbol", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead("bucket").over(Window.partitionBy("symbol").orderBy("ts"))
    return df.select(
        "symbol", "ts", F.first("open").over(so_far).alias("open"), F.max("high").over(so_far).alias("high"), F.min("low").over(so_far).alias("low"), "close",
        F.sum("volume").over(so_far).alias("volume"), F.coalesce(after != F.col("bucket"), F.lit(True)).alias("is_period_end"),
    )


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], prefix: str = "") -> DataFrame:
    """Each row of ``left`` with ``columns`` of the last row of ``right`` of its key at or before its time.

    One union, one shuffle and one sort by key and time; ties count as before. No range join, no pair is built.
    """
    rows = left.select(*by, F.col(left_ts).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__found"))
    marks = right.select(*by, F.col(right_ts).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct(*columns).alias("__found"))
    seen = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.unionByName(marks).withColumn("__last", F.last("__found", ignorenulls=True).over(seen)).where("__side = 1")
    return got.select("__row.*", *[F.col(f"__last.{c}").alias(prefix + c) for c in columns])


def align(bars: DataFrame, context: DataFrame, execution: Interval, over: Interval, columns: list[str], prefix: str = "ctx_") -> DataFrame:
    """Execution bars with the last context bar that is complete when the execution bar closes."""
    close = period_end(F.col("ts"), execution) if execution.unit in ("weeks", "months") else F.col("ts") + F.expr(f"interval {execution.seconds} seconds")
    left = bars.withColumn("__close", close)
    right = context.withColumn("__visible", period_end(F.col("ts"), over))
    return as_of(left, right, ["symbol"], "__close", "__visible", columns, prefix).drop("__close")


def convert(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """``amounts`` (currency, ts, amount) in the base currency at the last known rate (currency, ts, rate); without one, 1 to 1."""
    got = as_of(amounts, rates, ["currency"], "ts", "ts", ["rate"])
    return got.withColumn("base_amount", F.col("amount") * F.coalesce("rate", F.lit(1.0)))
