"""Signals and regimes as columns, trading calendars, and which entries a slice of bars would make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from .resample import as_of


def to_signal(x: Column) -> Column:
    """-1, 0 or 1; a missing value is 0."""
    return F.coalesce(F.signum(x), F.lit(0.0)).cast("int")


#: The default measures of the regimes, as formulas.
REGIMES = {"volatility": "std(ret, 20)", "trend": "abs(mean(c, 10) - mean(c, 30)) / mean(c, 30)", "range": "(tsmax(h, 20) - tsmin(l, 20)) / mean(c, 20)"}


def regimes(bars: DataFrame, high: float = 0.03, formulas: dict[str, str] | None = None) -> DataFrame:
    """regime per bar: HighVol over the volatility limit, else Trending where trend is over range, else RangeBound where
    there is a range, else LowVol; NULL while the measures are not there."""
    df = series.with_series(bars, formulas or REGIMES)
    ready = F.col("volatility").isNotNull() & F.col("trend").isNotNull() & F.col("range").isNotNull()
    name = F.when(F.col("volatility") > high, "HighVol").when(F.col("trend") > F.col("range"), "Trending").when(F.col("range") > 0, "RangeBound").otherwise("LowVol")
    return df.withColumn("regime", F.when(ready, name))


REGIME_SQL = """SELECT symbol, t, CASE WHEN volatility IS NULL OR trend IS NULL OR range IS NULL THEN NULL WHEN volatility > {high} THEN 'HighVol' WHEN trend > range THEN 'Trending'
 WHEN range > 0 THEN 'RangeBound' ELSE 'LowVol' END AS regime FROM ({inner})"""


def evaluate(bars: DataFrame, entries: dict[str, str], first: int = 1, last: int | None = None) -> DataFrame:
    """Which named entries hold at which bars (of a slice, if one is given), without a broker: symbol, t, entry. Windows see the bars before the slice."""
    df = series.with_series(bars, entries).where(F.col("t") >= first)
    df = df if last is None else df.where(F.col("t") <= last)
    named = F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in entries]), lambda x: x.isNotNull())
    return df.select("symbol", "t", F.explode(named).alias("entry"))


def sessions(days: DataFrame, opens: str = "09:30:00", closes: str = "16:00:00", settlement: int = 2) -> DataFrame:
    """A calendar from trading days (day): opens, closes, and the day it settles, counted in trading days."""
    from pyspark.sql import Window

    order = Window.orderBy("day")
    at = lambda clock: F.to_timestamp(F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), F.lit(clock)))
    return days.select("day", at(opens).alias("opens"), at(closes).alias("closes"), F.lead("day", settlement).over(order).alias("settles"))


def with_session(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """``rows`` (ts) with the last session that opened and whether it is open then."""
    left, right = rows.withColumn("__all", F.lit(1)), calendar.withColumn("__all", F.lit(1))
    got = as_of(left, right, ["__all"], "ts", "opens", ["opens", "closes"], "session_").drop("__all")
    return got.withColumn("is_open", F.coalesce(F.col("ts") < F.col("session_closes"), F.lit(False)))
