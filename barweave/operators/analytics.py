"""Performance analytics as aggregations: drawdown, returns, Sharpe, trade statistics, extended metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawdowns(equity: DataFrame, by: str = "symbol") -> DataFrame:
    """``equity`` (by, t, value) with peak, money and percent below it, and length of the run below (0 at a peak)."""
    up = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    df = equity.withColumn("peak", F.greatest(F.max("value").over(up), F.lit(0.0)))
    df = df.withColumn("money", F.col("peak") - F.col("value")).withColumn("percent", F.when(F.col("peak") > 0, 100 * F.col("money") / F.col("peak")).otherwise(0.0))
    last_peak = F.max(F.when(F.col("money") <= 0, F.col("t"))).over(up)
    return df.withColumn("length", (F.col("t") - F.coalesce(last_peak, F.lit(0))).cast("long"))


def returns(equity: DataFrame, by: str = "symbol", per_year: int = 252) -> DataFrame:
    """rtot (log of last over first), ravg (per bar), rnorm (a year's, compounded) per key; NULL where a value is not positive."""
    df = equity.groupBy(by).agg(F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"), F.count("*").alias("n"))
    ok = (F.col("first") > 0) & (F.col("last") > 0)
    df = df.withColumn("rtot", F.when(ok, F.log(F.col("last") / F.col("first")))).withColumn("ravg", F.col("rtot") / F.col("n"))
    return df.select(by, "n", "rtot", "ravg", F.expm1(F.col("ravg") * per_year).alias("rnorm"), (100 * F.expm1(F.col("ravg") * per_year)).alias("rnorm100"))


def _steps(equity: DataFrame, by: str, start: float | None) -> DataFrame:
    order = Window.partitionBy(by).orderBy("t")
    before = F.lag("value").over(order) if start is None else F.coalesce(F.lag("value").over(order), F.lit(float(start)))
    return equity.withColumn("r", F.try_divide(F.col("value") - before, before))


def sharpe(equity: DataFrame, by: str = "symbol", rate: float = 0.0, per_year: int = 252, start: float | None = None) -> DataFrame:
    """Mean excess simple return over its population deviation, annualised; 0 under two returns or without deviation.

    The yearly risk-free rate is taken down to a bar geometrically; with ``start`` the first bar counts too.
    """
    free = (1 + rate) ** (1 / per_year) - 1
    df = _steps(equity, by, start).groupBy(by).agg(F.avg(F.col("r") - free).alias("mean"), F.stddev_pop("r").alias("dev"), F.count("r").alias("n"))
    flat = (F.col("n") < 2) | (F.col("dev") < 1e-10)
    return df.select(by, F.when(flat, 0.0).otherwise(F.col("mean") / F.when(flat, 1.0).otherwise(F.col("dev")) * per_year**0.5).alias("sharpe"))


def extended(equity: DataFrame, trades: DataFrame, by: str = "symbol", rate: float = 0.0, per_year: int = 252, confidence: float = 0.95) -> DataFrame:
    """Annual return, CAGR, volatility, Sortino, Calmar, VaR per key, and profit factor, expectancy, win rate of its trades."""
    free = rate / per_year
    steps = _steps(equity, by, None)
    short = F.when(F.col("r") < free, F.col("r"))
    m = steps.groupBy(by).agg(
        F.avg("r").alias("mean"), F.stddev_pop("r").alias("dev"), F.stddev_pop(short).alias("downside"), F.count("*").alias("n"),
        F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"), F.percentile("r", F.lit(1 - confidence)).alias("tail"),
    )
    worst = drawdowns(equity, by).groupBy(by).agg(F.max("percent").alias("max_drawdown"))
    won, lost = F.sum(F.when(F.col("pnlcomm") > 0, F.col("pnlcomm"))), F.sum(F.when(F.col("pnlcomm") < 0, -F.col("pnlcomm")))
    t = trades.groupBy(by).agg(F.count("*").alias("trades"), F.coalesce(won, F.lit(0.0)).alias("won"), F.coalesce(lost, F.lit(0.0)).alias("lost"), F.avg("pnlcomm").alias("expectancy"), F.avg((F.col("pnlcomm") > 0).cast("double")).alias("win_rate"))
    df = m.join(worst, by).join(t, by, "left")
    growth = F.when((F.col("first") > 0) & (F.col("last") > 0), F.pow(F.col("last") / F.col("first"), per_year / F.col("n")) - 1)
    return df.select(
        by, (F.col("mean") * per_year).alias("annual_return"), growth.alias("cagr"), (F.col("dev") * per_year**0.5).alias("volatility"),
        F.try_divide((F.col("mean") - free) * per_year**0.5, F.col("downside")).alias("sortino"), F.try_divide(growth * 100, F.col("max_drawdown")).alias("calmar"),
        "max_drawdown", F.greatest(-F.col("tail"), F.lit(0.0)).alias("value_at_risk"),
        F.when(F.col("lost") > 0, F.col("won") / F.when(F.col("lost") > 0, F.col("lost"))).when(F.col("won") > 0, float("inf")).alias("profit_factor"),
        "expectancy", "win_rate", F.coalesce("trades", F.lit(0)).alias("trades"),
    )


def _longest(flag: Column, by: str, df: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy("seq")
    island = F.sum(F.when(flag, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("__island", island).where(flag).groupBy(by, "__island").agg(F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias(name))


def trade_statistics(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """Counts, gross and net results, streaks, long and short sides and lengths of closed trades (by, seq, size, pnl, pnlcomm, bars).

    A trade is won if its net result is not negative.
    """
    won = F.col("pnlcomm") >= 0
    base = trades.groupBy(by).agg(
        F.count("*").alias("closed"), F.count_if(won).alias("won"), F.count_if(~won).alias("lost"), F.sum("pnl").alias("gross"), F.sum("pnlcomm").alias("net"), F.avg("pnlcomm").alias("net_average"),
        F.max(F.when(won, F.col("pnlcomm"))).alias("best"), F.min(F.when(~won, F.col("pnlcomm"))).alias("worst"),
        F.count_if(F.col("size") > 0).alias("long"), F.count_if(F.col("size") < 0).alias("short"), F.sum(F.when(F.col("size") > 0, F.col("pnlcomm"))).alias("long_net"), F.sum(F.when(F.col("size") < 0, F.col("pnlcomm"))).alias("short_net"),
        F.sum("bars").alias("bars"), F.avg("bars").alias("bars_average"), F.max("bars").alias("bars_max"), F.min("bars").alias("bars_min"),
    )
    out = base.join(_longest(won, by, trades, "longest_won"), by, "left").join(_longest(~won, by, trades, "longest_lost"), by, "left")
    return out.fillna(0, ["longest_won", "longest_lost"])


def fills_per_bar(fills: DataFrame, by: str = "symbol") -> DataFrame:
    """Mean buy and sell prices per bar, NULL where there are none."""
    side = lambda s: F.avg(F.when(F.signum("size") == s, F.col("price")))
    return fills.groupBy(by, "t").agg(side(1).alias("buy"), side(-1).alias("sell"))
