"""Runs described by JSON: feeds, dates, rules, account; the results as one JSON row per portfolio."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import interval
from ..operators import analytics, resample
from ..operators.broker import Commission, Slippage
from ..sources import bars as source
from . import simulate

#: Bars before the first date that warm-up may need, in periods of the feed.
MARGIN_BARS = 50


class ConfigError(ValueError):
    pass


def parse(text: str) -> dict:
    """The configuration, with what is needed there and of the right kind."""
    try:
        config = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from e
    for key in ("path", "rules"):
        if key not in config:
            raise ConfigError(f"{key} is missing")
    for name in ("interval", "resample"):
        if config.get(name):
            interval(config[name])
    return config


def feed(spark: SparkSession, config: dict) -> DataFrame:
    """Bars of the feed, from MARGIN_BARS periods before the first date on, resampled if asked for."""
    from_date, margin = config.get("from"), None
    if from_date and config.get("interval"):
        span = interval(config["interval"]).seconds or 31 * 86400
        margin = str(spark.range(1).select(F.lit(from_date).cast("timestamp") - F.expr(f"interval {span * MARGIN_BARS} seconds")).first()[0])
    if config.get("format", "parquet") == "csv":
        bars, _ = source.read_csv(spark, config["path"], config.get("symbol", "A"), fromdate=margin or from_date, todate=config.get("to"))
    else:
        bars = source.read_parquet(spark, config["path"], margin or from_date, config.get("to"))
    if config.get("resample"):
        bars = resample.resample_to_start(bars, interval(config["resample"]))
    return source.numbered(bars)


def run(spark: SparkSession, text: str) -> DataFrame:
    """One row per symbol and combination: symbol, combo, result (JSON with metrics, trades, fills and equity)."""
    config = parse(text)
    rules = simulate.Rules(**config["rules"])
    account = simulate.Account(
        cash=config.get("cash", 100_000.0), commission=Commission(**config.get("commission", {})), slippage=Slippage(**config.get("slippage", {})),
        sizer=config.get("sizer", "percent"), sizer_args=tuple(config.get("sizer_args", (0.95,))),
    )
    got = simulate.backtest(feed(spark, config), rules, account, grid=config.get("grid"))
    metrics = simulate.summary(got).select("symbol", "combo", F.struct("final_value", "max_drawdown", "trades", "net").alias("metrics"))
    of = lambda kind, *cols: F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("t", *cols))), lambda x: x.isNotNull())
    rows = got.groupBy("symbol", "combo").agg(F.array_sort(of("trade", "size", "price", "pnl", "pnlcomm", "bars")).alias("trades"), F.array_sort(of("fill", "size", "price", "note")).alias("fills"), F.array_sort(of("equity", "value", "cash")).alias("equity"))
    return rows.join(metrics, ["symbol", "combo"]).select("symbol", "combo", F.to_json(F.struct("metrics", "trades", "fills", "equity")).alias("result"))


def sharpe_of(spark: SparkSession, text: str) -> DataFrame:
    config = parse(text)
    got = simulate.backtest(feed(spark, config), simulate.Rules(**config["rules"]), simulate.Account(cash=config.get("cash", 100_000.0)))
    return analytics.sharpe(got.where("kind = 'equity'"), start=config.get("cash", 100_000.0))
