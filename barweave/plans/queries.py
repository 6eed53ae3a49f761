"""The registered queries of the bar-series engine and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import series
from ..functions.intervals import Interval, interval
from ..operators import analytics, gate, indicators, patterns, resample, signals, stats
from ..operators.broker import Commission, Slippage
from ..sources import bars as source
from ..streaming import live
from . import factors, simulate

Query = Callable[[SparkSession, str], DataFrame]
#: Formulas that one query computes at most.
CHUNK = 24
KEEP = ("symbol", "t")

_SHIP = source.SHIPMENT_BARS_SQL.format(symbol="l_returnflag")
_SHIP_SQL = source.numbered_sql(_SHIP)
_LINES = source.SHIPMENT_BARS_SQL.format(symbol="('L' || l_linenumber)")
_LINES_SQL = source.numbered_sql(_LINES)
_EVENT = source.EVENT_BARS_SQL.format(bucket="hour")
_EVENT_SQL = source.numbered_sql(_EVENT)
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.numbered(source.shipment_bars(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    made = source.bars_of(li, F.concat(F.lit("L"), F.col("l_linenumber").cast("string")), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), F.date_trunc("day", "l_shipdate"), ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return source.numbered(made)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.numbered(source.event_bars(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to about ten places (sums differ in their last bits by order), whole numbers as long, times as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.expr(series.rounded_sql(f"`{name}`"))
        elif kind == "int":
            c = c.cast("long")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def _chunks(formulas: dict[str, str], name: str) -> dict[str, dict[str, str]]:
    """Formulas in groups of one kind: those that feed back, which need a grouped map, apart from the rest."""
    back = {k: v for k, v in formulas.items() if series.recursive(series.parse(v))}
    plain = {k: v for k, v in formulas.items() if k not in back}
    out = {}
    for kind, some in (("", list(plain.items())), ("_rec", list(back.items()))):
        for i in range(0, len(some), CHUNK):
            out[f"{name}{kind}_{i // CHUNK + 1}"] = dict(some[i : i + CHUNK])
    return out


def _formula_groups() -> dict[str, tuple[str, dict[str, str]]]:
    """Query name to (kind of bars, formulas)."""
    found: dict[str, tuple[str, dict[str, str]]] = {}
    for family in dict.fromkeys(i.family for i in indicators.REGISTRY.values()):
        for name, f in _chunks(indicators.formulas(indicators.family(family)), f"ind_{family}").items():
            found[name] = ("ship", f)
    found["candles_1"] = ("ship", patterns.formulas())
    for library in factors.LIBRARIES:
        bars = "lines" if library == "jkp" else "ship"
        for name, f in _chunks(factors.factors(library), library).items():
            found[name] = (bars, f)
    return found


GROUPS = _formula_groups()
KERNELS = [i.name for i in indicators.REGISTRY.values() if i.kernel]
_OF = {"ship": (_shipments, _SHIP_SQL), "lines": (_lines, _LINES_SQL), "event": (_events, _EVENT_SQL)}


def _formula_query(kind: str, formulas: dict[str, str]) -> Query:
    return lambda spark, sf_dir: rounded(series.with_series(_OF[kind][0](spark, sf_dir), formulas, KEEP))


def kernel_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.compute(_shipments(spark, sf_dir), KERNELS, KEEP))


# bars


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(source.event_bars(spark, sf_dir))


def bars_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(source.shipment_bars(spark, sf_dir))


def bars_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(source.quality(source.event_bars(spark, sf_dir)))


def resample_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.resample(source.event_bars(spark, sf_dir), interval("4h")))


def resample_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.resample(source.shipment_bars(spark, sf_dir), Interval("weeks")))


def resample_month_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.resample_to_start(source.shipment_bars(spark, sf_dir), interval("1M")))


def resample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.resample(source.shipment_bars(spark, sf_dir), Interval("days", 3)))


def replay_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.replay(source.shipment_bars(spark, sf_dir), Interval("weeks")))


def align_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = source.event_bars(spark, sf_dir)
    context = resample.resample_to_start(hours, interval("4h"))
    got = resample.align(hours, context, interval("1h"), interval("4h"), ["open", "close"])
    return rounded(got.select("symbol", "ts", "close", "ctx_open", "ctx_close"))


def convert_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices at the last rate before them; rates are the mean prices of all orders of a day, by customer's hash."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.expr("if(o_custkey % 2 = 0, 'EUR', 'GBP')").alias("currency"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"))
    rates = orders.groupBy("currency", "ts").agg((F.avg("amount") / 100000).alias("rate"))
    return rounded(resample.convert(orders, rates).select("key", "currency", "base_amount"))


# plans


def sma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.sma_cross(_events(spark, sf_dir)))


RULES = simulate.Rules(long="num(mean(c, {fast}) > mean(c, {slow}))", exit="num(mean(c, {fast}) < mean(c, {slow}))", params={"fast": 10, "slow": 30})
ACCOUNT = simulate.Account(cash=1e6, commission=Commission("percent", 0.001), slippage=Slippage(percent=0.0005))
GRID = {"fast": [5, 10], "slow": [20, 30, 50]}


def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simulate.backtest(_shipments(spark, sf_dir), RULES, ACCOUNT, equity=False)
    return rounded(got.where("kind = 'trade'").select("symbol", "ref", "t", "size", "price", "pnl", "pnlcomm", "bars"))


def backtest_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = simulate.Rules(long="num(c > mean(c, 20))", exit="num(c < mean(c, 20) * 0.8)", stop=0.05, target=0.1)
    account = simulate.Account(cash=1e8, commission=Commission("per_share", 0.01, 1.0), sizer="fixed", sizer_args=(10.0,))
    return rounded(simulate.backtest(_shipments(spark, sf_dir), rules, account, equity=False).where("kind = 'fill'").select("symbol", "t", "ref", "size", "price", "note"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.summary(simulate.backtest(_shipments(spark, sf_dir), RULES, ACCOUNT, grid=GRID), GRID))


def trade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simulate.backtest(_shipments(spark, sf_dir), RULES, ACCOUNT, equity=False)
    return rounded(analytics.trade_statistics(got.where("kind = 'trade'").withColumn("seq", F.col("ref"))))


def extended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simulate.backtest(_shipments(spark, sf_dir), RULES, ACCOUNT)
    return rounded(analytics.extended(got.where("kind = 'equity'"), got.where("kind = 'trade'")))


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipments(spark, sf_dir).select("symbol", "t", F.col("close").alias("value"))


def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.drawdowns(_equity(spark, sf_dir)))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.returns(_equity(spark, sf_dir)))


def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.sharpe(_equity(spark, sf_dir), rate=0.01))


def _test(name: str, formula: str) -> Query:
    return lambda spark, sf_dir: rounded(stats.test(_shipments(spark, sf_dir), name, formula))


def _rolling(name: str, formula: str, window: int) -> Query:
    return lambda spark, sf_dir: rounded(stats.rolling(_events(spark, sf_dir), name, formula, window))


ENTRY = "num(c > mean(c, 20) and lag(c, 1) <= lag(mean(c, 20), 1))"


def gate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.candidates(_shipments(spark, sf_dir), ENTRY).drop("ts"))


def gate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gate.candidates(_shipments(spark, sf_dir), ENTRY).withColumn("score", F.col("place")).where("score is not null")
    gated = gate.size(gate.calibrate(got, gate.isotonic(got)), "hybrid", 0.45)
    return rounded(gate.ledger(gated))


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.compute(_lines(spark, sf_dir), "alpha101", ["012", "041", "101"], cross=True).drop("ts"))


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the event stream, all that is there, read as a stream; the watermark drops windows from the state, and each
    micro-batch writes the bars that it changed, of which the latest count."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"{tempfile.gettempdir()}/barweave-stream"
    path = f"{root}/stream-{uuid.uuid4().hex}"
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    ticks = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    out = live.stream_bars(ticks, "1 day")
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    bars = ("high", "low", "volume", "ticks")
    got = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
    got = got.groupBy("symbol", "ts").agg(F.max_by(F.struct(*bars), "batch").alias("bar"))
    return rounded(got.select("symbol", "ts", *[f"bar.{x}" for x in bars]))


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.regimes(_shipments(spark, sf_dir), high=0.5).select("symbol", "t", "regime"))


ENTRIES = {"above": ENTRY, "narrow": "num(h - l < mean(h - l, 20) * 0.5)", "heavy": "num(v > 2 * mean(v, 20))"}


def signal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.evaluate(_shipments(spark, sf_dir), ENTRIES))


NAMED: dict[str, Query] = {
    f.__name__: f
    for f in (
        sma_cross, bars_events, bars_shipments, bars_quality, resample_4h, resample_week, resample_month_start, resample_days, replay_week, align_clocks, convert_currency,
        kernel_indicators, backtest_trades, backtest_brackets, sweep, trade_statistics, extended_metrics, drawdowns, returns, sharpe, gate_candidates, gate_ledger, cross_section, stream_bars, regimes, signal_entries,
    )
} | {
    "test_adf": _test("adf", "c"), "test_hurst_rs": _test("hurst_rs", "ret"), "test_garch": _test("garch", "ret"), "test_hmm2": _test("hmm2", "ret"),
    "rolling_adf": _rolling("adf", "c", 120), "rolling_hurst": _rolling("hurst_rs", "delta(c)", 120), "rolling_garch": _rolling("garch", "delta(c)", 120),
}


def queries() -> dict[str, Query]:
    return NAMED | {name: _formula_query(kind, f) for name, (kind, f) in GROUPS.items()}


def _r(x: str) -> str:
    return series.rounded_sql(x)


_BAR_OUT = ", ".join(f"{_r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "openinterest"))
_AGG = "first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, 0.0::DOUBLE AS openinterest, count(*) AS n_bars, max(ts) AS last_ts"

SQL = {
    "sma_cross": simulate.SMA_CROSS_SQL.format(bars=_EVENT_SQL, fast=10, slow=30, **{x: series.rounded_sql(x) for x in ("gross", "best", "worst", "max_drawdown")}),
    "bars_events": f"SELECT symbol, {_TS}, {_BAR_OUT} FROM ({_EVENT})",
    "bars_shipments": f"SELECT symbol, {_TS}, {_BAR_OUT} FROM ({_SHIP})",
    "bars_quality": f"""SELECT symbol, count(*) AS n_rows, 0::BIGINT AS duplicate_ts, sum((open IS NULL)::INT + (close IS NULL)::INT)::BIGINT AS not_finite, sum((open < 0)::INT + (high < 0)::INT + (low < 0)::INT + (close < 0)::INT)::BIGINT AS negative_prices,
        count(*) FILTER (high < low) AS crossed, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM ({_EVENT}) GROUP BY symbol""",
    "resample_4h": f"""WITH g AS (SELECT symbol, date_trunc('day', ts) AS d, hour(ts) // 4 AS k, {_AGG} FROM ({_EVENT}) GROUP BY ALL),
        n AS (SELECT *, lead(last_ts) OVER (PARTITION BY symbol ORDER BY last_ts) AS after FROM g)
        SELECT symbol, strftime(CASE WHEN after IS NOT NULL AND after::DATE <> last_ts::DATE THEN d + INTERVAL 86399 SECOND ELSE d + INTERVAL 4 HOUR * (k + 1) END, '%Y-%m-%d %H:%M:%S') AS ts, {_BAR_OUT}, n_bars FROM n""",
    "resample_week": f"WITH g AS (SELECT symbol, date_trunc('week', ts) AS w, {_AGG} FROM ({_SHIP}) GROUP BY ALL) SELECT symbol, strftime(date_trunc('day', last_ts) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS ts, {_BAR_OUT}, n_bars FROM g",
    "resample_month_start": f"WITH g AS (SELECT symbol, date_trunc('month', ts) AS m, {_AGG} FROM ({_SHIP}) GROUP BY ALL) SELECT symbol, strftime(m, '%Y-%m-%d %H:%M:%S') AS ts, {_BAR_OUT}, n_bars FROM g",
    "resample_days": f"WITH g AS (SELECT symbol, date_diff('day', DATE '1970-01-01', ts::DATE) // 3 AS k, {_AGG} FROM ({_SHIP}) GROUP BY ALL) SELECT symbol, strftime(date_trunc('day', last_ts) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS ts, {_BAR_OUT}, n_bars FROM g",
    "replay_week": f"""WITH b AS (SELECT *, date_trunc('week', ts) AS w FROM ({_SHIP}))
        SELECT symbol, {_TS}, {_r("first_value(open) OVER p")} AS open, {_r("max(high) OVER p")} AS high, {_r("min(low) OVER p")} AS low, {_r("close")} AS close, {_r("sum(volume) OVER p")} AS volume,
               coalesce(lead(w) OVER (PARTITION BY symbol ORDER BY ts) <> w, true) AS is_period_end
        FROM b WINDOW p AS (PARTITION BY symbol, w ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "align_clocks": f"""WITH h AS ({_EVENT}), c AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS start, {_AGG} FROM h GROUP BY ALL)
        SELECT h.symbol, strftime(h.ts, '%Y-%m-%d %H:%M:%S') AS ts, {_r("h.close")} AS close, {_r("c.open")} AS ctx_open, {_r("c.close")} AS ctx_close
        FROM h ASOF LEFT JOIN (SELECT *, start + INTERVAL 4 HOUR AS visible FROM c) c ON h.symbol = c.symbol AND h.ts + INTERVAL 1 HOUR >= c.visible""",
    "convert_currency": f"""WITH o AS (SELECT o_orderkey AS key, CASE WHEN o_custkey % 2 = 0 THEN 'EUR' ELSE 'GBP' END AS currency, o_orderdate AS ts, o_totalprice AS amount FROM orders),
        r AS (SELECT currency, ts, avg(amount) / 100000 AS rate FROM o GROUP BY ALL)
        SELECT o.key, o.currency, {_r("o.amount * coalesce(r.rate, 1.0)")} AS base_amount FROM o ASOF LEFT JOIN r ON o.currency = r.currency AND o.ts >= r.ts""",
    "drawdowns": f"""WITH e AS (SELECT symbol, t, close AS value FROM ({_SHIP_SQL})), p AS (SELECT *, greatest(max(value) OVER (PARTITION BY symbol ORDER BY t), 0.0) AS peak FROM e),
        m AS (SELECT *, peak - value AS money, CASE WHEN peak > 0 THEN 100 * (peak - value) / peak ELSE 0.0 END AS percent FROM p)
        SELECT symbol, t, {_r("value")} AS value, {_r("peak")} AS peak, {_r("money")} AS money, {_r("percent")} AS percent, t - coalesce(max(CASE WHEN money <= 0 THEN t END) OVER (PARTITION BY symbol ORDER BY t), 0) AS length FROM m""",
    "returns": f"""WITH e AS (SELECT symbol, first(close ORDER BY t) AS a, last(close ORDER BY t) AS b, count(*) AS n FROM ({_SHIP_SQL}) GROUP BY symbol)
        SELECT symbol, n, {_r("ln(b / a)")} AS rtot, {_r("ln(b / a) / n")} AS ravg, {_r("exp(ln(b / a) / n * 252) - 1")} AS rnorm, {_r("100 * (exp(ln(b / a) / n * 252) - 1)")} AS rnorm100 FROM e""",
    "sharpe": f"""WITH e AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM ({_SHIP_SQL}))
        SELECT symbol, {_r(f"avg(r - {1.01 ** (1 / 252) - 1!r}) / stddev_pop(r) * sqrt(252)")} AS sharpe FROM e GROUP BY symbol""",
    "gate_candidates": "SELECT * EXCLUDE (entry), CASE WHEN outcome IS NOT NULL THEN (outcome > 0)::BIGINT END AS label FROM ({}) WHERE entry = 1".format(
        series.to_sql(gate.FEATURES | {"entry": ENTRY, "outcome": "lead(c, 5) / lead(o, 1) - 1"}, _SHIP_SQL, keep=KEEP)
    ),
    "regimes": signals.REGIME_SQL.format(high=0.5, inner=series.to_sql(signals.REGIMES, _SHIP_SQL, rounding=False, keep=KEEP)),
    "signal_entries": " UNION ALL ".join(f"SELECT symbol, t, '{n}' AS entry FROM ({series.to_sql({n: f}, _SHIP_SQL, rounding=False, keep=KEEP)}) WHERE {n} = 1" for n, f in ENTRIES.items()),
    "stream_bars": f"SELECT event_type AS symbol, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS ts, {_r('max(value)')} AS high, {_r('min(value)')} AS low, count(*)::DOUBLE AS volume, count(*) AS ticks FROM events GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {name: series.to_sql(f, _OF[kind][1], keep=KEEP) for name, (kind, f) in GROUPS.items()}
