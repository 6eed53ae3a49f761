"""Bars, calendars, broker, analytics, statistics and streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions.intervals import Interval, InvalidInterval, interval
from barweave.operators import analytics, gate, kernels, resample, stats
from barweave.operators.broker import INSTRUMENTS, Broker, Commission, Instrument, Order, Position, Slippage, interactive
from barweave.plans import simulate
from barweave.sources import bars as source
from barweave.streaming.live import Limits, Live


def test_intervals():
    assert interval("4h").seconds == 14400
    assert interval("1w").token == "1w"
    assert interval("5m").finer_than(interval("1d"))
    with pytest.raises(InvalidInterval):
        interval("1D")


def minute_bars(spark):
    ts = pd.date_range("2024-01-01 23:50", periods=25, freq="min")
    rows = [("A", t.to_pydatetime(), float(i), float(i) + 1, float(i) - 1, float(i) + 0.5, 1.0, 0.0) for i, t in enumerate(ts)]
    return source.in_memory(spark, rows)


def test_resample_labels_and_replay(spark):
    bars = minute_bars(spark)
    got = [r.asDict() for r in resample.resample(bars, interval("5m")).orderBy("ts").collect()]
    assert [str(r["ts"]) for r in got[:3]] == ["2024-01-01 23:55:00", "2024-01-01 23:59:59", "2024-01-02 00:05:00"]
    assert got[0]["open"] == 0 and got[0]["close"] == 4.5 and got[0]["volume"] == 5
    again = resample.replay(bars, interval("5m")).where("is_period_end").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in again] == [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got]


def test_align_never_looks_ahead(spark):
    bars = minute_bars(spark)
    context = resample.resample_to_start(bars, interval("5m"))
    got = resample.align(bars, context, interval("1m"), interval("5m"), ["close"]).orderBy("ts").collect()
    assert [r.ctx_close for r in got[:6]] == [None, None, None, None, 4.5, 4.5]
    assert all(r.ctx_close is None or r.ctx_close <= r.close for r in got)


def test_csv_with_faults(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("﻿Date,Open,High,Low,Close,Volume,OI\r\n2024-01-02,1,2,0.5,1.5,10,0\r\n2024-01-02,1,2,0.5,12abc,10\r\nbad,1,2,0.5,x,10,0\r\n2024-01-01,1,2\r\n2024-01-01,1,2,0.5,1.5,,\r\n".encode())
    bars, report = source.read_csv(spark, str(p), "A")
    rows = bars.collect()
    assert len(rows) == 4 and rows[1].close == 12 and rows[2].close == 0 and rows[2].ts.year == 1970 and rows[3].volume == 0
    r = report.first()
    assert (r.rows_seen, r.rows_loaded, r.rows_short, r.bad_numbers, r.bad_dates) == (5, 4, 1, 1, 1)
    assert (r.duplicate_ts, r.out_of_order) == (1, 1)
    inside, _ = source.read_csv(spark, str(p), "A", fromdate="2024-01-02", todate="2024-01-02")
    assert inside.count() == 2


def test_position_average_and_flip():
    p, out = Position(), []
    for size, price in ((10, 100), (5, 110), (-8, 120), (-10, 90), (3, 80)):
        p.update(size, price)
        out.append((p.size, round(p.price, 6)))
    assert out == [(10, 100), (15, 103.333333), (7, 103.333333), (-3, 90), (0, 0)]


def test_commissions():
    assert Commission("percent", 0.001)(10, 100) == 1
    assert Commission("per_share", 0.01, 1.0)(10, 100) == 1
    assert Commission("tiered", tiers=((1000, 0.01), (2000, 0.005)))(30, 100) == 10 + 5 + 5
    assert interactive()(100, 50) == 1 and interactive()(1, 1) == 0.01


def test_orders_fill_as_specified():
    b = Broker()
    b.send(Order(1), 1)
    b.process(2, 10, 12, 9, 11)
    assert b.fills[-1]["price"] == 10
    b.send(Order(1, "limit", price=9.5), 2)
    b.process(3, 11, 12, 10, 11)
    assert len(b.fills) == 1
    b.process(4, 9, 12, 8, 11)
    assert b.fills[-1]["price"] == 9
    b.send(Order(-2, "stop", stop=8), 4)
    b.process(5, 7, 9, 6, 8)
    assert b.fills[-1]["price"] == 7 and b.position.size == 0
    trade = b.trades[0]
    assert trade.closed_at == 5 and math.isclose(trade.pnl, (7 - 9.5) * 2)


def test_trailing_stop_and_expiry_and_margin():
    b = Broker(cash=100)
    b.send(Order(5), 1)
    b.process(2, 10, 10, 10, 10)
    b.send(Order(-5, "stop_trail", trail=2.0), 2)
    for t, (o, h, lo) in enumerate(((10, 12, 9.9), (12, 15, 12), (14, 14, 12.5)), 3):
        b.process(t, o, h, lo, o)
    assert b.fills[-1]["price"] == 13 and b.position.size == 0
    late = b.send(Order(1, "limit", price=1.0, valid_until=6), 6)
    b.process(7, 10, 10, 0.5, 10)
    assert late.status == "expired"
    rich = b.send(Order(1000), 7)
    b.process(8, 10, 10, 10, 10)
    assert rich.status == "margin"


def test_bracket_cancels_sibling_and_slippage():
    b = Broker(slippage=Slippage(percent=0.01))
    _, target, guard = b.bracket(1, 11, 9, 1)
    b.process(2, 10, 10.5, 9.9, 10)
    assert math.isclose(b.fills[0]["price"], 10.1)
    b.process(3, 10.5, 11.5, 10, 11)
    assert target.status == "completed" and guard.status == "canceled" and b.position.size == 0
    b = Broker(cash=1000, instrument=Instrument("future", 50.0, 0, 0, 400.0))
    b.send(Order(3), 1)
    b.process(2, 10, 10, 10, 10)
    assert b.position.size == 0


def price_bars(spark, closes):
    ts = pd.date_range("2024-01-01", periods=len(closes))
    return source.numbered(source.in_memory(spark, [("A", t.to_pydatetime(), float(x), float(x) + 1, float(x) - 1, float(x), 1.0, 0.0) for t, x in zip(ts, closes)]))


def test_backtest_and_sweep(spark):
    closes = [10, 10, 10, 11, 12, 13, 14, 13, 12, 11, 10, 9, 9, 10, 11, 12, 13]
    rules = simulate.Rules(long="num(c > mean(c, {n}))", exit="num(c < mean(c, {n}))", params={"n": 3})
    got = simulate.backtest(price_bars(spark, closes), rules, simulate.Account(cash=1000, sizer="fixed", sizer_args=(1,)))
    trades = got.where("kind = 'trade'").collect()
    assert [(t.price, t.t, t.pnl) for t in trades] == [(12.0, 9, 0.0)]
    grid = {"n": [2, 3, 4]}
    summary = simulate.summary(simulate.backtest(price_bars(spark, closes), rules, simulate.Account(cash=1000, sizer="fixed", sizer_args=(1,)), grid=grid), grid)
    assert sorted(r.n for r in summary.collect()) == [2, 3, 4]


def test_flagship_by_hand(spark):
    closes = [*range(40, 0, -1), *range(1, 60), *range(60, 20, -1)]
    got = simulate.sma_cross(price_bars(spark, closes), 5, 10).collect()
    assert len(got) == 1 and got[0].trades == 1 and got[0].gross > 0


def test_analytics(spark):
    values = [100.0, 110.0, 99.0, 120.0, 90.0]
    eq = spark.createDataFrame([("A", i + 1, v) for i, v in enumerate(values)], "symbol string, t long, value double")
    d = analytics.drawdowns(eq).orderBy("t").collect()
    assert [r.length for r in d] == [0, 0, 1, 0, 1] and math.isclose(d[-1].percent, 25)
    r = analytics.returns(eq).first()
    assert math.isclose(r.rtot, math.log(0.9)) and math.isclose(r.ravg, math.log(0.9) / 5)
    steps = np.diff(values) / values[:-1]
    assert math.isclose(analytics.sharpe(eq).first().sharpe, steps.mean() / steps.std() * 252**0.5)
    trades = spark.createDataFrame([("A", i, s, p, p - 0.5, 2) for i, (s, p) in enumerate([(1.0, 5.0), (1.0, 3.0), (-1.0, -4.0), (1.0, 0.5), (1.0, -2.0)])], "symbol string, seq long, size double, pnl double, pnlcomm double, bars long")
    t = analytics.trade_statistics(trades).first()
    assert (t.closed, t.won, t.lost, t.longest_won, t.longest_lost) == (5, 3, 2, 2, 1)
    x = analytics.extended(eq, trades).first()
    assert x.trades == 5 and math.isclose(x.win_rate, 0.4) and math.isclose(x.max_drawdown, 25)
    flat = spark.createDataFrame([("A", 1, 1.0)], "symbol string, t long, value double")
    assert analytics.sharpe(flat).first().sharpe == 0


def test_statistics():
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    assert stats.adf(noise)["p_value"] < 0.05 < stats.adf(walk)["p_value"]
    assert 0.3 < stats.hurst_rs(noise)["hurst"] < 0.75
    g = stats.garch(noise)
    assert g["alpha"] + g["beta"] < 1 and g["omega"] > 0
    two = np.concatenate([rng.normal(-3, 1, 200), rng.normal(3, 1, 200)])
    h = stats.hmm2(two)
    assert abs(h["mean_0"] + 3) < 0.5 and abs(h["mean_1"] - 3) < 0.5 and h["stay_0"] > 0.9
    assert math.isnan(stats.adf(np.ones(50))["stat"]) and math.isnan(stats.hmm2(np.ones(50))["mean_0"])


def test_gate(spark):
    rows = spark.createDataFrame([("A", i, i / 100, int(i > 50)) for i in range(100)], "symbol string, t long, score double, label int").withColumn("outcome", F.col("label") - F.lit(0.5))
    points = gate.isotonic(rows, 20)
    assert [y for _, y in points] == sorted(y for _, y in points)
    led = gate.ledger(gate.size(gate.calibrate(rows, points), "gate", 0.5)).first()
    assert led.taken_outcome > led.rejected_outcome
    a, _ = gate.platt(np.array([0.0, 0.2, 0.8, 1.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert a > 0
    assert gate.preflight('{"features_hash": 1}', {}, {}) == ["the model was made for other features"]


def test_live_limits():
    limits, now = Limits(max_position=2, size=5, max_drawdown=10, fast=1, slow=3), Live(cash=1000, peak=1000)
    sizes = [now.tick(p, i, limits) for i, p in enumerate((100, 100, 100, 110, 120, 10, 300))]
    assert now.killed and now.position == 0 and any(why == "kill" for _, why in sizes)
    assert max(abs(s) for s, _ in sizes) <= 2


def test_live_stream(spark, tmp_path):
    from barweave.streaming import live

    rows = [("A", (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i)).to_pydatetime(), float(p)) for i, p in enumerate([*range(30, 5, -1), *range(5, 40)])]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double").write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(str(tmp_path / "in"))
    q = live.live(ticks, Limits(max_drawdown=99)).writeStream.format("memory").queryName("fills").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(15)
    q.stop()
    assert spark.sql("select * from fills where size > 0").count() >= 1


def test_quality(spark):
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    bars = source.in_memory(spark, [("A", t, 1.0, 0.5, 2.0, float("nan"), 1.0, 0.0), ("A", t, -1.0, 1.0, 1.0, 1.0, None, 0.0)])
    q = source.quality(bars).first()
    assert (q.n_rows, q.duplicate_ts, q.not_finite, q.negative_prices, q.crossed) == (2, 1, 2, 1, 1)


def test_days_bucket(spark):
    bars = price_bars(spark, range(1, 11))
    assert resample.resample(bars, Interval("days", 3)).count() == 4


def test_configured_run(spark, tmp_path):
    import json

    from barweave.plans import config

    closes = [10, 10, 10, 11, 12, 13, 14, 13, 12, 11, 10, 9, 9, 10, 11, 12, 13]
    price_bars(spark, closes).drop("t").write.parquet(str(tmp_path / "bars"))
    text = json.dumps({"path": str(tmp_path / "bars"), "interval": "1d", "from": "2024-01-01", "cash": 1000, "sizer": "fixed", "sizer_args": [1], "rules": {"long": "num(c > mean(c, 3))", "exit": "num(c < mean(c, 3))"}})
    row = config.run(spark, text).first()
    result = json.loads(row.result)
    assert len(result["equity"]) == len(closes) and result["trades"][0]["t"] == 9 and result["metrics"]["trades"] == 1
    for bad in ("nope", '{"path": "x"}'):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    with pytest.raises(InvalidInterval):
        config.parse('{"path": "x", "rules": {}, "interval": "1D"}')


def test_regimes_and_sessions(spark):
    from barweave.operators import signals

    bars = price_bars(spark, [10 + i % 3 for i in range(60)])
    names = {r.regime for r in signals.regimes(bars, high=9).collect()}
    assert names <= {None, "Trending", "RangeBound"} and None in names
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-05')) as day")
    rows = spark.sql("select timestamp'2024-01-02 10:00:00' as ts union all select timestamp'2024-01-02 17:00:00'")
    got = {str(r.ts): r.is_open for r in signals.with_session(rows, signals.sessions(days)).collect()}
    assert got == {"2024-01-02 10:00:00": True, "2024-01-02 17:00:00": False}


def test_increments(spark, tmp_path):
    from barweave.streaming import live

    spark.range(7).write.parquet(str(tmp_path / "in"))
    q = live.increments(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out/rows/*")).count() == 7
    assert spark.read.json(str(tmp_path / "out/increments/*")).selectExpr("sum(n)").first()[0] == 7


def test_instruments_sell_without_margin_and_bonds_count_in_hundredths():
    bond = INSTRUMENTS["bond"]
    b = Broker(cash=2000.0, instrument=bond)
    order = Order(1.0)
    b._execute(order, 100.0, 1)
    assert order.status == "completed" and b.cash == 1000.0 and b.value(101.0) == 2010.0
    b.cash = 0.0
    sell = Order(-1.0)
    b._execute(sell, 102.0, 2)
    assert sell.status == "completed" and b.cash == 1020.0 and b.trades[-1].pnl == 20.0
    late = Order(200.0)
    b._execute(late, 100.0, 3)
    assert late.status == "margin"


def test_error_band_and_trailing_level():
    """The first rows worked out by hand: a 12-bar band's forecast of its second value, and a level that starts at 50."""
    x = np.array([10.0, 11.0, 11.0])
    got = kernels.hwc({"close": x}, x)
    level = 10 + 2 / 13
    trend = level / 13
    assert np.allclose(got["mid"][:2], [10, level + trend]) and got["upper"][0] == got["lower"][0] == 10
    up = kernels.qqe({"close": x}, x, period=3, factor=1.0, smooth=1)[""]
    assert np.isnan(up[0]) and np.allclose(up[1:], [50.0, 37.5])
