"""The series language: three back ends give the same, warm-up is exact, symbols don't touch."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barweave.functions import series
from barweave.operators import indicators, patterns
from barweave.plans import factors

FORMULAS = {
    "sma": "mean(c, 5)", "std": "std(c, 7)", "rank": "rk(c)", "tsr": "tsr(v, 4)", "arg": "argmax(h, 6)", "old": "argmin_old(l, 6)", "corr": "corr(rk(h), v, 5)", "dl": "dlin(c, 5)", "slope": "linslope(c, 9)",
    "w": "wdot(c, [0.25, 0.75])", "q": "quantile(c, 6, 0.3)", "mad": "mad(c, 5)", "prod": "prod(1 + ret, 3)", "ema": "ema(c, 4)", "rsi": "100 - 100 / (1 + wilder(up(c), 5) / wilder(down(c), 5))",
    "nest": "ema(mean(c, 3), 4) - lag(ema(c, 2), 1)", "run": "runlen(c > o)", "last": "lastnn_before(c if c > o else null)", "div": "c / (v - v)", "cond": "1 if c > o and h > c else (-1 if c < o else 0)",
}


def bars(n=60, symbols=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
        spread = rng.uniform(0.1, 2, n).round(2)
        start = close + rng.normal(0, 0.5, n).round(2)
        out.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n), "t": np.arange(1, n + 1), "open": start, "high": np.maximum(start, close) + spread, "low": np.minimum(start, close) - spread, "close": close, "volume": rng.integers(10, 99, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


def in_sql(formulas, df):
    con = duckdb.connect()
    con.register("bars", df)
    return con.execute(series.to_sql(formulas, "SELECT * FROM bars", rounding=False)).df().sort_values(["symbol", "t"]).reset_index(drop=True)


def in_numpy(formulas, df):
    parts = []
    for _, g in df.groupby("symbol"):
        cols = {c: g[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
        parts.append(pd.DataFrame(series.evaluate(dict(formulas), cols)))
    return pd.concat(parts, ignore_index=True)


def same(a, b, names, tolerance=1e-8):
    for k in names:
        np.testing.assert_allclose(a[k].to_numpy(float), b[k].to_numpy(float), rtol=tolerance, atol=tolerance, err_msg=k)


def test_three_back_ends(spark):
    df = bars()
    sql, own = in_sql(FORMULAS, df), in_numpy(FORMULAS, df)
    same(sql, own, FORMULAS)
    plain = {k: v for k, v in FORMULAS.items() if not series.recursive(series.parse(v))}
    got = series.with_series(spark.createDataFrame(df), plain).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    same(got, sql, plain)
    back = {k: v for k, v in FORMULAS.items() if k not in plain}
    got = series.with_series(spark.createDataFrame(df), back).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    same(got, sql, back)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.sampled_from(["mean", "std", "tsmax", "sum", "tsr", "argmin"]))
def test_warm_up_is_positional(n, k, f):
    df = bars(n, ("A",))
    got = in_numpy({"x": f"{f}(c, {k})"}, df)["x"]
    assert got.isna().sum() == min(n, k - 1)


def test_missing_values_gate_windows():
    x = np.array([1.0, 2, np.nan, 4, 5, 6])
    cols = {c: x for c in ("open", "high", "low", "close", "volume")}
    got = series.evaluate({"m": "mean(c, 2)", "r": "rk(c)", "d": "log(c - 1)"}, cols)
    np.testing.assert_allclose(got["m"], [np.nan, 1.5, np.nan, np.nan, 4.5, 5.5])
    assert got["r"][2] == 0.0
    assert np.isnan(got["d"][0])


def test_window_plans_have_one_shuffle_and_no_python(spark):
    df = spark.createDataFrame(bars())
    plan = series.with_series(df, {"a": "corr(rk(h), rk(v), 5)", "b": "tsmax(mean(c, 3), 4)"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


def test_faulty_formulas():
    for text in ("nope(c, 3)", "mean(c, n)", "log(c, 2)"):
        with pytest.raises((series.FormulaError, TypeError)):
            series.parse(text)


def test_every_indicator_has_values():
    df = bars(400, ("A",))
    cols = {c: df[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
    got = indicators.evaluate(list(indicators.REGISTRY), cols)
    silent = [k for k, v in got.items() if np.isnan(v).all()]
    assert not [x for x in silent if x not in ("zigzag",)], silent


def test_known_indicator_values():
    x = np.arange(1.0, 41.0)
    cols = {"open": x, "high": x + 1, "low": x - 1, "close": x, "volume": np.ones(40)}
    got = indicators.evaluate([("SMA", {"period": 5}), ("EMA", {"period": 5}), ("RSI", {"period": 5}), ("ATR", {"period": 5}), ("Momentum", {"period": 3}), ("WMA", {"period": 3}), ("AroonUp", {"period": 5})], cols)
    assert got["sma"][4] == 3 and np.isnan(got["sma"][3])
    assert got["ema"][4] == 3 and abs(got["ema"][5] - 4) < 1e-12
    assert got["rsi"][5] == 100 and np.isnan(got["rsi"][4])
    assert got["atr"][5] == 2 and np.isnan(got["atr"][4])
    assert got["momentum"][3] == 3
    assert abs(got["wma"][2] - (1 + 4 + 9) / 6) < 1e-12
    assert got["aroonup"][5] == 100


def test_registry_aliases_and_min_bars():
    assert indicators.lookup("BBANDS").name == "BollingerBands"
    assert indicators.lookup("macd").min_bars("signal") == 34
    assert indicators.lookup("SMA").min_bars(period=10) == 10
    with pytest.raises(KeyError):
        indicators.lookup("nothing")
    with pytest.raises(TypeError):
        indicators.lookup("SMA").formulas(nope=3)


def test_indicator_families_agree_with_sql():
    df = bars(120)
    wanted = [i.name for i in indicators.REGISTRY.values() if not i.kernel and i.family in ("bands", "averages", "trend", "momentum", "statistics", "volume")]
    formulas = indicators.formulas(wanted)
    same(in_sql(formulas, df), in_numpy(formulas, df), formulas, 1e-6)


def test_candles():
    def one(rows):
        cols = {k: np.array([r[i] for r in rows], float) for i, k in enumerate(("open", "high", "low", "close"))} | {"volume": np.ones(len(rows))}
        return {k: v[-1] for k, v in series.evaluate(patterns.formulas(), cols).items() if v[-1]}

    assert one([(10, 11, 9, 10.02)])["cdldoji"] == 100
    assert one([(12, 12.2, 9.8, 10), (9.9, 12.5, 9.5, 12.3)])["cdlengulfing"] == 100
    assert one([(10, 12.2, 9.8, 12), (12.3, 12.5, 9.5, 9.7)])["cdlengulfing"] == -100
    assert one([(10, 11.2, 9.9, 11), (10.5, 12.2, 10.4, 12), (11.5, 13.2, 11.4, 13)])["cdlthreewhitesoldiers"] == 100
    assert "cdlhammer" in one([(10, 10.21, 7, 10.2)])


def test_factor_libraries_parse_and_gate():
    assert [len(factors.factors(x)) for x in ("alpha101", "alpha191", "jkp")] == [101, 191, 25]
    df = bars(300, ("A",))
    some = factors.factors("alpha101", ["001", "041", "054", "101"]) | factors.factors("alpha191", ["003", "024", "063"])
    own = in_numpy(some, df)
    same(in_sql(some, df), own, some)
    least = factors.min_bars("alpha101") | factors.min_bars("alpha191")
    for k in some:
        assert own[k][: least[k] - 1].isna().all()
