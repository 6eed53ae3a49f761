"""The indicator registry and how indicators are added to bars.

Most indicators are formulas of the series language; those without feedback run as window expressions, the rest
and the kernels of :mod:`barweave.operators.kernels` run together in one grouped map per symbol. Warm-up rows
are NULL. In formulas ``{name}`` is a parameter (or an expression of parameters) and ``{s}`` the source series.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions import series
from . import kernels


@dataclass(frozen=True)
class Indicator:
    name: str
    family: str
    aliases: tuple[str, ...]
    params: dict
    outputs: dict[str, str]  # output name ("" for the main line) to formula
    kernel: str | None = None

    def formulas(self, **given) -> dict[str, str]:
        p = self.bind(given)
        return {out: fill(text, p) for out, text in self.outputs.items()}

    def bind(self, given: dict) -> dict:
        if unknown := set(given) - set(self.params) - {"s"}:
            raise TypeError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        p = self.params | given
        return {k: max(v, 1) if isinstance(v, int) and not isinstance(v, bool) and k.startswith("period") else v for k, v in p.items()}

    def min_bars(self, output: str = "", **given) -> int:
        """Rows until the output is first there, measured on a series without gaps."""
        n = 1024
        i = np.arange(n, dtype=float)
        close = 100 + i * 0.1 + 5 * np.sin(i * 0.7) + 3 * np.cos(i * 1.9)
        cols = {"open": close - np.sin(i), "high": close + 2 + np.cos(i) ** 2, "low": close - 2 - np.sin(i) ** 2, "close": close, "volume": 1000 + 100 * np.sin(i * 0.3)}
        got = evaluate([(self.name, given)], cols)
        known = np.flatnonzero(~np.isnan(got[column(self.name, output or next(iter(self.outputs)))]))
        return int(known[0]) + 1 if len(known) else n


def _text(x) -> str:
    return x if isinstance(x, str) else repr(list(x)) if isinstance(x, (list, tuple, np.ndarray)) else repr(x)


def column(name: str, output: str = "") -> str:
    return f"{name.lower()}_{output}" if output else name.lower()


REGISTRY: dict[str, Indicator] = {}
ALIASES: dict[str, str] = {}


def register(name: str, family: str, aliases: str = "", outputs: dict[str, str] | str = "", kernel: str | None = None, **params) -> None:
    outs = {"": outputs} if isinstance(outputs, str) else outputs
    if kernel is None and any("{s}" in x or "(s," in x for x in outs.values()) or kernel in kernels.SOURCED:
        params = {"s": "c"} | params
    REGISTRY[name] = Indicator(name, family, tuple(aliases.split()), params, outs, kernel)
    ALIASES[name.lower()] = name
    for a in aliases.split():
        ALIASES[a.lower()] = name


def lookup(name: str) -> Indicator:
    if name.lower() not in ALIASES:
        raise KeyError(f"no indicator {name!r}")
    return REGISTRY[ALIASES[name.lower()]]


Ask = tuple[str, dict]


def _asked(wanted: list[Ask | str]) -> list[tuple[Indicator, dict]]:
    return [(lookup(w), {}) if isinstance(w, str) else (lookup(w[0]), w[1]) for w in wanted]


def formulas(wanted: list[Ask | str]) -> dict[str, str]:
    """Column name to formula, for indicators that are formulas."""
    return {column(ind.name, out): f for ind, given in _asked(wanted) if not ind.kernel for out, f in ind.formulas(**given).items()}


def evaluate(wanted: list[Ask | str], cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All outputs over one symbol's ordered columns."""
    got = series.evaluate(formulas(wanted), cols) if formulas(wanted) else {}
    for ind, given in _asked(wanted):
        if ind.kernel:
            p = ind.bind(given)
            with np.errstate(all="ignore"):
                if ind.kernel in kernels.SOURCED:
                    source = series.evaluate({"x": p.pop("s")}, cols)["x"]
                    out = kernels.SOURCED[ind.kernel](cols, source, **p)
                else:
                    out = kernels.BARS[ind.kernel](cols, **p)
            got |= {column(ind.name, k): v for k, v in out.items()}
    return got


def compute(bars: DataFrame, wanted: list[Ask | str], keep: tuple[str, ...] = ("symbol", "ts", "t")) -> DataFrame:
    """``keep`` and every output of the indicators, for bars numbered by t."""
    if not any(ind.kernel for ind, _ in _asked(wanted)):
        return series.with_series(bars, formulas(wanted), keep)
    import pyarrow as pa

    names = [column(ind.name, out) for ind, _ in _asked(wanted) for out in ind.outputs]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        cols = {c: table.column(c).cast("float64").to_numpy().astype(float) for c in ("open", "high", "low", "close", "volume")}
        got = evaluate(wanted, cols)
        return pa.table({k: table.column(k) for k in keep} | {n: pa.array(got[n], pa.float64(), mask=np.isnan(got[n])) for n in names})

    kinds = dict(bars.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"`{n}` double" for n in names)])
    return bars.groupBy("symbol").applyInArrow(one, schema)


def family(name: str) -> list[str]:
    return [i.name for i in REGISTRY.values() if i.family == name]


# --- weights and generated formulas -----------------------------------------------------------------------


def _normal(w: list[float]) -> list[float]:
    return [x / sum(w) for x in w]


def fibonacci(n: int) -> list[float]:
    w = [1.0, 1.0]
    while len(w) < n:
        w.append(w[-1] + w[-2])
    return _normal(w[:n])


def pascal(n: int) -> list[float]:
    return _normal([float(math.comb(n - 1, i)) for i in range(n)])


def triangle(n: int) -> list[float]:
    return _normal([float(min(i + 1, n - i)) for i in range(n)])


def sine(n: int) -> list[float]:
    return _normal([math.sin(math.pi * (i + 1) / (n + 1)) for i in range(n)])


def gauss(n: int, offset: float, sigma: float) -> list[float]:
    m, s = offset * (n - 1), n / sigma
    return _normal([math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)])


def wave(n: int, of: Callable[[float], float]) -> list[float]:
    return [of(2 * math.pi * i / n) for i in range(n)]


def ulcer(x: str, n: int) -> str:
    """Root of the mean squared percent fall from the highest value so far inside the window."""
    terms = []
    for k in range(n):
        now, best = f"lag({x}, {n - 1 - k})", f"lag(tsmax({x}, {k + 1}), {n - 1 - k})"
        terms.append(f"(0 if {best} == 0 else ({now} / {best} - 1) * 100) ** 2")
    return f"sqrt(({' + '.join(terms)}) / {n})"


def spearman(x: str, n: int) -> str:
    """Rank correlation with time; of equal values the later ranks higher."""
    total = " + ".join(f"({i} if lag({x}, {n - 1 - j}) <= lag({x}, {n - 1 - i}) else {j})" for i in range(n) for j in range(i))
    return f"(({total}) - {n * ((n - 1) / 2) ** 2}) / {n * (n * n - 1) / 12}"


def _register_all() -> None:
    r = register
    f = "bands"
    r("Aberration", f, "ABERRATION", {"mid": "mean({s}, {period})", "upper": "mean({s}, {period}) + {mult} * mad({s}, {period})", "lower": "mean({s}, {period}) - {mult} * mad({s}, {period})", "signal": "2 * {mult} * mad({s}, {period})"}, period=5, mult=2.0)
    k = "(0 if h + l == 0 else {mult} * (h - l) / (h + l))"
    r("AccelerationBands", f, "ACCBANDS", {"mid": "mean(c, {period})", "upper": f"mean(h * (1 + {k}), {{period}})", "lower": f"mean(l * (1 - {k}), {{period}})"}, period=20, mult=4.0)
    bb = {"mid": "mean({s}, {period})", "top": "mean({s}, {period}) + {devfactor} * std({s}, {period})", "bottom": "mean({s}, {period}) - {devfactor} * std({s}, {period})"}
    r("BollingerBands", f, "BBANDS Bollinger", bb, period=20, devfactor=2.0)
    r("BollingerBandsPct", f, "BBandsPct", bb | {"pctb": f"({{s}} - ({bb['bottom']})) / (({bb['top']}) - ({bb['bottom']}))"}, period=20, devfactor=2.0)
    r("ChandeKrollStop", f, "CKSP", {"stop_long": "gate({period + q + 1}, tsmax(tsmax(h, {period}) - {mult} * mean(tr0(), {period}), {q}))", "stop_short": "gate({period + q + 1}, tsmin(tsmin(l, {period}) + {mult} * mean(tr0(), {period}), {q}))"}, period=10, q=9, mult=1.0)
    r("Envelope", f, "", {"src": "{s}", "top": "{s} * (1 + {perc} / 100)", "bot": "{s} * (1 - {perc} / 100)"}, perc=2.5)
    averages = {
        "SMA": "mean({s}, {period})", "EMA": "ema({s}, {period})", "SMMA": "wilder({s}, {period})", "WMA": "wma({s}, {period})", "HMA": "wma(2 * wma({s}, {max(period // 2, 1)}) - wma({s}, {period}), {int(math.sqrt(period))})",
        "DEMA": "2 * ema({s}, {period}) - ema(ema({s}, {period}), {period})", "TEMA": "3 * ema({s}, {period}) - 3 * ema(ema({s}, {period}), {period}) + ema(ema(ema({s}, {period}), {period}), {period})",
        "ZLEMA": "ema(2 * {s} - lag({s}, {(period - 1) // 2}), {period})",
    }
    kama = "lin(1 - SC, SC * {s}, gate({period + 1}, mean({s}, {period})))".replace("SC", "((0 if sum(abs(delta({s})), {period}) == 0 else abs({s} - lag({s}, {period})) / sum(abs(delta({s})), {period})) * {2 / (fast + 1) - 2 / (slow + 1)} + {2 / (slow + 1)}) ** 2")
    env = lambda ma: {"mid": ma, "top": f"({ma}) * (1 + {{perc}} / 100)", "bot": f"({ma}) * (1 - {{perc}} / 100)"}
    r("MovingAverageEnvelope", f, "SMAEnvelope", env(averages["SMA"]), period=30, perc=2.5)
    for ma, text in averages.items():
        if ma != "SMA":
            r(f"{ma}Envelope", f, "", env(text), period=30, perc=2.5)
    r("KAMAEnvelope", f, "AdaptiveMovingAverageEnvelope MovingAverageAdaptiveEnvelope", env(kama), period=30, fast=2, slow=30, perc=2.5)
    band = {"mid": "", "top": "", "bot": ""}
    r("DMAEnvelope", f, "DicksonMAEnvelope DicksonMovingAverageEnvelope", band, kernel="dma_envelope", period=20, gainlimit=50, hperiod=7, perc=2.5)
    r("ZLIndicatorEnvelope", f, "ZeroLagIndicatorEnvelope", band, kernel="zero_lag_envelope", period=20, gainlimit=50, perc=2.5)
    mid = lambda n: f"((tsmax(h, {{{n}}}) + tsmin(l, {{{n}}})) / 2)"
    r("Ichimoku", f, "", {"tenkan_sen": mid("tenkan"), "kijun_sen": mid("kijun"), "senkou_span_a": f"lag(({mid('tenkan')} + {mid('kijun')}) / 2, {{senkou_lead}})", "senkou_span_b": f"lag({mid('senkou')}, {{senkou_lead}})", "chikou_span": "lead(c, {chikou})"}, tenkan=9, kijun=26, senkou=52, senkou_lead=26, chikou=26)
    r("Squeeze", f, "TTMSqueeze", {"momentum": "linend(c - (h + l) / 4, {period}) - mean(c, {period}) / 2", "squeeze_on": "num({bb_mult} * std(c, {period}) < {kc_mult} * mean(tr0(), {period}))"}, period=20, bb_mult=2.0, kc_mult=1.5)
    rms = "sqrt(max(var({s}, {period}) - linslope({s}, {period}) ** 2 * ({period} * {period} - 1) / 12, 0))"
    r("TosStdevAll", f, "TOS_STDEVALL", {"linreg": "linend({s}, {period})", **{f"{side}{m}": f"linend({{s}}, {{period}}) {sign} {m} * {rms}" for m in (1, 2) for side, sign in (("upper", "+"), ("lower", "-"))}}, period=30)
    r("SuperTrend", f, "", {"": "", "upper": "", "lower": ""}, kernel="supertrend", period=10, multiplier=3.0)
    r("ChandelierExit", f, "", {"long_exit": "tsmax(h, {period}) - {multiplier} * atr({period})", "short_exit": "tsmin(l, {period}) + {multiplier} * atr({period})"}, period=22, multiplier=3.0)
    r("DonchianChannels", f, "Donchian", {"mid": "(tsmax(h, {period}) + tsmin(l, {period})) / 2", "top": "tsmax(h, {period})", "bottom": "tsmin(l, {period})"}, period=20)
    r("KeltnerChannel", f, "Keltner", {"mid": "nz(gate({period + 1}, ema(c, {period})), null)", "top": "ema(c, {period}) + {devfactor} * atr({period})", "bottom": "ema(c, {period}) - {devfactor} * atr({period})"}, period=20, devfactor=2.0)

    f = "rolling"
    r("Accum", f, "CumSum CumulativeSum", "cumsum({s}) + {seed}", seed=0.0)
    r("FindFirstIndexHighest", f, "", "highday({s}, {period})", period=20)
    r("FindLastIndexHighest", f, "", "{period} - 1 - argmax_old({s}, {period})", period=20)
    r("FindFirstIndexLowest", f, "", "lowday({s}, {period})", period=20)
    r("FindLastIndexLowest", f, "", "{period} - 1 - argmin_old({s}, {period})", period=20)
    r("Highest", f, "MaxN", "tsmax({s}, {period})", period=14)
    r("Lowest", f, "MinN", "tsmin({s}, {period})", period=14)
    r("IdxMax", f, "", "highday({s}, {period})", period=14)
    r("IdxMin", f, "", "lowday({s}, {period})", period=14)
    r("ImxD", f, "", "(highday(h, {period}) - lowday(l, {period})) / {period}", period=14)
    r("AnyN", f, "", "tsmax(num({s} != 0), {period})", period=5)
    r("AllN", f, "", "tsmin(num({s} != 0), {period})", period=5)
    r("MidPoint", f, "", "(tsmax({s}, {period}) + tsmin({s}, {period})) / 2", period=14)
    r("MidPrice", f, "", "(tsmax(h, {period}) + tsmin(l, {period})) / 2", period=14)
    r("MinMax", f, "", {"max": "tsmax({s}, {period})", "min": "tsmin({s}, {period})"}, period=14)
    r("MaxIndex", f, "", "highday({s}, {period})", period=14)
    r("MinIndex", f, "", "lowday({s}, {period})", period=14)
    r("MinMaxIndex", f, "", {"max_index": "highday({s}, {period})", "min_index": "lowday({s}, {period})"}, period=14)
    r("SumN", f, "Sum", "sum({s}, {period})", period=14)

    f = "averages"
    cmo = "(0 if sum(up({s}), {m}) + sum(down({s}), {m}) == 0 else abs(sum(up({s}), {m}) - sum(down({s}), {m})) / (sum(up({s}), {m}) + sum(down({s}), {m})))".replace("{m}", "{momentum_period}")
    r("VIDYA", f, "", f"lin(1 - {{2 / (period + 1)}} * {cmo}, {{2 / (period + 1)}} * {cmo} * {{s}}, gate({{momentum_period + 1}}, {{s}}))", period=14, momentum_period=9)
    half = "{period // 2}"
    n1, n2, n3 = (f"(tsmax(lag({{s}}, {half}), {half}) - tsmin(lag({{s}}, {half}), {half})) / {half}", f"(tsmax({{s}}, {half}) - tsmin({{s}}, {half})) / {half}", "(tsmax({s}, {period}) - tsmin({s}, {period})) / {period}")
    frama = f"min(max(nz(exp(-4.6 * ((log({n1} + {n2}) - log({n3})) / {{math.log(2.0)}} - 1)) if {n1} > 0 and {n2} > 0 and {n3} > 0 else {{2 / (slow + 1)}}, {{2 / (slow + 1)}}), {{2 / (slow + 1)}}), {{2 / (fast + 1)}})"
    r("FRAMA", f, "", f"lin(1 - {frama}, {frama} * {{s}}, gate({{period}}, {{s}}))", period=16, fast=4, slow=300)
    for name, alias, call, params in (("ALMA", "ArnaudLegouxMA", "gauss(period, offset, sigma)", {"period": 9, "offset": 0.85, "sigma": 6.0}), ("FWMA", "FibonacciWeightedMA", "fibonacci(period)", {"period": 20}), ("PWMA", "PascalWeightedMA", "pascal(period)", {"period": 10}), ("SINWMA", "SineWeightedMA", "sine(period)", {"period": 14}), ("SWMA", "SymmetricWeightedMA", "triangle(period)", {"period": 10}), ("TRIMA", "TriangularMovingAverage", "triangle(period)", {"period": 20})):
        r(name, f, alias, "wdot({s}, {" + call + "})", **params)
    r("Average", f, "ArithmeticMean Mean", "mean({s}, {period})", period=30)
    names = {"SMA": "MA MovingAverageSimple", "EMA": "MovingAverageExponential", "SMMA": "SmoothedMovingAverage", "WMA": "WeightedMovingAverage", "HMA": "HullMovingAverage", "DEMA": "DoubleExponentialMovingAverage MovingAverageDoubleExponential", "TEMA": "TripleExponentialMovingAverage MovingAverageTripleExponential", "ZLEMA": "ZeroLagExponentialMovingAverage ZeroLagEma"}
    for ma, text in averages.items():
        r(ma, f, names[ma], text, period=30)
    r("ExponentialSmoothing", f, "ExpSmoothing", "lin(1 - {alpha}, {alpha} * {s}, mean({s}, {period}))", period=10, alpha=0.2)
    r("ExponentialSmoothingDynamic", f, "ExpSmoothingDynamic", "lin(1 - ({alpha}), ({alpha}) * {s}, mean({s}, {period}))", period=10, alpha="min(abs(ret), 1)")
    r("HT_Trendline", f, "HilbertTrendline", "", kernel="ht_trendline")
    r("MAMA", f, "MESAAdaptiveMovingAverage", {"mama": "", "fama": ""}, kernel="mama", fast_limit=0.5, slow_limit=0.05)
    r("HWC", f, "HoltWintersChannel", {"mid": "", "upper": "", "lower": ""}, kernel="hwc", period=12, mult=1.0)
    r("JMA", f, "JurikMA", "", kernel="jma", period=7, phase=0.0, power=2.0)
    r("AdaptiveMovingAverage", f, "KAMA MovingAverageAdaptive", kama, period=30, fast=2, slow=30)
    l0 = "lin({gamma}, (1 - {gamma}) * {s}, (1 - {gamma}) * {s})"
    pole = lambda x: f"lin({{gamma}}, nz(lag({x}, 1), 0) - {{gamma}} * {x}, nz(lag({x}, 1), 0) - {{gamma}} * {x})"
    l1 = pole(l0)
    l2 = pole(l1)
    r("LaguerreFilter", f, "LAGF", f"({l0} + 2 * {l1} + 2 * {l2} + {pole(l2)}) / 6", gamma=0.5)
    r("MAVP", f, "", " + ".join(f"(mean({{s}}, {n}) if {n} == floor(min(max({{periods}}, 2), 10)) else 0)" for n in range(2, 11)), periods="2 + mod(t, 9)")
    r("McGinleyDynamic", f, "MCGD", "", kernel="mcgd", period=10, k=0.6)
    e = ["{s}"]
    for _ in range(6):
        e.append(f"ema({e[-1]}, {{period}})")
    r("T3MovingAverage", f, "T3", f"{{-vfactor ** 3}} * {e[6]} + {{3 * vfactor ** 2 + 3 * vfactor ** 3}} * {e[5]} + {{-6 * vfactor ** 2 - 3 * vfactor - 3 * vfactor ** 3}} * {e[4]} + {{1 + 3 * vfactor + vfactor ** 3 + 3 * vfactor ** 2}} * {e[3]}", period=5, vfactor=0.7)
    r("SSF", f, "SuperSmootherFilter", "", kernel="ssf", period=10)
    r("VWMA", f, "VolumeWeightedMA", "nz(sum({s} * v, {period}) / sum(v, {period}), gate({period}, {s}))", period=20)
    r("WeightedAverage", f, "AverageWeighted", "{coef} * wdot({s}, {weights})", weights=[float(i + 1) for i in range(10)], coef=1.0)
    r("DicksonMovingAverage", f, "DMA DicksonMA", "", kernel="dma", period=20, gainlimit=50, hperiod=7)
    r("ZeroLagIndicator", f, "ZLIndicator ZLInd EC ErrorCorrecting", "", kernel="zero_lag", period=20, gainlimit=50)

    f = "volume"
    clv = "(0 if h == l else ((c - l) - (h - c)) / (h - l))"
    ad = f"cumsum({clv} * v)"
    obv = "cumsum(sign(delta(c)) * v)"
    r("ADOSC", f, "ChaikinADOscillator", f"ema0({ad}, {{fast_period}}) - ema0({ad}, {{slow_period}})", fast_period=3, slow_period=10)
    flow = f"nz({obv}, 0)"
    r("AOBV", f, "ArcherOBV", {"obv": flow, "fast": f"ema0({flow}, {{fast_period}})", "slow": f"ema0({flow}, {{slow_period}})"}, fast_period=4, slow_period=12)
    r("EFI", f, "ElderForceIndex", "nz(ema0(delta(c) * v, {period}), 0)", period=13)
    index = lambda cmp: f"lin(1 + (ret if v {cmp} lag(v, 1) else 0), 0 * c, 1000 if t == 1 else null)"
    r("NVI", f, "NegativeVolumeIndex", index("<"))
    r("PVI", f, "PositiveVolumeIndex", index(">"))
    r("OBV", f, "", "cumsum(v if t == 1 else sign(delta(c)) * v)")
    r("PriceVolume", f, "PVOL", "c * v")
    r("PVR", f, "PriceVolumeRank", "(1 if delta(v) >= 0 else 2) if delta(c) >= 0 else (-2 if delta(v) >= 0 else -1)")
    r("AccumulationDistribution", f, "AD AccDist", ad)
    r("PriceVolumeTrend", f, "PVT", "gate(2, cumsum(nz(v * ret, 0)))")
    r("VolumeWeightedAveragePrice", f, "VWAP", "cumsum(vwap * v) / cumsum(v)")
    r("ChaikinMoneyFlow", f, "CMF", f"nz(sum({clv} * v, {{period}}) / sum(v, {{period}}), gate({{period}}, 0))", period=20)
    pos, neg = ("sum(vwap * v if vwap %s lag(vwap, 1) else 0, {period})" % x for x in "><")
    r("MoneyFlowIndex", f, "MFI", f"100 if {neg} == 0 else 100 - 100 / (1 + {pos} / {neg})", period=14)
    r("EaseOfMovement", f, "EMV", "mean(nz(delta((h + l) / 2) * (h - l) / (v / {divisor}), 0 * lag(c, 1)), {period})", period=14, divisor=10000.0)
    r("KlingerOscillator", f, "Klinger", {"kvo": "", "signal": ""}, kernel="klinger", fast=34, slow=55, signal=13)
    r("VolumeProfile", f, "VP", "nz(sum((0.5 if h == l else (c - l) / (h - l)) * v, {period}) / sum(v, {period}), gate({period}, 0.5))", period=10)
    r("WilliamsAD", f, "WAD", "cumsum((c - min(l, lag(c, 1))) if delta(c) > 0 else ((c - max(h, lag(c, 1))) if delta(c) < 0 else 0))")

    f = "features"
    r("Alpha158VwapRatio", f, "", "vwap / lag(c, 1)")
    r("CntD", f, "", "mean(num(delta({s}) > 0), {period}) - mean(num(delta({s}) < 0), {period})", period=20)
    r("CntN", f, "", "mean(num(delta({s}) < 0), {period})", period=20)
    r("CntP", f, "", "mean(num(delta({s}) > 0), {period})", period=20)
    r("SumNegReturn", f, "", "sum(min(delta({s}), 0), {period})", period=20)
    r("SumD", f, "", "sum(abs(delta({s})), {period})", period=20)
    r("SumP", f, "", "sum(max(delta({s}), 0), {period})", period=20)
    r("VSumP", f, "", "sum(v if delta(c) > 0 else 0, {period})", period=20)
    r("VSumN", f, "", "sum(v if delta(c) < 0 else 0, {period})", period=20)
    r("VSumD", f, "", "sum(v if delta(c) > 0 else 0, {period}) - sum(v if delta(c) < 0 else 0, {period})", period=20)
    r("WVMA", f, "", "std(abs(ret) * v, {period})", period=20)

    f = "trend"
    r("AMAT", f, "ArcherMovingAveragesTrends", "sign(ema0({s}, {fast_period}) - ema0({s}, {slow_period}))", fast_period=8, slow_period=21)
    up, down = "100 / {period} * ({period} - highday(h, {period + 1}))", "100 / {period} * ({period} - lowday(l, {period + 1}))"
    r("AroonUp", f, "", up, period=14)
    r("AroonDown", f, "", down, period=14)
    r("Aroon", f, "AroonOscillator AroonOsc", {"": f"({up}) - ({down})", "up": up, "down": down}, period=14)
    r("AroonUpDown", f, "AroonIndicator", {"up": up, "down": down}, period=14)
    r("AroonUpDownOscillator", f, "AroonUpDownOsc", {"": f"({up}) - ({down})", "up": up, "down": down}, period=14)
    r("ATR", f, "AverageTrueRange", "atr({period})", period=14)
    r("Choppiness", f, "CHOP ChoppinessIndex", "gate({period + 1}, 0 if tsmax(h, {period}) == tsmin(l, {period}) else 100 * log10(sum(tr0(), {period}) / (tsmax(h, {period}) - tsmin(l, {period}))) / {math.log10(max(period, 2))})", period=14)
    diff = "({line1} - {line2})"
    r("NonZeroDifference", f, "NZD", f"lastnn(null if {diff} == 0 else {diff})", line1="c", line2="mean(c, 10)")
    before = f"lastnn_before(null if {diff} == 0 else {diff})"
    r("CrossUp", f, "", f"num({before} < 0 and {diff} > 0)", line1="c", line2="mean(c, 10)")
    r("CrossDown", f, "", f"num({before} > 0 and {diff} < 0)", line1="c", line2="mean(c, 10)")
    r("CrossOver", f, "", f"num({before} < 0 and {diff} > 0) - num({before} > 0 and {diff} < 0)", line1="c", line2="mean(c, 10)")
    r("Decay", f, "", "cummax({s} + t / {period}) - t / {period}", period=5)
    r("Decreasing", f, "", "tsmin(num(delta({s}) < 0), {period})", period=5)
    r("Increasing", f, "", "tsmin(num(delta({s}) > 0), {period})", period=5)
    pdm = "(delta(h) if delta(h) > -delta(l) and delta(h) > 0 else 0)"
    mdm = "(-delta(l) if -delta(l) > delta(h) and -delta(l) > 0 else 0)"
    di = lambda dm: f"(0 if wilder(tr(), {{period}}) == 0 else 100 * wilder({dm}, {{period}}) / wilder(tr(), {{period}}))"
    pdi, mdi = di(pdm), di(mdm)
    dx = f"(0 if {pdi} + {mdi} == 0 else 100 * abs({pdi} - {mdi}) / ({pdi} + {mdi}))"
    adx = f"wilder({dx}, {{period}})"
    adxr = f"({adx} + lag({adx}, {{period}})) / 2"
    r("DirectionalMovement", f, "DM", {"adx": adx, "adxr": adxr, "dx": dx, "plus_di": pdi, "minus_di": mdi}, period=14)
    r("PlusDirectionalIndicator", f, "PLUS_DI PlusDI", pdi, period=14)
    r("MinusDirectionalIndicator", f, "MINUS_DI MinusDI", mdi, period=14)
    r("ADX", f, "AverageDirectionalMovementIndex", adx, period=14)
    r("DirectionalIndicator", f, "DI", {"plus_di": pdi, "minus_di": mdi}, period=14)
    r("ADXR", f, "AverageDirectionalMovementIndexRating", adxr, period=14)
    r("DX", f, "DirectionalIndex", {"": dx, "plus_di": pdi, "minus_di": mdi}, period=14)
    r("PlusDM", f, "PLUS_DM", pdm)
    r("MinusDM", f, "MINUS_DM", mdm)
    r("DownDay", f, "", "max(lag({s}, {period}) - {s}, 0)", period=1)
    r("DownDayBool", f, "", "num({s} < lag({s}, {period}))", period=1)
    r("UpDay", f, "", "max({s} - lag({s}, {period}), 0)", period=1)
    r("UpDayBool", f, "", "num({s} > lag({s}, {period}))", period=1)
    r("DownMove", f, "", "lag({s}, 1) - {s}")
    r("UpMove", f, "", "{s} - lag({s}, 1)")
    ha_c = "((o + h + l + c) / 4)"
    ha_o = f"lin(0.5, lag({ha_c}, 1) / 2, (o + c) / 2 if t == 1 else null)"
    r("HeikinAshi", f, "", {"ha_open": ha_o, "ha_high": f"gate(2, max(max(h, {ha_o}), {ha_c}))", "ha_low": f"gate(2, min(min(l, {ha_o}), {ha_c}))", "ha_close": ha_c})
    r("haDelta", f, "haD", {"": f"gate(2, {ha_c} - {ha_o})", "smoothed": f"mean(gate(2, {ha_c} - {ha_o}), {{period}})"}, period=3)
    run = lambda cmp: f"num(runlen(({{fast}}) {cmp} ({{slow}})) >= {{period}})"
    r("LongRun", f, "LONG_RUN", run(">"), fast="c", slow="nz(mean(c, 10), c)", period=2)
    r("ShortRun", f, "SHORT_RUN", run("<"), fast="c", slow="nz(mean(c, 10), c)", period=2)
    e1 = "ema0(h - l, {ema_period})"
    r("MassIndex", f, "MASSI", f"sum(1 if ema0({e1}, {{ema_period}}) == 0 else {e1} / ema0({e1}, {{ema_period}}), {{sum_period}})", ema_period=9, sum_period=25)
    r("NATR", f, "NormalizedATR NormalizedAverageTrueRange", "0 if c == 0 else 100 * atr({period}) / c", period=14)
    around = lambda x, cmp: " and ".join(f"{x} {cmp} {g}({x}, {k})" for g in ("lag", "lead") for k in (1, 2))
    r("Fractal", f, "", {"up_fractal": f"h if {around('h', '>')} else null", "down_fractal": f"l if {around('l', '<')} else null"})
    r("ZigZag", f, "", "", kernel="zigzag", retrace=0.05)
    p = "((h + l + c) / 3)"
    r("PivotPoint", f, "", {"p": p, "s1": f"2 * {p} - h", "s2": f"{p} - (h - l)", "r1": f"2 * {p} - l", "r2": f"{p} + (h - l)"})
    r("FibonacciPivotPoint", f, "", {"p": p, **{f"{a}{i}": f"{p} {sign} {{level{i}}} * (h - l)" for a, sign in (("s", "-"), ("r", "+")) for i in (1, 2, 3)}}, level1=0.382, level2=0.618, level3=1.0)
    r("DemarkPivotPoint", f, "", {"p": "sign(c - o) / 4", "s1": "sign(c - o) / 2 - h", "r1": "sign(c - o) / 2 - l"})
    r("ParabolicSAR", f, "PSAR SAR", "", kernel="psar", period=2, af=0.02, afmax=0.2)
    r("TDSequential", f, "TD_SEQ TDSeq", "nz(runlen(nz(num({s} > lag({s}, {lookback})), 0) == 1) - runlen(nz(num({s} < lag({s}, {lookback})), 0) == 1), 0)", lookback=4)
    r("TrueHigh", f, "", "max(h, lag(c, 1))")
    r("TrueLow", f, "", "min(l, lag(c, 1))")
    r("TrueRange", f, "TRANGE TR", "tr()")
    trend = "(0 if t == 1 else (1 if {s} > ema0({s}, {period}) else -1))"
    r("TSignals", f, "TrendSignals", {"trend": trend, "signal": f"nz({trend} if {trend} != lag({trend}, 1) else 0, 0)"}, period=13)
    r("Vortex", f, "VortexIndicator", {"vi_plus": "sum(abs(h - lag(l, 1)), {period}) / sum(tr(), {period})", "vi_minus": "sum(abs(l - lag(h, 1)), {period}) / sum(tr(), {period})"}, period=14)
    above = "num(({fast}) > ({slow}))"
    r("XSignals", f, "CrossSignals", f"nz({above} - lag({above}, 1), 0)", fast="c", slow="nz(mean(c, 13), c)")

    f = "prices"
    r("AvgPrice", f, "AveragePrice", "(o + h + l + c) / 4")
    r("MedPrice", f, "MedianPrice", "(h + l) / 2")
    r("TypPrice", f, "TypicalPrice", "vwap")
    r("WclPrice", f, "WeightedClosePrice", "(h + l + 2 * c) / 4")

    f = "momentum"
    ao = "(mean((h + l) / 2, {fast}) - mean((h + l) / 2, {slow}))"
    r("AwesomeOscillator", f, "AwesomeOsc AO", ao, fast=5, slow=34)
    r("AccelerationDecelerationOscillator", f, "AccDeOsc", f"{ao} - mean({ao}, {{period}})", period=5, fast=5, slow=34)
    r("Bias", f, "", "nz(({s} - mean({s}, {period})) / mean({s}, {period}), gate({period}, 0))", period=26)
    r("BalanceOfPower", f, "BOP", "0 if h == l else (c - o) / (h - l)")
    r("CCI", f, "", "(vwap - mean(vwap, {period})) / ({factor} * mean(abs(vwap - mean(vwap, {period})), {period}))", period=20, factor=0.015)
    r("CFO", f, "ChandeForecastOscillator", "100 * ({s} - linend({s}, {period})) / {s}", period=9)
    r("DetrendedPriceOscillator", f, "DPO DetrendedPriceOsc", "{s} - lag(mean({s}, {period}), {(period - 1) // 2})", period=20)
    r("DV2", f, "", "below(mean(c / ((h + l) / 2), {maperiod}), {period}) / {period} * 100", period=252, maperiod=2)
    r("EfficiencyRatio", f, "ER", "nz(abs({s} - lag({s}, {period})) / sum(abs(delta({s})), {period}), gate({period + 1}, 0))", period=10)
    r("HurstExponent", f, "Hurst", "", kernel="hurst", period=40, lag_start=2, lag_end=0)
    r("Inertia", f, "", "", kernel="inertia", period=20, rvi_period=14)
    roc = lambda n: f"100 * ({{s}} / lag({{s}}, {n}) - 1)"
    kst = " + ".join(f"{i} * mean({roc('{rp%d}' % i)}, {{rma{i}}})" for i in (1, 2, 3, 4))
    r("KnowSureThing", f, "KST", {"kst": kst, "signal": f"mean({kst}, {{rsignal}})"}, rp1=10, rp2=15, rp3=20, rp4=30, rma1=10, rma2=10, rma3=10, rma4=10, rsignal=9)
    r("LaguerreRSI", f, "LRSI", "", kernel="laguerre_rsi", gamma=0.5, period=6)
    r("LogReturn", f, "LOG_RETURN", "log({s} / lag({s}, {period})) if lag({s}, {period}) > 0 else null", period=1)
    macd = "(ema({s}, {fast_period}) - ema({s}, {slow_period}))"
    macds = {"macd": macd, "signal": f"ema({macd}, {{signal_period}})", "histogram": f"{macd} - ema({macd}, {{signal_period}})"}
    r("MACD", f, "", macds, fast_period=12, slow_period=26, signal_period=9)
    r("MACDHisto", f, "MACDHistogram", macds | {"histo": macds["histogram"]}, fast_period=12, slow_period=26, signal_period=9)
    r("MACDFix", f, "", macds, fast_period=12, slow_period=26, signal_period=9)
    ext = "({fast_ma}({s}, {fast_period}) - {slow_ma}({s}, {slow_period}))"
    r("MACDExt", f, "", {"macd": ext, "signal": f"{{signal_ma}}({ext}, {{signal_period}})", "histogram": f"{ext} - {{signal_ma}}({ext}, {{signal_period}})"}, fast_period=12, slow_period=26, signal_period=9, fast_ma="mean", slow_ma="wma", signal_ma="ema")
    r("Momentum", f, "MOM", "{s} - lag({s}, {period})", period=12)
    r("ROC", f, "RateOfChange", "({s} - lag({s}, {period})) / lag({s}, {period})", period=12)
    r("ROC100", f, "RateOfChange100", "100 * ({s} - lag({s}, {period})) / lag({s}, {period})", period=12)
    r("MomentumOscillator", f, "MomentumOsc", "100 * {s} / lag({s}, {period})", period=12)
    r("Oscillator", f, "Osc", "{s} - ({osc})", osc="mean(c, 10)")
    r("MovingAverageOscillator", f, "SMAOscillator", f"{{s}} - ({averages['SMA']})", period=30)
    for ma, text in averages.items():
        if ma != "SMA":
            r(f"{ma}Oscillator", f, "", f"{{s}} - ({text})", period=30)
    r("KAMAOscillator", f, "AdaptiveMovingAverageOscillator MovingAverageAdaptiveOscillator", f"{{s}} - {kama}", period=30, fast=2, slow=30)
    r("DMAOscillator", f, "DicksonMAOscillator DicksonMovingAverageOscillator", "", kernel="dma_oscillator", period=20, gainlimit=50, hperiod=7)
    r("ZeroLagIndicatorOscillator", f, "ZLIndicatorOscillator ZeroLagIndicatorOsc ECOscillator", "", kernel="zero_lag_oscillator", period=20, gainlimit=50)
    r("PriceOscillator", f, "PriceOsc AbsolutePriceOscillator APO AbsPriceOsc", {"po": "ema({s}, {period1}) - ema({s}, {period2})"}, period1=12, period2=26)
    for name, alias, under in (("PercentagePriceOscillator", "PPO PercPriceOsc", "period2"), ("PercentagePriceOscillatorShort", "PPOShort PercPriceOscShort", "period1")):
        ppo = f"(100 * (ema({{s}}, {{period1}}) - ema({{s}}, {{period2}})) / ema({{s}}, {{{under}}}))"
        r(name, f, alias, {"ppo": ppo, "signal": f"ema({ppo}, {{period_signal}})", "histo": f"{ppo} - ema({ppo}, {{period_signal}})"}, period1=12, period2=26, period_signal=9)
    r("ChandeMomentumOscillator", f, "CMO", "nz(100 * (sum(up({s}), {period}) - sum(down({s}), {period})) / (sum(up({s}), {period}) + sum(down({s}), {period})), gate({period + 1}, 0))", period=14)
    cop = "100 * ({s} / lag({s}, {period1}) - 1) + 100 * ({s} / lag({s}, {period2}) - 1)"
    r("CoppockCurve", f, "Coppock", f"wdot({cop}, {{[float(i + 1) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)]}})", period1=11, period2=14)
    r("FisherTransform", f, "Fisher", {"fisher": "", "trigger": ""}, kernel="fisher", period=10)
    r("PercentChange", f, "PctChange", "{s} / lag({s}, {period}) - 1", period=30)
    r("PrettyGoodOscillator", f, "PGO PrettyGoodOsc", "(c - mean(c, {period})) / atr({period})", period=14)
    r("PSL", f, "PsychologicalLine", "100 * mean(num(delta({s}) > 0), {period})", period=12)
    r("QQE", f, "QuantQualEstimation", "", kernel="qqe", period=14, factor=4.236, smooth=5)
    r("QStick", f, "", "mean(c - o, {period})", period=10)
    r("ROCP", f, "RateOfChangePercentage", "nz(100 * ({s} - lag({s}, {period})) / lag({s}, {period}), gate({period + 1}, 0))", period=12)
    r("ROCR", f, "RateOfChangeRatio", "nz({s} / lag({s}, {period}), gate({period + 1}, 0))", period=12)
    r("ROCR100", f, "RateOfChangeRatio100", "nz(100 * {s} / lag({s}, {period}), gate({period + 1}, 0))", period=12)
    gains = ("max({s} - lag({s}, {lookback}), 0)", "max(lag({s}, {lookback}) - {s}, 0)")
    rsi = lambda avg, flat="null": "(({flat} if G == 0 else 100) if L == 0 else 100 - 100 / (1 + G / L))".replace("{flat}", flat).replace("G", avg(gains[0])).replace("L", avg(gains[1]))
    wild, simple, exp = (lambda x: f"wilder({x}, {{period}})"), (lambda x: f"mean({x}, {{period}})"), (lambda x: f"ema({x}, {{period}})")
    r("RSI", f, "", rsi(wild), period=14, lookback=1)
    r("RSI_Safe", f, "", rsi(wild, "{safelow}"), period=14, lookback=1, safelow=50.0)
    r("RSI_SMA", f, "RSI_Cutler", rsi(simple), period=14, lookback=1)
    r("RSI_EMA", f, "", rsi(exp), period=14, lookback=1)
    r("RelativeMomentumIndex", f, "RMI", rsi(wild), period=20, lookback=5)
    r("RVI", f, "RelativeVolatilityIndex", "", kernel="rvi", period=14, stddev_period=10)
    r("STC", f, "SchaffTrendCycle", "", kernel="stc", period=10, fast=23, slow=50, factor=0.5)
    raw = "nz(100 * (c - tsmin(l, {period})) / (tsmax(h, {period}) - tsmin(l, {period})), gate({period}, 0))"
    d1, d2 = f"mean({raw}, {{period_dfast}})", f"mean(mean({raw}, {{period_dfast}}), {{period_dslow}})"
    r("Stochastic", f, "StochasticSlow", {"percK": d1, "percD": d2}, period=14, period_dfast=3, period_dslow=3)
    r("StochasticFull", f, "", {"percK": raw, "percD": d1, "percDSlow": d2}, period=14, period_dfast=3, period_dslow=3)
    r("StochasticFast", f, "", {"percK": raw, "percD": d1}, period=14, period_dfast=3)
    r("KDJ", f, "", {"k": d1, "d": d2, "j": f"3 * {d1} - 2 * {d2}"}, period=9, period_dfast=3, period_dslow=3)
    rs = rsi(wild).replace("{period}", "{rsi_period}").replace("{lookback}", "1")
    sk = f"nz(100 * ({rs} - tsmin({rs}, {{stoch_period}})) / (tsmax({rs}, {{stoch_period}}) - tsmin({rs}, {{stoch_period}})), 50 if tsmax({rs}, {{stoch_period}}) == tsmin({rs}, {{stoch_period}}) else null)"
    r("StochRSI", f, "StochasticRSI", {"percK": sk, "percD": f"mean({sk}, {{period_d}})"}, rsi_period=14, stoch_period=14, period_d=3)
    e3 = "ema(ema(ema({s}, {period}), {period}), {period})"
    trix = f"100 * ({e3} / lag({e3}, {{rocperiod}}) - 1)"
    r("Trix", f, "", trix, period=15, rocperiod=1)
    r("TrixSignal", f, "", {"trix_line": trix, "signal": f"ema({trix}, {{sigperiod}})"}, period=15, rocperiod=1, sigperiod=9)
    ch = "({s} - lag({s}, {pchange}))"
    r("TrueStrengthIndicator", f, "TSI", f"100 * ema(ema({ch}, {{period1}}), {{period2}}) / ema(ema(abs({ch}), {{period1}}), {{period2}})", period1=25, period2=13, pchange=1)
    bp = "(c - min(l, lag(c, 1)))"
    uo = lambda n: f"nz(sum({bp}, {{{n}}}) / sum(tr(), {{{n}}}), gate({{{n} + 1}}, 0))"
    r("UltimateOscillator", f, "UltimateOsc UO", {"uo": f"100 * (4 * {uo('p1')} + 2 * {uo('p2')} + {uo('p3')}) / 7"}, p1=7, p2=14, p3=28)
    r("WilliamsR", f, "WillR", "-100 * (tsmax(h, {period}) - c) / (tsmax(h, {period}) - tsmin(l, {period}))", period=14)

    f = "statistics"
    r("CdlZ", f, "CDL_Z CandleZScore", "nz(((c - o) - mean(c - o, {period})) / std(c - o, {period}), gate({period}, 0))", period=30)
    r("CTI", f, "CorrelationTrendIndicator", "{spearman(s, period)}", period=12)
    sin_, cos_ = "(wdot({s}, {wave(period, math.sin)}) * 2 / {period})", "(wdot({s}, {wave(period, math.cos)}) * 2 / {period})"
    size = f"min(sqrt(({sin_} ** 2 + {cos_} ** 2) / var({{s}}, {{period}})), 1)"
    r("EBSW", f, "EvenBetterSineWave", f"nz({size} * (-1 if {sin_} < 0 else 1), gate({{period}}, 0))", period=10)
    r("Entropy", f, "ShannonEntropy", "log(sum(abs({s}), {period})) - sum(abs({s}) * log(abs({s})), {period}) / sum(abs({s}), {period})", period=10)
    r("Kurtosis", f, "RollingKurtosis", "kurt({s}, {period})", period=30)
    r("LinearReg", f, "LinearRegression", {"": "linend({s}, {period})", "slope": "linslope({s}, {period})", "intercept": "linstart({s}, {period})"}, period=14)
    r("LinearRegSlope", f, "LINEARREG_SLOPE", "linslope({s}, {period})", period=14)
    r("LinearRegIntercept", f, "LINEARREG_INTERCEPT", "linstart({s}, {period})", period=14)
    r("LinearRegAngle", f, "LINEARREG_ANGLE", "degrees(atan(linslope({s}, {period})))", period=14)
    r("TSF", f, "TimeSeriesForecast", "linend({s}, {period}) + linslope({s}, {period})", period=14)
    r("MeanDeviation", f, "MeanDev MAD", "mean(abs({s} - mean({s}, {period})), {period})", period=14)
    r("Median", f, "RollingMedian", "quantile({s}, {period}, 0.5)", period=30)
    reg = "nz(slope({data0}, {data1}, {period}), gate({period}, 0))"
    spread = f"({{data0}} - ({reg} * {{data1}} + mean({{data0}}, {{period}}) - {reg} * mean({{data1}}, {{period}})))"
    r("OLS_Slope_InterceptN", f, "", {"slope": reg, "intercept": f"mean({{data0}}, {{period}}) - {reg} * mean({{data1}}, {{period}})"}, data0="c", data1="v", period=10)
    r("OLS_TransformationN", f, "", {"spread": spread, "spread_mean": f"mean({spread}, {{period}})", "spread_std": f"std({spread}, {{period}})", "zscore": f"({spread} - mean({spread}, {{period}})) / std({spread}, {{period}})"}, data0="c", data1="v", period=10)
    r("OLS_BetaN", f, "", reg, data0="c", data1="v", period=10)
    r("PercentRank", f, "PctRank", "below({s}, {period}) / {period}", period=50)
    r("PriceDistance", f, "PDIST", "(h - l) / c")
    r("Quantile", f, "RollingQuantile", "quantile({s}, {period}, {q})", period=30, q=0.5)
    r("RollingResidual", f, "", "{s} - linend({s}, {period})", period=14)
    r("RollingRsquared", f, "", "nz(corr({s}, t, {period}) ** 2, gate({period}, 1))", period=14)
    r("Skew", f, "RollingSkew", "skew({s}, {period})", period=30)
    r("Correlation", f, "Correl", "corr({data0}, {data1}, {period})", data0="c", data1="v", period=20)
    r("RSquared", f, "", "corr({data0}, {data1}, {period}) ** 2", data0="c", data1="v", period=20)
    r("StdDev", f, "StandardDeviation", "std({s}, {period})", period=20)
    shake = "max(abs(delta(h)), abs(delta(l)))"
    r("Thermometer", f, "THERMO ElderThermometer", {"": f"nz(ema0({shake}, {{period}}), 0)", "thermo": f"nz({shake}, 0)"}, period=20)
    r("Variance", f, "VAR", "var({s}, {period})", period=5)
    r("UlcerIndex", f, "Ulcer", "{ulcer(s, period)}", period=14)
    r("ChaikinVolatility", f, "", "100 * (ema(h - l, {ema_period}) / lag(ema(h - l, {ema_period}), {roc_period}) - 1)", ema_period=10, roc_period=10)
    r("ZScore", f, "", "nz(({s} - mean({s}, {period})) / std({s}, {period}), gate({period}, 0))", period=30)


_HELPERS = {f.__name__: f for f in (gauss, fibonacci, pascal, triangle, sine, wave, ulcer, spearman)}


def fill(text: str, params: dict) -> str:
    """The text with each {expression of parameters} put in; the weights and generators above may be named."""
    space = {"math": math, **_HELPERS, **params}
    names = {"__builtins__": {"max": max, "min": min, "int": int, "round": round, "float": float}}
    return re.sub(r"\{([^{}]+)\}", lambda m: _text(eval(m[1], names | space)), text)


_register_all()
