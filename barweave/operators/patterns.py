"""Candle patterns: 100, -100 or 0 per bar, from comparisons of a bar with up to two before it.

Suffix 0, 1, 2 means: two bars ago, one bar ago, now (two-bar patterns use 1 and 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import series


def _at(text: str) -> str:
    """o0 h1 c2 ... spelt as lags; body/range/top/bot of a bar likewise."""
    out = text
    for k, back in (("0", 2), ("1", 1), ("2", 0)):
        for f in "ohlc":
            out = out.replace(f"{f}{k}", f if back == 0 else f"lag({f}, {back})")
    return out


def _shape(k: str) -> dict[str, str]:
    return {f"body{k}": f"abs(c{k} - o{k})", f"range{k}": f"(h{k} - l{k})", f"top{k}": f"max(o{k}, c{k})", f"bot{k}": f"min(o{k}, c{k})", f"bull{k}": f"c{k} > o{k}", f"bear{k}": f"c{k} < o{k}"}


_WORDS = {name: text for k in "012" for name, text in _shape(k).items()}

#: Pattern to (bars, bullish rule, bearish rule); an empty rule never holds.
RULES: dict[str, tuple[int, str, str]] = {
    "CDLDoji": (1, "range2 > 0 and body2 <= 0.05 * range2 and c2 >= o2", "range2 > 0 and body2 <= 0.05 * range2 and c2 < o2"),
    "CDLHammer": (1, "range2 > 0 and body2 < range2 / 3 and bot2 - l2 >= 2 * body2 and h2 - top2 <= 0.1 * body2", ""),
    "CDLHangingMan": (1, "", "range2 > 0 and body2 < range2 / 3 and bot2 - l2 >= 2 * body2 and h2 - top2 <= 0.1 * body2"),
    "CDLShootingStar": (1, "", "range2 > 0 and body2 < range2 / 3 and h2 - top2 >= 2 * body2 and bot2 - l2 <= 0.1 * body2"),
    "CDLMarubozu": (1, "range2 > 0 and body2 >= 0.95 * range2 and bull2", "range2 > 0 and body2 >= 0.95 * range2 and c2 <= o2"),
    "CDLSpinningTop": (1, "range2 > 0 and body2 < 0.3 * range2 and h2 - top2 > 0.2 * range2 and bot2 - l2 > 0.2 * range2 and c2 >= o2", "range2 > 0 and body2 < 0.3 * range2 and h2 - top2 > 0.2 * range2 and bot2 - l2 > 0.2 * range2 and bear2"),
    "CDLBeltHold": (1, "range2 > 0 and o2 == l2 and bull2 and body2 >= 0.6 * range2", "range2 > 0 and o2 == h2 and bear2 and body2 >= 0.6 * range2"),
    "CDLEngulfing": (2, "bear1 and bull2 and top2 >= top1 and bot2 <= bot1", "bull1 and bear2 and top2 >= top1 and bot2 <= bot1"),
    "CDLHarami": (2, "bear1 and bull2 and top2 <= top1 and bot2 >= bot1", "bull1 and bear2 and top2 <= top1 and bot2 >= bot1"),
    "CDLPiercingLine": (2, "bear1 and bull2 and o2 < c1 and c2 > (o1 + c1) / 2 and c2 < o1", ""),
    "CDLDarkCloudCover": (2, "", "bull1 and bear2 and o2 > c1 and c2 < (o1 + c1) / 2 and c2 > o1"),
    "CDLKicking": (2, "range1 > 0 and range2 > 0 and body1 >= 0.9 * range1 and body2 >= 0.9 * range2 and bear1 and bull2 and l2 > h1", "range1 > 0 and range2 > 0 and body1 >= 0.9 * range1 and body2 >= 0.9 * range2 and bull1 and bear2 and h2 < l1"),
    "CDLCounterAttack": (2, "range1 > 0 and bear1 and bull2 and body1 >= 0.3 * range1 and abs(c2 - c1) <= 0.005 * range1", "range1 > 0 and bull1 and bear2 and body1 >= 0.3 * range1 and abs(c2 - c1) <= 0.005 * range1"),
    "CDLHomingPigeon": (2, "bull1 and bull2 and o2 >= o1 and c2 <= c1", ""),
    "CDLMatchingLow": (2, "bear1 and bear2 and abs(c2 - c1) <= 0.001 * (1 if c1 == 0 else abs(c1))", ""),
    "CDLMorningStar": (3, "range0 > 0 and bear0 and body0 >= 0.5 * range0 and body1 < 0.5 * body0 and bull2 and body2 >= body1 and c2 >= (o0 + c0) / 2", ""),
    "CDLEveningStar": (3, "", "range0 > 0 and bull0 and body0 >= 0.5 * range0 and body1 < 0.5 * body0 and bear2 and body2 >= body1 and c2 <= (o0 + c0) / 2"),
    "CDLThreeWhiteSoldiers": (3, "bull0 and bull1 and bull2 and c1 > c0 and c2 > c1 and o1 >= o0 and o1 <= c0 and o2 >= o1 and o2 <= c1", ""),
    "CDLThreeBlackCrows": (3, "", "bear0 and bear1 and bear2 and c1 < c0 and c2 < c1 and o1 <= o0 and o1 >= c0 and o2 <= o1 and o2 >= c1"),
    "CDLAbandonedBaby": (3, "bear0 and range1 > 0 and body1 <= 0.1 * range1 and h1 < l0 and l2 > h1 and bull2", "bull0 and range1 > 0 and body1 <= 0.1 * range1 and l1 > h0 and h2 < l1 and bear2"),
    "CDLThreeInside": (3, "bear0 and bull1 and top1 <= top0 and bot1 >= bot0 and c2 > top0", "bull0 and bear1 and top1 <= top0 and bot1 >= bot0 and c2 < bot0"),
    "CDLThreeOutside": (3, "bear0 and bull1 and top1 >= top0 and bot1 <= bot0 and c2 > c1", "bull0 and bear1 and top1 >= top0 and bot1 <= bot0 and c2 < c1"),
    "CDLTasukiGap": (3, "bull0 and bull1 and l1 > h0 and bear2 and o2 >= o1 and o2 <= c1 and c2 < l1 and c2 > h0", "bear0 and bear1 and h1 < l0 and bull2 and o2 <= o1 and o2 >= c1 and c2 > h1 and c2 < l0"),
    "CDLUpsideGap": (3, "bull0 and bull1 and l1 > h0 and bull2 and l2 > h0", ""),
}


def _spelt(rule: str) -> str:
    for name in sorted(_WORDS, key=len, reverse=True):
        rule = rule.replace(name, f"({_WORDS[name]})")
    return _at(rule)


def formula(pattern: str) -> str:
    bars, up, down = RULES[pattern]
    text = "0"
    if down:
        text = f"(-100 if {_spelt(down)} else {text})"
    if up:
        text = f"(100 if {_spelt(up)} else {text})"
    return text if bars == 1 else f"nz({text}, 0)"


def formulas(patterns: list[str] | None = None) -> dict[str, str]:
    out = {p.lower(): formula(p) for p in (patterns or RULES)}
    if patterns is None:
        out["cdlinside"] = "num(h < lag(h, 1) and l > lag(l, 1))"
    return out


def compute(bars: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return series.with_series(bars, formulas(patterns))
