"""The corrective gate: features of entries, calibration of scores, sizing by probability, outcomes of entries not taken."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series

#: What an entry is described by.
FEATURES: dict[str, str] = {
    "ret_1": "ret", "ret_5": "c / lag(c, 5) - 1", "ret_20": "c / lag(c, 20) - 1", "vol_10": "std(ret, 10)", "vol_20": "std(ret, 20)", "range": "(h - l) / c", "body": "(c - o) / c",
    "volume_ratio": "v / mean(v, 20)", "trend": "(mean(c, 10) - mean(c, 30)) / mean(c, 30)", "place": "(c - tsmin(l, 20)) / (tsmax(h, 20) - tsmin(l, 20))",
    "skew_20": "skew(ret, 20)", "corr_cv": "corr(c, v, 20)", "slope": "linslope(c, 14) / c", "er": "abs(c - lag(c, 10)) / sum(abs(delta(c)), 10)",
}


def candidates(bars: DataFrame, entry: str, horizon: int = 5) -> DataFrame:
    """Every bar where the entry formula holds, its features, and what it would have earned over ``horizon`` bars."""
    df = series.with_series(bars, FEATURES | {"entry": entry, "outcome": f"lead(c, {horizon}) / lead(o, 1) - 1"})
    return df.where("entry = 1").withColumn("label", F.when(F.col("outcome").isNotNull(), (F.col("outcome") > 0).cast("int"))).drop("entry")


def isotonic(scored: DataFrame, bins: int = 200) -> list[tuple[float, float]]:
    """Breakpoints (score, probability) of a rising step function: label rates of score bins, pooled where they fall."""
    df = scored.where("label is not null").withColumn("bin", F.floor(F.col("score") * bins))
    rows = df.groupBy("bin").agg(F.avg("score").alias("x"), F.avg(F.col("label").cast("double")).alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most ``bins`` + 1 rows
    pools: list[list[float]] = []
    for r in rows:
        pools.append([r["x"], r["y"], r["n"]])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            n = a[2] + b[2]
            pools.append([(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n])
    return [(x, y) for x, y, _ in pools]


def platt(score: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - label) * score).sum(), (p - label).sum()])
        hess = np.array([[(w * score * score).sum() + 1e-9, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def calibrate(scored: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """Adds probability: linear between breakpoints, flat beyond them."""
    p = F.lit(points[0][1] if points else 0.5)
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        p = F.when(F.col("score") >= x0, y0 + (F.least(F.col("score"), F.lit(x1)) - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(p)
    return scored.withColumn("probability", p)


def size(gated: DataFrame, policy: str = "gate", threshold: float = 0.5, power: float = 2.0) -> DataFrame:
    """Adds scale: 1 or 0 at the threshold, the probability to a power, or that power only above the threshold."""
    p = F.col("probability")
    scale = {"gate": (p >= threshold).cast("double"), "power": F.pow(p, power), "hybrid": F.when(p >= threshold, F.pow(p, power)).otherwise(0.0)}[policy]
    return gated.withColumn("scale", scale)


def ledger(gated: DataFrame) -> DataFrame:
    """Per symbol: entries taken and left, and the mean outcome of either."""
    took = F.col("scale") > 0
    return gated.groupBy("symbol").agg(F.count_if(took).alias("taken"), F.count_if(~took).alias("rejected"), F.avg(F.when(took, F.col("outcome"))).alias("taken_outcome"), F.avg(F.when(~took, F.col("outcome"))).alias("rejected_outcome"))


def schema_hash(names: list[str]) -> int:
    """64-bit FNV-1a of the feature names, to tell whether a model was made for these features."""
    h = 0xCBF29CE484222325
    for byte in ",".join(names).encode():
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return h


def preflight(config: str, golden: dict[str, float], got: dict[str, float], tolerance: float = 1e-6) -> list[str]:
    """What speaks against a gate's configuration (JSON with features_hash): a wrong hash, or a golden row that comes out otherwise."""
    faults = []
    if json.loads(config).get("features_hash") != schema_hash(list(FEATURES)):
        faults.append("the model was made for other features")
    faults += [f"{k}: {got.get(k)} instead of {v}" for k, v in golden.items() if k not in got or abs(got[k] - v) > tolerance * max(1.0, abs(v))]
    return faults


def runs(signals: DataFrame, flag: str) -> DataFrame:
    """Runs of bars where ``flag`` holds: symbol, first t, last t, length."""
    order = Window.partitionBy("symbol").orderBy("t")
    df = signals.where(F.col(flag)).withColumn("island", F.col("t") - F.row_number().over(order))
    return df.groupBy("symbol", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("length")).drop("island")
