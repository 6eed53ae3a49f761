"""Statistical tests on whole series and rolling scores per bar, as grouped maps with numpy kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import series

#: MacKinnon's response surfaces for the unit-root test with a constant, by level.
MACKINNON = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.04), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}


def _critical(n: int) -> list[tuple[float, float]]:
    return [(sum(b / n**i for i, b in enumerate(row)), p) for p, row in MACKINNON.items()]


def _p_value(stat: float, n: int) -> float:
    """Piecewise linear between the critical values, drawn out to 0.001 and 0.99 beyond them."""
    points = _critical(n)
    xs = [points[0][0] - 2.0, *(c for c, _ in points), 0.0, 2.0]
    ps = [0.001, *(p for _, p in points), 0.9, 0.99]
    return float(np.interp(stat, xs, ps))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    s2 = float(resid @ resid) / max(len(y) - x.shape[1], 1)
    return beta, float(resid @ resid), s2 * np.linalg.pinv(x.T @ x)


def _adf_design(y: np.ndarray, lags: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(y)
    rows = np.arange(drop, len(d))
    x = [np.ones(len(rows)), y[rows]] + [d[rows - k] for k in range(1, lags + 1)]
    return np.stack(x, axis=1), d[rows]


def adf(y: np.ndarray, max_lags: int | None = None, lags: int | None = None) -> dict[str, float]:
    """Augmented Dickey-Fuller with a constant; lags by AIC over one common sample."""
    n = len(y)
    if n < 12 or np.ptp(y) == 0:
        return {"stat": math.nan, "p_value": math.nan, "lags": 0.0}
    if lags is None:
        top = min(max_lags if max_lags is not None else math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
        scores = []
        for k in range(top + 1):
            x, d = _adf_design(y, k, top)
            rss = _ols(x, d)[1]
            scores.append(len(d) * math.log(max(rss, 1e-300) / len(d)) + 2 * x.shape[1])
        lags = int(np.argmin(scores))
    x, d = _adf_design(y, lags, lags)
    beta, _, cov = _ols(x, d)
    stat = float(beta[1] / math.sqrt(cov[1, 1])) if cov[1, 1] > 0 else math.nan
    return {"stat": stat, "p_value": _p_value(stat, len(d)) if stat == stat else math.nan, "lags": float(lags)}


def hurst_rs(y: np.ndarray) -> dict[str, float]:
    """Rescaled range on chunks of 8, 16, ... rows; the exponent is the slope of the logs."""
    sizes, points = [], []
    size = 8
    while size <= len(y) // 2:
        chunks = y[: len(y) // size * size].reshape(-1, size)
        dev = np.cumsum(chunks - chunks.mean(axis=1, keepdims=True), axis=1)
        spread, sd = np.ptp(dev, axis=1), chunks.std(axis=1)
        ok = sd > 0
        if ok.any():
            sizes.append(math.log(size))
            points.append(math.log(float((spread[ok] / sd[ok]).mean())))
        size *= 2
    if len(sizes) < 2:
        return {"hurst": 0.5}
    return {"hurst": float(np.polyfit(sizes, points, 1)[0])}


def _simplex(f: Callable[[np.ndarray], float], x0: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder and Mead's search."""
    points = [x0] + [x0 + np.eye(len(x0))[i] * 0.25 for i in range(len(x0))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-10:
            break
        mid = np.mean(points[:-1], axis=0)
        out = mid + (mid - points[-1])
        v = f(out)
        if v < values[0]:
            far = mid + 2 * (mid - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (out, v)
        elif v < values[-2]:
            points[-1], values[-1] = out, v
        else:
            near = mid + 0.5 * (points[-1] - mid)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def _garch_path(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    out, v = np.empty(len(r)), float(r.var())
    for i, x in enumerate(r.tolist()):
        out[i] = v
        v = omega + alpha * x * x + beta * v
    return out


def garch(r: np.ndarray) -> dict[str, float]:
    """GARCH(1,1) by maximum likelihood over (log omega, logit alpha, logit beta), alpha + beta below 0.9999."""
    r = r - r.mean() if len(r) else r
    var = float(r.var()) if len(r) else 0.0
    if len(r) < 20 or var <= 0:
        return {"omega": math.nan, "alpha": math.nan, "beta": math.nan, "loglik": math.nan}
    logit = lambda p: math.log(p / (1 - p))
    sigm = lambda x: 1 / (1 + math.exp(-min(max(x, -35.0), 35.0)))

    def cost(p: np.ndarray) -> float:
        omega, alpha, beta = math.exp(min(max(p[0], -60.0), 60.0)), sigm(p[1]), sigm(p[2])
        if alpha + beta >= 0.9999:
            return 1e12
        v = np.maximum(_garch_path(r, omega, alpha, beta), 1e-300)
        return 0.5 * float((np.log(2 * math.pi * v) + r * r / v).sum())

    best = _simplex(cost, np.array([math.log(0.05 * var), logit(0.05), logit(0.90)]))
    return {"omega": math.exp(best[0]), "alpha": sigm(best[1]), "beta": sigm(best[2]), "loglik": -cost(best)}


def hmm2(x: np.ndarray, rounds: int = 100) -> dict[str, float]:
    """Two Gaussian states by Baum-Welch in scaled form, begun by a split at the median; the state of lower mean first."""
    n = len(x)
    if n < 4 or x.std() == 0:
        return {"mean_0": math.nan, "mean_1": math.nan, "sd_0": math.nan, "sd_1": math.nan, "stay_0": math.nan, "stay_1": math.nan, "loglik": math.nan}
    low = x <= np.median(x)
    mean = np.array([x[low].mean(), x[~low].mean() if (~low).any() else x.max()])
    sd = np.maximum([x[low].std(), x[~low].std() if (~low).any() else x.std()], 1e-6 * x.std())
    move, start, last = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), -math.inf
    for _ in range(rounds):
        log_p = -0.5 * ((x[:, None] - mean) / sd) ** 2 - np.log(sd * math.sqrt(2 * math.pi))
        top = log_p.max(axis=1)
        p = np.exp(log_p - top[:, None])
        fwd, scale = np.empty((n, 2)), np.empty(n)
        a = start * p[0]
        for i in range(n):
            if i:
                a = (fwd[i - 1] @ move) * p[i]
            scale[i] = a.sum()
            fwd[i] = a / scale[i]
        back = np.ones((n, 2))
        for i in range(n - 2, -1, -1):
            back[i] = (move @ (p[i + 1] * back[i + 1])) / scale[i + 1]
        loglik = float((np.log(scale) + top).sum())
        seen = fwd * back
        seen /= seen.sum(axis=1, keepdims=True)
        pair = np.einsum("ti,ij,tj->ij", fwd[:-1], move, p[1:] * back[1:] / scale[1:, None])
        move = pair / pair.sum(axis=1, keepdims=True)
        start, weight = seen[0], seen.sum(axis=0)
        mean = (seen * x[:, None]).sum(axis=0) / weight
        sd = np.maximum(np.sqrt((seen * (x[:, None] - mean) ** 2).sum(axis=0) / weight), 1e-6 * x.std())
        if abs(loglik - last) < 1e-6:
            break
        last = loglik
    i, j = (0, 1) if mean[0] <= mean[1] else (1, 0)
    return {"mean_0": float(mean[i]), "mean_1": float(mean[j]), "sd_0": float(sd[i]), "sd_1": float(sd[j]), "stay_0": float(move[i, i]), "stay_1": float(move[j, j]), "loglik": loglik}


TESTS: dict[str, tuple[Callable[[np.ndarray], dict[str, float]], list[str]]] = {
    "adf": (adf, ["stat", "p_value", "lags"]),
    "hurst_rs": (hurst_rs, ["hurst"]),
    "garch": (garch, ["omega", "alpha", "beta", "loglik"]),
    "hmm2": (hmm2, ["mean_0", "mean_1", "sd_0", "sd_1", "stay_0", "stay_1", "loglik"]),
}


def _source(table: pa.Table, formula: str) -> np.ndarray:
    cols = {c: table.column(c).cast("float64").to_numpy().astype(float) for c in ("open", "high", "low", "close", "volume")}
    return series.evaluate({"x": formula}, cols)["x"]


def test(bars: DataFrame, name: str, formula: str = "c") -> DataFrame:
    """symbol, n and the test's figures, of the formula's known values."""
    run, out = TESTS[name]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = _source(table, formula)
        x = x[~np.isnan(x)]
        got = run(x)
        return pa.table({"symbol": table.column("symbol")[:1], "n": [len(x)], **{k: pa.array([got[k]], pa.float64(), from_pandas=True) for k in out}})

    return bars.groupBy("symbol").applyInArrow(one, "symbol string, n long, " + ", ".join(f"{k} double" for k in out))


def rolling(bars: DataFrame, name: str, formula: str = "c", window: int = 252) -> DataFrame:
    """symbol, ts, t, score per bar: -log10 of the unit-root p-value (lags as in the first window), the exponent, or sigma of the fitted GARCH."""

    def scores(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if name == "garch":
            fit = garch(x)
            if fit["omega"] == fit["omega"]:
                out = np.sqrt(_garch_path(x - x.mean(), fit["omega"], fit["alpha"], fit["beta"]))
            return out
        lags = None
        for i in range(window - 1, len(x)):
            w = x[i - window + 1 : i + 1]
            if name == "hurst_rs":
                out[i] = hurst_rs(w)["hurst"]
            else:
                got = adf(w, lags=lags)
                lags = int(got["lags"]) if lags is None else lags
                out[i] = -math.log10(max(got["p_value"], 1e-12)) if got["p_value"] == got["p_value"] else math.nan
        return out

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = _source(table, formula)
        known = ~np.isnan(x)
        score = np.full(len(x), np.nan)
        score[known] = scores(x[known])
        return pa.table({"symbol": table.column("symbol"), "ts": table.column("ts"), "t": table.column("t"), "score": pa.array(score, pa.float64(), mask=np.isnan(score))})

    kinds = dict(bars.dtypes)
    return bars.groupBy("symbol").applyInArrow(one, f"symbol string, ts {kinds['ts']}, t {kinds['t']}, score double")
