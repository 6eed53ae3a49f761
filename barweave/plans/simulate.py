"""Backtests: indicator and signal columns, then one fold per portfolio; parameter sweeps as more portfolios."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..operators.broker import SIZERS, Broker, Commission, Instrument, Order, Slippage

RESULT = "symbol string, combo int, kind string, t long, ref long, size double, price double, value double, cash double, pnl double, pnlcomm double, bars long, note string"
COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


@dataclass(frozen=True)
class Rules:
    """A declarative strategy: formulas that are true (1) where to enter or leave; ``{name}`` are parameters."""

    long: str = "null"
    short: str = "null"
    exit: str = "null"
    exit_short: str = ""
    stop: float | None = None  # share of the price, as a stop order behind an entry
    target: float | None = None
    params: dict = field(default_factory=dict)

    def formulas(self, **given) -> dict[str, str]:
        p = self.params | given
        put = lambda text: text.format(**p) if text else "null"
        return {"long": put(self.long), "short": put(self.short), "leave": put(self.exit), "leave_short": put(self.exit_short or self.exit)}


@dataclass(frozen=True)
class Account:
    cash: float = 100_000.0
    commission: Commission = Commission()
    slippage: Slippage = Slippage()
    instrument: Instrument | None = None
    sizer: str = "percent"
    sizer_args: tuple = (0.95,)


Strategy = Callable[[Broker, int, dict[str, float]], None]


def _follow(rules: Rules, account: Account) -> Strategy:
    size_of = SIZERS[account.sizer](*account.sizer_args)

    def step(broker: Broker, t: int, row: dict[str, float]) -> None:
        held, price = broker.position.size, row["close"]
        if held > 0 and row["leave"] == 1 or held < 0 and row["leave_short"] == 1:
            for x in broker.orders:
                broker.cancel(x)
            broker.send(Order(-held), t)
        elif held == 0 and not any(x.alive for x in broker.orders):
            side = 1 if row["long"] == 1 else -1 if row["short"] == 1 else 0
            size = side * size_of(broker, price, side > 0) if side else 0.0
            if size and rules.stop and rules.target:
                broker.bracket(size, price * (1 + side * rules.target), price * (1 - side * rules.stop), t)
            elif size:
                parent = broker.send(Order(size), t)
                if rules.stop:
                    broker.send(Order(-size, "stop", stop=price * (1 - side * rules.stop), parent=parent.ref), t)

    return step


def fold(cols: dict[str, np.ndarray], account: Account, strategy: Strategy, first: int = 1) -> tuple[Broker, np.ndarray, np.ndarray]:
    """Run one portfolio: orders sent at a bar meet the next bar first. Gives the broker, and cash and value per bar."""
    broker = Broker(account.cash, account.commission, account.slippage, account.instrument)
    rows = {k: v.tolist() for k, v in cols.items()}
    n = len(rows["close"])
    cash, value = np.empty(n), np.empty(n)
    for i in range(n):
        row = {k: v[i] for k, v in rows.items()}
        broker.process(i + 1, row["open"], row["high"], row["low"], row["close"])
        if i + 1 >= first:
            strategy(broker, i + 1, row)
        cash[i], value[i] = broker.cash, broker.value(row["close"])
    return broker, cash, value


def _rows(symbol: str, combo: int, broker: Broker, cash: np.ndarray, value: np.ndarray, equity: bool) -> list[dict]:
    out = [{"kind": "fill", "t": x["t"], "ref": x["ref"], "size": x["size"], "price": x["price"], "note": x["kind"]} for x in broker.fills]
    for x in broker.trades:
        r = x.row()
        out.append({"kind": "trade" if x.closed_at else "open", "t": r["closed_at"] or len(value), "ref": r["seq"], "size": r["size"], "price": r["price"], "pnl": r["pnl"], "pnlcomm": r["pnlcomm"], "bars": r["bars"]})
    if equity:
        out += [{"kind": "equity", "t": i + 1, "value": float(v), "cash": float(k)} for i, (v, k) in enumerate(zip(value, cash))]
    return [{c: x.get(c) for c in COLUMNS} | {"symbol": symbol, "combo": combo} for x in out]


def backtest(bars: DataFrame, rules: Rules, account: Account | None = None, strategy: Strategy | None = None, grid: dict[str, list] | None = None, equity: bool = True) -> DataFrame:
    """Fills, trades and equity of one portfolio per symbol (and per combination of ``grid``), as rows of RESULT.

    Bars are shuffled once: a symbol's combinations are dealt out as groups of their own, so a sweep spreads over
    symbols times combinations.
    """
    account = account or Account()
    combos = list(itertools.product(*grid.values())) if grid else [()]
    names = list(grid) if grid else []
    spread = bars.withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1))))
    cols = ("open", "high", "low", "close", "volume")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        symbol, combo = table.column("symbol")[0].as_py(), table.column("combo")[0].as_py()
        data = {c: table.column(c).cast("float64").to_numpy().astype(float) for c in cols}
        got = series.evaluate(rules.formulas(**dict(zip(names, combos[combo]))), data)
        broker, cash, value = fold(data | got, account, strategy or _follow(rules, account))
        rows = _rows(symbol, combo, broker, cash, value, equity)
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        return pa.table({c: pa.array([r[c] for r in rows], kinds[k]) for c, k in (x.split() for x in RESULT.split(", "))})

    return spread.groupBy("symbol", "combo").applyInArrow(one, RESULT)


def summary(result: DataFrame, grid: dict[str, list] | None = None) -> DataFrame:
    """One row per symbol and combination: final value, highest drawdown, trades and net result; the parameters beside it."""
    order = Window.partitionBy("symbol", "combo").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    eq = result.where("kind = 'equity'").withColumn("peak", F.max("value").over(order))
    eq = eq.groupBy("symbol", "combo").agg(F.max_by("value", "t").alias("final_value"), F.max(100 * (F.col("peak") - F.col("value")) / F.col("peak")).alias("max_drawdown"))
    tr = result.where("kind = 'trade'").groupBy("symbol", "combo").agg(F.count("*").alias("trades"), F.sum("pnlcomm").alias("net"))
    df = eq.join(tr, ["symbol", "combo"], "left").fillna(0, ["trades", "net"])
    if grid:
        combos = [(i, *c) for i, c in enumerate(itertools.product(*grid.values()))]
        params = result.sparkSession.createDataFrame(combos, ["combo", *grid])
        df = df.join(F.broadcast(params.withColumn("combo", F.col("combo").cast("int"))), "combo")  # one row per combination
    return df


def sma_cross(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """The flagship plan in native expressions: average cross, market fill at the next open, closed trades per symbol.

    A position is opened at the bar after an upward cross and closed at the bar after the next downward one; each
    trade is one unit. Gives symbol, trades, won, gross, best, worst, max_drawdown of the summed results.
    """
    f, s = f"mean(c, {fast})", f"mean(c, {slow})"
    diff = f"({f} - {s})"
    before = f"lastnn_before(null if {diff} == 0 else {diff})"
    df = series.with_series(bars, {"up": f"num({before} < 0 and {diff} > 0)", "down": f"num({before} > 0 and {diff} < 0)", "next_open": "lead(o, 1)"})
    turn = df.where("(up = 1 or down = 1) and next_open is not null")
    order = Window.partitionBy("symbol").orderBy("t")
    closed = turn.withColumn("exit", F.lead("next_open").over(order)).where("up = 1 and exit is not null").withColumn("pnl", F.col("exit") - F.col("next_open"))
    total = F.sum("pnl").over(order.rowsBetween(Window.unboundedPreceding, 0))
    closed = closed.withColumn("total", total)
    closed = closed.withColumn("peak", F.greatest(F.max("total").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return closed.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") >= 0).alias("won"), F.sum("pnl").alias("gross"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.max(F.col("peak") - F.col("total")).alias("max_drawdown"),
    )


SMA_CROSS_SQL = """
WITH b AS ({bars}),
m AS (SELECT *, CASE WHEN t >= {fast} THEN avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {fast} - 1 PRECEDING AND CURRENT ROW) END
              - CASE WHEN t >= {slow} THEN avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {slow} - 1 PRECEDING AND CURRENT ROW) END AS d,
      lead(open) OVER (PARTITION BY symbol ORDER BY t) AS next_open FROM b),
p AS (SELECT *, last_value(nullif(d, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM m),
x AS (SELECT *, lead(next_open) OVER (PARTITION BY symbol ORDER BY t) AS leave FROM p WHERE (q < 0 AND d > 0 OR q > 0 AND d < 0) AND next_open IS NOT NULL),
c AS (SELECT symbol, t, leave - next_open AS pnl, sum(leave - next_open) OVER (PARTITION BY symbol ORDER BY t) AS total FROM x WHERE q < 0 AND d > 0 AND leave IS NOT NULL),
k AS (SELECT *, greatest(max(total) OVER (PARTITION BY symbol ORDER BY t), 0) AS peak FROM c)
SELECT symbol, trades, won, {gross} AS gross, {best} AS best, {worst} AS worst, {max_drawdown} AS max_drawdown
FROM (SELECT symbol, count(*) AS trades, count(*) FILTER (pnl >= 0) AS won, sum(pnl) AS gross, max(pnl) AS best, min(pnl) AS worst, max(peak - total) AS max_drawdown FROM k GROUP BY symbol)
"""
