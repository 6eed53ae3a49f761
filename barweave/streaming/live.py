"""Streaming: bars from ticks, incremental summaries, and a live portfolio with risk limits as a stateful fold."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars from a stream of (symbol, ts, price, volume); rows later than the watermark are dropped."""
    at = F.struct("ts", "price")
    df = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every))
    df = df.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ticks"))
    return df.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def increments(result: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Writes each micro-batch of ``result`` as one increment: its rows as JSON under rows, its number and size under increments.

    Rows stay where they are; a batch that is run again after a failure replaces its own files only.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(number).alias("seq"), *batch.columns)
        rows.write.mode("overwrite").json(f"{path}/rows/batch={number}")
        rows.agg(F.lit(number).alias("seq"), F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/increments/batch={number}")
        if sink:
            sink(batch, number)

    return result.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


@dataclass
class Limits:
    max_position: float = 10.0
    max_drawdown: float = 20.0  # percent; beyond it the portfolio is flattened and stays out
    max_orders: int = 5  # per second of event time
    fast: int = 5
    slow: int = 20
    size: float = 1.0
    silent_ms: int = 60_000


@dataclass
class Live:
    """All that is kept between ticks of a symbol."""

    n: int = 0
    fast: float = 0.0
    slow: float = 0.0
    above: int = 0
    position: float = 0.0
    cash: float = 100_000.0
    peak: float = 100_000.0
    last: float = 0.0
    killed: bool = False
    second: int = 0
    orders: int = 0

    def tick(self, price: float, second: int, limits: Limits) -> tuple[float, str]:
        """One bar of one price: moving averages, an order of at most the room there is, and the limits. Gives size and reason."""
        self.n += 1
        for name, n in (("fast", limits.fast), ("slow", limits.slow)):
            old = getattr(self, name)
            setattr(self, name, price if self.n == 1 else old + (price - old) * 2 / (n + 1))
        self.last = price
        if second != self.second:
            self.second, self.orders = second, 0
        value = self.cash + self.position * price
        self.peak = max(self.peak, value)
        if not self.killed and self.peak > 0 and 100 * (self.peak - value) / self.peak > limits.max_drawdown:
            self.killed = True
            return self._fill(-self.position, price), "kill"
        side = (self.fast > self.slow) - (self.fast < self.slow)
        crossed = side != 0 and side != self.above and self.n > limits.slow
        self.above = side or self.above
        if not crossed or self.killed:
            return 0.0, ""
        if self.orders >= limits.max_orders:
            return 0.0, "rate"
        wanted = max(min(side * limits.size - self.position, limits.max_position - self.position), -limits.max_position - self.position)
        return self._fill(wanted, price), "cross"

    def _fill(self, size: float, price: float) -> float:
        if size:
            self.orders += 1
            self.position += size
            self.cash -= size * price
        return size


OUT = "symbol string, ts timestamp, price double, size double, position double, value double, reason string"


def live(ticks: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Fills of a live portfolio per symbol from a stream of (symbol, ts, price), with its position and value after each.

    State is one small record per symbol. A symbol that is silent longer than its limit is flattened at its last price.
    """
    limits = limits or Limits()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Live(**json.loads(state.get[0])) if state.exists else Live()
        out = []
        if state.hasTimedOut:
            size = now._fill(-now.position, now.last)
            if size:
                out.append((key[0], pd.Timestamp(0), now.last, size, now.position, now.cash, "silent"))
            state.remove()
        else:
            for frame in frames:
                for row in frame.sort_values("ts").itertuples():
                    size, why = now.tick(row.price, int(row.ts.timestamp()), limits)
                    if size or why:
                        out.append((key[0], row.ts, row.price, size, now.position, now.cash + now.position * row.price, why))
            state.update((json.dumps(asdict(now)),))
            state.setTimeoutDuration(limits.silent_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
