"""The order machine: orders, fills, positions and trades of one portfolio, bar by bar.

This part feeds back into itself (cash and positions decide what fills), so it is a fold, run per portfolio as a
grouped map by :mod:`barweave.plans.simulate`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

EPS = 1e-10


@dataclass(frozen=True)
class Commission:
    """percent of notional, fixed per order, or per share; at least ``minimum``, at most ``cap`` of notional."""

    kind: str = "percent"
    rate: float = 0.0
    minimum: float = 0.0
    cap: float | None = None
    tiers: tuple[tuple[float, float], ...] = ()

    def __call__(self, size: float, price: float, multiplier: float = 1.0) -> float:
        size, notional = abs(size), abs(size) * price * multiplier
        match self.kind:
            case "percent":
                fee = notional * self.rate
            case "fixed":
                fee = self.rate
            case "per_share":
                fee = size * self.rate
            case "tiered":  # each tier's rate for what lies in it, the last rate beyond
                fee, below = 0.0, 0.0
                for top, rate in self.tiers:
                    fee += max(min(notional, top) - below, 0.0) * rate
                    below = top
                if self.tiers:
                    fee += max(notional - below, 0.0) * self.tiers[-1][1]
            case _:
                raise ValueError(f"no commission of kind {self.kind!r}")
        fee = max(fee, self.minimum) if size else 0.0
        return fee if self.cap is None else min(fee, max(self.cap * notional, 0.0))


def interactive(rate: float = 0.005, minimum: float = 1.0, cap: float = 0.01) -> Commission:
    return Commission("per_share", rate, minimum, cap)


@dataclass(frozen=True)
class Instrument:
    """What a unit is worth and what holding it ties up."""

    kind: str = "equity"
    multiplier: float = 1.0
    initial: float = 0.5
    maintenance: float = 0.25
    fixed_margin: float | None = None

    @property
    def unit(self) -> float:
        """What a unit of the price is worth; bonds are quoted in hundredths of their face value."""
        return self.multiplier / 100 if self.kind == "bond" else self.multiplier

    def notional(self, size: float, price: float) -> float:
        return abs(size) * price * self.unit

    def margin(self, size: float, price: float) -> float:
        if self.fixed_margin is not None:
            return abs(size) * self.fixed_margin
        return self.notional(size, price) * self.initial

    def maintenance_margin(self, size: float, price: float) -> float:
        if self.fixed_margin is not None:
            return abs(size) * self.fixed_margin * 0.8
        return self.notional(size, price) * self.maintenance


#: Margins by kind of instrument.
INSTRUMENTS = {
    "equity": Instrument("equity", 1.0, 0.5, 0.25),
    "future": Instrument("future", 50.0, 0.0, 0.0, 5000.0),
    "forex": Instrument("forex", 1.0, 0.02, 0.01),
    "option": Instrument("option", 100.0, 1.0, 1.0),
    "bond": Instrument("bond", 1000.0, 0.1, 0.05),
    "cfd": Instrument("cfd", 1.0, 0.05, 0.025),
}


@dataclass(frozen=True)
class Slippage:
    percent: float = 0.0
    fixed: float = 0.0
    out: bool = False  # keep a price outside the bar
    match: bool = True  # else move it to the bar's edge; else don't fill
    opens: bool = True
    limits: bool = False


@dataclass
class Order:
    size: float  # signed
    kind: str = "market"  # market limit stop stop_limit stop_trail stop_trail_limit
    price: float | None = None  # limit
    stop: float | None = None
    trail: float | None = None
    trail_percent: float | None = None
    valid_until: int | None = None
    oco: int | None = None
    parent: int | None = None
    ref: int = 0
    status: str = "created"
    created: int = 0
    filled_at: int | None = None
    fill_price: float | None = None
    commission: float = 0.0

    @property
    def alive(self) -> bool:
        return self.status in ("created", "submitted", "accepted")


@dataclass
class Position:
    size: float = 0.0
    price: float = 0.0

    def update(self, size: float, price: float) -> tuple[float, float]:
        """Apply a fill; how much it opened and how much it closed. The average price moves only when the position grows."""
        before = self.size
        after = before + size
        if abs(after) < EPS:
            after = 0.0
        if before == 0 or (before > 0) == (size > 0):
            self.price = price if before == 0 else (before * self.price + size * price) / after
            opened, closed = size, 0.0
        elif after == 0 or (after > 0) == (before > 0):
            opened, closed = 0.0, size
        else:
            opened, closed, self.price = after, -before, price
        self.size = after
        if after == 0:
            self.price = 0.0
        return opened, closed


@dataclass
class Trade:
    seq: int
    size: float
    price: float
    opened_at: int
    pnl: float = 0.0
    commission: float = 0.0
    closed_at: int | None = None
    peak: float = 0.0

    def row(self) -> dict:
        return {"seq": self.seq, "size": self.peak, "price": self.price, "pnl": self.pnl, "pnlcomm": self.pnl - self.commission, "opened_at": self.opened_at, "closed_at": self.closed_at, "bars": (self.closed_at or self.opened_at) - self.opened_at}


@dataclass
class Broker:
    cash: float = 100_000.0
    commission: Commission = Commission()
    slippage: Slippage = Slippage()
    instrument: Instrument | None = None
    position: Position = field(default_factory=Position)
    orders: list[Order] = field(default_factory=list)
    trades: list[Trade] = field(default_factory=list)
    fills: list[dict] = field(default_factory=list)
    refs: int = 0

    # orders
    def send(self, order: Order, t: int) -> Order:
        self.refs += 1
        order.ref, order.created = self.refs, t
        self.orders.append(order)
        return order

    def bracket(self, size: float, limit: float, stop: float, t: int) -> tuple[Order, Order, Order]:
        """A market entry with a limit and a stop on the other side, of which one cancels the other."""
        parent = self.send(Order(size), t)
        group = -parent.ref
        target = self.send(Order(-size, "limit", price=limit, oco=group, parent=parent.ref), t)
        guard = self.send(Order(-size, "stop", stop=stop, oco=group, parent=parent.ref), t)
        return parent, target, guard

    def cancel(self, order: Order) -> None:
        if order.alive:
            order.status = "canceled"
            for child in self.orders:
                if child.parent == order.ref:
                    self.cancel(child)

    # a bar
    def process(self, t: int, o: float, h: float, lo: float, c: float) -> None:
        """What fills at this bar: orders sent before it, in the order they were sent."""
        done: set[int] = set()
        by_ref = {x.ref: x for x in self.orders}
        for order in self.orders:
            if not order.alive:
                continue
            parent = by_ref.get(order.parent) if order.parent else None
            if parent is not None and parent.status != "completed":
                if not parent.alive:
                    order.status = "canceled"
                continue
            if order.valid_until is not None and t > order.valid_until:
                order.status = "expired"
                continue
            order.status = "accepted"
            if "stop" in order.kind and order.stop is None and not self._set_trail(order, o):
                order.status = "rejected"
                continue
            price = self._price(order, o, h, lo)
            if price is None:
                self._ratchet(order, h, lo)
                continue
            self._execute(order, price, t)
            if order.status == "completed" and order.oco is not None:
                done.add(order.oco)
        for order in self.orders:  # siblings go after the pass, so two may fill in one bar
            if order.alive and order.oco in done:
                self.cancel(order)
        self.orders = [x for x in self.orders if x.alive or any(y.alive and y.parent == x.ref for y in self.orders)]

    def _distance(self, order: Order, price: float) -> float | None:
        if order.trail_percent is not None:
            return price * order.trail_percent
        return order.trail

    def _set_trail(self, order: Order, price: float) -> bool:
        gap = self._distance(order, price) if "trail" in order.kind else None
        if gap is None:
            return False
        order.stop = price + gap if order.size > 0 else price - gap
        return True

    def _ratchet(self, order: Order, h: float, lo: float) -> None:
        if "trail" not in order.kind:
            return
        gap = self._distance(order, lo if order.size > 0 else h)
        if gap is not None:
            order.stop = min(order.stop, lo + gap) if order.size > 0 else max(order.stop, h - gap)

    def _price(self, order: Order, o: float, h: float, lo: float) -> float | None:
        buy = order.size > 0
        limit = lambda at, x: (min(x, at) if lo <= x else None) if buy else (max(x, at) if h >= x else None)
        stop = lambda: (max(order.stop, o) if h >= order.stop else None) if buy else (min(order.stop, o) if lo <= order.stop else None)
        kind = order.kind
        if kind == "market":
            return self._slip(o, buy, h, lo) if self.slippage.opens else o
        if kind == "limit":
            price = limit(o, order.price)
            return self._slip(price, buy, h, lo) if price is not None and self.slippage.limits else price
        price = stop()
        if price is None:
            return None
        if kind in ("stop", "stop_trail"):
            return self._slip(price, buy, h, lo)
        return limit(price, order.price)

    def _slip(self, price: float, buy: bool, h: float, lo: float) -> float | None:
        s = self.slippage
        move = price * s.percent if s.percent else s.fixed
        if not move:
            return price
        moved = price + move if buy else price - move
        if lo <= moved <= h or s.out:
            return moved
        return min(max(moved, lo), h) if s.match else None

    def _execute(self, order: Order, price: float, t: int) -> None:
        size = order.size
        unit = self.instrument.unit if self.instrument else 1.0
        fee = self.commission(size, price, unit)
        if self.instrument:
            if size > 0 and self.instrument.margin(size, price) + fee > self.cash:
                order.status = "margin"
                return
        elif size > 0 and size * price + fee > self.cash:
            order.status = "margin"
            return
        was = replace(self.position)
        opened, closed = self.position.update(size, price)
        self.cash -= size * price * unit + fee
        order.status, order.filled_at, order.fill_price, order.commission = "completed", t, price, fee
        self.fills.append({"t": t, "ref": order.ref, "size": size, "price": price, "commission": fee, "kind": order.kind})
        if closed:
            trade = self.trades[-1]
            trade.pnl += -closed * (price - was.price) * unit
            trade.commission += fee * abs(closed) / abs(size)
            trade.size += closed
            if abs(trade.size) < EPS:
                trade.size, trade.closed_at = 0.0, t
        if opened:
            share = fee * abs(opened) / abs(size)
            if was.size and (was.size > 0) == (opened > 0):
                trade = self.trades[-1]
                trade.size, trade.price = self.position.size, self.position.price
            else:
                trade = Trade(len(self.trades) + 1, opened, price, t)
                self.trades.append(trade)
            trade.commission += share
            trade.peak = max(trade.peak, trade.size, key=abs)

    def value(self, close: float) -> float:
        return self.cash + self.position.size * close * (self.instrument.unit if self.instrument else 1.0)


Sizer = Callable[[Broker, float, bool], float]


def fixed(stake: float = 1.0) -> Sizer:
    return lambda broker, price, buy: stake


def percent(share: float = 0.2) -> Sizer:
    return lambda broker, price, buy: float(math.floor(broker.value(price) * share / price)) if price > 0 else 0.0


def all_in() -> Sizer:
    return lambda broker, price, buy: (broker.cash / price if price > 0 else 0.0) if buy else abs(broker.position.size)


def reverser(stake: float = 1.0) -> Sizer:
    return lambda broker, price, buy: abs(broker.position.size) + stake


SIZERS: dict[str, Callable[..., Sizer]] = {"fixed": fixed, "percent": percent, "all_in": all_in, "reverser": reverser}
