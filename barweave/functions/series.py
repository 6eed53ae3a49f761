"""The series language: one formula text, three back ends.

A formula is written over the columns of ordered bars, e.g. ``corr(rk(h), rk(v), 3)``. It is compiled to

* window expressions for Spark (:func:`with_series`): one select per nesting level, all over one sort;
* numpy for formulas that feed back into themselves (``lin``), run per symbol as a grouped map, all at once;
* SQL with ordinary window functions and recursive CTEs (:func:`to_sql`), which serves as the oracle.

Rules that hold in all three: missing is NULL; division by zero, logarithms of what is not positive and the
like are NULL; an aggregate over n rows is NULL until n non-missing rows are there; ranks count strictly
smaller members and give 0 for a missing current value; extrema positions prefer the latest of ties.

Names: o h l c v (bar), t (row number from 1), vwap ((h+l+c)/3), ret (simple return), adv<n> (mean volume),
null, and any other column. Functions are listed in ``SCALAR`` and ``WINDOW``.
"""

from __future__ import annotations

import ast
import functools
import math
from collections.abc import Callable, Iterable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

SHORT = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
RANK_ROWS = 252
#: Ranks and positions of extrema compare values rounded to so many places: what differs only by the order of
#: a summation is a tie.
TIE_DIGITS = 9
Node = tuple

#: Functions of single rows, by number of arguments.
SCALAR = {"log": 1, "sqrt": 1, "abs": 1, "sign": 1, "exp": 1, "atan": 1, "sin": 1, "cos": 1, "max": 2, "min": 2, "pow": 2, "spow": 2, "nz": 2, "num": 1, "isnull": 1, "log10": 1, "degrees": 1, "mod": 2, "floor": 1}
#: Functions of a row's neighbourhood: the series arguments come first, then constants.
WINDOW = {
    "lag": 1, "lead": 1, "sum": 1, "mean": 1, "std": 1, "var": 1, "tsmin": 1, "tsmax": 1, "skew": 1, "kurt": 1, "quantile": 1, "esum": 1, "emean": 1, "estd": 1, "emax": 1, "emin": 1,
    "cumsum": 1, "cummax": 1, "cummin": 1, "corr": 2, "cov": 2, "tsr": 1, "rk": 1, "argmax": 1, "argmin": 1, "argmax_old": 1, "argmin_old": 1, "wdot": 1, "prod": 1, "lastnn": 1, "lastnn_before": 1, "rollup": 1, "lin": 3, "first": 1, "below": 1, "mad": 1,
}
def _linear_weights(x: str, n: str) -> str:
    """Weights 1 to n, newest heaviest: a dot product for short windows, two sums for long ones (which cancel more)."""
    k = int(float(n))
    if k <= 64:
        return f"wdot({x}, {[2 * (i + 1) / (k * (k + 1)) for i in range(k)]})"
    return f"((sum(t * ({x}), {n}) - (t - {n}) * sum({x}, {n})) / ({n} * ({n} + 1) / 2))"


#: Short forms, spelt out while parsing.
MACROS: dict[str, Callable[..., str]] = {
    "delta": lambda x, n="1": f"(({x}) - lag({x}, {n}))",
    "dlin": lambda x, n: _linear_weights(x, n),
    "linslope": lambda x, n: f"((sum(t * ({x}), {n}) - (t - ({n} - 1) / 2) * sum({x}, {n})) / ({n} * ({n} * {n} - 1) / 12))",
    "linend": lambda x, n: f"(mean({x}, {n}) + linslope({x}, {n}) * ({n} - 1) / 2)",
    "linstart": lambda x, n: f"(mean({x}, {n}) - linslope({x}, {n}) * ({n} - 1) / 2)",
    "highday": lambda x, n: f"({n} - 1 - argmax({x}, {n}))",
    "lowday": lambda x, n: f"({n} - 1 - argmin({x}, {n}))",
    "scale": lambda x: f"(nz(0 * ({x}) if cumsum(abs({x})) == 0 else ({x}) / cumsum(abs({x})), null))",
    "count": lambda cond, n: f"sum(num({cond}), {n})",
    "ema": lambda x, n: f"lin(1 - 2 / ({n} + 1), ({x}) * 2 / ({n} + 1), mean({x}, {n}))",
    "ema0": lambda x, n: f"lin(1 - 2 / ({n} + 1), ({x}) * 2 / ({n} + 1), {x})",
    "wilder": lambda x, n: f"lin(1 - 1 / {n}, ({x}) / {n}, mean({x}, {n}))",
    "smooth": lambda x, n, m="1": f"lin(1 - {m} / {n}, ({x}) * {m} / {n}, {x})",
    "tr": lambda: "(max(max(h - l, abs(h - lag(c, 1))), abs(l - lag(c, 1))))",
    "tr0": lambda: "nz(max(max(h - l, abs(h - lag(c, 1))), abs(l - lag(c, 1))), h - l)",
    "wma": lambda x, n: _linear_weights(x, n),
    "slope": lambda y, x, n: f"(cov({y}, {x}, {n}) / var({x}, {n}))",
    "gate": lambda n, x: f"(({x}) if t >= {n} else null)",
    "up": lambda x: f"max(({x}) - lag({x}, 1), 0)",
    "down": lambda x: f"max(lag({x}, 1) - ({x}), 0)",
    "runlen": lambda cond: f"(t - nz(lastnn(null if ({cond}) else t), 0))",
    "atr": lambda n: f"wilder(tr(), {n})",
}


class FormulaError(ValueError):
    pass


@functools.cache
def parse(text: str) -> Node:
    return _node(ast.parse(text.strip(), mode="eval").body)


def _node(e: ast.expr) -> Node:
    match e:
        case ast.Constant(value=bool() | int() | float() as x):
            return ("const", float(x))
        case ast.Name(id="null"):
            return ("null",)
        case ast.Name(id="vwap"):
            return parse("(h + l + c) / 3")
        case ast.Name(id="ret"):
            return parse("(c - lag(c, 1)) / lag(c, 1)")
        case ast.Name(id=x) if x.startswith("adv") and x[3:].isdigit():
            return parse(f"mean(v, {x[3:]})")
        case ast.Name(id=x):
            return ("col", SHORT.get(x, x))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            n = _node(x)
            return ("const", -n[1]) if n[0] == "const" else ("op", "-", ("const", 0.0), n)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return ("not", _node(x))
        case ast.BinOp(left=a, op=op, right=b):
            name = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "pow"}[type(op)]
            a, b = _node(a), _node(b)
            if a[0] == b[0] == "const":
                return ("const", _fold(name, a[1], b[1]))
            return ("fn", "pow", a, b) if name == "pow" else ("op", name, a, b)
        case ast.Compare(left=a, ops=[op], comparators=[b]):
            return ("cmp", {ast.Lt: "<", ast.Gt: ">", ast.LtE: "<=", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}[type(op)], _node(a), _node(b))
        case ast.BoolOp(op=op, values=xs):
            return functools.reduce(lambda a, b: ("bool", "and" if isinstance(op, ast.And) else "or", a, b), map(_node, xs))
        case ast.IfExp(test=q, body=a, orelse=b):
            return ("if", _node(q), _node(a), _node(b))
        case ast.Call(func=ast.Name(id=f), args=args) if f in MACROS:
            return parse(MACROS[f](*(ast.unparse(a) for a in args)))
        case ast.Call(func=ast.Name(id=f), args=args) if f in SCALAR:
            if len(args) != SCALAR[f]:
                raise FormulaError(f"{f} takes {SCALAR[f]} arguments")
            return ("fn", f, *map(_node, args))
        case ast.Call(func=ast.Name(id=f), args=args) if f in WINDOW:
            k = WINDOW[f]
            rest = tuple(tuple(ast.literal_eval(a)) if isinstance(a, ast.List) else _constant(a) for a in args[k:])
            return ("win", f, tuple(map(_node, args[:k])), rest)
    raise FormulaError(f"not understood: {ast.unparse(e)}")


def _fold(op: str, a: float, b: float) -> float:
    match op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return a / b if b else math.nan
    return a**b


def _constant(e: ast.expr) -> float:
    n = _node(e)
    if n[0] != "const":
        raise FormulaError(f"a constant is needed, not {ast.unparse(e)}")
    return n[1]


def children(n: Node) -> Iterable[Node]:
    if n[0] == "win":
        return n[2]
    return [x for x in n[1:] if isinstance(x, tuple)]


@functools.cache
def depth(n: Node) -> int:
    below = max((depth(x) for x in children(n)), default=0)
    return below + (n[0] == "win")


@functools.cache
def recursive(n: Node) -> bool:
    return (n[0] == "win" and n[1] == "lin") or any(recursive(x) for x in children(n))


def windows(roots: Iterable[Node]) -> dict[int, list[Node]]:
    """The distinct window nodes by level."""
    found: dict[Node, None] = {}

    def walk(n: Node) -> None:
        if n in found:
            return
        for x in children(n):
            walk(x)
        if n[0] == "win":
            found[n] = None

    for r in roots:
        walk(r)
    levels: dict[int, list[Node]] = {}
    for n in found:
        levels.setdefault(depth(n), []).append(n)
    return dict(sorted(levels.items()))


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)" if not float(x).is_integer() or abs(x) >= 1e15 else f"{int(x)}.0D"


class Dialect:
    """How a formula is spelt in SQL. The texts are the same for both engines but for what the methods say."""

    spark = True
    partition, order = "symbol", "t"

    def number(self, x: float) -> str:
        if math.isnan(x):
            return "CAST(NULL AS DOUBLE)"
        return f"CAST({x!r} AS DOUBLE)"

    def safe(self, name: str, ok: str, value: str) -> str:
        return f"CASE WHEN {ok} THEN {value} END"

    def scalar(self, n: Node, names: dict[Node, str]) -> str:
        """SQL of a node whose windows have got names."""
        if n in names:
            return names[n]
        s = lambda x: self.scalar(x, names)
        kind = n[0]
        if kind == "const":
            return self.number(n[1])
        if kind == "null":
            return "CAST(NULL AS DOUBLE)"
        if kind == "col":
            return f"CAST({n[1]} AS DOUBLE)" if n[1] == "t" else n[1]
        if kind == "op":
            a, b = s(n[2]), s(n[3])
            return f"({a} / nullif({b}, 0.0))" if n[1] == "/" else f"({a} {n[1]} {b})"
        if kind == "cmp":
            return f"({s(n[2])} {n[1]} {s(n[3])})"
        if kind == "bool":
            return f"({s(n[2])} {n[1]} {s(n[3])})"
        if kind == "not":
            return f"(NOT {s(n[1])})"
        if kind == "if":
            return f"(CASE WHEN {s(n[1])} THEN {s(n[2])} WHEN {s(n[1])} IS NULL THEN NULL ELSE {s(n[3])} END)"
        f, args = n[1], [s(x) for x in n[2:]]
        a, b = args[0], args[-1]
        match f:
            case "log":
                return f"(CASE WHEN {a} > 0 THEN ln({a}) END)"
            case "log10":
                return f"(CASE WHEN {a} > 0 THEN log10({a}) END)"
            case "sqrt":
                return f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)"
            case "pow":
                return f"(CASE WHEN ({a} > 0 OR ({a} < 0 AND {b} = floor({b})) OR ({a} = 0 AND {b} >= 0)) THEN power({a}, {b}) END)"
            case "spow":
                return f"(CASE WHEN {a} = 0 AND {b} > 0 THEN 0.0 WHEN {a} <> 0 THEN sign({a}) * power(abs({a}), {b}) END)"
            case "max" | "min":
                return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {'greatest' if f == 'max' else 'least'}({a}, {b}) END)"
            case "nz":
                return f"coalesce({a}, {b})"
            case "num":
                return f"CAST(CAST({a} AS INT) AS DOUBLE)"
            case "isnull":
                return f"({a} IS NULL)"
            case "mod":
                return f"({a} - {b} * floor({a} / nullif({b}, 0.0)))"
            case "floor":
                return f"CAST(floor({a}) AS DOUBLE)"
            case "sign":
                return f"CAST(sign({a}) AS DOUBLE)"
        return f"{f}({a})"

    def over(self, n: int | None, to: str = "CURRENT ROW") -> str:
        start = "UNBOUNDED" if n is None else str(n - 1)
        return f"OVER (PARTITION BY {self.partition} ORDER BY {self.order} ROWS BETWEEN {start} PRECEDING AND {to})"

    def window(self, n: Node, names: dict[Node, str]) -> tuple[list[str], str]:
        """(window expressions, what is made of them): the latter names them as {0}, {1}, ..."""
        f, args, rest = n[1], [self.scalar(x, names) for x in n[2]], n[3]
        x = args[0]
        k = int(rest[0]) if rest and not isinstance(rest[0], tuple) else None
        plain = f"OVER (PARTITION BY {self.partition} ORDER BY {self.order})"
        full = f"count({x}) {self.over(k)}" if k else ""
        agg = {"sum": "sum", "mean": "avg", "std": "stddev_pop", "var": "var_pop", "tsmin": "min", "tsmax": "max"}
        match f:
            case "lag" | "lead":
                return [f"{f}({x}, {k}) {plain}"], "{0}"
            case _ if f in agg:
                return [full, f"{agg[f]}({x}) {self.over(k)}"], f"CASE WHEN {{0}} = {k} THEN {{1}} END"
            case "skew" | "kurt":
                parts = [full, *(f"{a} {self.over(k)}" for a in (f"avg({x})", f"avg({x} * {x})", f"avg({x} * {x} * {x})", f"avg({x} * {x} * {x} * {x})"))]
                m2 = "({2} - {1} * {1})"
                m3 = "({3} - 3 * {1} * {2} + 2 * {1} * {1} * {1})"
                m4 = "({4} - 4 * {1} * {3} + 6 * {1} * {1} * {2} - 3 * {1} * {1} * {1} * {1})"
                value = f"{m3} / power({m2}, 1.5)" if f == "skew" else f"{m4} / ({m2} * {m2}) - 3"
                return parts, f"CASE WHEN {{0}} = {k} AND {m2} > 1e-14 * {{2}} THEN {value} END"
            case "quantile":
                q = rest[1]
                value = f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"
                return [full, f"{value} {self.over(k)}"], f"CASE WHEN {{0}} = {k} THEN {{1}} END"
            case "esum" | "emean" | "estd" | "emax" | "emin":
                name = {"esum": "sum", "emean": "avg", "estd": "stddev_pop", "emax": "max", "emin": "min"}[f]
                return [f"{name}({x}) {self.over(k)}"], "{0}"
            case "cumsum" | "cummax" | "cummin":
                return [f"{f[3:]}({x}) {self.over(None)}"], "{0}"
            case "corr" | "cov":
                both = f"count(CASE WHEN {args[0]} IS NOT NULL AND {args[1]} IS NOT NULL THEN 1 END) {self.over(k)}"
                cov = f"covar_pop({args[0]}, {args[1]}) {self.over(k)}"
                if f == "cov":
                    return [both, cov], f"CASE WHEN {{0}} = {k} THEN {{1}} END"
                sides = [f"var_pop({a}) {self.over(k)}" for a in args]
                scale = [f"avg({a} * {a}) {self.over(k)}" for a in args]
                return [both, cov, *sides, *scale], f"CASE WHEN {{0}} = {k} AND {{2}} > 1e-13 * {{4}} AND {{3}} > 1e-13 * {{5}} THEN {{1}} / sqrt({{2}} * {{3}}) END"
            case "tsr":
                x = f"round({x}, {TIE_DIGITS})"
                return [self.listed(x, k), x], f"CASE WHEN t >= {k} THEN CASE WHEN {{1}} IS NULL THEN 0.0 ELSE {self.smaller('{0}', '{1}')} / CAST({k} AS DOUBLE) END END"
            case "rk":
                x = f"round({x}, {TIE_DIGITS})"
                return [self.listed(x, RANK_ROWS), x], f"CASE WHEN {{1}} IS NULL THEN 0.0 ELSE {self.smaller('{0}', '{1}')} / CAST(least(t, {RANK_ROWS}) AS DOUBLE) END"
            case "below":
                x = f"round({x}, {TIE_DIGITS})"
                return [full, self.listed(x, k), x], f"CASE WHEN {{0}} = {k} THEN {self.smaller('{1}', '{2}')} END"
            case "argmax" | "argmin" | "argmax_old" | "argmin_old":
                best = "max" if f.startswith("argmax") else "min"
                x = f"round({x}, {TIE_DIGITS})"
                place = self.place("{1}", "{2}", f.endswith("old"))
                return [full, self.listed(x, k), f"{best}({x}) {self.over(k)}"], f"CASE WHEN {{0}} = {k} THEN {place} END"
            case "wdot":
                weights = rest[0]
                return [f"count({x}) {self.over(len(weights))}", self.listed(f"coalesce({x}, 0.0)", len(weights))], f"CASE WHEN {{0}} = {len(weights)} THEN {self.dot('{1}', weights)} END"
            case "mad":
                return [full, self.listed(x, k), f"avg({x}) {self.over(k)}"], f"CASE WHEN {{0}} = {k} THEN {self.deviation('{1}', '{2}')} / CAST({k} AS DOUBLE) END"
            case "prod":
                return [full, self.listed(x, k)], f"CASE WHEN {{0}} = {k} THEN {self.product('{1}')} END"
            case "lastnn":
                return [self.last(x, "CURRENT ROW")], "{0}"
            case "lastnn_before":
                return [self.last(x, "1 PRECEDING")], "{0}"
            case "first":
                return [f"first_value({x}) {self.over(None)}"], "{0}"
        raise FormulaError(f)

    # what the engines spell differently
    def listed(self, x: str, k: int) -> str:
        return f"collect_list({x}) {self.over(k)}"

    def smaller(self, items: str, x: str) -> str:
        return f"CAST(size(filter({items}, y -> y < {x})) AS DOUBLE)"

    def place(self, items: str, x: str, old: bool) -> str:
        if old:
            return f"CAST(array_position({items}, {x}) - 1 AS DOUBLE)"
        return f"CAST(size({items}) - array_position(reverse({items}), {x}) AS DOUBLE)"

    def dot(self, items: str, weights: tuple) -> str:
        return f"aggregate(zip_with({items}, array({', '.join(map(self.number, weights))}), (a, b) -> a * b), CAST(0 AS DOUBLE), (a, b) -> a + b)"

    def deviation(self, items: str, m: str) -> str:
        return f"aggregate({items}, CAST(0 AS DOUBLE), (a, y) -> a + abs(y - {m}))"

    def product(self, items: str) -> str:
        return f"aggregate({items}, CAST(1 AS DOUBLE), (a, b) -> a * b)"

    def last(self, x: str, to: str) -> str:
        return f"last({x}, true) {self.over(None, to)}"


class Oracle(Dialect):
    """The same in DuckDB's SQL."""

    spark = False

    def listed(self, x: str, k: int) -> str:
        return f"list({x}) {self.over(k)}"

    def smaller(self, items: str, x: str) -> str:
        return f"CAST(len([y FOR y IN {items} IF y < {x}]) AS DOUBLE)"

    def place(self, items: str, x: str, old: bool) -> str:
        if old:
            return f"CAST(list_position({items}, {x}) - 1 AS DOUBLE)"
        return f"CAST(len({items}) - list_position(list_reverse({items}), {x}) AS DOUBLE)"

    def dot(self, items: str, weights: tuple) -> str:
        return f"list_dot_product({items}, [{', '.join(map(self.number, weights))}])"

    def deviation(self, items: str, m: str) -> str:
        return f"list_sum([abs(y - {m}) FOR y IN {items}])"

    def product(self, items: str) -> str:
        return f"list_product({items})"

    def last(self, x: str, to: str) -> str:
        return f"last_value({x} IGNORE NULLS) {self.over(None, to)}"


def with_series(bars, formulas: dict[str, str], keep: tuple[str, ...] = ("symbol", "ts", "t")):
    """``keep`` and a column per formula, for a DataFrame of bars (symbol, ts, t, open, high, low, close, volume).

    Formulas without feedback become window expressions over one sort of (symbol, t); if any feeds back, all
    are evaluated in one grouped map per symbol.
    """
    from pyspark.sql import functions as F

    nodes = {name: parse(text) for name, text in formulas.items()}
    if any(map(recursive, nodes.values())):
        return _grouped(bars, nodes, keep)
    names: dict[Node, str] = {}
    df, dialect = bars, Dialect()
    for level, found in windows(nodes.values()).items():
        raw: dict[str, str] = {}
        made: list[tuple[Node, str]] = []
        for n in found:
            parts, value = dialect.window(n, names)
            made.append((n, value.format(*(raw.setdefault(p, f"w{level}_{len(raw)}") for p in parts))))
        df = df.select("*", *[F.expr(p).alias(w) for p, w in raw.items()])
        df = df.select("*", *[F.expr(value).alias(f"s{level}_{i}") for i, (_, value) in enumerate(made)]).drop(*raw.values())
        names |= {n: f"s{level}_{i}" for i, (n, _) in enumerate(made)}
    return df.select(*keep, *[F.expr(dialect.scalar(n, names)).cast("double").alias(name) for name, n in nodes.items()])


def _grouped(bars, nodes: dict[str, Node], keep: tuple[str, ...]):
    import pyarrow as pa

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        columns = {c: _floats(table.column(c)) for c in table.column_names if pa.types.is_floating(table.column(c).type) or pa.types.is_integer(table.column(c).type)}
        got = evaluate(nodes, columns)
        out = {k: table.column(k) for k in keep}
        return pa.table(out | {name: pa.array(x, pa.float64(), mask=np.isnan(x)) for name, x in got.items()})

    kinds = dict(bars.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"`{name}` double" for name in nodes)])
    return bars.groupBy("symbol").applyInArrow(one, schema)


def _floats(column) -> np.ndarray:
    return column.cast("float64").to_numpy().astype(np.float64)


# --- numpy ------------------------------------------------------------------------------------------------


def evaluate(nodes: dict[str, Node | str], columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each formula over one symbol's ordered columns; missing is NaN. Booleans are 1, 0 and NaN inside."""
    memo: dict[Node, np.ndarray] = {}
    rows = len(next(iter(columns.values())))
    columns = columns | {"t": np.arange(1, rows + 1, dtype=float)}
    with np.errstate(all="ignore"):
        return {name: _eval(parse(n) if isinstance(n, str) else n, columns, memo, rows).copy() for name, n in nodes.items()}


def _eval(n: Node, cols: dict, memo: dict, rows: int) -> np.ndarray:
    if n not in memo:
        memo[n] = _value(n, lambda x: _eval(x, cols, memo, rows), cols, rows)
    return memo[n]


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def _value(n: Node, ev: Callable[[Node], np.ndarray], cols: dict, rows: int) -> np.ndarray:
    kind = n[0]
    if kind == "const":
        return np.full(rows, n[1])
    if kind == "null":
        return np.full(rows, np.nan)
    if kind == "col":
        return cols[n[1]]
    if kind == "op":
        a, b = ev(n[2]), ev(n[3])
        if n[1] == "/":
            return np.where(b == 0, np.nan, a / b)
        return a + b if n[1] == "+" else a - b if n[1] == "-" else a * b
    if kind == "cmp":
        a, b = ev(n[2]), ev(n[3])
        hit = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "=": a == b, "<>": a != b}[n[1]]
        return np.where(np.isnan(a) | np.isnan(b), np.nan, hit.astype(float))
    if kind == "bool":
        a, b = ev(n[2]), ev(n[3])
        known = 0.0 if n[1] == "and" else 1.0
        plain = a * b if n[1] == "and" else np.maximum(a, b)
        return np.where((a == known) | (b == known), known, plain)
    if kind == "not":
        return 1 - ev(n[1])
    if kind == "if":
        q = ev(n[1])
        return np.where(np.isnan(q), np.nan, np.where(q == 1, ev(n[2]), ev(n[3])))
    if kind == "fn":
        a, b = ev(n[2]), ev(n[-1])
        match n[1]:
            case "log":
                return np.where(a > 0, np.log(np.where(a > 0, a, 1)), np.nan)
            case "log10":
                return np.where(a > 0, np.log10(np.where(a > 0, a, 1)), np.nan)
            case "sqrt":
                return np.sqrt(a)
            case "pow":
                return np.where((a == 0) & (b < 0), np.nan, np.power(a, b))
            case "spow":
                return np.where((a == 0) & (b <= 0), np.nan, np.sign(a) * np.power(np.abs(a), b))
            case "max":
                return np.maximum(a, b)
            case "min":
                return np.minimum(a, b)
            case "nz":
                return np.where(np.isnan(a), b, a)
            case "num":
                return a
            case "isnull":
                return np.isnan(a).astype(float)
            case "mod":
                return np.where(b == 0, np.nan, a - b * np.floor(a / b))
        return {"abs": np.abs, "sign": np.sign, "exp": np.exp, "atan": np.arctan, "sin": np.sin, "cos": np.cos, "degrees": np.degrees, "floor": np.floor}[n[1]](a)
    return _windowed(n[1], [ev(x) for x in n[2]], n[3], rows)


def _rolling(x: np.ndarray, k: int) -> np.ndarray:
    """The last k values at each row, oldest first; before the first row stands NaN."""
    return sliding_window_view(np.concatenate([np.full(k - 1, np.nan), x]), k)


def _windowed(f: str, args: list[np.ndarray], rest: tuple, rows: int) -> np.ndarray:
    x = args[0]
    k = int(rest[0]) if rest and not isinstance(rest[0], tuple) else 0
    out = np.full(rows, np.nan)
    if f == "lag":
        out[k:] = x[: max(rows - k, 0)]
        return out
    if f == "lead":
        out[: max(rows - k, 0)] = x[k:]
        return out
    if f in ("cumsum", "cummax", "cummin"):
        fill = {"cumsum": 0.0, "cummax": -np.inf, "cummin": np.inf}[f]
        fold = {"cumsum": np.cumsum, "cummax": np.maximum.accumulate, "cummin": np.minimum.accumulate}[f]
        seen = np.cumsum(~np.isnan(x)) > 0
        return np.where(seen, fold(np.where(np.isnan(x), fill, x)), np.nan)
    if f in ("lastnn", "lastnn_before"):
        at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(rows)))
        last = np.where(at >= 0, x[np.maximum(at, 0)], np.nan)
        return last if f == "lastnn" else np.concatenate([[np.nan], last[:-1]])
    if f == "first":
        return np.full(rows, x[0]) if rows else out
    if f == "lin":
        return _linear(*args)
    if f == "wdot":
        w = np.array(rest[0])
        return _rolling(x, len(w)) @ w if rows else out
    if f in ("rk", "tsr"):
        n = RANK_ROWS if f == "rk" else k
        x = np.round(x, TIE_DIGITS)
        smaller = (_rolling(x, n) < x[:, None]).sum(axis=1)
        t = np.arange(1, rows + 1)
        return smaller / np.minimum(t, n) if f == "rk" else np.where(t >= n, smaller / n, np.nan)
    w = _rolling(np.round(x, TIE_DIGITS) if f.startswith("arg") or f == "below" else x, k)
    known = ~np.isnan(w)
    if f in ("esum", "emean", "estd", "emax", "emin"):
        some = known.any(axis=1)
        safe = np.where(some[:, None], w, 0.0)
        return np.where(some, {"esum": np.nansum, "emean": np.nanmean, "estd": np.nanstd, "emax": np.nanmax, "emin": np.nanmin}[f](safe, axis=1), np.nan)
    full = known.all(axis=1)
    if f in ("corr", "cov"):
        w2 = _rolling(args[1], k)
        full &= ~np.isnan(w2).any(axis=1)
        a, b = w - w.mean(axis=1, keepdims=True), w2 - w2.mean(axis=1, keepdims=True)
        cov, va, vb = (a * b).mean(axis=1), (a * a).mean(axis=1), (b * b).mean(axis=1)
        if f == "cov":
            return np.where(full, cov, np.nan)
        ok = full & (va > 1e-13 * (w * w).mean(axis=1)) & (vb > 1e-13 * (w2 * w2).mean(axis=1))
        return np.where(ok, cov / np.sqrt(va * vb), np.nan)
    if f in ("skew", "kurt"):
        d = w - w.mean(axis=1, keepdims=True)
        m2 = (d * d).mean(axis=1)
        ok = full & (m2 > 1e-14 * (w * w).mean(axis=1))
        value = (d**3).mean(axis=1) / m2**1.5 if f == "skew" else (d**4).mean(axis=1) / (m2 * m2) - 3
        return np.where(ok, value, np.nan)
    if f == "below":
        return np.where(full, (w < np.round(x, TIE_DIGITS)[:, None]).sum(axis=1).astype(float), np.nan)
    if f == "quantile":
        return np.where(full, np.quantile(np.where(full[:, None], w, 0.0), rest[1], axis=1), np.nan)
    if f in ("argmax", "argmin", "argmax_old", "argmin_old"):
        pick = np.argmax if "max" in f else np.argmin
        safe = np.where(full[:, None], w, 0.0)
        place = pick(safe, axis=1) if f.endswith("old") else k - 1 - pick(safe[:, ::-1], axis=1)
        return np.where(full, place.astype(float), np.nan)
    if f == "mad":
        return np.where(full, np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=1), np.nan)
    fold = {"sum": np.sum, "mean": np.mean, "std": np.std, "var": np.var, "tsmin": np.min, "tsmax": np.max, "prod": np.prod}[f]
    return np.where(full, fold(w, axis=1), np.nan)


def _linear(a: np.ndarray, b: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """y = a * y before + b, from the first known seed on; a row with a missing input is passed over."""
    out, y = [], None
    for p, q, s in zip(a.tolist(), b.tolist(), seed.tolist()):
        if y is None:
            if s == s:
                y = s
            out.append(s)
            continue
        z = p * y + q
        if z == z:
            y = z
        out.append(z)
    return np.array(out, float)


# --- SQL ----------------------------------------------------------------------------------------------------


def rounded_sql(x: str) -> str:
    """A double cut to about ten significant places: sums differ in their last bits by the order of adding.

    The cut is off the half on purpose, where prices of two decimals, halved and averaged, come to lie. From 1e12 on, the
    first ten digits, the exponent and the sign are kept, again off the half; infinities stay.
    """
    cut = lambda scale: f"CAST(floor(({x}) * {scale} + 0.3137) AS DOUBLE) / {scale}"
    large = f"CAST(printf('%.9e', ({x}) * 1.0000000000137e0) AS DOUBLE)"
    return f"CASE WHEN abs({x}) >= 1e308 THEN {x} WHEN abs({x}) >= 1e12 THEN {large} WHEN abs({x}) >= 1e6 THEN {cut('1e0')} WHEN abs({x}) >= 1 THEN {cut('1e4')} ELSE {cut('1e9')} END + 0.0"


def to_sql(formulas: dict[str, str], bars_sql: str, rounding: bool = True, keep: tuple[str, ...] = ("symbol", "ts", "t")) -> str:
    """One statement that gives what :func:`with_series` gives, over bars made by ``bars_sql``."""
    nodes = {name: parse(text) for name, text in formulas.items()}
    names: dict[Node, str] = {}
    dialect = Oracle()
    ctes, last = [f"b0 AS ({bars_sql})"], "b0"
    for level, found in windows(nodes.values()).items():
        raw: dict[str, str] = {}
        made: list[tuple[Node, str]] = []
        folds = [n for n in found if n[1] == "lin"]
        for n in found:
            if n[1] == "lin":
                continue
            parts, value = dialect.window(n, names)
            made.append((n, value.format(*(raw.setdefault(p, f"w{level}_{len(raw)}") for p in parts))))
        inner = "".join(f", {p} AS {w}" for p, w in raw.items())
        outer = "".join(f", {value} AS s{level}_{i}" for i, (_, value) in enumerate(made))
        drop = f" EXCLUDE ({', '.join(raw.values())})" if raw else ""
        if made:
            ctes.append(f"b{level} AS (SELECT *{drop}{outer} FROM (SELECT *{inner} FROM {last}))")
            last = f"b{level}"
        names |= {n: f"s{level}_{i}" for i, (n, _) in enumerate(made)}
        if folds:
            args = [[dialect.scalar(x, names) for x in n[2]] for n in folds]
            put = "".join(f", {a} AS a{i}, {b} AS q{i}, {s} AS z{i}" for i, (a, b, s) in enumerate(args))
            ctes.append(f"i{level} AS MATERIALIZED (SELECT symbol, t{put} FROM {last})")
            first = "".join(f", z{i} AS y{i}, z{i} AS k{i}" for i in range(len(folds)))
            step = ""
            for i in range(len(folds)):
                y = f"CASE WHEN r.k{i} IS NULL THEN n.z{i} ELSE n.a{i} * r.k{i} + n.q{i} END"
                step += f", {y}, coalesce({y}, r.k{i})"
            ctes.append(f"r{level} AS (SELECT symbol, t{first} FROM i{level} WHERE t = 1 UNION ALL SELECT n.symbol, n.t{step} FROM r{level} r JOIN i{level} n ON n.symbol = r.symbol AND n.t = r.t + 1)")
            got = "".join(f", r.y{i} AS f{level}_{i}" for i in range(len(folds)))
            ctes.append(f"j{level} AS (SELECT b.*{got} FROM {last} b JOIN r{level} r ON b.symbol = r.symbol AND b.t = r.t)")
            last = f"j{level}"
            names |= {n: f"f{level}_{i}" for i, n in enumerate(folds)}
    plain = ", ".join([*keep, *(f"CAST({dialect.scalar(n, names)} AS DOUBLE) AS {name}" for name, n in nodes.items())])
    shown = ", ".join([*keep, *(f"{rounded_sql(name) if rounding else name} AS {name}" for name in nodes)])
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {shown} FROM (SELECT {plain} FROM {last})"
