"""Factor definitions: a small typed grammar with canonical text, compiled to columns or, on a second path, to SQL.

A definition is a field of the panel or a call, such as cs_rank(div(ts_mean(total,5),high)). Calls are of three
kinds: element-wise, along an instrument's observations (ts_), and across a date's instruments (cs_).
Parts that several definitions share are computed once. Parts are computed in layers, as Spark does not nest
windows; a layer has one kind only, so that its windows share one partitioning.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.functions.safe import positive_log, ratio
from alidade.operators import crosssection as cs
from alidade.operators import timeseries as ts

#: Number of operands, and whether a number of observations follows.
CALLS: dict[str, tuple[int, bool]] = {
    "add": (2, False), "sub": (2, False), "mul": (2, False), "div": (2, False), "neg": (1, False), "abs": (1, False), "log": (1, False),
    "ts_lag": (1, True), "ts_delta": (1, True), "ts_ret": (1, True), "ts_mean": (1, True), "ts_sum": (1, True), "ts_std": (1, True), "ts_min": (1, True), "ts_max": (1, True), "ts_corr": (2, True),
    "cs_rank": (1, False), "cs_z": (1, False), "cs_demean": (1, False),
}
COMMUTES = {"add", "mul", "ts_corr"}
TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*|\d+|[(),])")


@dataclass(frozen=True)
class Expr:
    """A field if it has no operands, else a call."""

    op: str
    args: tuple[Expr, ...] = ()
    n: int = 0

    def __str__(self) -> str:
        """Canonical text: operands of commutative calls in order, no blanks."""
        if not self.args:
            return self.op
        inner = [str(a) for a in self.args]
        if self.op in COMMUTES:
            inner.sort()
        return f"{self.op}({','.join([*inner, *([str(self.n)] if self.n else [])])})"

    @property
    def kind(self) -> str:
        return self.op[:2] if self.op[:3] in ("ts_", "cs_") and self.args else "el"

    @property
    def name(self) -> str:
        """Its column."""
        return "e" + hashlib.sha256(str(self).encode()).hexdigest()[:12] if self.args else self.op

    def parts(self) -> Iterator[Expr]:
        """Itself and all that it is made of, operands first."""
        for a in self.args:
            yield from a.parts()
        yield self


def parse(text: str) -> Expr:
    """The expression of a definition; raises ValueError where the text is none."""
    tokens = TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"not a definition: {text!r}")
    expr, at = _read(tokens, 0)
    if at != len(tokens):
        raise ValueError(f"more follows in {text!r}")
    return expr


def _read(tokens: list[str], at: int) -> tuple[Expr, int]:
    if at >= len(tokens) or not tokens[at][0].isalpha():
        raise ValueError("a field or call is missing")
    op = tokens[at]
    if at + 1 == len(tokens) or tokens[at + 1] != "(":
        return Expr(op), at + 1
    if op not in CALLS:
        raise ValueError(f"unknown call {op}")
    count, counted = CALLS[op]
    args, n, at = [], 0, at + 1
    for k in range(count + counted):
        at += 1  # over the bracket or comma
        if k < count:
            arg, at = _read(tokens, at)
            args.append(arg)
        else:
            if at >= len(tokens) or not tokens[at].isdigit() or not int(tokens[at]):
                raise ValueError(f"{op} needs a number of observations")
            n, at = int(tokens[at]), at + 1
        if at >= len(tokens) or tokens[at] != (")" if k == count + counted - 1 else ","):
            raise ValueError(f"{op} takes {count} operands" + " and a number" * counted)
    return Expr(op, tuple(args), n), at + 1


def layers(exprs: Iterable[Expr], known: Iterable[str]) -> list[list[Expr]]:
    """All parts of exprs but known columns, in layers of one kind each; whatever is ready of a kind goes in one layer."""
    have = set(known)
    todo = {p.name: p for e in exprs for p in e.parts() if p.name not in have}
    missing = [p.op for p in todo.values() if not p.args]
    if missing:
        raise ValueError(f"the panel has no {', '.join(sorted(missing))}")
    out, kind = [], "el"
    while todo:
        ready = {k: [p for p in todo.values() if p.kind == k and all(a.name in have for a in p.args)] for k in ("el", "ts", "cs")}
        # Stay with a kind for as long as it has anything ready; element-wise parts cost no exchange.
        kind = "el" if ready["el"] else kind if ready.get(kind) else "ts" if ready["ts"] else "cs"
        out.append(ready[kind])
        for p in ready[kind]:
            have.add(p.name)
            del todo[p.name]
    return out


def column(e: Expr) -> Column:
    """One part over the columns of its operands."""
    x, y = (*(F.col(a.name) for a in e.args), None)[:2]
    match e.op:
        case "add":
            return x + y
        case "sub":
            return x - y
        case "mul":
            return x * y
        case "div":
            return ratio(x, y)
        case "neg":
            return -x
        case "abs":
            return F.abs(x)
        case "log":
            return positive_log(x)
        case "ts_lag":
            return ts.lagged(x, e.n)
        case "ts_delta":
            return ts.change(x, e.n)
        case "ts_ret":
            return ts.period_return(x, e.n)
        case "ts_corr":
            return ts.rolling_corr(x, y, e.n)
        case "cs_rank":
            return cs.relative_rank(x)
        case "cs_z":
            day = Window.partitionBy("dt")
            spread = F.stddev_pop(x).over(day)
            return F.when(spread > 1e-12, ratio(x - F.avg(x).over(day), spread))
        case "cs_demean":
            return x - F.avg(x).over(Window.partitionBy("dt"))
        case _:
            return ts.rolling(e.op[3:], x, e.n)


def evaluate(panel: DataFrame, definitions: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """instrument, dt, the kept columns, and one double column for each definition, named by its hash (see Expr.name)."""
    exprs = [parse(d) for d in definitions]
    fields = sorted({p.op for e in exprs for p in e.parts() if not p.args})
    rows = panel.select("instrument", "dt", *keep, *(F.col(f).cast("double").alias(f) for f in fields if f not in keep))
    for layer in layers(exprs, rows.columns):
        rows = rows.withColumns({p.name: column(p) for p in layer})
    return rows.select("instrument", "dt", *keep, *dict.fromkeys(e.name for e in exprs))


def long_values(wide: DataFrame, definitions: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """factor_id (the hash of the canonical text), instrument, dt, value and the kept columns, from evaluate's result: no shuffle."""
    from alidade.operators.audit import factor_id

    exprs = {str(parse(d)): parse(d) for d in definitions}
    each = F.explode(F.array(*(F.struct(F.lit(factor_id(t)).alias("factor_id"), F.col(e.name).cast("double").alias("value")) for t, e in exprs.items())))
    return wide.select("instrument", "dt", *keep, each.alias("_f")).select("_f.factor_id", "instrument", "dt", "_f.value", *keep)


# The second path: the same definitions as SQL text, made without the column code above.

_SQL = {
    "add": "{x} + {y}", "sub": "{x} - {y}", "mul": "{x} * {y}", "div": "{x} / nullif({y}, 0)", "neg": "-{x}", "abs": "abs({x})", "log": "CASE WHEN {x} > 0 THEN ln({x}) END",
    "ts_lag": "lag({x}, {n}) OVER ({h})", "ts_delta": "{x} - lag({x}, {n}) OVER ({h})", "ts_ret": "{x} / nullif(lag({x}, {n}) OVER ({h}), 0) - 1",
    "ts_mean": "CASE WHEN count({x}) OVER ({w}) = {n} THEN avg({x}) OVER ({w}) END", "ts_sum": "CASE WHEN count({x}) OVER ({w}) = {n} THEN sum({x}) OVER ({w}) END",
    "ts_std": "CASE WHEN count({x}) OVER ({w}) = {n} THEN stddev_pop({x}) OVER ({w}) END", "ts_min": "CASE WHEN count({x}) OVER ({w}) = {n} THEN min({x}) OVER ({w}) END",
    "ts_max": "CASE WHEN count({x}) OVER ({w}) = {n} THEN max({x}) OVER ({w}) END",
    "ts_corr": "CASE WHEN count({x} + {y}) OVER ({w}) = {n} AND stddev_pop({xy}) OVER ({w}) * stddev_pop({yx}) OVER ({w}) > 1e-12"
    " THEN covar_pop({xy}, {yx}) OVER ({w}) / nullif(stddev_pop({xy}) OVER ({w}) * stddev_pop({yx}) OVER ({w}), 0) END",
    "cs_rank": "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY dt ORDER BY round({x}, 9) NULLS LAST)"
    " + (count({x}) OVER (PARTITION BY dt, round({x}, 9)) - 1) / CAST(2 AS DOUBLE)) / count({x}) OVER (PARTITION BY dt) END",
    "cs_z": "CASE WHEN stddev_pop({x}) OVER (PARTITION BY dt) > 1e-12 THEN ({x} - avg({x}) OVER (PARTITION BY dt)) / nullif(stddev_pop({x}) OVER (PARTITION BY dt), 0) END",
    "cs_demean": "{x} - avg({x}) OVER (PARTITION BY dt)",
}


def to_sql(definitions: list[str], panel: str, keep: tuple[str, ...] = ()) -> str:
    """A query over the relation `panel` with the result of evaluate; common to Spark and other engines with ANSI windows."""
    exprs = [parse(d) for d in definitions]
    fields = sorted({p.op for e in exprs for p in e.parts() if not p.args})
    steps = [f"l0 AS (SELECT {', '.join(['instrument', 'dt', *keep, *(f'CAST({f} AS DOUBLE) AS {f}' for f in fields if f not in keep)])} FROM {panel})"]
    for k, layer in enumerate(layers(exprs, ["instrument", "dt", *keep, *fields])):
        made = []
        for e in layer:
            names = [a.name for a in e.args]
            x, y = names[0], names[-1]
            h = "PARTITION BY instrument ORDER BY dt"
            made.append(
                _SQL[e.op].format(
                    x=x, y=y, n=e.n, h=h, w=f"{h} ROWS BETWEEN {max(e.n - 1, 0)} PRECEDING AND CURRENT ROW", xy=f"CASE WHEN {y} IS NOT NULL THEN {x} END", yx=f"CASE WHEN {x} IS NOT NULL THEN {y} END"
                )
                + f" AS {e.name}"
            )
        steps.append(f"l{k + 1} AS (SELECT *, {', '.join(made)} FROM l{k})")
    return f"WITH {', '.join(steps)} SELECT {', '.join(['instrument', 'dt', *keep, *dict.fromkeys(e.name for e in exprs)])} FROM l{len(steps) - 1}"


def generate(fields: list[str], count: int, seed: int, depth: int = 3, lengths: tuple[int, ...] = (2, 3, 5)) -> list[str]:
    """`count` distinct canonical definitions, drawn with a seed; each ends across the date, so that it compares instruments."""
    rng, out = random.Random(seed), {}

    def draw(left: int) -> Expr:
        if left == 0 or rng.random() < 0.2:
            return Expr(rng.choice(fields))
        op = rng.choice([c for c in CALLS if not c.startswith("cs_")])
        args, counted = CALLS[op]
        operands = tuple(draw(left - 1) for _ in range(args))
        if args == 2 and str(operands[0]) == str(operands[1]):  # x - x and the like tell nothing
            operands = (operands[0], Expr(rng.choice([f for f in fields if f != str(operands[0])] or fields)))
        return Expr(op, operands, rng.choice([n for n in lengths if n > 2 or op not in ("ts_corr", "ts_std")]) if counted else 0)

    for _ in range(count * 200):
        e = Expr(rng.choice(("cs_rank", "cs_z")), (draw(depth - 1),))
        out.setdefault(str(e))
        if len(out) == count:
            break
    return list(out)
