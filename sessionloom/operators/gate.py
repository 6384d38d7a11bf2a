"""Regime conditions: a small language parsed to a tree and compiled to columns.

``vix>30``, ``spy>=spy_200dma``, ``gold_ret_prev != 0``, ``tnx_up``.  A term is a
number or a series with a suffix: none (close), ``_prev``, ``_ret``, ``_ret_prev`` or
``_<N>dma``.  Conditions joined by ``&`` and ``|`` (with brackets, ``&`` binding
tighter) and sums and products of terms are accepted where ``extended`` is set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.sources.bars import view_name


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Feature:
    series: str
    kind: str  # val, prev, ret, ret_prev, dma
    n: int = 0

    @property
    def column(self) -> str:
        return f"{self.series}__{self.kind}{self.n or ''}"


@dataclass(frozen=True)
class Op:
    name: str
    left: object
    right: object


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+)|([a-z][a-z0-9_]*|\d+[a-z][a-z0-9_]*)|(>=|<=|==|!=|[><&|()+*/-]))")
_NAME = re.compile(r"([a-z0-9]+?)(_ret_prev|_prev|_ret|_(\d+)dma)?")


def _feature(name: str) -> Feature:
    m = _NAME.fullmatch(name)
    if not m:
        raise ValueError(f"not a term: {name!r}")
    if m[3]:
        return Feature(m[1], "dma", int(m[3]))
    return Feature(m[1], (m[2] or "_val")[1:])


def parse(when: str, extended: bool = False):
    """The tree of a condition; ValueError where it is none."""
    text, at, tokens = when.strip().lower(), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a condition: {when!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos][3] if pos < len(tokens) else None

    def term():
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"a term is missing in {when!r}")
        m = tokens[pos]
        if m[1]:
            pos += 1
            return Number(float(m[1]))
        if m[2]:
            pos += 1
            if flag := re.fullmatch(r"([a-z0-9]+)_(up|down)", m[2]):
                return Op(">" if flag[2] == "up" else "<", Feature(flag[1], "ret"), Number(0.0))
            return _feature(m[2])
        if m[3] == "-":
            pos += 1
            inner = term()
            return Number(-inner.value) if isinstance(inner, Number) else Op("*", Number(-1.0), inner)
        if m[3] == "(" and extended:
            pos += 1
            inner = disjunction()
            if peek() != ")":
                raise ValueError(f"a bracket is open in {when!r}")
            pos += 1
            return inner
        raise ValueError(f"not a condition: {when!r}")

    def chain(lower, ops):
        def level():
            nonlocal pos
            left = lower()
            while peek() in ops:
                name = peek()
                pos += 1
                left = Op(name, left, lower())
            return left

        return level

    arithmetic = chain(chain(term, ("*", "/")), ("+", "-")) if extended else term

    def comparison():
        nonlocal pos
        left = arithmetic()
        if peek() in (">", "<", ">=", "<=", "==", "!="):
            name = peek()
            pos += 1
            return Op(name, left, arithmetic())
        return left

    disjunction = chain(chain(comparison, ("&",)), ("|",))
    tree = disjunction() if extended else comparison()
    if pos != len(tokens) or not (isinstance(tree, Op) and tree.name in (">", "<", ">=", "<=", "==", "!=", "&", "|")):
        raise ValueError(f"not a condition: {when!r}")
    return tree


def features(tree) -> set[Feature]:
    if isinstance(tree, Feature):
        return {tree}
    return features(tree.left) | features(tree.right) if isinstance(tree, Op) else set()


def column(tree, unequal_null: bool = False) -> Column:
    """The condition over feature columns; ``unequal_null``: ``!=`` holds where a side is unknown."""
    if isinstance(tree, Number):
        return F.lit(tree.value)
    if isinstance(tree, Feature):
        return F.col(tree.column)
    a, b = column(tree.left, unequal_null), column(tree.right, unequal_null)
    if tree.name == "!=":
        return F.coalesce(a != b, F.lit(True)) if unequal_null else a != b
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b}[tree.name] if tree.name in (">", "<", ">=", "<=", "==") else {"&": a & b, "|": a | b}[tree.name] if tree.name in "&|" else {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[tree.name]()


def feature_column(f: Feature, least: int | None = 1) -> Column:
    """A feature on its series' own history of fixed-point closes; averages count ``least`` sessions."""
    price = S.to_price_col("close")
    if f.kind == "val":
        return price
    if f.kind == "prev":
        return F.lag(price).over(S.by_symbol())
    if f.kind == "ret":
        return S.lag_ret()
    if f.kind == "ret_prev":
        return F.lag(F.col("close").cast("double"), 1).over(S.by_symbol()) / F.lag(F.col("close").cast("double"), 2).over(S.by_symbol()) - 1.0
    return S.rolling_mean("close", f.n, least)


def gated(left: DataFrame, bars: DataFrame, wanted: set[Feature], date: str) -> DataFrame:
    """``left`` with the features of every series, by exact date; a missing date is null.

    All series are read once: each kind of feature is one column of them all, which a
    group by date turns into a row of all that is wanted.
    """
    if not wanted:
        return left
    view = view_name(F.col("symbol"))
    kinds = {(f.kind, f.n): f for f in wanted}
    name = lambda f: f"__{f.kind}_{f.n}"
    own = bars.where(view.isin(*sorted({f.series for f in wanted}))).select(view.alias("__view"), "symbol", F.col("date").alias(date), *(feature_column(f).alias(name(f)) for f in (kinds[k] for k in sorted(kinds, key=str))))
    day = own.groupBy(date).agg(*(F.max(F.when(F.col("__view") == f.series, F.col(name(f)))).alias(f.column) for f in sorted(wanted, key=lambda f: f.column)))
    return left.join(day, date, "left")
