"""Column expressions over composite sort keys (nulls first, as Spark sorts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(col: str, kind: str) -> Column:
    """A key column as a value that reaches the driver and comes back without
    loss whatever the time zones are: timestamps as microseconds or text."""
    if kind == "timestamp":
        return F.unix_micros(F.col(col))
    if kind == "timestamp_ntz":
        return F.col(col).cast("string")
    return F.col(col)


def literal(value, kind: str | None = None) -> Column:
    """The literal of an ``encoded`` value (foldable, so bounds reach the scan)."""
    if kind is None:
        return F.lit(value)
    if kind == "timestamp" and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def lex_le(cols: Sequence[str], values: Sequence, kinds: Sequence[str] | None = None) -> Column:
    """``(cols[0], ..., cols[j-1]) <= values`` in lexicographic order with
    nulls first, where ``j = len(values)`` may be shorter than ``cols`` (then
    the whole group sharing that prefix is included). Never null.

    The leading column also gets a plain bound, which Catalyst can push into
    a parquet scan; the OR-chain alone would not be pushed.
    """
    n = len(values)
    if n == 0:
        raise ValueError("empty key prefix")
    kinds = kinds or [None] * n

    def below(i: int, strictly: bool) -> Column:
        c = F.col(cols[i])
        if values[i] is None:
            return F.lit(False) if strictly else c.isNull()
        v = literal(values[i], kinds[i])
        return c.isNull() | ((c < v) if strictly else (c <= v))

    expr = below(n - 1, False)
    for i in range(n - 2, -1, -1):
        same = F.col(cols[i]).eqNullSafe(literal(values[i], kinds[i]))
        expr = below(i, True) | (same & expr)
    return F.coalesce(below(0, False) & expr, F.lit(False)) if n > 1 else F.coalesce(expr, F.lit(False))


def prefix_eq(cols: Sequence[str], values: Sequence, kinds: Sequence[str] | None = None) -> Column:
    """All of ``cols[i]`` equal to (or null like) ``values[i]`` for the given prefix (TRUE when empty)."""
    expr = F.lit(True)
    for i, (c, v) in enumerate(zip(cols, values)):
        expr = expr & F.col(c).eqNullSafe(literal(v, kinds[i] if kinds else None))
    return expr
