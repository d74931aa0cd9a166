"""Arithmetic whose results have the widest type of their kind and never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.types import FRACTIONAL, NARROW, is_number


def promoted(c: Column, t: T.DataType, is_leaf: bool) -> tuple[Column, T.DataType]:
    """TINYINT and SMALLINT become INT, INT becomes BIGINT, FLOAT becomes DOUBLE; a null or non-number leaf is 0."""
    if not is_number(t):
        return F.lit(0), T.IntegerType()
    wide = T.DoubleType() if isinstance(t, FRACTIONAL) else T.IntegerType() if isinstance(t, NARROW) else T.LongType()
    c = c.cast("string").cast("double") if isinstance(t, T.FloatType) and not is_leaf else c.cast(wide)
    return (F.coalesce(c, F.lit(0).cast(wide)) if is_leaf else c), wide


def arithmetic(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, T.DataType]:
    """``a op b`` of promoted operands. Overflow of 64 bits wraps; division by zero is null; / is always a double."""
    if op == "/":
        return F.try_divide(a.cast("double"), b.cast("double")), T.DoubleType()
    real = isinstance(ta, T.DoubleType) or isinstance(tb, T.DoubleType)
    wide = T.DoubleType() if real else T.IntegerType() if isinstance(ta, T.IntegerType) and isinstance(tb, T.IntegerType) and op in "+-*%" else T.LongType()
    a, b = a.cast(wide), b.cast(wide)
    if op == "%":
        return F.try_mod(a, b), wide
    if op == "DIV":
        if real:
            q = F.try_divide(a, b)
            return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("bigint"), T.LongType()
        return _div(a.cast("bigint"), b.cast("bigint")), T.LongType()
    if real:
        return {"+": a + b, "-": a - b, "*": a * b}[op], wide
    return _wrapping(op, a.cast("bigint"), b.cast("bigint")), T.LongType()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def _wrapping(op: str, a: Column, b: Column) -> Column:
    """The 64-bit result where it fits; a sum or difference beyond wraps, by way of decimals."""
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    if op == "*":
        return tried  # a product beyond 64 bits is null
    x, y = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    d = x + y if op == "+" else x - y
    span = F.lit("18446744073709551616").cast("decimal(21,0)")
    low = F.when(d > F.lit("9223372036854775807").cast("decimal(21,0)"), d - span).otherwise(d + span).cast("bigint")
    return F.when(tried.isNotNull() | a.isNull() | b.isNull(), tried).otherwise(low)
