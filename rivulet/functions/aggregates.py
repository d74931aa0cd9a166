"""Aggregate functions over any frame: a window, or a group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import QueryError
from rivulet.types import INTEGRAL, is_number

Typed = tuple[Column, T.DataType]
AGGREGATES = ("count", "sum", "avg", "collect_list", "collect_set")


@dataclass
class Frame:
    """Where an aggregate looks. ``over`` turns a Spark aggregate into a column."""

    over: Callable[[Column], Column]

    def count(self, x: Column) -> Column:
        return self.over(F.count(x))

    def total(self, x: Column) -> Column:
        return self.over(F.sum(x))

    def values(self, x: Column) -> Column:
        """The non-null values in order of arrival."""
        return self.over(F.collect_list(x))


class GroupFrame(Frame):
    """A group of ``groupBy``: rows come in any order, so values are sorted by their place of arrival."""

    def __init__(self, seq: str):
        super().__init__(lambda c: c)
        self.seq = seq

    def values(self, x: Column) -> Column:
        own = F.collect_list(F.when(x.isNotNull(), F.struct(F.col(self.seq).alias("s"), x.alias("x"))))
        return F.transform(F.array_sort(own, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0)), lambda p: p["x"])


class TimeFrame(Frame):
    """The rows of the last ``length`` seconds by ``second`` that have arrived so far.

    A range of whole seconds would also hold rows of the same second that arrive later. Counts and totals
    are of the seconds before, and of the rows so far in the row's own second; values are filtered by place.
    """

    def __init__(self, keys: list[Column], second: Column, seq: str, length: int):
        self.second, self.seq = second, seq
        by = Window.partitionBy(*keys).orderBy(second)
        self.range, self.before = by.rangeBetween(-length, 0), by.rangeBetween(-length, -1)
        self.same = Window.partitionBy(*keys, second).orderBy(F.col(seq)).rowsBetween(Window.unboundedPreceding, 0)
        super().__init__(lambda c: c.over(self.range))

    def count(self, x: Column) -> Column:
        return F.count(x).over(self.before) + F.count(x).over(self.same)

    def total(self, x: Column) -> Column:
        before, same = F.sum(x).over(self.before), F.sum(x).over(self.same)
        return F.coalesce(before + same, before, same)

    def values(self, x: Column) -> Column:
        rows = F.collect_list(F.when(x.isNotNull(), F.struct(self.second.alias("t"), F.col(self.seq).alias("s"), x.alias("x")))).over(self.range)
        seen = F.filter(rows, lambda r: (r["t"] < self.second) | (r["s"] <= F.col(self.seq)))
        in_order = F.array_sort(seen, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))
        return F.transform(in_order, lambda r: r["x"])


class NotMergeable(Exception):
    """A frame of totals was asked for values."""


class BlockFrame(Frame):
    """Counts and totals as those of TimeFrame, each row being added twice at most, however many rows a window has.

    Time is cut into blocks as long as a window, so that a window is the begin of one block and the end of the
    one before. Each block (``keys``) also holds copies of the rows of the block before it. ``moment`` is a
    row's second, and of a copy the second in which it has left. The begin is summed up forwards and the
    end backwards: nothing is taken out again, so totals of doubles stay as exact as sums are.
    """

    def __init__(self, keys: list[Column], moment: Column, seq: str, copy: Column):
        self.copy = copy
        self.begin = Window.partitionBy(*keys).orderBy(moment, F.col(seq)).rowsBetween(Window.unboundedPreceding, 0)
        self.end = Window.partitionBy(*keys).orderBy(moment.desc()).rangeBetween(Window.unboundedPreceding, -1)
        super().__init__(lambda c: c)

    def count(self, x: Column) -> Column:
        return F.count(F.when(~self.copy, x)).over(self.begin) + F.count(F.when(self.copy, x)).over(self.end)

    def total(self, x: Column) -> Column:
        begin, end = F.sum(F.when(~self.copy, x)).over(self.begin), F.sum(F.when(self.copy, x)).over(self.end)
        return F.coalesce(end + begin, end, begin)

    def values(self, x: Column) -> Column:
        raise NotMergeable


_LOW = 0xFFFFFFFF


def _halves(high: Column, low: Column) -> Column:
    """high * 2 ** 32 + low as 64 bits, which wrap."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def wrapped_total(frame: Frame, x: Column) -> Column:
    """The sum of a BIGINT column modulo 2 ** 64, from the sums of its halves: neither can overflow below two thousand million rows."""
    return _halves(frame.total(F.shiftright(x, 32)), frame.total(x.bitwiseAND(F.lit(_LOW))))


def wrapped_sum(values: Column) -> Column:
    """The sum of an array of BIGINT modulo 2 ** 64."""
    zero = F.lit(0).cast("bigint")
    high = F.aggregate(values, zero, lambda a, b: a + F.shiftright(b, 32))
    return _halves(high, F.aggregate(values, zero, lambda a, b: a + b.bitwiseAND(F.lit(_LOW))))


def aggregate(frame: Frame, name: str, arg: Typed | None, distinct: bool) -> Typed:
    """count, sum, avg, collect_list, collect_set of ``arg`` in ``frame``; ``distinct`` takes each value once.

    Sums of integers are BIGINT, which wrap, and 0 where there is no value; averages of integers are whole, null
    where there is no value.
    """
    if name == "count" and arg is None:
        return frame.count(F.lit(1)), T.LongType()
    if arg is None:
        raise QueryError(f"{name} needs an argument")
    x, t = arg
    if name in ("collect_list", "collect_set"):
        own = frame.values(x)
        return (F.array_distinct(own) if name == "collect_set" or distinct else own), T.ArrayType(t)
    if name == "count":
        return (F.size(F.array_distinct(frame.values(x))).cast("bigint") if distinct else frame.count(x)), T.LongType()
    whole = isinstance(t, INTEGRAL)
    kind = T.LongType() if whole else T.DoubleType()
    x = x.cast(kind) if is_number(t) else F.lit(None).cast("bigint")
    kind = kind if is_number(t) else T.LongType()
    whole = isinstance(kind, T.LongType)
    zero = F.lit(0).cast(kind)
    if distinct:
        own = F.array_distinct(frame.values(x))
        total, n = wrapped_sum(own) if whole else F.aggregate(own, zero, lambda a, b: a + b), F.size(own).cast("bigint")
    else:
        # 32 bits and less can't overflow
        total, n = F.coalesce(wrapped_total(frame, x) if isinstance(t, T.LongType) else frame.total(x), zero), None
    if name == "sum":
        return total, kind
    n = frame.count(x) if n is None else n
    if whole:
        return F.call_function("div", total, F.nullif(n, F.lit(0).cast("bigint"))), T.LongType()
    return F.try_divide(total, n.cast("double")), T.DoubleType()
