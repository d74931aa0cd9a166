"""Binding of parsed expressions to columns of a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import QueryError
from rivulet.functions.aggregates import AGGREGATES, Frame, aggregate
from rivulet.functions.arithmetic import arithmetic, promoted
from rivulet.functions.scalars import SCALARS, cast
from rivulet.plans.nodes import Arith, Call, Cast, Compare, Const, Field, Index, Item, Logic, Not, show
from rivulet.types import is_number, spark_type

Typed = tuple[Column, T.DataType]
_CONST = {"string": "string", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "boolean": "boolean"}


def visible(df: DataFrame) -> list[str]:
    """The columns that a query sees; those with two leading underscores are the engine's own."""
    return [c for c in df.columns if not c.startswith("__")]


class Binder:
    """Turns expressions into columns of ``df``.

    ``tuples``: names by which this row may be addressed. ``frame``: where aggregates look; None forbids
    them. ``functions``: registered functions by name.
    """

    def __init__(self, df: DataFrame, tuples: Iterable[str] = (), frame: Frame | None = None, functions: dict[str, Any] | None = None, context: dict[str, Any] | None = None):
        self.df, self.tuples, self.frame, self.functions, self.context = df, set(tuples), frame, functions or {}, context or {}

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType

    def field(self, f: Field) -> Typed:
        """A path; missing fields, keys and elements are null."""
        parts = list(f.parts)
        if parts[0][0] == "_context":
            return self._context(parts[1][0] if len(parts) > 1 else "")
        if len(parts) > 1 and parts[0][0] in self.tuples and not parts[0][1]:
            parts = parts[1:]
        names = {c.lower(): c for c in visible(self.df)}
        name, subs = parts[0]
        if name.lower() not in names:
            return F.lit(None), T.NullType()
        own = names[name.lower()]
        c, t = F.col(f"`{own}`"), self.df.schema[own].dataType
        for k, (name, subs) in enumerate(parts):
            if k:
                if not isinstance(t, T.StructType) or name not in t.names:
                    return F.lit(None), T.NullType()
                c, t = c.getField(name), t[name].dataType
            for s in subs:
                c, t = self._element(c, t, s)
        return c, t

    def _element(self, c: Column, t: T.DataType, sub: Any) -> Typed:
        key = self.value(sub)[0]
        if isinstance(t, T.ArrayType):
            return F.get(c, key.cast("int")), t.elementType
        if isinstance(t, T.MapType):
            return F.try_element_at(c, key.cast(t.keyType)), t.valueType
        return F.lit(None), T.NullType()

    def _context(self, name: str) -> Typed:
        if name in ("task_index", "task_id"):
            return F.spark_partition_id(), T.IntegerType()
        return F.lit(self.context.get(name)).cast("string"), T.StringType()

    def value(self, x: Any) -> Typed:
        """(column, type) of an expression."""
        if isinstance(x, Const):
            c = F.lit(x.value).cast(_CONST[x.type])
            return c, self.type_of(c)
        if isinstance(x, Field):
            return self.field(x)
        if isinstance(x, Arith):
            (a, ta), (b, tb) = (self._operand(v) for v in (x.left, x.right))
            return arithmetic(x.op, a, ta, b, tb)
        if isinstance(x, Index):
            return self._element(*self.value(x.value), x.key)
        if isinstance(x, Cast):
            c, t = self.value(x.value)
            to = spark_type((x.type, x.format))
            return cast(c, t, to, x.format), to
        if isinstance(x, Call):
            return self._call(x)
        raise QueryError(f"no value: {show(x)}")

    def _operand(self, x: Any) -> Typed:
        c, t = self.value(x)
        return promoted(c, t, not isinstance(x, Arith))

    def _call(self, x: Call) -> Typed:
        if x.name in AGGREGATES:
            if self.frame is None:
                raise QueryError(f"{x.name} is not allowed here")
            if len(x.args) > 1:
                raise QueryError(f"{x.name}: wrong number of arguments")
            inner = Binder(self.df, self.tuples, None, self.functions, self.context)
            return aggregate(self.frame, x.name, inner.value(x.args[0]) if x.args else None, x.distinct)
        if x.distinct:
            raise QueryError(f"DISTINCT is not allowed in {x.name}")
        if x.name in self.functions:
            return self.functions[x.name].bind(self, x)
        if x.name not in SCALARS:
            raise QueryError(f"unknown function {x.name}")
        if x.name == "regexp_extract" and len(x.args) == 3 and all(isinstance(a, Const) for a in x.args[1:]):
            if not 0 <= x.args[2].value <= re.compile(x.args[1].value).groups:
                return F.lit(None).cast("string"), T.StringType()
        return SCALARS[x.name]([self.value(a) for a in x.args])

    # conditions have two values: what is null, or can't be compared, is false at its leaf
    def condition(self, x: Any, negated: bool = False) -> Column:
        """A condition for ``where``. Only below a NOT must a null be made false; elsewhere it counts as false
        anyway, and a plain comparison is pushed down to the scan."""
        if isinstance(x, Logic):
            out = self.condition(x.values[0], negated)
            for v in x.values[1:]:
                own = self.condition(v, negated)
                out = out & own if x.op == "AND" else out | own
            return out
        if isinstance(x, Not):
            if isinstance(x.value, Compare) and x.value.op == "NULL":
                return self.value(x.value.left)[0].isNotNull()
            return ~self.condition(x.value, True)
        if isinstance(x, Compare):
            own = self._compare(x)
        else:
            c, t = self.value(x)
            own = c if isinstance(t, T.BooleanType) else F.lit(False)
        return F.coalesce(own, F.lit(False)) if negated else own

    def _compare(self, x: Compare) -> Column:
        c, t = self.value(x.left)
        if x.op == "NULL":
            return c.isNull()
        if isinstance(t, T.NullType):
            return F.lit(False)
        if x.op in ("LIKE", "REGEXP"):
            if not isinstance(t, T.StringType):
                return F.lit(False)
            pattern = x.right.value
            if x.op == "LIKE":  # the rest of the pattern is a regular expression as it stands
                pattern = re.sub("_+", lambda m: f".{{{len(m[0])}}}", pattern).replace("%", ".*")
            return c.rlike(rf"\A(?:{pattern})\z")
        if x.op in ("IN", "ALL"):
            if isinstance(t, T.ArrayType):
                own = [v for v in x.right if self._alike(t.elementType, self.type_of(F.lit(v.value)))]
                if not own or (x.op == "ALL" and len(own) < len(x.right)):
                    return F.lit(False)
                wanted = F.array(*[F.lit(v.value).cast(t.elementType) for v in own])
                return F.arrays_overlap(c, wanted) if x.op == "IN" else F.size(F.array_except(wanted, c)) == 0
            if x.op == "ALL":
                return F.lit(False)
            own = [v.value for v in x.right if self._alike(t, self.type_of(F.lit(v.value)))]
            return c.isin(own) if own else F.lit(False)
        if x.op == "BETWEEN":
            (a, ta), (b, tb) = map(self.value, x.right)
            return c.between(a, b) if self._alike(t, ta) and self._alike(t, tb) else F.lit(False)
        d, td = self.value(x.right)
        if not self._alike(t, td):
            return F.lit(False)
        return {"=": c == d, "<>": c != d, "<": c < d, "<=": c <= d, ">": c > d, ">=": c >= d}[x.op]

    @staticmethod
    def _alike(a: T.DataType, b: T.DataType) -> bool:
        return is_number(a) and is_number(b) or type(a) is type(b)

    def items(self, items: Iterable[Item]) -> list[tuple[str, Column]]:
        """(name, column) of each output field; * and tuple.* stand for all fields not named before or after."""
        out: list[tuple[str, Column]] = []
        for item in items:
            x = item.value
            if isinstance(x, Field) and x.star:
                out.extend((c, F.col(f"`{c}`")) for c in visible(self.df) if len(x.parts) == 1 or x.parts[0][0] in self.tuples)
                continue
            out.append((item.alias or default_name(x), self.value(x)[0]))
        names = [n for n, _ in out]
        for n in names:
            if names.count(n) > 1:
                raise QueryError(f"more than one field is named {n}")
        return out


def default_name(x: Any) -> str:
    """The name of a field without alias: its own, that of a cast's field, or the function's."""
    if isinstance(x, Field):
        return x.name
    if isinstance(x, Cast | Index):
        return default_name(x.value)
    if isinstance(x, Call):
        return x.name
    raise QueryError(f"{show(x)} needs an alias")


def has_aggregate(x: Any, more: Callable[[str], bool] = lambda _: False) -> bool:
    if isinstance(x, Call):
        return x.name in AGGREGATES or more(x.name) or any(has_aggregate(a, more) for a in x.args)
    if isinstance(x, Arith):
        return has_aggregate(x.left, more) or has_aggregate(x.right, more)
    return isinstance(x, Cast | Index) and has_aggregate(x.value, more)
