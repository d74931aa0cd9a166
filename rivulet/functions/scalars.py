"""The scalar functions, as Spark expressions with this language's rules for nulls and wrong types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import QueryError
from rivulet.types import FRACTIONAL, INTEGRAL, is_number

Typed = tuple[Column, T.DataType]


def _arguments(name: str, args: list, low: int, high: int | None = None) -> None:
    if len(args) < low or (high is not None and len(args) > high):
        raise QueryError(f"{name}: wrong number of arguments ({len(args)})")


def concat(args: list[Typed]) -> Typed:
    """All arguments as text; nulls are skipped."""
    _arguments("concat", args, 2)
    return F.concat_ws("", *[c.cast("string") for c, _ in args]), T.StringType()


def ifnull(args: list[Typed]) -> Typed:
    _arguments("ifnull", args, 2, 2)
    (a, ta), (b, tb) = args
    if isinstance(ta, T.NullType):
        return b, tb
    if type(ta) is not type(tb) and not isinstance(tb, T.NullType) and not (is_number(ta) and is_number(tb)):
        return F.coalesce(a.cast("string"), b.cast("string")), T.StringType()
    return F.coalesce(a, b), tb if is_number(ta) and isinstance(tb, FRACTIONAL) else ta


def split(args: list[Typed]) -> Typed:
    """Cuts at a regular expression; empty parts at the end go, but the empty text gives itself."""
    _arguments("split", args, 2, 2)
    (s, ts), (pattern, _) = args
    if not isinstance(ts, T.StringType):
        return F.lit(None).cast("array<string>"), T.ArrayType(T.StringType())
    parts = F.split(s, pattern)
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.when(s == "", F.array(F.lit(""))).otherwise(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0)))), T.ArrayType(T.StringType())


def regexp_extract(args: list[Typed]) -> Typed:
    """The group of the first match, of the whole match without a number; null where nothing matches."""
    _arguments("regexp_extract", args, 2, 3)
    (s, _), (pattern, _) = args[:2]
    group = F.coalesce(args[2][0].cast("int"), F.lit(0)) if len(args) == 3 else F.lit(0)
    return F.when(F.rlike(s, pattern), F.call_function("regexp_extract", s.cast("string"), pattern, group)), T.StringType()


def parse_url(args: list[Typed]) -> Typed:
    """Parts of a url; a malformed one is null. QUERY needs a key, whose value holds no further = sign; an unknown part gives the url."""
    _arguments("parse_url", args, 2, 3)
    (url, _), (part, _) = args[:2]
    key = args[2][0] if len(args) == 3 else None
    plain = F.try_parse_url(url, part)
    if key is not None:
        pairs = F.split(F.try_parse_url(url, F.lit("QUERY")), "&")
        own = F.filter(F.transform(pairs, lambda p: F.split(p, "=")), lambda kv: (F.size(kv) == 2) & (kv[0] == key))
        query = F.get(own, F.lit(0))[1]
    else:
        query = F.lit(None).cast("string")
    known = part.isin("HOST", "PATH", "QUERY", "REF", "PROTOCOL", "AUTHORITY", "FILE", "USERINFO")
    valid = F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull()
    return F.when(valid, F.when(part == "QUERY", query).when(known, plain).otherwise(url)), T.StringType()


def date_format(args: list[Typed]) -> Typed:
    _arguments("date_format", args, 2, 2)
    (c, t), (pattern, _) = args
    if isinstance(t, T.TimestampType | T.DateType):
        return F.call_function("date_format", c, pattern), T.StringType()
    return c, t


def _real(a: Typed) -> Column:
    """A number as double, null for anything else."""
    return a[0].cast("double") if is_number(a[1]) else F.lit(None).cast("double")


def distance(args: list[Typed]) -> Typed:
    """Euclidean distance of two points; 0 where an argument is no number."""
    _arguments("distance", args, 4, 4)
    x1, y1, x2, y2 = map(_real, args)
    return F.coalesce(F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)), F.lit(0.0)), T.DoubleType()


def _guarded(f: Callable[[Column], Column]) -> Callable[[list[Typed]], Typed]:
    def of(args: list[Typed]) -> Typed:
        _arguments(f.__name__, args, 1, 1)
        return F.coalesce(f(_real(args[0])), F.lit(0.0)), T.DoubleType()

    return of


def size(args: list[Typed]) -> Typed:
    _arguments("size", args, 1, 1)
    c, t = args[0]
    return (F.coalesce(F.size(c), F.lit(0)) if isinstance(t, T.ArrayType | T.MapType) else F.lit(0)), T.IntegerType()


def slice_list(args: list[Typed]) -> Typed:
    """Elements from one place up to another, the latter excluded; negative places count from the end, all are clamped."""
    _arguments("slice", args, 2, 3)
    c, t = args[0]
    if not isinstance(t, T.ArrayType):
        return F.lit(None).cast("array<string>"), T.ArrayType(T.StringType())
    n = F.size(c)

    def place(x: Column) -> Column:
        x = x.cast("int")
        return F.greatest(F.least(F.when(x < 0, n + x).otherwise(x), n), F.lit(0))

    begin = place(args[1][0])
    end = place(args[2][0]) if len(args) == 3 else n
    return F.slice(c, begin + 1, F.greatest(end - begin, F.lit(0))), t


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}


def cast(c: Column, t: T.DataType, to: T.DataType, form: str | None) -> Column:
    """Null where a value can't be converted. Integers wrap to narrower ones; timestamps are epoch seconds as numbers."""
    if isinstance(to, T.StringType):
        return c.cast("string")
    if isinstance(to, T.BooleanType):
        if isinstance(t, T.StringType):
            return F.length(c) > 0
        return c if isinstance(t, T.BooleanType) else c != 0 if is_number(t) else F.lit(None).cast("boolean")
    if isinstance(to, T.TimestampType):
        if isinstance(t, T.StringType):
            return F.try_to_timestamp(c, F.lit(form)) if form else F.timestamp_seconds(F.when(c.rlike(r"\A[+-]?\d+\z"), c.try_cast("bigint")))
        return c if isinstance(t, T.TimestampType) else F.timestamp_seconds(c.cast("bigint")) if is_number(t) else F.lit(None).cast("timestamp")
    if isinstance(t, T.TimestampType):
        c, t = F.unix_seconds(c), T.LongType()
    if isinstance(t, T.BooleanType):
        c, t = c.cast("int"), T.IntegerType()
    if isinstance(t, T.StringType):
        if isinstance(to, FRACTIONAL):
            return F.when(c.rlike(r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?\s*\z"), F.regexp_replace(c, r"[fFdD]?\s*\z", "").try_cast(to))
        return F.when(c.rlike(r"\A[+-]?\d+\z"), c.try_cast(to))
    if not is_number(t):
        return F.lit(None).cast(to)
    if isinstance(t, INTEGRAL) and type(to) in _BITS:
        bits = _BITS[type(to)]
        own = F.pmod(c.cast("bigint"), F.lit(1 << bits).cast("bigint"))
        return F.when(own >= 1 << (bits - 1), own - (1 << bits)).otherwise(own).cast(to)
    if isinstance(t, FRACTIONAL) and isinstance(to, INTEGRAL):
        whole = F.when(F.isnan(c), F.lit(0.0)).otherwise(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double"))
        if isinstance(to, T.LongType):
            return F.least(F.greatest(whole, F.lit(-9223372036854775808.0)), F.lit(9223372036854774784.0)).cast("bigint")
        narrowed = F.least(F.greatest(whole, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("bigint")
        return cast(narrowed, T.LongType(), to, None)
    return c.cast(to)


SCALARS: dict[str, Callable[[list[Typed]], Typed]] = {
    "concat": concat, "ifnull": ifnull, "split": split, "regexp_extract": regexp_extract, "parse_url": parse_url,
    "date_format": date_format, "distance": distance, "size": size, "slice": slice_list,
    "sqrt": _guarded(F.sqrt), "sin": _guarded(F.sin), "cos": _guarded(F.cos), "tan": _guarded(F.tan),
}
