"""Types of declared tuples, and reading their records from JSON."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMITIVE = {
    "STRING": T.StringType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
}
NARROW, INTEGRAL, FRACTIONAL = (T.ByteType, T.ShortType), (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, INTEGRAL + FRACTIONAL)


def spark_type(declared: Any) -> T.DataType:
    """Spark's type of a parsed one; an untyped field is a string that holds JSON scalars as text."""
    if declared is None:
        return T.StringType()
    if declared[0] == "LIST":
        return T.ArrayType(spark_type(declared[1]))
    if declared[0] == "MAP":
        return T.MapType(spark_type(declared[1]), spark_type(declared[2]))
    if declared[0] == "STRUCT":
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in declared[1]])
    return _PRIMITIVE[declared[0]]


def type_text(declared: Any) -> str:
    if declared is None:
        return ""
    if declared[0] == "LIST":
        return f"LIST<{type_text(declared[1])}>"
    if declared[0] == "MAP":
        return f"MAP<{type_text(declared[1])}, {type_text(declared[2])}>"
    if declared[0] == "STRUCT":
        return "STRUCT<" + ", ".join(f"{n} {type_text(t)}".strip() for n, t in declared[1]) + ">"
    return declared[0] + (f"('{declared[1]}')" if declared[1] else "")


@dataclass(frozen=True)
class TupleSchema:
    """A declared tuple: named fields in order, with their types or None, and the fields that partition it."""

    name: str
    fields: tuple[tuple[str, Any], ...]
    keys: tuple[str, ...] = ()
    comment: str | None = None

    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in self.fields])

    def describe(self) -> str:
        """As EXPLAIN shows it."""
        own = ", ".join(f"{n} {type_text(t)}".strip() for n, t in self.fields)
        return f"{self.name}({own})" + (f" partitioned by {', '.join(self.keys)}" if self.keys else "")


def epoch_or_format(c: Column, form: str | None) -> Column:
    """A timestamp from text: by a pattern, else from a number of epoch seconds."""
    if form:
        return F.try_to_timestamp(c, F.lit(form))
    return F.timestamp_seconds(c.try_cast("double"))


def _wire(declared: Any) -> T.DataType:
    """The type read from JSON before conversion: timestamps come as text."""
    if declared is None or declared[0] == "TIMESTAMP":
        return T.StringType()
    if declared[0] == "LIST":
        return T.ArrayType(_wire(declared[1]))
    if declared[0] == "MAP":
        return T.MapType(T.StringType(), _wire(declared[2]))
    if declared[0] == "STRUCT":
        return T.StructType([T.StructField(n, _wire(t)) for n, t in declared[1]])
    return spark_type(declared)


def _converted(c: Column, declared: Any) -> Column:
    if declared is None:
        return c
    if declared[0] == "TIMESTAMP":
        return epoch_or_format(c, declared[1])
    if declared[0] == "LIST":
        return F.transform(c, lambda x: _converted(x, declared[1]))
    if declared[0] == "MAP":
        key, value = spark_type(declared[1]), declared[2]
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(_converted(e["key"], declared[1]).cast(key) if declared[1][0] == "TIMESTAMP" else e["key"].try_cast(key), _converted(e["value"], value))))
    if declared[0] == "STRUCT":
        return F.when(c.isNotNull(), F.struct(*[_converted(c[n], t).alias(n) for n, t in declared[1]]))
    return c


def from_json_lines(lines: DataFrame, schema: TupleSchema, line: str = "value", strict: bool = True) -> DataFrame:
    """Rows of a tuple from JSON objects, one in each row of ``lines``.

    Unquoted names are read. A missing field is null. With ``strict`` a record that has a field which the
    tuple lacks is dropped, as are records that are no JSON object.
    """
    options = {"allowUnquotedFieldNames": "true", "mode": "PERMISSIVE"}
    wire = T.StructType([T.StructField(n, _wire(t)) for n, t in schema.fields])
    if strict:
        keys = F.map_keys(F.from_json(F.col(line), "map<string,string>", options))
        lines = lines.where(keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(n) for n in schema.names()]))) == 0))
    row = F.from_json(F.col(line), wire, options)
    rest = [c for c in lines.columns if c != line]
    parsed = lines.withColumn("_r", row)
    return parsed.select(*[_converted(F.col("_r")[n], t).alias(n) for n, t in schema.fields], *rest)
