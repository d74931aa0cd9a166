"""Lookups: a row gets the results of a query on another store, one output row for each result."""

from __future__ import annotations

import json
import logging
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.errors import QueryError
from rivulet.functions.expressions import Binder
from rivulet.plans.parser import Parser

Fetch = Callable[[DataFrame, Binder, Sequence[str]], DataFrame]
_MARK = re.compile(r"(?<!\\)@([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)")
#: Rows of a lookup that compares no field of the stream.
_MOST = 10_000
#: Statistics decide whether a lookup table is broadcast; this is never forced on tables of unknown size.


def _field(binder: Binder, path: str):
    return binder.field(Parser(path).field())


def table_lookup(table: DataFrame, keys: dict[str, str], columns: Sequence[str], constants: dict[str, Any] | None = None, sort: Sequence[tuple[str, bool]] = (), limit: int | None = None) -> Fetch:
    """Rows of ``table`` whose columns equal the row's fields (``keys``: column to field) and ``constants``.

    With ``sort`` (column, descending) and ``limit``, the first rows of each key; they are chosen before the join.
    """

    def fetch(df: DataFrame, binder: Binder, fields: Sequence[str]) -> DataFrame:
        if len(fields) != len(columns):
            raise QueryError(f"JOIN names {len(fields)} fields, the lookup gives {len(columns)}")
        own = table
        for c, v in (constants or {}).items():
            own = own.where(F.col(c) == F.lit(v))
        if limit is not None:
            order = [F.desc(c) if down else F.asc(c) for c, down in sort] or [F.lit(0)]
            w = Window.partitionBy(*keys).orderBy(*order)
            own = own.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
        right = own.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"__f{i}") for i, c in enumerate(columns)])
        left = df.withColumns({f"__l{i}": _field(binder, f)[0] for i, f in enumerate(keys.values())})
        on = [F.col(f"__l{i}") == F.col(f"__k{i}") for i in range(len(keys))]
        if on:
            joined = left.join(right, on)
        else:  # a lookup without a field: its whole result goes to every row, so it must be small
            if len(right.limit(_MOST + 1).collect()) > _MOST:
                raise QueryError(f"a lookup without @field gives over {_MOST} rows")
            joined = left.join(F.broadcast(right), F.lit(True))
        names = [c for c in df.columns if c not in fields]
        return joined.select(*[F.col(f"`{c}`") for c in names if not c.startswith("__")], *[F.col(f"__f{i}").alias(f) for i, f in enumerate(fields)], *[c for c in names if c.startswith("__")])

    return fetch


def document_query(text: str) -> tuple[dict[str, str], dict[str, Any]]:
    """({column: @field}, {column: constant}) of a query document such as {host:@host, kind:'x'}."""
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise QueryError(f"not a query document: {text}")
    keys: dict[str, str] = {}
    constants: dict[str, Any] = {}
    for part in filter(None, re.split(r",(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", body[1:-1])):
        name, colon, value = part.partition(":")
        name, value = name.strip().strip("'\""), value.strip()
        if not colon or value.startswith("{"):
            raise QueryError(f"a query document takes equalities only: {part}")
        if value.startswith("@"):
            keys[name] = value[1:]
        elif value[:1] in "'\"":
            constants[name] = value[1:-1]
        else:
            constants[name] = json.loads(value)
    return keys, constants


def document_sort(text: str) -> list[tuple[str, bool]]:
    """[(column, descending)] of a sort document such as {c:-1}."""
    return [(n.strip().strip("'\""), int(v) < 0) for n, _, v in (p.partition(":") for p in text.strip()[1:-1].split(","))]


def mongo_fetch(collection: DataFrame, query: str, columns: Sequence[str], *more: Any) -> Fetch:
    """``more``: a sort document, a limit and an expiry, each optional. Spark reads the collection anew for each run, so nothing expires."""
    sort = next((document_sort(x) for x in more if isinstance(x, str)), [])
    limit = next((x for x in more if isinstance(x, int)), None)
    keys, constants = document_query(query)
    return table_lookup(collection, keys, columns, constants, sort, limit)


def jdbc_query(sql: str) -> tuple[list[str], str, dict[str, str], dict[str, Any]]:
    """(columns, table, keys, constants) of SELECT a, b FROM t WHERE c = @f AND d = 'x'."""
    m = re.fullmatch(r"(?is)\s*select\s+(.+?)\s+from\s+(\S+)(?:\s+where\s+(.+?))?\s*;?\s*", sql)
    if not m:
        raise QueryError(f"not a lookup query: {sql}")
    keys: dict[str, str] = {}
    constants: dict[str, Any] = {}
    for part in re.split(r"(?i)\s+and\s+", m[3]) if m[3] else []:
        name, eq, value = (x.strip() for x in part.partition("="))
        if not eq:
            raise QueryError(f"a lookup takes equalities only: {part}")
        if value.startswith("@"):
            keys[name] = value[1:]
        else:
            constants[name] = value[1:-1] if value[:1] == "'" else json.loads(value)
    return [c.strip() for c in m[1].split(",")], m[2], keys, constants


def walk(document: Any, path: str) -> list[Any]:
    """The values at a dotted path with subscripts; lists on the way, and at its end, fan out."""
    found = [document]
    for part in path.split("."):
        name, *subs = re.findall(r"[^\[\]]+", part)
        found = [y for x in found for y in (x if isinstance(x, list) else [x])]
        found = [x[name] for x in found if isinstance(x, dict) and name in x]
        for s in subs:
            found = [x[int(s)] for x in found if isinstance(x, list) and int(s) < len(x)]
    return [y for x in found for y in (x if isinstance(x, list) else [x])]


def web_fetch(url: str, path: str, columns: Sequence[str], *more: Any, get: Callable[[str], str] | None = None) -> Fetch:
    """GET for each row, with @fields filled in; each task asks once for each url. Results come as JSON text or scalars as strings.

    A failing request, or an answer that is not JSON, is logged and its row dropped.
    """
    marks = list(dict.fromkeys(_MARK.findall(url)))

    def fetch(df: DataFrame, binder: Binder, fields: Sequence[str]) -> DataFrame:
        keep = [c for c in df.columns if c not in fields]
        schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *[T.StructField(f, T.StringType()) for f in fields]])
        arrow = to_arrow_schema(schema)
        rows = df.select(*keep, *[_field(binder, m)[0].cast("string").alias(f"__m{i}") for i, m in enumerate(marks)])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = get or (lambda u: urllib.request.urlopen(u, timeout=30).read().decode())
            cache: dict[str, list] = {}
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    values = {m: row.pop(f"__m{i}") for i, m in enumerate(marks)}
                    own = _MARK.sub(lambda m: urllib.parse.quote(values[m[1]] or ""), url).replace("\\@", "@")
                    if own not in cache:
                        if len(cache) > 10_000:
                            cache.clear()
                        try:
                            cache[own] = walk(json.loads(read(own)), path)
                        except (OSError, ValueError) as e:  # the row goes, and the next one with this url asks again
                            logging.getLogger("rivulet.web_fetch").error("%s: %s", own, e)
                            continue
                    for x in cache[own]:
                        got = [x.get(c) if isinstance(x, dict) else None for c in columns]
                        out.append({**row, **dict(zip(fields, [v if v is None or isinstance(v, str) else json.dumps(v) for v in got]))})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

        return rows.mapInArrow(ask, schema)

    return fetch
