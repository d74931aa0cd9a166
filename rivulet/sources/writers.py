"""Sinks. Each takes a DataFrame of the fields sent; streams are written batch by batch.

A sink with ``by_batch`` also takes a name of the batch, which is the same when Spark runs a batch again, and
then writes it once only. One with ``ordered`` gets rows with their place of arrival (SEQ) and the number of
the tuple they come from (FROM), and the fields that each tuple sends.
"""

from __future__ import annotations

import json
import logging
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import QueryError
from rivulet.operators.windows import SEQ
from rivulet.sources import embedded
from rivulet.storage import delete

Write = Callable[..., None]
#: Column with the number of the tuple that a row comes from.
FROM = "__from"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _dates(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(f.name, _ISO).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema])


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, in column value; null fields stay out, timestamps are ISO-8601 in UTC."""
    return _dates(df).select(F.to_json(F.struct("*")).alias("value"))


def as_csv(df: DataFrame) -> DataFrame:
    """One CSV record for each row: nulls are empty, and quotes are doubled in fields that need them."""
    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        text = F.to_json(c) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else c.cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))

    own = _dates(df)
    return own.select(F.concat_ws(",", *[cell(f) for f in own.schema]).alias("value"))


def kafka_emit(topic: str, form: str = "json", servers: str = "localhost:9092") -> Write:
    def write(df: DataFrame) -> None:
        (as_csv if form == "csv" else as_json)(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def _files(df: DataFrame, path: str):
    """The Hadoop file system of ``path``, and a function that makes paths of it."""
    make = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), make


def appended(df: DataFrame, path: str, save: Callable[[Any, str], None], batch: str | None = None) -> None:
    """Adds the files of ``df`` to a folder. A named batch's files bear its name and replace those it has left before."""
    if batch is None:
        save(df.write.mode("append"), path)
        return
    aside = f"{path}__{batch}"
    save(df.write.mode("overwrite"), aside)
    fs, make = _files(df, path)
    fs.mkdirs(make(path))
    for old in fs.globStatus(make(f"{path}/{batch}-*")):
        fs.delete(old.getPath(), False)
    for k, new in enumerate(fs.globStatus(make(f"{aside}/part-*"))):
        name = new.getPath().getName()
        fs.rename(new.getPath(), make(f"{path}/{batch}-{k:05d}{name[name.index('.') :] if '.' in name else ''}"))
    delete(df.sparkSession, aside)


def folder_emit(path: str, form: str = "json") -> Write:
    """JSON or CSV lines appended to a folder."""

    def write(df: DataFrame, batch: str | None = None) -> None:
        appended((as_csv if form == "csv" else as_json)(df), path, lambda w, p: w.text(p), batch)

    write.by_batch = True
    return write


def latest(df: DataFrame, keys: Sequence[str], order: str = SEQ, sends: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """One row for each key: of each other field a struct of its last value by ``order``; null where no row of the key sends it.

    Values are combined in each task before the shuffle, so a hot key sends one row of each task.
    """
    own = [c for c in df.columns if c not in (*keys, order, FROM)]
    last = []
    for c in own:
        sent = F.lit(True) if sends is None else F.col(FROM).isin([i for i, fields in enumerate(sends) if c in fields])
        last.append(F.max_by(F.when(sent, F.struct(F.col(f"`{c}`").alias("v"))), F.when(sent, F.col(order))).alias(c))
    if not last:
        return df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*last)


def collection(spark: Any, path: str) -> DataFrame | None:
    """The rows of the collection at ``path``; None where there is none. A switch that was cut off is undone first."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(make(path)) and fs.exists(make(f"{path}__before")):
        fs.rename(make(f"{path}__before"), make(path))
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(path: str, keys: Sequence[str] = ()) -> Write:
    """A folder of Parquet as a collection: rows are added, or with ``keys`` set the fields that they send of the row with their key.

    The last row of a key, in order of arrival, sets a field; fields that are not sent keep their value. The
    merged collection is written aside in full and takes the place of the old one by two renames, and a cut
    between these is mended at the next read: a collection is meant to be much smaller than its stream.
    """

    def write(df: DataFrame, batch: str | None = None, sends: Sequence[Sequence[str]] | None = None) -> None:
        spark = df.sparkSession
        if not keys:
            plain = df.drop(SEQ, FROM)
            appended(plain, path, lambda w, p: w.parquet(p), batch)
            return
        new = latest(df, keys, SEQ, sends)
        old = collection(spark, path)
        fields = [c for c in new.columns if c not in keys]
        value = lambda c: F.col(f"n.`{c}`.v")
        if old is None:
            out = new.alias("n").select(*[F.col(f"n.`{k}`") for k in keys], *[value(c).alias(c) for c in fields])
        else:
            same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
            both = old.withColumn("__o", F.lit(True)).alias("o").join(new.withColumn("__n", F.lit(True)).alias("n"), same, "full_outer")
            key = [F.when(F.col("__n"), F.col(f"n.`{k}`")).otherwise(F.col(f"o.`{k}`")).alias(k) for k in keys]
            kept = lambda c: F.col(f"o.`{c}`") if c in old.columns else F.lit(None)
            rest = [F.when(F.col(f"n.`{c}`").isNotNull(), value(c)).otherwise(kept(c)).alias(c) for c in fields]
            out = both.select(*key, *rest, *[F.col(f"o.`{c}`") for c in old.columns if c not in (*keys, *fields)])
        fs, make = _files(df, path)
        out.write.mode("overwrite").parquet(f"{path}__after")
        if fs.exists(make(path)):
            fs.delete(make(f"{path}__before"), True)
            fs.rename(make(path), make(f"{path}__before"))
        fs.rename(make(f"{path}__after"), make(path))
        fs.delete(make(f"{path}__before"), True)

    write.ordered = bool(keys)
    write.by_batch = True
    return write


def jdbc_persist(url: str, user: str, password: str, sql: str) -> Write:
    """INSERT INTO t (c, ...) VALUES (@f, ...): fields are bound by name; lists, maps and structs go as JSON.

    Rows for a database in the driver's process pass through the driver.
    """
    m = re.fullmatch(r"(?is)\s*insert\s+into\s+(\S+)\s*\(([^)]*)\)\s*values\s*\(([^)]*)\)\s*;?\s*", sql)
    if not m:
        raise QueryError("jdbc_persist takes INSERT INTO table (columns) VALUES (@fields)")
    columns, marks = ([x.strip() for x in m[k].split(",")] for k in (2, 3))
    if len(columns) != len(marks) or not all(x.startswith("@") for x in marks):
        raise QueryError("jdbc_persist: each column needs one @field")

    def rows(df: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema}
        nested = T.ArrayType | T.MapType | T.StructType
        return df.select(*[(F.to_json(f"`{x[1:]}`") if isinstance(types[x[1:]], nested) else F.col(f"`{x[1:]}`")).alias(c) for c, x in zip(columns, marks)])

    def write(df: DataFrame) -> None:
        if embedded.driver_only(df.sparkSession, url):
            embedded.insert(rows(df), url, m[1], user, password)
        else:
            rows(df).write.mode("append").jdbc(url, m[1], properties={"user": user, "password": password})

    write.rows = rows
    return write


def web_body(rows: list[str], kind: str | None = None, options: dict[str, str] | None = None) -> bytes:
    """A JSON array of the rows, or lines for Elasticsearch's bulk interface."""
    if kind != "es":
        return ("[" + ",".join(rows) + "]").encode()
    action = json.dumps({"index": {"_index": options["index"], **({"_type": options["type"]} if "type" in options else {})}})
    return "".join(f"{action}\n{r}\n" for r in rows).encode()


def web_emit(url: str, kind: str | None = None, options: dict[str, str] | None = None, batch: int = 500) -> Write:
    """Rows are posted from the tasks, ``batch`` at a time."""
    def post(rows: Iterator[Any]) -> None:
        held: list[str] = []

        def send() -> None:
            request = urllib.request.Request(url, web_body(held, kind, options), {"Content-Type": "application/json"})
            urllib.request.urlopen(request, timeout=30).close()
            held.clear()

        for r in rows:
            held.append(r[0])
            if len(held) >= batch:
                send()
        if held:
            send()

    return lambda df: as_json(df).foreachPartition(post)


def log(name: str = "rivulet.emit") -> Write:
    """Each row as a line of JSON in the task's log."""
    def write_lines(rows: Iterator[Any]) -> None:
        for r in rows:
            logging.getLogger(name).info("%s", r[0])

    return lambda df: as_json(df).foreachPartition(write_lines)


class Collected:
    """Keeps all rows on the driver; for tests and small results."""

    def __init__(self):
        self.rows: list = []

    def __call__(self, df: DataFrame) -> None:
        self.rows.extend(df.collect())
