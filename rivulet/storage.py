"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from rivulet.errors import QueryError

_open: list[list[str]] = []


def in_one_process(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only where the session names none and all tasks run in this process a temporary folder is set: on a
    cluster, executors would write there what nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not in_one_process(spark):
            raise QueryError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {spark.sparkContext.master})")
        base = tempfile.mkdtemp(prefix="rivulet-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rivulet-{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    return stored(df, shared_dir(df.sparkSession, what))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to the folder ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all shared folders that were begun inside; results must be written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        delete(spark, *_open.pop())
