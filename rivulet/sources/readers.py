"""Sources of tuples. Each gives a DataFrame with the tuple's fields, SEQ and CLOCK."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators.windows import CLOCK, SEQ
from rivulet.types import TupleSchema, from_json_lines

TIME = "_time"


def prepared(df: DataFrame, seq: str | Column | None = None, clock: str | Column | None = None) -> DataFrame:
    """``df`` plus a place of arrival and a clock.

    ``seq``: a column that orders the rows; without one, the order in which Spark reads them. ``clock``: a
    timestamp; without one the column _time, else the time at which the query runs. Timestamps without a
    time zone are taken to be in the session's.
    """
    plain = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    df = df.withColumns(plain) if plain else df
    seq = F.monotonically_increasing_id() if seq is None else F.col(seq) if isinstance(seq, str) else seq
    if clock is None:
        clock = F.col(TIME).cast("timestamp") if TIME in df.columns else F.current_timestamp()
    clock = F.col(clock) if isinstance(clock, str) else clock
    return df.withColumns({SEQ: seq.cast("bigint"), CLOCK: clock})


def json_folder(spark: SparkSession, path: str, schema: TupleSchema, streaming: bool = False) -> DataFrame:
    """Records of a tuple from files of JSON lines; new files are read as they come when ``streaming``."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    rows = from_json_lines(lines, schema)
    if TIME in schema.names():
        rows = rows.withColumn(TIME, F.coalesce(F.timestamp_seconds(F.col(TIME).try_cast("double")), F.try_to_timestamp(F.col(TIME)), F.current_timestamp()) if dict(rows.dtypes)[TIME] == "string" else F.coalesce(TIME, F.current_timestamp()))
    return prepared(rows)


def parquet_table(spark: SparkSession, path: str, seq: str | None = None, clock: str | None = None) -> DataFrame:
    return prepared(spark.read.parquet(path), seq, clock)


def parquet_stream(spark: SparkSession, folder: str, seq: str | None = None, clock: str | None = None, files: str = "*.parquet") -> DataFrame:
    """The files of a folder whose names match ``files``, those there now and new ones as they come."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return prepared(spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder), seq, clock)


def kafka_options(servers: str, topic: str, start_offset: int | None = None, from_start: bool = False, most: int = 1 << 20, partitions: int = 1) -> dict[str, str]:
    """Options of Spark's Kafka source: where to start, in each of the topic's ``partitions``, and how many records a trigger takes at most."""
    offsets = "earliest" if from_start or start_offset in (-2, 0) else "latest" if start_offset in (None, -1) else json.dumps({topic: {str(k): start_offset for k in range(partitions)}})
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets, "maxOffsetsPerTrigger": str(most), "failOnDataLoss": "false"}


def kafka_topic(spark: SparkSession, schema: TupleSchema, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """JSON records of a Kafka topic (the connector must be on Spark's class path); offset and record time order them."""
    rows = (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()
    lines = rows.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("__o"), F.col("timestamp").alias("__t"))
    return prepared(from_json_lines(lines, schema), F.col("__o"), F.col("__t")).drop("__o", "__t")


def dummy(spark: SparkSession, schema: TupleSchema) -> DataFrame:
    """No row at all."""
    return prepared(spark.createDataFrame([], schema.struct()))
