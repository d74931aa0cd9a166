"""Runs folds on bounded and on streaming data."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rivulet.streaming.folds import Fold
from rivulet.streaming.spill import in_order

#: Rows that are taken from, or given to, Spark at a time.
_TOGETHER = 4096
#: On bounded data, the place of a row: its Arrow batch and number.
REF = "__ref"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _output(df: DataFrame, fold: Fold) -> T.StructType:
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fold.added)) if fold.added else T.StructType()
    names = {f.name for f in added}
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name not in names] + list(added))


def run(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, clock: str | None = None, delay: int | None = None) -> DataFrame:
    """``fold`` over the rows of each group (equal ``keys``) in ``order``. Without keys all rows are one group.

    On streams with a ``delay`` (seconds), rows come at most that much later than the newest by their
    ``clock``, later ones are dropped, and a group's state goes once it can matter no more.
    """
    return _stream(df, keys, order, fold, clock, delay) if df.isStreaming else _batch(df, keys, order, fold)


def _as(x: pa.Array, kind: pa.DataType) -> pa.Array:
    """``x`` as ``kind``, which differs from its own type at most in the fields that may be null."""
    if x.type == kind:
        return x
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_as(x.field(i), f.type) for i, f in enumerate(kind)], fields=list(kind), mask=x.is_null())
    return pa.array(x.to_pylist(), kind) if pa.types.is_nested(kind) else x.cast(kind)


def _batch(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold) -> DataFrame:
    """Groups stream past in order, so a task holds one group's state, however many rows the group has.

    Only the columns that the fold reads become values of Python. Others stay in their Arrow batch: a row has
    the place of its own under ``REF``, a payload is a place too, and the output is taken from these places.
    """
    schema = _output(df, fold)
    arrow = to_arrow_schema(schema)
    added = {n for n, _ in fold.added}
    read = [c for c in df.columns if fold.reads(c)]

    def taken(places: list[tuple[pa.RecordBatch, int] | None], column: str, kind: pa.DataType) -> pa.Array:
        """The values of ``column`` at these places; null where there is none."""
        batches: dict[int, tuple[int, pa.RecordBatch]] = {}
        at, end = [], 0
        for p in places:
            if p is None:
                at.append(None)
                continue
            if id(p[0]) not in batches:
                batches[id(p[0])] = (end, p[0])
                end += p[0].num_rows
            at.append(batches[id(p[0])][0] + p[1])
        if not batches:
            return pa.nulls(len(at), kind)
        return _as(pa.concat_arrays([b.column(column) for _, b in batches.values()]).take(pa.array(at, pa.int64())), kind)

    def given(out: list[dict]) -> pa.RecordBatch:
        cols = []
        for f in arrow:
            if f.name in added:
                cols.append(pa.array([r[f.name] for r in out], f.type))
            else:
                by = f.name if fold.payload(f.name) else REF
                cols.append(taken([r.get(by) for r in out], f.name, f.type))
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, out = object(), None, []
        for whole in batches:
            for a in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(a, _TOGETHER)
                payloads = [c for c in batch.schema.names if fold.payload(c)]
                groups = list(zip(*[batch.column(k).to_pylist() for k in keys])) or [()] * batch.num_rows
                values = zip(*[batch.column(c).to_pylist() for c in read]) if read else [()] * batch.num_rows
                for i, (own, one) in enumerate(zip(groups, values)):
                    if own != group:
                        group, state = own, fold.start()
                    place = (batch, i)
                    row = dict(zip(read, one))
                    row[REF] = place
                    for c in payloads:
                        row[c] = place
                    for r in fold.row(state, row):
                        out.append(r)
                        if len(out) >= _TOGETHER:
                            yield given(out)
                            out = []
                if out:
                    yield given(out)
                    out = []

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(folded, schema)


def _key(df: DataFrame, keys: Sequence[str]) -> Column:
    """The group's key as one text, which is never null."""
    own = [(F.col(k) + F.lit(0).cast(df.schema[k].dataType) if isinstance(df.schema[k].dataType, T.DoubleType | T.FloatType) else F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(F.struct(*own), {"ignoreNullFields": "false", "timestampFormat": f"{exact}XXX", "timestampNTZFormat": exact}) if own else F.lit("")


def _stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, clock: str | None, delay: int | None) -> DataFrame:
    """The state is kept, pickled, under the group's key in the state store; rows of a micro-batch are folded in order.

    Such state needs the RocksDB store, which the session is set to. Timers clear it as the watermark passes.
    Rows reach the fold pickled and leave it so, since only data frames of pandas stream in and out of it: a
    group may have any number of rows in a micro-batch. They are sorted on the worker's disk.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = _output(df, fold)
    names, columns = schema.names, df.columns
    arrow = to_arrow_schema(schema)
    timed = clock is not None and delay is not None
    kept = ["__key", *([clock] if timed else [])]
    packed_schema = T.StructType([T.StructField("key", T.StringType()), *([T.StructField("at", df.schema[clock].dataType)] if timed else []), T.StructField("packed", T.BinaryType())])
    packed_arrow = to_arrow_schema(packed_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _TOGETHER):
                own = batch.slice(a, _TOGETHER)
                rows = own.select(columns).to_pylist()
                raw = [pickle.dumps(([(r[o] is not None, r[o]) for o in order], tuple(r.values()))) for r in rows]
                yield pa.RecordBatch.from_arrays([*[own.column(k).cast(f.type) for k, f in zip(kept, packed_arrow)], pa.array(raw, pa.binary()).cast(packed_arrow[-1].type)], schema=packed_arrow)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                values = zip(*pickle.loads(raw.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, arrow)], schema=arrow)

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("state", T.StructType([T.StructField("raw", T.BinaryType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state = pickle.loads(bytes(self.kept.get()[0])) if self.kept.exists() else fold.start()
            out = []
            for _, values in in_order(bytes(x) for part in rows for x in part.iloc[:, -1]):
                for one in fold.row(state, dict(zip(columns, values))):
                    out.append(tuple(one.get(n) for n in names))
                    if len(out) >= _TOGETHER:
                        yield pd.DataFrame({"packed": [pickle.dumps(out)]})
                        out = []
            if out:
                yield pd.DataFrame({"packed": [pickle.dumps(out)]})
            self.kept.update((pickle.dumps(state),))
            if timed and (until := fold.until(state)) is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(max((until + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.kept.clear()
            return iter(())

        def close(self) -> None: ...

    dealt = df.withColumn("__key", _key(df, keys)).mapInArrow(pack, packed_schema)
    if timed:
        dealt = dealt.withWatermark("at", f"{delay} seconds")
    folded = dealt.groupBy("key").transformWithStateInPandas(Processor(), "packed binary", "Append", "EventTime" if timed else "None")
    return folded.mapInArrow(unpack, schema)
