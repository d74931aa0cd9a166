"""Per-row and windowed operators on bounded data.

Every row has a place of arrival (SEQ) and, where time matters, a clock (CLOCK). Grouped operators are
Spark windows or aggregates on the group's keys. Ungrouped ones see all rows as one group, but no task
gets them all: rows are dealt into ranges of their places, and what a range needs from those before it
comes from totals of the ranges or from copies of the rows just before its begin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.aggregates import BlockFrame, Frame, GroupFrame, NotMergeable, TimeFrame, aggregate
from rivulet.functions.expressions import Binder
from rivulet.operators.cron import CronSchedule
from rivulet.plans.nodes import Call, Field, Item
from rivulet.storage import written

SEQ, CLOCK = "__seq", "__clock"
#: Rows of a range of ungrouped rows, at least.
RANGE_ROWS = 1 << 16
#: Seconds of a range of ungrouped rows, at least.
RANGE_SECONDS = 3600

Bind = Callable[..., Binder]


def hidden(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns if c.startswith("__") and not c.startswith("__tmp")]


def second(df: DataFrame) -> Column:
    return F.unix_seconds(F.col(CLOCK))


def project(df: DataFrame, items: Sequence[Item], binder: Binder) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in binder.items(items)], *hidden(df))


class _RangeTotals(Frame):
    """Running aggregates over ranges: within a range by a window, plus the totals of the ranges before."""

    def __init__(self):
        super().__init__(self._no)
        self.needed: list[Column] = []
        self.ready = False
        self.local = Window.partitionBy("__tmp_range").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)

    def _no(self, c: Column) -> Column:
        raise NotMergeable

    def _use(self, total: Column, running: Column) -> Column:
        if not self.ready:
            self.needed.append(total)
            return F.lit(0)
        k = self.used
        self.used += 1
        before = F.col(f"__tmp_before{k}")
        return F.coalesce(running + F.coalesce(before, F.lit(0)), running, before)

    used = 0

    def count(self, x: Column) -> Column:
        return self._use(F.count(x), F.count(x).over(self.local))

    def total(self, x: Column) -> Column:
        return self._use(F.sum(x), F.sum(x).over(self.local))

    def values(self, x: Column) -> Column:
        raise NotMergeable


def _ranges(df: DataFrame) -> DataFrame:
    """``df`` in ranges of SEQ, numbered by __tmp_range, written so that the numbers stay."""
    return written(df.repartitionByRange(SEQ).withColumn("__tmp_range", F.spark_partition_id()), "ranges")


def _before(df: DataFrame, totals: Sequence[Column]) -> DataFrame:
    """``df`` plus the totals of all ranges before a row's own. There are no more ranges than shuffle partitions."""
    own = df.groupBy("__tmp_range").agg(*[c.alias(f"t{k}") for k, c in enumerate(totals)])
    w = Window.orderBy("__tmp_range").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(F.broadcast(own.select("__tmp_range", *[F.sum(f"t{k}").over(w).alias(f"__tmp_before{k}") for k in range(len(totals))])), "__tmp_range")


def each(df: DataFrame, keys: Sequence[str], items: Sequence[Item], bind: Bind, running: bool) -> DataFrame:
    """Projection; aggregates run over the group's rows so far."""
    if not running:
        return project(df, items, bind(df, None))
    whole = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    if keys:
        return project(df, items, bind(df, Frame(lambda c: c.over(whole))))
    frame = _RangeTotals()
    try:
        bind(df, frame).items(items)
    except NotMergeable:  # sets and lists of all rows so far have no totals: their size alone forbids many rows
        return project(df, items, bind(df, Frame(lambda c: c.over(whole))))
    ranged = _before(_ranges(df), frame.needed)
    frame.ready = True
    out = project(ranged, items, bind(ranged, frame))
    return out


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` plus __tmp_n, the number of each row in its group, from 1."""
    if keys:
        return df.withColumn("__tmp_n", F.row_number().over(Window.partitionBy(*keys).orderBy(SEQ)).cast("long"))
    ranged = _before(_ranges(df), [F.count(F.lit(1))])
    own = F.row_number().over(Window.partitionBy("__tmp_range").orderBy(SEQ))
    return ranged.withColumn("__tmp_n", own + F.coalesce("__tmp_before0", F.lit(0))).drop("__tmp_before0", "__tmp_range")


def slide_rows(df: DataFrame, keys: Sequence[str], n: int, items: Sequence[Item], bind: Bind) -> DataFrame:
    """Aggregates over the last ``n`` rows of the group, for each row."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(1 - n, 0)
        return project(df, items, bind(df, Frame(lambda c: c.over(w))))
    size = max(n, RANGE_ROWS)
    at = F.col("__tmp_n") - 1
    own = numbered(df, keys).withColumn("__tmp_b", F.floor(at / size)).withColumn("__tmp_copy", F.lit(False))
    copies = own.where(at % size >= size - n + 1).withColumn("__tmp_b", F.col("__tmp_b") + 1).withColumn("__tmp_copy", F.lit(True))
    rows = own.unionByName(copies)
    w = Window.partitionBy("__tmp_b").orderBy("__tmp_n").rowsBetween(1 - n, 0)
    return _without_copies(rows, items, bind(rows, Frame(lambda c: c.over(w))))


def _without_copies(rows: DataFrame, items: Sequence[Item], binder: Binder) -> DataFrame:
    out = rows.select(*[c.alias(n) for n, c in binder.items(items)], *hidden(rows), "__tmp_copy")
    return out.where(~F.col("__tmp_copy")).drop("__tmp_copy")


def slide_time(df: DataFrame, keys: Sequence[str], seconds: int, by: Column, items: Sequence[Item], bind: Bind) -> DataFrame:
    """Aggregates over the rows of the last ``seconds``, in whole seconds of ``by``, that have arrived so far; for each row."""
    rows = df.withColumn("__tmp_s", F.unix_seconds(by)).where(F.col("__tmp_s").isNotNull())
    block = seconds + 1
    own = rows.withColumns({"__tmp_b": F.floor(F.col("__tmp_s") / block), "__tmp_copy": F.lit(False)})
    both = own.unionByName(own.withColumns({"__tmp_b": F.col("__tmp_b") + 1, "__tmp_s": F.col("__tmp_s") + block, "__tmp_copy": F.lit(True)}))
    try:
        return _without_copies(both, items, bind(both, BlockFrame([*map(F.col, keys), F.col("__tmp_b")], F.col("__tmp_s"), SEQ, F.col("__tmp_copy"))))
    except NotMergeable:  # lists and sets hold each window's rows
        pass
    if keys:
        return project(rows, items, bind(rows, TimeFrame([F.col(k) for k in keys], F.col("__tmp_s"), SEQ, seconds)))
    size = max(seconds + 1, RANGE_SECONDS)
    own = rows.withColumn("__tmp_b", F.floor(F.col("__tmp_s") / size)).withColumn("__tmp_copy", F.lit(False))
    copies = own.where(F.pmod("__tmp_s", F.lit(size)) >= size - seconds).withColumn("__tmp_b", F.col("__tmp_b") + 1).withColumn("__tmp_copy", F.lit(True))
    rows = own.unionByName(copies)
    return _without_copies(rows, items, bind(rows, TimeFrame([F.col("__tmp_b")], F.col("__tmp_s"), SEQ, seconds)))


class _LastRow(Binder):
    """In a group, a plain field is that of the last row."""

    def field(self, f: Field):
        c, t = super().field(f)
        return F.max_by(c, F.col(SEQ)), t

    def items(self, items):
        out = []
        for item in items:
            if isinstance(item.value, Field) and item.value.star:
                out.extend((n, F.max_by(c, F.col(SEQ))) for n, c in super().items([item]))
            else:
                out.extend(super().items([item]))
        return out

    def _call(self, x: Call):
        if x.name in ("count", "sum", "avg", "collect_list", "collect_set"):
            inner = Binder(self.df, self.tuples, None, self.functions, self.context)
            return aggregate(self.frame, x.name, inner.value(x.args[0]) if x.args else None, x.distinct)
        return super()._call(x)


def _grouped(df: DataFrame, keys: Sequence[str], bucket: str, items: Sequence[Item], bind: Bind, clock: Column | None = None, least: int | None = None) -> DataFrame:
    """One row for each group and bucket; partial aggregates keep a hot group from one task's rows."""
    binder = bind(df, GroupFrame(SEQ), _LastRow)
    cols = [c.alias(n) for n, c in binder.items(items)]
    carried = [c for c in df.columns if c.startswith("__") and not c.startswith("__tmp") and c not in (*keys, SEQ, CLOCK)]
    own = [F.max_by(F.col(c), F.col(SEQ)).alias(c) for c in carried]
    out = df.groupBy(*keys, bucket).agg(*cols, F.max(SEQ).alias("__tmp_seq"), F.max(CLOCK).alias("__tmp_clock"), F.count(F.lit(1)).alias("__tmp_rows"), *own)
    if least is not None:
        out = out.where(F.col("__tmp_rows") >= least)
    names = [n for n, _ in binder.items(items)]
    return out.select(*names, F.col("__tmp_seq").alias(SEQ), (clock if clock is not None else F.col("__tmp_clock")).alias(CLOCK), *keys, *carried)


def snapshot_rows(df: DataFrame, keys: Sequence[str], n: int, items: Sequence[Item], bind: Bind) -> DataFrame:
    """Every ``n``-th row of a group gives the aggregates of those n rows; a last window that isn't full gives none."""
    rows = numbered(df, keys).withColumn("__tmp_b", F.floor((F.col("__tmp_n") - 1) / n))
    return _grouped(rows, keys, "__tmp_b", items, bind, least=n)


def period_bucket(df: DataFrame, seconds: int, origin: int) -> DataFrame:
    return df.withColumn("__tmp_b", F.floor((second(df) - origin) / seconds))


def cron_bucket(df: DataFrame, schedule: CronSchedule) -> DataFrame:
    """``df`` plus __tmp_b: the first instant of the schedule after the row's clock, in epoch seconds."""

    @F.arrow_udf("long")
    def after(x: pa.Array) -> pa.Array:
        known = x.is_valid().to_numpy(zero_copy_only=False)
        ends = schedule.after(x.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(ends, mask=(ends < 0) | ~known)

    return df.withColumn("__tmp_b", after(second(df))).where(F.col("__tmp_b").isNotNull())


def snapshot(df: DataFrame, keys: Sequence[str], every: int | CronSchedule, items: Sequence[Item], bind: Bind, expire: int | CronSchedule | None = None, origin: int = 0) -> DataFrame:
    """One row for each group and window that has rows; with ``expire`` aggregates go on until the expiry has passed."""
    rows = cron_bucket(df, every) if isinstance(every, CronSchedule) else period_bucket(df, every, origin)
    end = F.timestamp_seconds(F.col("__tmp_b")) if isinstance(every, CronSchedule) else F.timestamp_seconds((F.col("__tmp_b") + 1) * every + origin)
    if expire is None:
        return _grouped(rows, keys, "__tmp_b", items, bind, clock=end)
    # the state goes where a window's first row comes after an expiry
    first = F.min(F.struct(SEQ, CLOCK)).over(Window.partitionBy(*keys, "__tmp_b"))[CLOCK]
    own = rows.withColumn("__tmp_first", first).withColumnRenamed("__tmp_b", "__tmp_w")
    if isinstance(expire, CronSchedule):
        own = cron_bucket(own.withColumn("__tmp_c", F.col(CLOCK)).withColumn(CLOCK, F.col("__tmp_first")), expire).withColumn(CLOCK, F.col("__tmp_c")).drop("__tmp_c").withColumnRenamed("__tmp_b", "__tmp_e")
    else:
        own = own.withColumn("__tmp_e", F.floor((F.unix_seconds("__tmp_first") - origin) / expire))
    w = Window.partitionBy(*keys, "__tmp_e").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    binder = bind(own, Frame(lambda c: c.over(w)))
    last = F.row_number().over(Window.partitionBy(*keys, "__tmp_e", "__tmp_w").orderBy(F.desc(SEQ)))
    cols = [c.alias(n) for n, c in binder.items(items)]
    out = own.select(*cols, *hidden(own), "__tmp_w", last.alias("__tmp_last")).where("__tmp_last = 1")
    end = F.timestamp_seconds(F.col("__tmp_w")) if isinstance(every, CronSchedule) else F.timestamp_seconds((F.col("__tmp_w") + 1) * every + origin)
    return out.withColumn(CLOCK, end).drop("__tmp_w", "__tmp_last")


def limit_rows(df: DataFrame, keys: Sequence[str], n: int, first: bool) -> DataFrame:
    """Of every ``n`` rows of a group the first, or the last."""
    at = (F.col("__tmp_n") - 1) % n == 0 if first else F.col("__tmp_n") % n == 0
    return numbered(df, keys).where(at).drop("__tmp_n")
