"""Folds alone, and in streams against their result on bounded data."""

import json
import pickle
import re

import pytest
from pyspark.sql import functions as F

from rivulet.functions.user import load
from rivulet.operators.stream import Context, Stream, tuple_join
from rivulet.operators.windows import SEQ
from rivulet.plans.nodes import Field, Period
from rivulet.sources import readers, writers
from rivulet.streaming import runner
from rivulet.streaming.folds import Aggregates, TupleJoin

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_eviction():
    fold = Aggregates("rows", (("collect_set", 1, False, "array<int>", None), ("avg", 1, False, "bigint", None)), 2)
    state, got = fold.start(), []
    for x in (1, 1, 2, None, 3):
        got += [(r["__r0"], r["__r1"]) for r in fold.row(state, {"__a0_0": x, "__a1_0": x})]
    assert got == [([1], 1), ([1], 1), ([1, 2], 1), ([2], 2), ([3], 3)]


def test_three_sides_give_all_combinations():
    fold = TupleJoin(10, 3)
    state, out = fold.start(), []
    for now, side, p in ((0, 0, "a"), (1, 0, "b"), (2, 1, "c"), (3, 2, "d"), (4, 2, "e")):
        out += fold.row(state, {"__now": now, "__side": side, f"__p{side}": p})
    assert [(r["__p0"], r["__p1"], r["__p2"]) for r in out] == [("a", "c", "d"), ("b", "c", "d")] and state[2] == [(14, "e")]


def _stream(spark, tmp_path, build, files=3):
    """Rows of ``build`` over the events, read as a stream of several files, and over the same rows at once."""
    df = spark.read.parquet(EVENTS).orderBy("event_id").limit(600)
    path = str(tmp_path / "in")
    rows = df.count()
    for k in range(files):  # later files hold later rows
        df.where((F.col("event_id") >= rows * k // files) & (F.col("event_id") < rows * (k + 1) // files)).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    out = build(Stream({"e": readers.prepared(live, "event_id", "ts")}))
    name = f"q{abs(hash(str(tmp_path))) % 10**9}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(str, spark.table(name).collect()))
    whole = build(Stream({"e": readers.prepared(spark.read.parquet(path), "event_id", "ts")}))
    return got, sorted(map(str, whole.collect()))


@pytest.mark.parametrize("build", [
    lambda s: s.filter("value > 10").each("event_id, value * 2 AS v").df,
    lambda s: s.begin_group("event_type").each("event_id, sum(user_id) AS s, count() AS n, count(DISTINCT user_id) AS u").df,
    lambda s: s.begin_group("event_type").slide(4, "event_id, sum(user_id) AS s, collect_list(user_id) AS l").df,
    lambda s: s.begin_group("event_type").slide(Period(3600, "1h"), "event_id, count() AS n, avg(user_id) AS a", "ts").df,
    lambda s: s.begin_group("event_type").snapshot(7, "event_id, sum(user_id) AS s").df,
    lambda s: s.begin_group("event_type").limit(True, 5).each("event_id").df,
    lambda s: s.begin_group("user_id").limit(False, Period(3600, "1h")).each("event_id").df,
    lambda s: s.begin_group("user_id").filter_group(Period(86400, "1days"), ["event_type = 'click'", "event_type = 'view'"]).each("event_id").df,
], ids=["each", "running", "slide_rows", "slide_time", "snapshot", "limit_rows", "limit_time", "filter_group"])
def test_streams_equal_bounded_data(spark, tmp_path, build):
    got, want = _stream(spark, tmp_path, build)
    assert got == want and got


def test_streaming_windows_close(spark, tmp_path):
    """A time window's row comes out once the watermark has passed it; the last windows stay open."""
    got, want = _stream(spark, tmp_path, lambda s: s.begin_group("event_type").snapshot(Period(86400, "1days"), "event_type, count() AS n, sum(user_id) AS s").df)
    assert got and set(got) <= set(want)


def test_state_of_streams_goes_when_it_has_expired(spark, tmp_path):
    """With a delay, groups that fall silent leave the state store; rows that still match are found."""
    path = str(tmp_path / "in")
    schema = "n long, k long, side int, at timestamp"
    # a hundred keys in the first minute, each once; then one key, an hour later for the second time
    for k, rows in enumerate(([(i, i, 0, i % 60) for i in range(100)], [(100, 5, 1, 50)], [(101, 200, 0, 4000)], [(102, 200, 1, 4005)], [(103, 6, 1, 4010)], [(104, 7, 1, 4011)])):
        spark.createDataFrame(rows, "n long, k long, side int, s long").select("n", "k", "side", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    s = Stream({"e": readers.prepared(live, "n", "at")}, context=Context(delay=0))
    out = s.begin_group("k").filter_group(Period(300, "5min"), ["side = 0", "side = 1"]).each("n, k").df
    name = f"q{abs(hash(str(tmp_path))) % 10**9}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table(name).collect()) == [100, 102]
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(kept) > 90 and kept[-1] < 20


def test_upsert_of_merged_tuples_and_repeated_batches(spark, tmp_path):
    """Each tuple sets its own fields; a batch that is written again leaves what one writing leaves; a cut switch is mended."""
    path = str(tmp_path / "c")
    write = writers.upsert(path, ["k"])
    rows = spark.createDataFrame([(1, "a", None, 5, 0), (1, None, 7, 3, 1), (1, "b", None, 9, 0), (2, None, 8, 4, 1), (1, "old", None, 1, 0)], f"k int, x string, y int, {SEQ} long, {writers.FROM} int")
    for _ in range(2):
        write(rows.repartition(3), "one_0", [["k", "x"], ["k", "y"]])
    read = lambda: sorted(tuple(r) for r in writers.collection(spark, path).select("k", "x", "y").collect())
    assert read() == [(1, "b", 7), (2, None, 8)]
    write(spark.createDataFrame([(2, "c", 1, 0), (None, "n", 2, 0)], f"k int, x string, {SEQ} long, {writers.FROM} int"), "one_1", [["k", "x"]])
    assert sorted(map(str, writers.collection(spark, path).collect())) == sorted(map(str, spark.createDataFrame([(1, "b", 7), (2, "c", 8), (None, "n", None)], "k int, x string, y int").collect()))
    (tmp_path / "c").rename(tmp_path / "c__before")
    assert writers.collection(spark, path).count() == 3
    lines = str(tmp_path / "lines")
    sink = writers.folder_emit(lines)
    for name, n in (("b_0", 3), ("b_0", 3), ("b_1", 2)):
        sink(spark.range(n).repartition(2), name)
    assert spark.read.text(lines).count() == 5


def test_kafka_offsets_of_all_partitions():
    assert json.loads(readers.kafka_options("s", "t", 7, partitions=3)["startingOffsets"]) == {"t": {"0": 7, "1": 7, "2": 7}}


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.read.parquet(EVENTS).limit(100)

    def once():
        live = spark.readStream.schema(df.schema).parquet(path)
        s = Stream({"e": readers.prepared(live, "event_id", "ts")}).begin_group("event_type").each("event_id, event_type, count() AS n").df
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    df.where("event_id < 50").coalesce(1).write.mode("append").parquet(path)
    once()
    df.where("event_id >= 50").coalesce(1).write.mode("append").parquet(path)
    once()
    got = {r.event_type: r.m for r in spark.read.parquet(out).groupBy("event_type").agg(F.max("n").alias("m")).collect()}
    assert got == {r.event_type: r["count"] for r in df.groupBy("event_type").count().collect()}


def test_scripts_and_aggregates_of_ones_own(spark, tmp_path):
    script = tmp_path / "f.py"
    script.write_text("n = 0\ndef evaluate(x) -> int:\n    global n\n    n += x\n    return n\ndef exclude(x):\n    global n\n    n -= x\n    return n\ndef clear():\n    global n\n    n = 0\n")
    f = load("mysum", str(script))
    assert f.aggregate and f.returns == "bigint"
    from rivulet.operators.stream import Context

    df = spark.createDataFrame([(i, i) for i in range(1, 6)], "k long, x long")
    s = Stream({"t": readers.prepared(df, "k")}, (), Context({"mysum": f}))
    assert [r[0] for r in s.slide(2, "mysum(x) AS s").df.collect()] == [1, 3, 5, 7, 9]


def test_self_join_needs_another_name(spark):
    from rivulet.errors import QueryError

    df = readers.prepared(spark.createDataFrame([(1, "a")], "k long, x string"), "k")
    s = Stream({"t": df})
    f = lambda t, n: Field(((t, ()), (n, ())))
    with pytest.raises(QueryError):
        tuple_join([("t", s), ("t", s)], [[(f("t", "k"), f("t", "k"))]], [("t", "x", None)], Period(60, "1min"), "j")


def test_sinks(spark, tmp_path):
    from rivulet.sources import lookups, writers

    df = spark.createDataFrame([(1, 'a"b', None), (2, "x,y", [1, 2])], "k int, s string, l array<int>")
    assert [r[0] for r in writers.as_csv(df).collect()] == ['1,"a""b",', '2,"x,y","[1,2]"']
    assert [json.loads(r[0]) for r in writers.as_json(df).collect()] == [{"k": 1, "s": 'a"b'}, {"k": 2, "s": "x,y", "l": [1, 2]}]
    rows = writers.jdbc_persist("jdbc:x", "u", "p", "INSERT INTO t (c1, c2) VALUES (@l, @k)").rows(df)
    assert rows.columns == ["c1", "c2"] and [tuple(r) for r in rows.collect()] == [(None, 1), ("[1,2]", 2)]
    assert writers.web_body(['{"a":1}'], "es", {"index": "i", "type": "t"}) == b'{"index": {"_index": "i", "_type": "t"}}\n{"a":1}\n'
    assert readers.kafka_options("h:1", "t", 5)["startingOffsets"] == '{"t": {"0": 5}}'
    assert lookups.walk({"r": {"docs": [{"id": 1}, {"id": 2}]}}, "r.docs") == [{"id": 1}, {"id": 2}]
    fetch = lookups.web_fetch("http://x/?q=@s", "r[0]", ["id"], get=lambda u: json.dumps({"r": [[{"id": u[-3:]}]]}))
    s = Stream({"t": readers.prepared(df, "k")}).lookup(["id"], fetch)
    assert sorted(r[0] for r in s.each("id").df.collect()) == ["22b", "2Cy"]


def test_a_group_of_a_stream_need_not_fit_in_memory(spark, tmp_path, monkeypatch):
    """A group's rows of a micro-batch reach the fold in order, and its output leaves it, in parts: one record for each row, or all rows in one, would be held whole."""
    path = str(tmp_path / "in")
    n = 3 * runner._TOGETHER
    spark.range(n).select("id", F.expr("CASE WHEN id % 2 = 0 THEN 1.5D END").alias("k"), F.timestamp_seconds("id").alias("at")).repartition(5).write.parquet(path)
    live = spark.readStream.schema("id long, k double, at timestamp").parquet(path)
    out = Stream({"e": readers.prepared(live, "id", "at")}).begin_group("k").each("id, k, at, count() AS n, sum(id) AS s").df
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "packed" in plan
    name = f"w{abs(hash(str(tmp_path))) % 10**9}"
    out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.id, r.k, int(r["at"].timestamp()), r.n, r.s) for r in spark.table(name).collect())
    assert got == [(i, 1.5 if i % 2 == 0 else None, i, i // 2 + 1, sum(range(i % 2, i + 1, 2))) for i in range(n)]


def test_spilled_rows_come_in_order(monkeypatch):
    """Runs of 8 rows, four merged at a time, over several levels; equal ones stay as they come, and few are held at a time."""
    from rivulet.streaming import spill

    for name, n in (("RUN_ITEMS", 8), ("BLOCK", 3), ("FAN", 4)):
        monkeypatch.setattr(spill, name, n)
    own = [(i * 7919 % 101, i) for i in range(1000)]
    assert list(spill.in_order(pickle.dumps(x) for x in own)) == sorted(own)
    assert list(spill.in_order(iter(()))) == [] and list(spill.in_order([pickle.dumps((1,))])) == [(1,)]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_time_slides_add_each_row_at_most_twice(spark, keys):
    """Counts and totals by running frames only, which take no row again; rows of negative seconds, of the same second, far apart, with nulls and infinities."""
    rows = [(i, s, i % 2, None if i % 5 == 0 else i * (1 << 40), float("inf") if i == 3 else i / 4 if i % 3 else None) for i, s in enumerate([-25, -25, -14, -3, -3, 0, 6, 7, 7, 17, 18, 29, 40, 41, 400, 401, 411, 412])]
    df = spark.createDataFrame(rows, "n long, s long, g int, x long, y double").withColumn("at", F.timestamp_seconds("s"))
    s = Stream({"t": readers.prepared(df, "n", "at")})
    out = (s.begin_group(*keys) if keys else s).slide(Period(10, "10sec"), "n, count() AS c, count(x) AS cx, sum(x) AS sx, sum(y) AS sy, avg(x) AS ax", "at").df
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+)\)", out._jdf.queryExecution().optimizedPlan().toString())
    assert frames and all(begin == "unboundedpreceding$()" for _, begin, _ in frames), frames
    for r in out.collect():
        n, s, g = rows[r.n][:3]
        seen = [q for q in rows if q[0] <= n and s - 10 <= q[1] and (not keys or q[2] == g)]
        x, y = [q[3] for q in seen if q[3] is not None], [q[4] for q in seen if q[4] is not None]
        assert (r.c, r.cx, r.sx, r.sy, r.ax) == (len(seen), len(x), sum(x), sum(y), sum(x) // len(x) if x else None), r
    assert out.count() == len(rows)


def test_joined_rows_wait_in_arrow_with_the_fields_that_are_sent(spark, monkeypatch):
    """Rows wait over several batches; nested fields and nulls go through as they are; what is neither sent nor compared stays behind."""
    a = spark.range(3000).select(F.col("id").alias("n"), (F.col("id") % 2).alias("k"), F.struct(F.when(F.col("id") % 3 > 0, F.array("id")).alias("l"), F.lit("x").alias("t")).alias("own"), F.lit("behind").alias("rest"), F.timestamp_seconds(F.lit(0)).alias("at"))
    b = spark.createDataFrame([(1, 0, None), (2, 0, "late")], "m long, k long, t string").withColumn("at", F.timestamp_seconds(F.lit(1)))
    monkeypatch.setattr(runner, "_TOGETHER", 100)
    f = lambda t, n: Field(((t, ()), (n, ())))
    sides = [("a", Stream({"a": readers.prepared(a, "n", "at")})), ("b", Stream({"b": readers.prepared(b, "m", "at")}))]
    out = tuple_join(sides, [[(f("a", "k"), f("b", "k"))]], [("a", "n", None), ("a", "own", None), ("b", "m", None), ("b", "t", None)], Period(60, "1min"), "j").df
    assert "behind" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.n, r.own.l, r.own.t, r.m, r.t) for r in out.collect())
    assert got == [(i, [i] if i % 3 else None, "x", 1, None) for i in range(0, 3000, 2)]
