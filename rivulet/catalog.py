"""Registered queries, one for each operator and function of the language, with SQL that gives the same rows."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.user import UserFunction
from rivulet.operators.stream import Context, Stream
from rivulet.plans.nodes import Cron, Period
from rivulet.plans.parser import parse
from rivulet.session import Session, stream
from rivulet.sources import lookups, readers, writers
from rivulet.storage import shared_dir
from rivulet.types import TupleSchema, from_json_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf: str, context: Context | None = None) -> Stream:
    return stream(table(spark, sf, "events"), "events", "event_id", "ts", context)


def orders(spark: SparkSession, sf: str) -> Stream:
    return stream(table(spark, sf, "orders"), "orders", "o_orderkey", "o_orderdate")


def simple(name: str, source: str, condition: str | None, items: str, sql: str) -> None:
    """A query of FILTER and EACH over one table."""
    key = {"events": "event_id", "orders": "o_orderkey", "pages": "page_id", "embeddings": "vec_id", "lineitem": None, "documents": "doc_id"}[source]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = stream(table(spark, sf, source), source, key)
        return (s.filter(condition) if condition else s).each(items).df

    run.__name__ = name
    query(sql)(run)


# predicates
simple("filter_compare", "events", "event_type = 'purchase' AND value > 50", "event_id, user_id, value * 2 AS v2", "SELECT event_id, user_id, value * 2 AS v2 FROM events WHERE event_type = 'purchase' AND value > 50")
simple("filter_in", "orders", "o_orderstatus IN ('F', 'P') OR o_custkey IN (1, 2, 3)", "o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_custkey IN (1, 2, 3)")
simple("filter_between", "orders", "o_totalprice BETWEEN 1000 AND 50000", "o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
simple("filter_like", "orders", "o_orderpriority LIKE '_-%H'", "o_orderkey, o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '_-%H'")
simple("filter_regexp", "orders", "o_orderpriority REGEXP '[12]-[A-Z]+'", "o_orderkey, o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_full_match(o_orderpriority, '[12]-[A-Z]+')")
simple("filter_null", "events", "missing IS NULL AND props IS NOT NULL", "event_id", "SELECT event_id FROM events WHERE props IS NOT NULL")
simple("filter_not_two_valued", "events", "NOT missing > 10 AND NOT (value <= 50 OR event_type = 'view')", "event_id", "SELECT event_id FROM events WHERE NOT coalesce(value <= 50 OR event_type = 'view', false)")
simple("filter_type_mismatch", "events", "event_type <> 5 OR value < 1", "event_id", "SELECT event_id FROM events WHERE value < 1")
simple("filter_field_field", "events", "event_id >= user_id", "event_id, user_id", "SELECT event_id, user_id FROM events WHERE event_id >= user_id")

# expressions
simple("each_arith", "lineitem", None, "l_orderkey, l_linenumber, l_orderkey + 6 AS a, l_partkey - l_suppkey AS b, l_linenumber * 3 AS c, l_quantity * (1 - l_discount) AS d", "SELECT l_orderkey, l_linenumber, l_orderkey + 6 AS a, l_partkey - l_suppkey AS b, CAST(l_linenumber AS BIGINT) * 3 AS c, l_quantity * (1 - l_discount) AS d FROM lineitem")
simple("each_div_zero", "events", None, "event_id, value / (event_id % 3) AS q, event_id % (event_id % 2) AS m, event_id DIV (event_id % 4) AS d", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / (event_id % 3) END AS q, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id % (event_id % 2) END AS m, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id // (event_id % 4) END AS d FROM events")
simple("each_intdiv_mod", "orders", None, "o_orderkey, (o_custkey - 700) DIV 7 AS d, (o_custkey - 700) % 7 AS m, o_custkey / 8 AS q", "SELECT o_orderkey, (o_custkey - 700) // 7 AS d, (o_custkey - 700) % 7 AS m, o_custkey / 8.0::DOUBLE AS q FROM orders")
simple("each_null_operand", "events", None, "event_id, missing + value AS a, missing * value AS b, event_type + 1 AS c", "SELECT event_id, value AS a, 0.0::DOUBLE * value AS b, 1::BIGINT AS c FROM events")
simple("each_cast", "events", None, "event_id, cast(value AS INT) AS i, cast(user_id AS TINYINT) AS t, cast(event_id AS STRING) AS s, cast(event_type AS INT) AS n, cast(event_type AS BOOLEAN) AS b", "SELECT event_id, trunc(value)::INT AS i, (((user_id + 128) % 256) - 128)::TINYINT AS t, event_id::VARCHAR AS s, NULL::INT AS n, length(event_type) > 0 AS b FROM events")
simple("each_cast_timestamp", "events", None, "event_id, cast(ts AS BIGINT) AS s, cast(cast(event_id AS TIMESTAMP) AS BIGINT) AS e, cast(cast('20240102' AS TIMESTAMP('yyyyMMdd')) AS BIGINT) AS f", "SELECT event_id, floor(epoch(ts))::BIGINT AS s, event_id AS e, 1704153600::BIGINT AS f FROM events")
simple("each_date_format", "events", None, "event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS d, date_format(event_type, 'yyyy') AS e", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS d, event_type AS e FROM events")
simple("each_concat", "orders", None, "o_orderkey, concat(o_orderstatus, '-', missing, o_custkey) AS c", "SELECT o_orderkey, o_orderstatus || '-' || o_custkey::VARCHAR AS c FROM orders")
simple("each_ifnull", "orders", None, "o_orderkey, ifnull(missing, 'none') AS a, ifnull(o_orderstatus, 'none') AS b", "SELECT o_orderkey, 'none' AS a, coalesce(o_orderstatus, 'none') AS b FROM orders")
simple("each_split", "pages", None, "page_id, split(url, '/')[0] AS scheme, split(url, '/')[2] AS host, size(split(concat(url, '//'), '/')) AS n", "SELECT page_id, string_split(url, '/')[1] AS scheme, string_split(url, '/')[3] AS host, len(string_split(regexp_replace(url, '/+$', ''), '/'))::INT AS n FROM pages")
simple("each_regexp_extract", "pages", None, "page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS num, regexp_extract(url, 'nothing') AS none, regexp_extract(url, '://') AS whole, regexp_extract(url, '(a)', 7) AS beyond", "SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS num, NULL::VARCHAR AS none, '://' AS whole, NULL::VARCHAR AS beyond FROM pages")
simple("each_parse_url", "pages", None, "page_id, parse_url(url, 'HOST') AS host, parse_url(url, 'PROTOCOL') AS protocol, parse_url(url, 'QUERY') AS query, parse_url(url, 'QUERY', 'page') AS page", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+)', 1) AS protocol, NULL::VARCHAR AS query, nullif(regexp_extract(url, '[?&]page=([^&#=]*)', 1), '') AS page FROM pages")
simple("each_distance", "lineitem", None, "l_orderkey, l_linenumber, distance(l_quantity, l_tax, l_discount, l_extendedprice) AS d, distance(l_quantity, 'x', 0, 0) AS z", "SELECT l_orderkey, l_linenumber, sqrt((l_quantity - l_discount) * (l_quantity - l_discount) + (l_tax - l_extendedprice) * (l_tax - l_extendedprice)) AS d, 0.0::DOUBLE AS z FROM lineitem")
simple("each_sqrt_trig", "events", None, "event_id, sqrt(value) AS q, sin(value) AS s, cos(value) AS c, tan(value) AS t, sqrt(event_type) AS z", "SELECT event_id, sqrt(value) AS q, sin(value) AS s, cos(value) AS c, tan(value) AS t, 0.0::DOUBLE AS z FROM events")
simple("each_size", "embeddings", None, "vec_id, size(embedding) AS n, size(label) AS z", "SELECT vec_id, len(embedding)::INT AS n, 0::INT AS z FROM embeddings")
simple("each_slice", "embeddings", None, "vec_id, slice(embedding, 0, 2)[1] AS a, size(slice(embedding, -3)) AS n, slice(embedding, -2, -1)[0] AS b, size(slice(embedding, 5, 2)) AS e", "SELECT vec_id, embedding[2] AS a, 3::INT AS n, embedding[len(embedding) - 1] AS b, 0::INT AS e FROM embeddings")
simple("each_subscript", "embeddings", None, "vec_id, embedding[0] AS a, embedding[size(embedding) - 1] AS b, embedding[100000] AS none", "SELECT vec_id, embedding[1] AS a, embedding[len(embedding)] AS b, NULL::FLOAT AS none FROM embeddings")
simple("filter_all_list", "embeddings", "embedding ALL (100.5, 200.5)", "vec_id", "SELECT vec_id FROM embeddings WHERE list_contains(embedding, 100.5) AND list_contains(embedding, 200.5)")
simple("filter_in_list", "embeddings", "label IN (1, 2, 3) OR embedding IN (100.5, 200.5)", "vec_id, label", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2, 3) OR list_has_any(embedding, [100.5::FLOAT, 200.5::FLOAT])")


def _props(spark: SparkSession, sf: str) -> Stream:
    df = table(spark, sf, "events")
    df = df.withColumns({"s": F.from_json("props", "struct<k:bigint>"), "m": F.from_json("props", "map<string,bigint>")})
    return stream(df, "events", "event_id", "ts")


@query("SELECT event_id, (props->>'k')::BIGINT AS a, NULL::VARCHAR AS b FROM events WHERE (props->>'k')::BIGINT > 10")
def each_struct_field(spark, sf):
    return _props(spark, sf).filter("events.s.k > 10").each("event_id, events.s.k AS a, s.nothing AS b").df.withColumn("b", F.col("b").cast("string"))


@query("SELECT event_id, (props->>'k')::BIGINT AS a, NULL::BIGINT AS b FROM events")
def each_map_access(spark, sf):
    return _props(spark, sf).each("event_id, m['k'] AS a, m['none'] AS b").df


# running aggregates and grouping
_RUN = "ORDER BY event_id ROWS UNBOUNDED PRECEDING"


@query(f"SELECT event_id, (sum(user_id) OVER w)::BIGINT AS s, count(*) OVER w AS n, ((sum(user_id) OVER w) // count(*) OVER w)::BIGINT AS a FROM events WINDOW w AS ({_RUN})")
def running_global(spark, sf):
    return events(spark, sf).each("event_id, sum(user_id) AS s, count() AS n, avg(user_id) AS a").df


@query(f"SELECT event_id, user_id, round(sum(value) OVER w, 6) AS s, count(*) OVER w AS n, round(avg(value) OVER w + 1e-9, 6) AS a FROM events WINDOW w AS (PARTITION BY user_id {_RUN})")
def running_grouped(spark, sf):
    out = events(spark, sf).begin_group("user_id").each("event_id, user_id, sum(value) AS s, count() AS n, avg(value) AS a").df
    return out.withColumns({"s": F.round("s", 6), "a": F.round(F.col("a") + 1e-9, 6)})


@query(f"SELECT event_id, ((sum(user_id) OVER w) // count(*) OVER w)::BIGINT AS a FROM events WINDOW w AS (PARTITION BY event_type {_RUN})")
def running_avg_int(spark, sf):
    return events(spark, sf).begin_group("event_type").each("event_id, avg(user_id) AS a").df


@query(f"SELECT event_id, count(DISTINCT event_type) OVER w AS n, (list_sum(list_distinct(list(event_id % 5) OVER w)))::BIGINT AS s FROM events WINDOW w AS (PARTITION BY user_id {_RUN})")
def running_distinct(spark, sf):
    return events(spark, sf).begin_group("user_id").each("event_id, count(DISTINCT event_type) AS n, sum(DISTINCT event_id % 5) AS s").df


@query(f"SELECT event_id, array_to_string(list(event_type) OVER w, ',') AS l FROM events WINDOW w AS (PARTITION BY user_id {_RUN})")
def running_collect_list(spark, sf):
    return events(spark, sf).begin_group("user_id").each("event_id, collect_list(event_type) AS l").df.withColumn("l", F.array_join("l", ","))


@query(f"SELECT event_id, array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ',') AS l FROM events WINDOW w AS (PARTITION BY user_id {_RUN})")
def running_collect_set(spark, sf):
    return events(spark, sf).begin_group("user_id").each("event_id, collect_set(event_type) AS l").df.withColumn("l", F.array_join(F.array_sort("l"), ","))


@query(f"SELECT event_id, (sum(event_id * 10) OVER w * count(*) OVER w)::BIGINT AS d FROM events WINDOW w AS (PARTITION BY user_id {_RUN})")
def running_agg_arith(spark, sf):
    return events(spark, sf).begin_group("user_id").each("event_id, sum(event_id * 10) * count() AS d").df


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n2,
  count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n1 FROM events""")
def group_nested(spark, sf):
    """BEGIN GROUP inside a group, then END GROUP: the first count sees both keys, the second one only."""
    s = events(spark, sf).begin_group("user_id").begin_group("event_type").each("event_id, user_id, count() AS n2").end_group()
    return s.each("event_id, n2, count() AS n1").df


@query("""SELECT event_id, k, count(*) OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n
FROM (SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE event_type END AS k FROM events)""")
def group_null_key(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.when(F.col("value") <= 100, F.col("event_type")))
    return stream(df, "events", "event_id", "ts").begin_group("k").each("event_id, k, count() AS n").df


@query("""SELECT event_id, n, (sum(n) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS t FROM
(SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)""")
def to_stream(spark, sf):
    return events(spark, sf).begin_group("user_id").each("event_id, count() AS n").to_stream().each("event_id, n, sum(n) AS t").df


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def partition_by(spark, sf):
    """PARTITION BY deals rows by key; a count per key then needs no further exchange."""
    return events(spark, sf).partition("user_id").each("user_id, event_id").df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# windows
@query("SELECT event_id, (sum(user_id) OVER w)::BIGINT AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING)")
def slide_count(spark, sf):
    return events(spark, sf).begin_group("event_type").slide(5, "event_id, sum(user_id) AS s, count() AS n").df


@query("SELECT event_id, (sum(user_id) OVER w)::BIGINT AS s, round(avg(value) OVER w + 1e-9, 6) AS a FROM events WINDOW w AS (ORDER BY event_id ROWS 99 PRECEDING)")
def slide_count_global(spark, sf):
    return events(spark, sf).slide(100, "event_id, sum(user_id) AS s, avg(value) AS a").df.withColumn("a", F.round(F.col("a") + 1e-9, 6))


_SECONDS = "(SELECT *, floor(epoch(ts))::BIGINT AS sec FROM events)"


@query(f"""SELECT a.event_id, count(*) AS n, sum(b.event_id)::BIGINT AS s, round(avg(b.value) + 1e-9, 6) AS v FROM {_SECONDS} a JOIN {_SECONDS} b
ON a.user_id = b.user_id AND b.sec >= a.sec - 86400 AND b.event_id <= a.event_id GROUP BY a.event_id""")
def slide_time(spark, sf):
    out = events(spark, sf).begin_group("user_id").slide(Period(86400, "1days"), "event_id, count() AS n, sum(event_id) AS s, avg(value) AS v", "ts").df
    return out.withColumn("v", F.round(F.col("v") + 1e-9, 6))


@query(f"""SELECT a.event_id, count(*) AS n, sum(b.user_id)::BIGINT AS s FROM {_SECONDS} a JOIN {_SECONDS} b
ON b.sec >= a.sec - 600 AND b.event_id <= a.event_id AND b.sec // 600 >= a.sec // 600 - 1 AND b.sec // 600 <= a.sec // 600 GROUP BY a.event_id""")
def slide_time_global(spark, sf):
    return events(spark, sf).slide(Period(600, "10min"), "event_id, count() AS n, sum(user_id) AS s", "ts").df


@query(f"""SELECT a.event_id, count(DISTINCT b.event_type) AS n, sum(DISTINCT b.event_id % 7)::BIGINT AS s FROM {_SECONDS} a JOIN {_SECONDS} b
ON a.user_id = b.user_id AND b.sec >= a.sec - 86400 AND b.event_id <= a.event_id GROUP BY a.event_id""")
def slide_distinct(spark, sf):
    return events(spark, sf).begin_group("user_id").slide(Period(86400, "1days"), "event_id, count(DISTINCT event_type) AS n, sum(DISTINCT event_id % 7) AS s", "ts").df


@query("SELECT event_id, array_to_string(list(event_type) OVER w, ',') AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)")
def slide_collect(spark, sf):
    return events(spark, sf).begin_group("user_id").slide(3, "event_id, collect_list(event_type) AS l").df.withColumn("l", F.array_join("l", ","))


@query("""SELECT event_type, max(event_id) AS event_id, sum(user_id)::BIGINT AS s, count(*) AS n FROM
(SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 10 AS b FROM events) GROUP BY event_type, b HAVING count(*) = 10""")
def snapshot_count(spark, sf):
    return events(spark, sf).begin_group("event_type").snapshot(10, "event_type, event_id, sum(user_id) AS s, count() AS n").df


@query("""SELECT max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, sum(user_id)::BIGINT AS s FROM
(SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS b FROM events) GROUP BY b HAVING count(*) = 64""")
def snapshot_count_global(spark, sf):
    return events(spark, sf).snapshot(64, "event_id, event_type, sum(user_id) AS s").df


@query("SELECT count(*) AS n, sum(user_id)::BIGINT AS s, max(event_id) AS event_id FROM events GROUP BY floor(epoch(ts))::BIGINT // 3600")
def snapshot_time(spark, sf):
    return events(spark, sf).snapshot(Period(3600, "1h"), "count() AS n, sum(user_id) AS s, event_id").df


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS s, count(DISTINCT user_id) AS u FROM events GROUP BY event_type, floor(epoch(ts))::BIGINT // 86400")
def snapshot_time_grouped(spark, sf):
    out = events(spark, sf).begin_group("event_type").snapshot(Period(86400, "1days"), "event_type, count() AS n, sum(value) AS s, count(DISTINCT user_id) AS u").df
    return out.withColumn("s", F.round("s", 6))


@query("SELECT event_type, count(*) AS n, max(event_id) AS event_id FROM events GROUP BY event_type, floor(epoch(ts) / 21600)")
def snapshot_cron(spark, sf):
    return events(spark, sf).begin_group("event_type").snapshot(Cron("0 0 0/6 * * ? *"), "event_type, count() AS n, event_id").df


@query("""SELECT event_type, event_id, n, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY event_type, h ORDER BY event_id DESC) AS r FROM
(SELECT event_type, event_id, h, count(*) OVER w AS n, sum(value) OVER w AS s FROM
 (SELECT *, floor(epoch(ts))::BIGINT // 21600 AS h, floor(epoch(first_value(ts) OVER (PARTITION BY event_type, floor(epoch(ts))::BIGINT // 21600 ORDER BY event_id)))::BIGINT // 86400 AS d FROM events)
 WINDOW w AS (PARTITION BY event_type, d ORDER BY event_id ROWS UNBOUNDED PRECEDING))) WHERE r = 1""")
def snapshot_expire(spark, sf):
    out = events(spark, sf).begin_group("event_type").snapshot(Period(21600, "6h"), "event_type, event_id, count() AS n, sum(value) AS s", Period(86400, "1days")).df
    return out.withColumn("s", F.round("s", 6))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 9223372036854775807 ELSE 4611686018427387904 + user_id END AS x FROM events),
s AS (SELECT event_id, user_id, sum(x::HUGEINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM e)
SELECT event_id, (((t + 9223372036854775808) % 18446744073709551616) - 9223372036854775808)::BIGINT AS s FROM s""")
def running_sum_wraps(spark, sf):
    """Sums beyond 64 bits wrap."""
    df = table(spark, sf, "events").withColumn("x", F.when(F.col("event_id") % 5 == 0, F.lit((1 << 63) - 1)).otherwise(F.lit(1 << 62) + F.col("user_id")))
    return stream(df, "events", "event_id", "ts").begin_group("user_id").each("event_id, sum(x) AS s").df


@query("""WITH e AS (SELECT event_id, event_type, event_id // 4 AS sec, CASE WHEN event_id % 4 = 3 THEN 1e300 ELSE value END AS x FROM events)
SELECT a.event_id, count(*) AS n, max(b.x) >= 1e300 AS big, CASE WHEN max(b.x) < 1e300 THEN round(sum(b.x) + 1e-9, 6) END AS s FROM e a JOIN e b ON b.event_type = a.event_type AND b.sec BETWEEN a.sec - 2 AND a.sec AND b.event_id <= a.event_id GROUP BY a.event_id""")
def slide_time_same_second(spark, sf):
    """Four rows in a second, the last one huge: it must not be in the sums of those before it, not even as a rounding error."""
    df = table(spark, sf, "events").withColumns({"at": F.timestamp_seconds(F.floor(F.col("event_id") / 4)), "x": F.when(F.col("event_id") % 4 == 3, 1e300).otherwise(F.col("value"))})
    out = stream(df, "events", "event_id", "at").begin_group("event_type").slide(Period(2, "2sec"), "event_id, count() AS n, sum(x) AS t", "at").df
    return out.select("event_id", "n", (F.col("t") >= 1e300).alias("big"), F.when(F.col("t") < 1e300, F.round(F.col("t") + 1e-9, 6)).alias("s"))


# sampling and patterns
@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE (r - 1) % 3 = 0")
def limit_first_count(spark, sf):
    return events(spark, sf).begin_group("user_id").limit(True, 3).each("event_id").df


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r % 100 = 0")
def limit_last_count(spark, sf):
    return events(spark, sf).limit(False, 100).each("event_id").df


@query("""WITH RECURSIVE e AS (SELECT *, floor(epoch(ts))::BIGINT AS sec FROM events),
walk AS (SELECT user_id, min(event_id) AS event_id FROM e GROUP BY user_id
 UNION ALL SELECT w.user_id, (SELECT min(n.event_id) FROM e n WHERE n.user_id = w.user_id AND n.event_id > w.event_id AND n.sec > c.sec + 86400)
 FROM walk w JOIN e c ON c.event_id = w.event_id WHERE w.event_id IS NOT NULL)
SELECT event_id FROM walk WHERE event_id IS NOT NULL""")
def limit_first_time(spark, sf):
    return events(spark, sf).begin_group("user_id").limit(True, Period(86400, "1days")).each("event_id").df


@query("""WITH RECURSIVE e AS (SELECT *, floor(epoch(ts))::BIGINT AS sec, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
walk AS (SELECT user_id, min(event_id) AS event_id FROM e GROUP BY user_id
 UNION ALL SELECT w.user_id, (SELECT min(n.event_id) FROM e n WHERE n.user_id = w.user_id AND n.event_id > w.event_id AND n.sec > c.sec + 86400)
 FROM walk w JOIN e c ON c.event_id = w.event_id WHERE w.event_id IS NOT NULL)
SELECT e.prev AS event_id FROM walk JOIN e USING (event_id) WHERE e.prev IS NOT NULL""")
def limit_last_time(spark, sf):
    return events(spark, sf).begin_group("user_id").limit(False, Period(86400, "1days")).each("event_id").df


#: The rows one by one: of each condition the second up to which it holds, and whether both did.
_GROUPS = """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec, event_type = 'purchase' AS c1, event_type = 'click' AND value > 20 AS c2,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
walk AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 0::BIGINT AS k1, 0::BIGINT AS k2, NULL::BIGINT AS event_id, false AS hit FROM e
 UNION ALL SELECT user_id, r, CASE WHEN n1 > 0 AND n2 > 0 THEN 0 ELSE n1 END, CASE WHEN n1 > 0 AND n2 > 0 THEN 0 ELSE n2 END, event_id, n1 > 0 AND n2 > 0 FROM
 (SELECT e.user_id, e.r, e.event_id, CASE WHEN c1 THEN sec + 172800 WHEN k1 < sec THEN 0 ELSE k1 END AS n1, CASE WHEN c2 THEN sec + 172800 WHEN k2 < sec THEN 0 ELSE k2 END AS n2
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1))
SELECT event_id, user_id, 2 AS n FROM walk WHERE hit"""


@query(_GROUPS)
def filter_group(spark, sf):
    s = events(spark, sf).begin_group("user_id")
    return s.filter_group(Period(172800, "2days"), ["event_type = 'purchase'", "event_type = 'click' AND value > 20"], "until").each("event_id, user_id, size(until) AS n").df


# joins, merging and naming
@query("SELECT o_orderkey, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_lookup(spark, sf):
    fetch = lookups.table_lookup(table(spark, sf, "customer"), {"c_custkey": "o_custkey"}, ["c_name", "c_mktsegment"])
    return orders(spark, sf).lookup(["name", "segment"], fetch).each("o_orderkey, name, segment").df


@query("""SELECT c_custkey, o_orderkey AS best FROM customer JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON c_custkey = o_custkey AND r <= 2""")
def join_lookup_topk(spark, sf):
    """A lookup that gives two rows at most: sort and limit are applied to each key before the join."""
    fetch = lookups.table_lookup(table(spark, sf, "orders"), {"o_custkey": "c_custkey"}, ["o_orderkey"], sort=[("o_totalprice", True), ("o_orderkey", False)], limit=2)
    return stream(table(spark, sf, "customer"), "customer", "c_custkey").lookup(["best"], fetch).each("c_custkey, best").df


def _joined(spark, sf, text: str, *tables: tuple[str, DataFrame, str, str]) -> DataFrame:
    s = Session(spark)
    out_df: list[DataFrame] = []
    for name, df, seq, clock in tables:
        s.register(name, df, seq, clock)
    s.sinks["keep"] = lambda: lambda df: out_df.append(df)
    s.run(text)
    return out_df[0]


@query("SELECT o_orderkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) JOIN customer ON o_custkey = c_custkey WHERE r = 1")
def tuple_join_2way(spark, sf):
    """All customers arrive at once, then orders one by one: the first order of each takes its customer away."""
    c = table(spark, sf, "customer").withColumn("at", F.timestamp_seconds(F.lit(0)))
    o = table(spark, sf, "orders").withColumn("at", F.timestamp_seconds(F.lit(1)))
    return _joined(spark, sf, """FROM (orders JOIN customer ON orders.o_custkey = customer.c_custkey TO orders.o_orderkey, customer.c_custkey, customer.c_name EXPIRE 1min) AS t USING memory_spout()
      EMIT * USING keep(); SUBMIT TOPOLOGY j;""", ("orders", o, "o_orderkey", "at"), ("customer", c, "c_custkey", "at"))


@query("SELECT n_nationkey, s_suppkey, c_custkey FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) ON c_nationkey = n_nationkey WHERE r = 1")
def tuple_join_nway(spark, sf):
    """Three sides on one key: nations and suppliers wait for the first customer of their nation."""
    at = lambda t, s: table(spark, sf, t).withColumn("at", F.timestamp_seconds(F.lit(s)))
    return _joined(spark, sf, """FROM (nation JOIN supplier ON nation.n_nationkey = supplier.s_nationkey JOIN customer ON nation.n_nationkey = customer.c_nationkey
      TO nation.n_nationkey, supplier.s_suppkey, customer.c_custkey EXPIRE 1min) AS t USING memory_spout() EMIT * USING keep(); SUBMIT TOPOLOGY j;""",
      ("nation", at("nation", 0), "n_nationkey", "at"), ("supplier", at("supplier", 1), "s_suppkey", "at"), ("customer", at("customer", 2), "c_custkey", "at"))


@query("""WITH f AS (SELECT r_regionkey, r_name, n_nationkey FROM region JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) ON n_regionkey = r_regionkey WHERE r = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT r_name, n_nationkey, s_suppkey AS sup FROM f JOIN g ON s_nationkey = n_nationkey WHERE k = 1""")
def tuple_join_chain(spark, sf):
    """Regions with their first nation, and that one with its first supplier: two keys, one join after the other."""
    at = lambda t, s: table(spark, sf, t).withColumn("at", F.timestamp_seconds(F.lit(s)))
    return _joined(spark, sf, """FROM (region JOIN nation ON region.r_regionkey = nation.n_regionkey JOIN supplier ON nation.n_nationkey = supplier.s_nationkey
      TO region.r_name, nation.n_nationkey, supplier.s_suppkey AS sup EXPIRE 1min) AS t USING memory_spout() EMIT * USING keep(); SUBMIT TOPOLOGY j;""",
      ("region", at("region", 0), "r_regionkey", "at"), ("nation", at("nation", 1), "n_nationkey", "at"), ("supplier", at("supplier", 2), "s_suppkey", "at"))


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority FROM orders JOIN (SELECT l_orderkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber) AS r FROM lineitem) l
ON o_orderkey = l_orderkey AND o_custkey % 3 = l_suppkey % 3 WHERE r = 1""")
def tuple_join_composite(spark, sf):
    """Two equalities make one key."""
    o = table(spark, sf, "orders").withColumns({"at": F.timestamp_seconds(F.lit(0)), "k": F.col("o_custkey") % 3})
    lines = table(spark, sf, "lineitem").withColumns({"at": F.timestamp_seconds(F.lit(1)), "k": F.col("l_suppkey") % 3})
    return _joined(spark, sf, """FROM (orders JOIN lineitem ON orders.o_orderkey = lineitem.l_orderkey AND orders.k = lineitem.k
      TO lineitem.l_orderkey, lineitem.l_linenumber, orders.o_orderpriority EXPIRE 1min) AS t USING memory_spout() EMIT * USING keep(); SUBMIT TOPOLOGY j;""",
      ("orders", o, "o_orderkey", "at"), ("lineitem", lines, "l_linenumber", "at"))


@query("SELECT n_nationkey AS a, n_nationkey AS b FROM nation")
def tuple_join_self(spark, sf):
    """A stream joined with itself under another name: each row meets itself, and is taken away."""
    n = table(spark, sf, "nation").withColumn("at", F.timestamp_seconds(F.lit(0)))
    return _joined(spark, sf, """FROM nation USING memory_spout() INTO s1; FROM s1(nation) AS other INTO s2;
      FROM (s1(nation) JOIN s2(other) ON nation.n_nationkey = other.n_nationkey TO nation.n_nationkey AS a, other.n_nationkey AS b EXPIRE 1min) AS t
      EMIT * USING keep(); SUBMIT TOPOLOGY j;""", ("nation", n, "n_nationkey", "at"))


@query("SELECT event_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) e JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) o ON o_custkey = user_id WHERE k = 1")
def tuple_join_nested(spark, sf):
    """A key inside a struct: all events arrive first, then the first order of each user takes its events away."""
    e = table(spark, sf, "events").withColumns({"at": F.timestamp_seconds(F.lit(0)), "who": F.struct(F.struct(F.col("user_id").alias("id")).alias("user"))})
    o = table(spark, sf, "orders").withColumn("at", F.timestamp_seconds(F.lit(1)))
    return _joined(spark, sf, """FROM (orders JOIN events ON orders.o_custkey = events.who.user.id TO events.event_id, orders.o_orderkey EXPIRE 1min) AS t USING memory_spout()
      EMIT * USING keep(); SUBMIT TOPOLOGY j;""", ("orders", o, "o_orderkey", "at"), ("events", e, "event_id", "at"))


@query("SELECT event_id, max(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS other FROM events")
def tuple_join_grouped(spark, sf):
    """Streams of one group are joined inside it: each row meets itself only, though others of its group have the key's value too."""
    return _joined(spark, sf, """FROM events USING memory_spout() INTO s1; FROM s1 BEGIN GROUP BY user_id, event_id INTO a; FROM s1(events) AS other BEGIN GROUP BY user_id, event_id INTO b;
      FROM (a(events) JOIN b(other) ON events.event_type = other.event_type TO events.event_id, other.event_id AS other EXPIRE 1min) AS t EMIT * USING keep(); SUBMIT TOPOLOGY j;""", _EVENTS(spark, sf))


@query("""SELECT event_id AS id, value AS x FROM events UNION ALL SELECT o_orderkey, o_totalprice FROM orders""")
def merge(spark, sf):
    """Streams of two tuples as one; EMIT sends the rows of both."""
    return _joined(spark, sf, """FROM events, orders USING memory_spout() INTO s1;
      FROM s1(events) EACH event_id AS id, value AS x INTO a; FROM s1(orders) EACH o_orderkey AS id, o_totalprice AS x INTO b;
      FROM a, b EMIT * USING keep(); SUBMIT TOPOLOGY m;""", ("events", table(spark, sf, "events"), "event_id", "ts"), ("orders", table(spark, sf, "orders"), "o_orderkey", "o_orderdate"))


@query("""SELECT count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT o_orderkey FROM orders)""")
def merge_running(spark, sf):
    """A running count over both tuples of a stream: its last value."""
    out = _joined(spark, sf, """FROM events, orders USING memory_spout() INTO s1;
      FROM s1 EACH count() AS c EMIT * USING keep(); SUBMIT TOPOLOGY m;""", ("events", table(spark, sf, "events"), "event_id", "ts"), ("orders", table(spark, sf, "orders"), "o_orderkey", "o_orderdate"))
    return out.agg(F.max("c").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def rename(spark, sf):
    return _joined(spark, sf, "FROM events AS e USING memory_spout() FILTER e.event_type = 'click' INTO s; FROM s(e) AS f EACH f.event_id, f.user_id EMIT * USING keep(); SUBMIT TOPOLOGY r;", ("events", table(spark, sf, "events"), "event_id", "ts"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY ALL")
def view(spark, sf):
    s, out = Session(spark), []
    s.register("events", table(spark, sf, "events"), "event_id", "ts")
    s.sinks["keep"] = lambda: out.append
    s.run("""CREATE VIEW big AS FROM events FILTER event_type = 'purchase' AND value > 10;
      FROM big USING memory_spout() BEGIN GROUP BY event_type SNAPSHOT EVERY 36500days event_type, count() AS n EMIT * USING keep(); SUBMIT TOPOLOGY v;""")
    return out[0]


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def multi_tuple_select(spark, sf):
    return _joined(spark, sf, "FROM events, orders USING memory_spout() INTO s; FROM s(orders) FILTER o_orderstatus = 'F' EMIT o_orderkey USING keep(); SUBMIT TOPOLOGY t;", ("events", table(spark, sf, "events"), "event_id", "ts"), ("orders", table(spark, sf, "orders"), "o_orderkey", "o_orderdate"))


@query("SELECT 'a' AS part, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'b', count(*) FROM events WHERE value > 50")
def named_stream_fanout(spark, sf):
    s, out = Session(spark), []
    s.register("events", table(spark, sf, "events"), "event_id", "ts")
    s.sinks["keep"] = lambda: out.append
    s.run("""FROM events USING memory_spout() INTO s1;
      FROM s1 FILTER event_type = 'click' EMIT event_id USING keep(); FROM s1 FILTER value > 50 EMIT event_id USING keep(); SUBMIT TOPOLOGY f;""")
    return out[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("a").alias("part"), "n").union(out[1].agg(F.count(F.lit(1)).alias("n")).select(F.lit("b"), "n"))


# sinks
_EVENTS = lambda spark, sf: ("events", table(spark, sf, "events"), "event_id", "ts")


def _stored(spark: SparkSession, text: str, *tables: tuple[str, DataFrame, str, str]) -> Session:
    """A session with a warehouse, after ``text``."""
    s = Session(spark, warehouse=shared_dir(spark, "warehouse"))
    for t in tables:
        s.register(*t)
    s.run(text)
    return s


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def emit_upsert(spark, sf):
    """The store keeps the row that arrived last of each key, whatever exchange its rows have been through; a second topology writes to the same collection."""
    s = _stored(spark, """FROM events USING memory_spout() FILTER event_type <> 'click' PARTITION BY event_type EMIT user_id, event_id, event_type USING mongo_persist('db', 'last', ['user_id']); SUBMIT TOPOLOGY one;""", _EVENTS(spark, sf))
    e = table(spark, sf, "events")
    newest = e.groupBy("user_id").agg(F.max("event_id").alias("newest")).join(e.where("event_type = 'click'"), "user_id").where("event_id = newest").drop("newest")
    s.register("clicks", newest, "event_id", "ts")
    s.run("FROM clicks USING memory_spout() EMIT user_id, event_id, event_type USING mongo_persist('db', 'last', ['user_id']); SUBMIT TOPOLOGY two;")
    return s.collection(("db", "last"))


@query("""SELECT user_id, max(event_id) FILTER (event_type = 'click') AS clicked, max(event_id) FILTER (event_type = 'purchase') AS bought FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id""")
def emit_upsert_fields(spark, sf):
    """Two topologies set different fields of one collection; what one does not send keeps its value."""
    s = _stored(spark, """FROM events USING memory_spout() FILTER event_type = 'click' EACH user_id, event_id AS clicked EMIT * USING mongo_persist('db', 'seen', 'user_id'); SUBMIT TOPOLOGY a;
      FROM events USING memory_spout() FILTER event_type = 'purchase' EACH user_id, event_id AS bought EMIT * USING mongo_persist('db', 'seen', 'user_id'); SUBMIT TOPOLOGY b;""", _EVENTS(spark, sf))
    return s.collection(("db", "seen"))


@query("SELECT event_id, user_id FROM events WHERE value > 20")
def emit_append(spark, sf):
    """Without keys, rows are added."""
    s = _stored(spark, """FROM events USING memory_spout() FILTER value > 50 EMIT event_id, user_id USING mongo_persist('db', '${topology_name}'); SUBMIT TOPOLOGY big;
      FROM events USING memory_spout() FILTER value > 20 AND NOT value > 50 EMIT event_id, user_id USING mongo_persist('db', 'big'); SUBMIT TOPOLOGY small;""", _EVENTS(spark, sf))
    return s.collection(("db", "big"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")
def emit_to(spark, sf):
    """Rows become records of another declared tuple, which a second topology reads."""
    s = _stored(spark, """CREATE TUPLE clicks (event_id BIGINT, user_id BIGINT);
      FROM events USING memory_spout() FILTER event_type = 'click' EMIT event_id, user_id TO clicks; SUBMIT TOPOLOGY first;""", _EVENTS(spark, sf))
    out: list[DataFrame] = []
    s.sinks["keep"] = lambda: out.append
    s.run("FROM clicks USING kafka_spout() BEGIN GROUP BY user_id SNAPSHOT EVERY 36500days user_id, count() AS n EMIT * USING keep(); SUBMIT TOPOLOGY second;")
    return out[0]


@query("""SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_jdbc(spark, sf):
    """Rows are written to a database (Derby, in the driver's process, on its disk) by jdbc_persist and looked up from it by jdbc_fetch."""
    url = f"jdbc:derby:{tempfile.mkdtemp(prefix='rivulet-')}/people;create=true"
    spark._jvm.java.sql.DriverManager.getConnection(url).createStatement().execute("CREATE TABLE people (id BIGINT, name VARCHAR(64), segment VARCHAR(16))")
    keep: list[DataFrame] = []
    s = Session(spark)
    s.register("customer", table(spark, sf, "customer"), "c_custkey", None)
    s.register("orders", table(spark, sf, "orders"), "o_orderkey", "o_orderdate")
    s.sinks["keep"] = lambda: keep.append
    s.run(f"""FROM customer USING memory_spout() EMIT c_custkey, c_name, c_mktsegment
        USING jdbc_persist('{url}', '', '', 'INSERT INTO people (id, name, segment) VALUES (@c_custkey, @c_name, @c_mktsegment)'); SUBMIT TOPOLOGY w;
      FROM orders USING memory_spout() JOIN name USING jdbc_fetch('{url}', '', '', "SELECT name FROM people WHERE id = @o_custkey AND segment = 'BUILDING'")
        EMIT o_orderkey, name USING keep(); SUBMIT TOPOLOGY r;""")
    return keep[0]


@query("""SELECT o_orderkey, c_name AS name, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_mongo_fetch(spark, sf):
    s = Session(spark)
    s.register("orders", table(spark, sf, "orders"), "o_orderkey", "o_orderdate")
    s.collections["db", "people"] = table(spark, sf, "customer")
    keep: list[DataFrame] = []
    s.sinks["keep"] = lambda: keep.append
    s.run("""FROM orders USING memory_spout() JOIN name, nation USING mongo_fetch('db', 'people', '{c_custkey:@o_custkey, c_mktsegment:"BUILDING"}', ['c_name', 'c_nationkey'], 1min)
      EMIT o_orderkey, name, nation USING keep(); SUBMIT TOPOLOGY r;""")
    return keep[0]


def _answer(url: str) -> str:
    """A service that knows the even numbers, breaks at multiples of three, and answers with a list of one object for each."""
    n = int(url.rsplit("=", 1)[1])
    if n % 3 == 0:
        raise OSError("no answer")
    return json.dumps({"found": [[{"id": n, "half": n // 2}]] if n % 2 == 0 else [[]]})


@query("SELECT n_nationkey, n_nationkey::VARCHAR AS id, (n_nationkey // 2)::VARCHAR AS half FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def join_web_fetch(spark, sf):
    """A lookup by url; rows whose request fails go, as do those without a result."""
    fetch = lookups.web_fetch("http://service/?n=@n_nationkey", "found[0]", ["id", "half"], get=_answer)
    return stream(table(spark, sf, "nation"), "nation", "n_nationkey").lookup(["id", "half"], fetch).each("n_nationkey, id, half").df


@query("SELECT event_id::VARCHAR || ',' || event_type || ',\"' || replace(props, '\"', '\"\"') || '\"' AS value FROM events WHERE props LIKE '%\"%'")
def emit_csv(spark, sf):
    return writers.as_csv(events(spark, sf).filter("props REGEXP '.*\".*'").project(["event_id", "event_type", "props"]))


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}' AS value FROM orders""")
def emit_json(spark, sf):
    return writers.as_json(orders(spark, sf).project(["o_orderkey", "o_orderstatus", "o_orderdate"]))


# sources and streams
@query("SELECT event_id, user_id, event_type, round(value, 6) AS value, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type <> 'view'")
def source_json(spark, sf):
    """Records as JSON lines, read by a declared schema; timestamps come as epoch seconds, a record with an unknown field is dropped."""
    df = table(spark, sf, "events").withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp")))
    extra = F.when(F.col("event_type") == "view", F.lit(1)).alias("unknown")
    lines = df.select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "ts", extra)).alias("value"))
    own = parse("CREATE TUPLE e (event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP)").args
    rows = stream(from_json_lines(lines, TupleSchema("e", own["fields"])), "e", "event_id", "ts")
    return rows.each("event_id, user_id, event_type, value, cast(ts AS BIGINT) AS s").df.withColumn("value", F.round("value", 6))


def _streamed(spark: SparkSession, sf: str, build: Callable[[Stream], Stream]) -> DataFrame:
    """``build`` over the events as a stream, run to its end; what the sink has got."""
    base = shared_dir(spark, "stream")
    live = readers.parquet_stream(spark, sf, "event_id", "ts", "events.parquet")
    out = build(Stream({"events": live})).df
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"SELECT event_id, (sum(user_id) OVER w)::BIGINT AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type {_RUN})")
def stream_running(spark, sf):
    """Structured Streaming: one output row for each input row, with state in the state store."""
    return _streamed(spark, sf, lambda s: s.begin_group("event_type").each("event_id, sum(user_id) AS s, count() AS n"))


@query(SQL["limit_first_time"])
def stream_limit(spark, sf):
    return _streamed(spark, sf, lambda s: s.begin_group("user_id").limit(True, Period(86400, "1days")).each("event_id"))


@query("SELECT event_id, count(*) OVER w AS n, array_to_string(list(event_type) OVER w, ',') AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)")
def stream_slide(spark, sf):
    return _streamed(spark, sf, lambda s: s.begin_group("user_id").slide(3, "event_id, count() AS n, collect_list(event_type) AS l")).withColumn("l", F.array_join("l", ","))


@query(SQL["filter_group"])
def stream_filter_group(spark, sf):
    conditions = ["event_type = 'purchase'", "event_type = 'click' AND value > 20"]
    return _streamed(spark, sf, lambda s: s.begin_group("user_id").filter_group(Period(172800, "2days"), conditions, "until").each("event_id, user_id, size(until) AS n"))


@query("SELECT event_id, (((user_id * 3) % 7) + 1)::BIGINT AS f FROM events")
def udf_script(spark, sf):
    """CREATE FUNCTION from a script, which is compiled once in each task."""
    path = os.path.join(tempfile.mkdtemp(prefix="rivulet-"), "f.py")
    with open(path, "w") as f:
        f.write("def evaluate(x) -> int:\n    return None if x is None else x * 3 % 7 + 1\n")
    s, out = Session(spark), []
    s.register("events", table(spark, sf, "events"), "event_id", "ts")
    s.sinks["keep"] = lambda: out.append
    s.run(f"CREATE FUNCTION turned AS '{path}'; FROM events USING memory_spout() EACH event_id, turned(user_id) AS f EMIT * USING keep(); SUBMIT TOPOLOGY t;")
    return out[0]


_SCRIPT = """CREATE TUPLE a (x INT, y STRING) PARTITIONED BY x COMMENT 'first'; CREATE VIEW v AS FROM a FILTER x > 1; SHOW TUPLES; SHOW VIEWS; DESC TUPLE a; DESC VIEW v;
  SET k = 5; SET k; FROM a USING memory_spout() EACH x, y EMIT x TO a; EXPLAIN; CLEAR; DROP VIEW v; DROP TUPLE a; SHOW TUPLES"""


@query("""SELECT * FROM (VALUES (1, 'OK'), (2, 'OK'), (3, '["a"]'), (4, '["v"]'), (5, '{"name": "a", "fields": {"x": "INT", "y": "STRING"}, "partitioned": ["x"], "comment": "first"}'),
  (6, '{"name": "v", "from": "a", "filter": "x > 1", "comment": null}'), (7, 'OK'), (8, '{"k": "5"}'), (9, 'OK'),
  (10, 'Explain:' || chr(10) || 'SPOUT_0(memory_spout(), [a(x INT, y STRING) partitioned by x])' || chr(10) || ' EACH_1([x, y])' || chr(10) || ' EMIT_2(TO a, [x])'), (11, 'OK'), (12, 'OK'), (13, 'OK'), (14, '[]')) t(n, result)""")
def commands(spark, sf):
    """Declarations and commands, and what each answers."""
    return spark.createDataFrame(list(enumerate(Session(spark).run(_SCRIPT), 1)), "n int, result string")


# functions of one's own
class Doubled:
    returns = "bigint"

    def evaluate(self, x):
        return None if x is None else 2 * x


class Largest:
    """Largest value of a window."""

    returns = "bigint"

    def __init__(self):
        self.values = []

    def evaluate(self, x):
        self.values.append(x)
        return max(self.values)

    def exclude(self, x):
        self.values.remove(x)
        return max(self.values) if self.values else None

    def clear(self):
        self.values = []


def _own() -> Context:
    return Context({"doubled": UserFunction("doubled", Doubled, "bigint"), "largest": UserFunction("largest", Largest, "bigint")})


@query("SELECT event_id, 2 * user_id AS d FROM events")
def udf_scalar(spark, sf):
    return events(spark, sf, _own()).each("event_id, doubled(user_id) AS d").df


@query("SELECT event_id, max(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING) AS m FROM events")
def udaf_incremental(spark, sf):
    """A user's aggregate with evaluate and exclude over a sliding window."""
    return events(spark, sf, _own()).begin_group("event_type").slide(5, "event_id, largest(user_id) AS m").df


# pipelines
@query("""WITH r AS (SELECT event_id, user_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS route FROM events),
f AS (SELECT event_id, array_to_string(route, '>') AS route, route[len(route)] AS ep FROM r WHERE len(route) >= 2)
SELECT event_id, route, ep, count(*) OVER (PARTITION BY route ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM f""")
def pipeline_slide_then_group(spark, sf):
    """Routes of each user's last events, then how often each route was seen."""
    s = events(spark, sf).begin_group("user_id").slide(3, "event_id, collect_list(event_type) AS route").end_group()
    s = s.filter("size(route) >= 2").begin_group("route").each("event_id, route, route[size(route) - 1] AS ep, count() AS c")
    return s.df.withColumn("route", F.array_join("route", ">"))


@query("""WITH j AS (SELECT o_orderkey, c_mktsegment AS seg, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'),
d AS (SELECT seg, floor(epoch(o_orderdate))::BIGINT // 2592000 AS b, count(*) AS cnt, max(o_orderkey) AS k FROM j GROUP BY ALL)
SELECT seg, cnt, (sum(cnt) OVER (PARTITION BY seg ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS total, 'cnt_seg' AS record FROM d""")
def pipeline_packet(spark, sf):
    """Lookup, filter, group, snapshot, then running totals of the snapshots, labelled."""
    fetch = lookups.table_lookup(table(spark, sf, "customer"), {"c_custkey": "o_custkey"}, ["c_mktsegment"])
    s = orders(spark, sf).lookup(["seg"], fetch).filter("seg <> 'BUILDING'").begin_group("seg")
    return s.snapshot(Period(2592000, "30days"), "seg, count() AS cnt").each("seg, cnt, sum(cnt) AS total, ifnull(record, 'cnt_seg') AS record").df


@query("SELECT event_id, user_id, value * 2 AS v2 FROM events WHERE event_type = 'purchase' AND value > 50")
def flagship(spark, sf):
    """Statements from text to rows."""
    return _joined(spark, sf, "FROM events USING memory_spout() FILTER event_type = 'purchase' AND value > 50 EACH event_id, user_id, value * 2 AS v2 EMIT * USING keep(); SUBMIT TOPOLOGY q;", ("events", table(spark, sf, "events"), "event_id", "ts"))
