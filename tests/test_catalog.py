"""Every registered query against its SQL, at the smallest scale."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from rivulet import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.SQL:
        want = db.sql(catalog.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_compare"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50" in plan and "props" not in plan


_ON_EXECUTORS = """
import sys
from pyspark.sql import SparkSession
from rivulet import catalog
from rivulet.sources import embedded
base, sf = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{base}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
embedded._CHUNK = 64
print("rows", sorted(tuple(r) for r in catalog.QUERIES["join_jdbc"](spark, sf).select("o_orderkey", "name").collect()))
"""


def test_a_database_in_the_drivers_process_is_reached_from_executors(db, tmp_path):
    run = subprocess.run([sys.executable, "-c", _ON_EXECUTORS, str(tmp_path), SF], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ)
    want = sorted(db.sql(f"SELECT o_orderkey, name FROM ({catalog.SQL['join_jdbc']})").fetchall())
    assert f"rows {want}" in run.stdout.splitlines(), run.stderr[-2000:]
