"""The language's rules, on records posted one by one."""

import json

import pytest

from rivulet.errors import QueryError
from rivulet.session import Session
from rivulet.sources.writers import Collected


class Run:
    def __init__(self, spark, ddl="CREATE TUPLE t (aaa STRING, bbb INT, ccc INT, ddd STRING, _time);", **more):
        self.s = Session(spark, **more)
        self.out: dict[str, Collected] = {}
        self.s.sinks["keep"] = lambda name="x": self.out.setdefault(name, Collected())
        self.s.run(ddl)

    def post(self, *rows, name="t", step=10, start=0):
        for k, r in enumerate(rows):
            self.s.post(name, r, start + k * step)
        return self

    def __call__(self, text, name="x"):
        self.s.run(text if text.lstrip().startswith(("FROM", "CREATE", "SET")) else f"FROM t USING memory_spout() {text} EMIT * USING keep()")
        self.s.submit(f"t{len(self.s.topologies)}")
        return [tuple(r) for r in self.out[name].rows]


def row(a=None, b=None, c=None, d=None):
    return {k: v for k, v in zip(("aaa", "bbb", "ccc", "ddd"), (a, b, c, d)) if v is not None}


def test_arithmetic(spark):
    run = Run(spark).post(row("x", 2147483647, 3), row("x", None, 3), row("x", 9))
    got = run("EACH bbb + ccc AS a, bbb * ccc AS b, bbb / ccc AS c, bbb % ccc AS d, bbb DIV ccc AS e, aaa + 1 AS f, bbb MOD 2 AS g")
    assert got == [(2147483650, 6442450941, 2147483647 / 3, 1, 715827882, 1, 1), (3, 0, 0.0, 0, 0, 1, 0), (9, 0, None, None, None, 1, 1)]


def test_running_groups_and_null_keys(spark):
    run = Run(spark).post(*[row(a, 10, 1) for a in ("k1", None, "k1", None, "k2")])
    got = run("BEGIN GROUP BY aaa EACH aaa, sum(bbb) AS s, count() AS n")
    assert sorted(got, key=str) == sorted([("k1", 10, 1), (None, 10, 1), ("k1", 20, 2), (None, 20, 2), ("k2", 10, 1)], key=str)


def test_aggregates(spark):
    run = Run(spark).post(row("a", 10, d="p"), row("a", None, d="q"), row("a", 25, d="p"))
    got = run("EACH avg(bbb) AS a, sum(ccc) AS s, count(bbb) AS n, count(DISTINCT ddd) AS u, sum(DISTINCT bbb) AS v, collect_list(bbb) AS l, collect_set(ddd) AS c, avg(ccc) AS z")
    assert got == [(10, 0, 1, 1, 10, [10], ["p"], None), (10, 0, 1, 2, 10, [10], ["p", "q"], None), (17, 0, 2, 2, 35, [10, 25], ["p", "q"], None)]


def test_slides(spark):
    run = Run(spark).post(*[row("a", 10)] * 8)
    assert [r[0] for r in run("SLIDE LENGTH 5 sum(bbb) AS s")] == [10, 20, 30, 40, 50, 50, 50, 50]
    text = "CREATE TUPLE u (aaa STRING, bbb INT, _time TIMESTAMP);"
    run = Run(spark, text)
    for t, b in ((0, 10), (10, 30), (30, 30), (45, 5), (45, 7)):
        run.s.post("u", {"aaa": "a", "bbb": b, "_time": t}, t)
    got = run("FROM u USING memory_spout() BEGIN GROUP BY aaa SLIDE LENGTH 30sec BY _time sum(bbb) AS s, count() AS c, avg(bbb) AS a, sum(DISTINCT bbb) AS d, collect_list(bbb) AS l EMIT * USING keep();")
    assert got == [(10, 1, 10, 10, [10]), (40, 2, 20, 40, [10, 30]), (70, 3, 23, 40, [10, 30, 30]), (35, 2, 17, 35, [30, 5]), (42, 3, 14, 42, [30, 5, 7])]
    with pytest.raises(QueryError, match="not a timestamp"):
        run("FROM u USING memory_spout() SLIDE LENGTH 30sec BY bbb count() AS c EMIT * USING keep();")


def test_snapshots(spark):
    rows = [row("a", i, d="p") for i in range(7)]
    run = Run(spark).post(*rows)
    assert sorted(run("SNAPSHOT EVERY 3 bbb, sum(bbb) AS s, collect_list(bbb) AS l")) == [(2, 3, [0, 1, 2]), (5, 12, [3, 4, 5])]
    run = Run(spark).post(*rows)
    assert sorted(run("SNAPSHOT EVERY 30sec bbb, count() AS n, sum(bbb * 2) * count() AS p")) == [(2, 3, 18), (5, 3, 72), (6, 1, 12)]
    run = Run(spark).post(*rows)
    assert sorted(run("SNAPSHOT EVERY '0/30 * * * * ? *' bbb, count() AS n")) == [(2, 3), (5, 3), (6, 1)]
    run = Run(spark).post(*rows)
    assert sorted(run("SNAPSHOT EVERY 20sec bbb, count() AS n EXPIRE 40sec")) == [(1, 2), (3, 4), (5, 2), (6, 3)]
    run = Run(spark).post(*rows)
    assert sorted(run("SNAPSHOT EVERY '0/20 * * * * ?' bbb, count() AS n EXPIRE '0/40 * * * * ?'")) == [(1, 2), (3, 4), (5, 2), (6, 1)]


def test_limits(spark):
    rows = [row("a", i) for i in range(7)]
    for text, want in (("FIRST EVERY 3", [0, 3, 6]), ("LAST EVERY 3", [2, 5]), ("FIRST EVERY 25sec", [0, 3, 6]), ("LAST EVERY 25sec", [2, 5]), ("FIRST EVERY 1", list(range(7)))):
        run = Run(spark).post(*rows)
        assert sorted(r[0] for r in run(f"LIMIT {text} EACH bbb")) == want, text


def test_filter_group(spark):
    rows = [row(x, k) for k, x in enumerate("abcbaabcba")]
    run = Run(spark).post(*rows)
    assert [r[1] for r in run("FILTER GROUP EXPIRE 15sec aaa = 'a', aaa = 'b'")] == [1, 4, 6, 9]
    run = Run(spark).post(*rows)
    got = run("FILTER GROUP EXPIRE 1min STATE TO st aaa = 'a', aaa = 'b'")
    assert [(r[1], len(r[-1])) for r in got] == [(1, 2), (4, 2), (6, 2), (9, 2)]
    # the second condition stays armed after a match where only the first one starts anew
    run = Run(spark, reset_first_only=True).post(*rows)
    assert [r[1] for r in run("FILTER GROUP EXPIRE 1min aaa = 'a', aaa = 'b'")] == [1, 4, 5, 9]


def test_predicates(spark):
    ddl = "CREATE TUPLE t (aaa STRING, bbb INT, ccc INT, ddd STRING, eee LIST<STRING>);"
    rows = [{"aaa": "x1", "bbb": 10, "ddd": "q", "eee": ["456", "123", "0"]}, {"aaa": "x2", "bbb": 20, "ccc": 5, "eee": ["456"]}, {"aaa": "x3"}]
    for cond, want in (
        ("ifnull(ccc, 0) <= 100 AND bbb IN (10, 20) AND ddd IS NOT NULL AND eee ALL ('456', '123')", ["x1"]),
        ("aaa != 'x1' AND bbb != 0", ["x2"]), ("NOT bbb > 10", ["x1", "x3"]), ("bbb = '10'", []), ("eee IN ('0', '9')", ["x1"]),
        ("aaa LIKE 'x_'", ["x1", "x2", "x3"]), ("aaa LIKE '%3'", ["x3"]), ("aaa REGEXP 'x[12]'", ["x1", "x2"]), ("aaa REGEXP 'x'", []),
        ("bbb BETWEEN 10 AND 15", ["x1"]), ("bbb > ccc", ["x2"]), ("ccc IS NULL", ["x1", "x3"]), ("NOT NOT bbb = 10", ["x2", "x3"]), ("aaa ALL ('x1', 'x2')", []), ("nothing = 1", []),
    ):
        run = Run(spark, ddl).post(*rows)
        assert sorted(r[0] for r in run(f"FILTER {cond} EACH aaa")) == want, cond


def test_functions(spark):
    run = Run(spark, "CREATE TUPLE t (s STRING, n INT, l LIST<INT>, d DOUBLE, m MAP<STRING, INT>);")
    run.post({"s": "a,b,,", "n": 300, "l": [1, 2, 3, 4], "d": 2.7, "m": {"k": 5}}, {"s": ""})
    got = run("EACH size(split(s, ',')) AS a, cast(n AS TINYINT) AS b, slice(l, -3, -1) AS c, cast(d AS INT) AS e, m['k'] AS f, l[9] AS g, concat(s, n) AS h, sqrt(s) AS i, size(m) AS j, regexp_extract(s, '(a),(b)', 2) AS k, cast(s AS BOOLEAN) AS o, cast(' 5 ' AS INT) AS p, cast('5' AS INT) AS q, slice(l, 2) AS r")
    assert got[0] == (2, 44, [2, 3], 2, 5, None, "a,b,,300", 0.0, 1, "b", True, None, 5, [3, 4])
    assert got[1][:2] == (1, None) and got[1][6:11] == ("", 0.0, 0, None, False)


def test_urls(spark):
    run = Run(spark, "CREATE TUPLE t (u STRING);").post({"u": "http://u:p@h.com:8/a/b?k=v&x=1=2#r"}, {"u": "not a url"})
    got = run("EACH parse_url(u, 'HOST') AS a, parse_url(u, 'PATH') AS b, parse_url(u, 'QUERY') AS c, parse_url(u, 'QUERY', 'k') AS d, parse_url(u, 'QUERY', 'x') AS e, parse_url(u, 'REF') AS f, parse_url(u, 'ODD') AS g, parse_url(u, 'USERINFO') AS h")
    assert got[0] == ("h.com", "/a/b", None, "v", None, "r", "http://u:p@h.com:8/a/b?k=v&x=1=2#r", "u:p")
    assert got[1] == (None,) * 8


JOIN = """CREATE TUPLE t1 (aaa STRING, bbb INT); CREATE TUPLE t2 (eee STRING, fff INT);"""


def joined(spark, arrivals, expire="1min", to="t1.*, t2.*"):
    run = Run(spark, JOIN)
    for at, name, key, n in arrivals:
        run.s.post(name, {"aaa": key, "bbb": n} if name == "t1" else {"eee": key, "fff": n}, at)
    return sorted(run(f"FROM (t1 JOIN t2 ON t1.aaa = t2.eee TO {to} EXPIRE {expire}) AS j USING memory_spout() EMIT * USING keep();"), key=str)


def test_join_takes_its_matches_away(spark):
    got = joined(spark, [(0, "t1", "k", 1), (1, "t1", "k", 2), (2, "t2", "k", 3), (3, "t2", "k", 4), (4, "t1", "k", 5), (5, "t2", "o", 6)])
    assert got == [("k", 1, "k", 3), ("k", 2, "k", 3), ("k", 5, "k", 4)]


def test_join_expires(spark):
    assert joined(spark, [(0, "t1", "k", 1), (61, "t2", "k", 2)]) == []
    assert joined(spark, [(0, "t1", "k", 1), (60, "t2", "k", 2)], to="t2.fff AS f, t1.bbb") == [(2, 1)]


def test_join_errors(spark):
    for to in ("t3.*", "t1.aaa, t2.eee AS aaa"):
        with pytest.raises(QueryError):
            joined(spark, [(0, "t1", "k", 1)], to=to)


def test_lookup_fan_out_and_top(spark):
    run = Run(spark).post(row("k", 1), row("none", 2))
    run.s.collections["books"] = spark.createDataFrame([("k", "x", 3), ("k", "y", 9), ("z", "w", 1)], "id string, name string, c int")
    got = run("JOIN a, b USING mongo_fetch('db', 'books', '{id:@aaa}', ['name', 'c'], 1min) EACH bbb, a, b")
    assert sorted(got) == [(1, "x", 3), (1, "y", 9)]
    run = Run(spark).post(row("k", 1))
    run.s.collections["books"] = spark.createDataFrame([("k", "x", 3), ("k", "y", 9)], "id string, name string, c int")
    assert run("JOIN a USING mongo_fetch('db', 'books', '{id:@aaa}', ['name'], '{c:-1}', 1, 1min) EACH a") == [("y",)]
    run = Run(spark).post(row("k", 1))
    run.s.collections["books"] = spark.createDataFrame([("k", "x", 3)], "id string, name string, c int")
    assert run("JOIN a USING jdbc_fetch('url', 'u', 'p', 'SELECT name FROM books WHERE id = @aaa AND c = 3') EACH a") == [("x",)]


def test_streams_merge_rename_and_views(spark):
    run = Run(spark).post(row("k", 1), row("k", 200))
    got = run("""FROM t USING memory_spout() INTO s1; FROM s1(t) AS u EACH u.aaa AS aaa, u.bbb AS bbb INTO s2;
      FROM s1(t), s2 BEGIN GROUP BY aaa EACH count() AS c INTO s3; FROM s3 TO STREAM EMIT c USING keep();""")
    assert sorted(r[0] for r in got) == [1, 2, 3, 4]
    run = Run(spark).post(row("k", 1), row("k", 200))
    assert run("CREATE VIEW big AS FROM t FILTER bbb > 100; FROM big USING memory_spout() EMIT bbb USING keep();") == [(200,)]
    with pytest.raises(QueryError, match="no tuple"):
        run("FROM t USING memory_spout() INTO s; FROM s(zzz) EMIT * USING keep();")
    with pytest.raises(QueryError, match="more than one"):
        run("FROM t USING memory_spout() INTO s; FROM s, s EMIT * USING keep();")


def test_json_records(spark):
    run = Run(spark, "CREATE TUPLE t (a INT, t1 TIMESTAMP, t2 TIMESTAMP('yyyyMMdd'), m MAP<BIGINT, BOOLEAN>, s STRUCT<x STRING, y LIST<INT>>, any);")
    run.post("{a: 1, t1: 86400, t2: '20240102', m: {'5': true}, s: {x: 'q', y: [1, 2]}, any: 7}".replace("'", '"'), '{"a": 2, "unknown": 1}', "no json", '{"a": 3}')
    got = run("EACH a, cast(t1 AS BIGINT) AS b, cast(t2 AS BIGINT) AS c, m[5] AS d, s.x AS e, s.y[1] AS f, any")
    assert got == [(1, 86400, 1704153600, True, "q", 2, "7"), (3, None, None, None, None, None, None)]


def test_commands(spark, tmp_path):
    s = Session(spark, warehouse=str(tmp_path))
    assert s.run("CREATE TUPLE a (x INT, y) PARTITIONED BY x; CREATE VIEW v AS FROM a FILTER x > 1; SET k = 5; SHOW TUPLES; DESC VIEW v; SET k")[3:] == ['["a"]', '{"name": "v", "from": "a", "filter": "x > 1", "comment": null}', '{"k": "5"}']
    assert '"y": "auto detect"' in s.execute("DESC TUPLE a")
    with pytest.raises(QueryError):
        s.execute("DROP TUPLE a")
    s.post("a", {"x": 1, "y": 2})
    s.post("a", {"x": 1, "y": 3})
    s.run("FROM a USING memory_spout() EMIT * USING mongo_persist('db', 'c', ['x']); SUBMIT TOPOLOGY one;")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/db/c").collect()] == [(1, "3")]
    s.run("STOP TOPOLOGY one; START TOPOLOGY one;")
    assert spark.read.parquet(f"{tmp_path}/db/c").count() == 1
    assert "RUNNING" in s.execute("DESC TOPOLOGY one") and "Parquet" not in s.execute("EXPLAIN one") and "EMIT_1(mongo_persist" in s.execute("EXPLAIN EXTENDED")
    s.run("CREATE TUPLE b (x INT); FROM a USING memory_spout() EMIT x TO b; SUBMIT TOPOLOGY two;")
    out = Collected()
    s.sinks["keep"] = lambda: out
    s.run("FROM b USING memory_spout() EMIT * USING keep(); SUBMIT TOPOLOGY three; STATS TOPOLOGY; DESC CLUSTER; STOP TOPOLOGY three; DROP TOPOLOGY three; CLEAR; DROP VIEW v;")
    assert [tuple(r) for r in out.rows] == [(1,), (1,)]
    for bad in ("SUBMIT TOPOLOGY x", "DESC TUPLE zzz", "DROP TOPOLOGY zzz", "FROM zzz EMIT * USING keep()", "FROM a USING odd() EMIT * USING keep()"):
        with pytest.raises(QueryError):
            s.execute(bad)


def test_users_and_files(spark, tmp_path):
    s = Session(spark, warehouse=str(tmp_path / "w"))
    script = tmp_path / "f.py"
    script.write_text("def evaluate(x) -> int:\n    return x + 1\n")
    assert s.run(f"CREATE USER ann IDENTIFIED BY 'one'; ALTER USER 'ann' IDENTIFIED BY 'two'; UPLOAD '{script}'; SHOW FILES")[:3] == ["OK"] * 3
    assert [u["name"] for u in json.loads(s.execute("SHOW USERS"))] == ["root", "ann"] and json.loads(s.execute("DESC USER"))["name"] == "root"
    assert s.users.all["ann"].matches("two") and not s.users.all["ann"].matches("one") and b"two" not in s.users.all["ann"].digest
    assert json.loads(s.execute("DESC FILE f.py"))["size"] == script.stat().st_size
    out = Collected()
    s.sinks["keep"] = lambda: out
    s.run("CREATE FUNCTION up AS 'f.py'; CREATE TUPLE a (x INT); POST a {\"x\": 4}; FROM a USING memory_spout() EACH up(x) AS y EMIT * USING keep(); SUBMIT TOPOLOGY t; DROP FILE f.py; DROP USER ann;")
    assert [tuple(r) for r in out.rows] == [(5,)] and s.execute("SHOW FILES") == "[]"
    for bad in ("DROP USER root", "DROP USER ann", "CREATE USER root IDENTIFIED BY 'x'", "DESC FILE f.py", "UPLOAD /no/such/file"):
        with pytest.raises(QueryError):
            s.execute(bad)
    other = Session(spark, user="bob")
    assert other.execute("ALTER USER bob IDENTIFIED BY 'x'") == "OK"
    for bad in ("SHOW USERS", "CREATE USER c IDENTIFIED BY 'x'", "ALTER USER root IDENTIFIED BY 'x'"):
        with pytest.raises(QueryError):
            other.execute(bad)
