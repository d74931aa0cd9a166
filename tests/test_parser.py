import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from rivulet.errors import QueryError
from rivulet.operators.cron import CronSchedule
from rivulet.plans.nodes import Arith, Call, Cast, Command, Compare, Const, Field, Logic, Not, Period, Query
from rivulet.plans.parser import parse, parse_condition, parse_items, statements


def test_statements_are_cut_outside_strings():
    assert statements("SET a = 'x;y'; FROM s EMIT * USING log();") == ["SET a = 'x;y'", "FROM s EMIT * USING log()"]


def test_query_of_all_clauses():
    q = parse("""FROM t1 AS a, t2 USING kafka_spout('topic', 'json') PARALLELISM 2
      FILTER a.x = 1 EACH x, y + 1 AS z BEGIN GROUP BY x SLIDE LENGTH 5min BY ts sum(z) AS s
      SNAPSHOT EVERY '0/3 * * * * ? *' s EXPIRE 1h LIMIT LAST EVERY 3 END GROUP PARTITION BY x TO STREAM
      JOIN p, q USING mongo_fetch('db', 'c', '{k:@x}', ['p', 'q'], 1min) FILTER GROUP EXPIRE 10sec STATE TO st x = 1, y = 2
      INTO s EMIT x, y USING kafka_emit('out', {a: 1}) PARALLELISM 3;""")
    assert isinstance(q, Query) and q.parallelism == 2
    assert [c.kind for c in q.clauses] == ["FILTER", "EACH", "BEGIN GROUP", "SLIDE", "SNAPSHOT", "LIMIT", "END GROUP", "PARTITION", "TO STREAM", "JOIN", "FILTER GROUP", "INTO", "EMIT"]
    assert q.clauses[-1].parallelism == 3 and q.clauses[3].args["length"] == Period(300, "5min")


def test_precedence_and_literals():
    (item,) = parse_items("a + b * -2 AS x")
    f = lambda n: Field(((n, ()),))
    assert item.value == Arith("+", f("a"), Arith("*", f("b"), Const(-2, "int")))
    kinds = [i.value.type for i in parse_items("1Y AS a, 2S AS b, 3 AS c, 4L AS d, 1.5F AS e, 1.5 AS f, TRUE AS g, 'x' AS h")]
    assert kinds == ["tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string"]
    c = parse_condition("NOT NOT a = 1 AND b <> 2 OR (c IN (1, 2) AND d BETWEEN 1 AND 3)")
    assert isinstance(c, Logic) and c.op == "OR" and isinstance(c.values[0].values[0], Not) and isinstance(c.values[0].values[0].value, Compare)


def test_calls_casts_and_subscripts():
    a, b, c = parse_items("count(DISTINCT concat(x, 'y')) AS n, cast(s AS TIMESTAMP('yyyy')) AS t, t.m['k'][0].z")
    assert a.value == Call("count", (Call("concat", (Field((("x", ()),)), Const("y", "string"))),), True)
    assert b.value == Cast(Field((("s", ()),)), "TIMESTAMP", "yyyy")
    assert str(c.value) == "t.m['k'][0].z"


def test_names_may_begin_with_digits_and_be_keywords():
    c = parse("CREATE TUPLE t (10 STRING, group INT, st STRUCT<5 STRING, l LIST<INT>>, any) PARTITIONED BY group")
    assert isinstance(c, Command) and [n for n, _ in c.args["fields"]] == ["10", "group", "st", "any"] and c.args["keys"] == ("group",)


@pytest.mark.parametrize("text", ["FROM", "FROM s EACH a +", "EACH x", "FROM s FILTER x IN (1)", "FROM s SLIDE LENGTH 5min a", "FROM s EACH x #", "CREATE TUPLE t (a FOO)", "FROM s SNAPSHOT EVERY 1min x EXPIRE 5", "FROM s EMIT a"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_cron():
    day = 1_704_067_200  # 2024-01-01, a Monday
    assert CronSchedule("0 0 0/6 * * ? *").between(day + 1, day + 86_400)[:5] == [day + 21_600 * k for k in range(1, 6)]
    assert CronSchedule("30 15 10 ? * TUE").between(day, day + 86_400) == [day + 86_400 + 36_930]
    assert CronSchedule("0 0 0 L * ?").between(day, day)[0] == day + 30 * 86_400
    assert CronSchedule("0/20 * * * * ?").between(day, day + 45) == [day, day + 20, day + 40, day + 60]
    for bad in ("0 0 0", "61 * * * * ?", "x * * * * ?"):
        with pytest.raises(QueryError):
            CronSchedule(bad)


@pytest.mark.parametrize("text", ["0 0 0/6 * * ? *", "*/7 * * * * ?", "0 30 8 L * ?", "15 10 3 ? * MON-FRI 2024", "0 0 0 29 2 ?"])
def test_cron_instants_follow_one_by_one(text):
    own, start = CronSchedule(text), datetime(1970, 1, 1)
    rng = random.Random(1)
    at = [rng.randrange(1704067200, 1704067200 + 86400 * 400) for _ in range(25)]
    for t, got in zip(at, own.after(np.array(at)).tolist()):
        x, found = t + 1, -1
        while found < 0 and x < t + 86400 * 1500:
            d = start + timedelta(seconds=x)
            if not own._day(d.replace(hour=0, minute=0, second=0)):
                x = (x // 86400 + 1) * 86400
            elif d.hour in own.hours and d.minute in own.minutes and d.second in own.seconds:
                found = x
            else:
                x += 1
        assert got == found
    assert own.after(np.array([10**13])).tolist() == [-1]
