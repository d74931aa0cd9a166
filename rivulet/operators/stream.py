"""Streams: sets of named DataFrames, and the operators of the language on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import QueryError
from rivulet.functions.aggregates import AGGREGATES, Frame, aggregate
from rivulet.functions.expressions import Binder, has_aggregate, visible
from rivulet.operators import windows
from rivulet.operators.cron import CronSchedule
from rivulet.operators.windows import CLOCK, SEQ
from rivulet.plans.nodes import Arith, Call, Cast, Cron, Field, Index, Item, Period
from rivulet.plans.parser import Parser, parse_condition, parse_items
from rivulet.streaming import folds, runner


@dataclass(frozen=True)
class Context:
    """What all streams of a session share."""

    functions: dict[str, Any] = field(default_factory=dict)
    names: dict[str, Any] = field(default_factory=dict)
    origin: int = 0
    reset_first_only: bool = False
    #: On streams: seconds that rows may come late by their clock; state that has expired by then goes. None: state stays.
    delay: int | None = None


@dataclass(frozen=True)
class Stream:
    """``frames``: a DataFrame for each tuple name. ``levels``: the groupings opened, each a list of (field, key column)."""

    frames: dict[str, DataFrame]
    levels: tuple[tuple[tuple[str, str], ...], ...] = ()
    context: Context = field(default_factory=Context)

    # helpers
    @property
    def keys(self) -> list[str]:
        return [k for level in self.levels for _, k in level]

    @property
    def df(self) -> DataFrame:
        """The only DataFrame, without the engine's own columns."""
        if len(self.frames) != 1:
            raise QueryError("the stream holds several tuples: " + ", ".join(self.frames))
        own = next(iter(self.frames.values()))
        return own.select(*[F.col(f"`{c}`") for c in visible(own)])

    def _binder(self, names: Sequence[str]) -> Callable[..., Binder]:
        def bind(df: DataFrame, frame: Frame | None, kind: type[Binder] = Binder) -> Binder:
            return kind(df, names, frame, self.context.functions, self.context.names)

        return bind

    def _map(self, f: Callable[[DataFrame, Callable[..., Binder]], DataFrame]) -> Stream:
        return replace(self, frames={n: f(df, self._binder([n])) for n, df in self.frames.items()})

    def _stateful(self, f: Callable[[DataFrame, Callable[..., Binder]], DataFrame]) -> Stream:
        """``f`` on all tuples as one: its state spans them."""
        if len(self.frames) == 1:
            return self._map(f)
        both = None
        for n, df in self.frames.items():
            own = df.withColumn("__name", F.lit(n))
            both = own if both is None else both.unionByName(own, allowMissingColumns=True)
        out = f(both, self._tuple_binder())
        return replace(self, frames={n: out.where(F.col("__name") == n).drop("__name") for n in self.frames})

    def _tuple_binder(self) -> Callable[..., Binder]:
        names = set(self.frames)

        class Named(Binder):
            """t.x is the field of rows of tuple t only."""

            def field(self, f: Field):
                c, t = super().field(f)
                if len(f.parts) > 1 and f.parts[0][0] in names and not isinstance(t, T.NullType):
                    c = F.when(F.col("__name") == f.parts[0][0], c)
                return c, t

        def bind(df: DataFrame, frame: Frame | None, kind: type[Binder] = Binder) -> Binder:
            own = Named if kind is Binder else type("NamedLast", (kind, Named), {})
            return own(df, names, frame, self.context.functions, self.context.names)

        return bind

    def _is_user_aggregate(self, name: str) -> bool:
        f = self.context.functions.get(name)
        return f is not None and f.aggregate

    def _items(self, items: str | Sequence[Item]) -> tuple[Item, ...]:
        return parse_items(items) if isinstance(items, str) else tuple(items)

    def _condition(self, condition: Any) -> Any:
        return parse_condition(condition) if isinstance(condition, str) else condition

    # choice and naming of tuples
    def select(self, *names: str) -> Stream:
        for n in names:
            if n not in self.frames:
                raise QueryError(f"the stream has no tuple {n}")
        return replace(self, frames={n: self.frames[n] for n in names})

    def rename(self, alias: str) -> Stream:
        if len(self.frames) != 1:
            raise QueryError("only a stream of one tuple can be renamed")
        return replace(self, frames={alias: next(iter(self.frames.values()))})

    @staticmethod
    def merge(streams: Sequence[Stream]) -> Stream:
        first = streams[0]
        frames: dict[str, DataFrame] = {}
        for s in streams:
            if [[f for f, _ in level] for level in s.levels] != [[f for f, _ in level] for level in first.levels]:
                raise QueryError("streams of different groups can't be merged")
            for n, df in s.frames.items():
                if n in frames:
                    raise QueryError(f"tuple {n} comes from more than one stream")
                frames[n] = df
        return replace(first, frames=frames)

    # operators
    def filter(self, condition: Any) -> Stream:
        """Keeps rows for which ``condition`` (text, a parsed condition, or a Column) is true."""
        if isinstance(condition, Column):
            return self._map(lambda df, _: df.where(F.coalesce(condition, F.lit(False))))
        own = self._condition(condition)
        return self._map(lambda df, bind: df.where(bind(df, None).condition(own)))

    def each(self, items: str | Sequence[Item]) -> Stream:
        own = self._items(items)
        running = any(has_aggregate(i.value, self._is_user_aggregate) for i in own)
        if not running:
            return self._map(lambda df, bind: windows.each(df, self.keys, own, bind, False))
        if self._by_fold(own):
            return self._fold_items("running", own, 0, None)
        return self._stateful(lambda df, bind: windows.each(df, self.keys, own, bind, True))

    def slide(self, length: int | Period, items: str | Sequence[Item], by: str | Field | None = None) -> Stream:
        own = self._items(items)
        if not isinstance(length, Period):
            if length < 1:
                raise QueryError("SLIDE needs a length of 1 or more")
            if self._by_fold(own):
                return self._fold_items("rows", own, length, None)
            return self._stateful(lambda df, bind: windows.slide_rows(df, self.keys, length, own, bind))
        by = Parser(by).field() if isinstance(by, str) else by
        if self._by_fold(own):
            return self._fold_items("time", own, length.seconds, by)

        def run(df: DataFrame, bind: Callable[..., Binder]) -> DataFrame:
            c, t = bind(df, None).field(by)
            if not isinstance(t, T.TimestampType):
                raise QueryError(f"SLIDE BY {by}: not a timestamp")
            return windows.slide_time(df, self.keys, length.seconds, c, own, bind)

        return self._stateful(run)

    def snapshot(self, every: int | Period | Cron, items: str | Sequence[Item], expire: Period | Cron | None = None) -> Stream:
        own = self._items(items)
        if isinstance(every, int):
            if self._by_fold(own):
                return self._fold_items("snapshot", own, every, None)
            return self._stateful(lambda df, bind: windows.snapshot_rows(df, self.keys, every, own, bind))
        if any(df.isStreaming for df in self.frames.values()):
            return self._streaming_snapshot(every, own, expire)
        plain = lambda x: x.seconds if isinstance(x, Period) else CronSchedule(x.text) if isinstance(x, Cron) else x
        return self._stateful(lambda df, bind: windows.snapshot(df, self.keys, plain(every), own, bind, plain(expire), self.context.origin))

    def _streaming_snapshot(self, every: Any, items: Sequence[Item], expire: Any) -> Stream:
        """Time windows of a stream: Spark's own, with the clock's watermark; a row for each group and window that has closed."""
        if not isinstance(every, Period) or expire is not None:
            raise QueryError("on streaming data SNAPSHOT takes a count or a period, without EXPIRE")

        def run(df: DataFrame, bind: Callable[..., Binder]) -> DataFrame:
            rows = df.withWatermark(CLOCK, f"{every.seconds} seconds").withColumn("__tmp_b", F.window(CLOCK, f"{every.seconds} seconds", startTime=f"{self.context.origin % every.seconds} seconds"))
            return windows._grouped(rows, self.keys, "__tmp_b", items, bind, clock=F.col("__tmp_b.end"))

        return self._stateful(run)

    def limit(self, first: bool, every: int | Period) -> Stream:
        if isinstance(every, Period):
            fold = folds.LimitTime(every.seconds, first)
        elif every < 1:
            raise QueryError("LIMIT needs a number of 1 or more")
        elif any(df.isStreaming for df in self.frames.values()):
            fold = folds.LimitRows(every, first)
        else:
            return self._stateful(lambda df, bind: windows.limit_rows(df, self.keys, every, first))
        return self._stateful(lambda df, bind: self._folded(df, fold))

    def filter_group(self, expire: Period, conditions: Sequence[Any], state_to: str | None = None) -> Stream:
        own = [self._condition(c) for c in conditions]
        fold = folds.FilterGroup(expire.seconds, len(own), state_to, self.context.reset_first_only)

        def run(df: DataFrame, bind: Callable[..., Binder]) -> DataFrame:
            b = bind(df, None)
            rows = df.withColumns({f"__c{i}": b.condition(c) for i, c in enumerate(own)})
            out = self._folded(rows, fold)
            return out.drop(*[f"__c{i}" for i in range(len(own))])

        return self._stateful(run)

    def _folded(self, df: DataFrame, fold: folds.Fold) -> DataFrame:
        out = runner.run(df.withColumn("__now", windows.second(df)), self.keys, [SEQ], fold, CLOCK, self.context.delay)
        names = [c for c in out.columns if not c.startswith("__")]
        return out.select(*[F.col(f"`{c}`") for c in names], *[c for c in out.columns if c.startswith("__") and c != "__now"])

    def _by_fold(self, items: Sequence[Item]) -> bool:
        """Streams, and user-defined aggregates, are folded; anything else is a window or an aggregate of Spark."""
        found: list[Call] = []
        for i in items:
            _calls(i.value, found, self._is_user_aggregate)
        return any(df.isStreaming for df in self.frames.values()) or any(self._is_user_aggregate(c.name) for c in found)

    def _fold_items(self, kind: str, items: Sequence[Item], length: int, by: Field | None) -> Stream:
        """Aggregates by a fold; the expressions around them stay Spark's."""
        calls: list[Call] = []
        for i in items:
            _calls(i.value, calls, self._is_user_aggregate)

        def run(df: DataFrame, bind: Callable[..., Binder]) -> DataFrame:
            b, specs, rows = bind(df, Frame(lambda c: c)), [], df
            plain = bind(df, None)
            for i, c in enumerate(calls):
                user = self.context.functions[c.name] if self._is_user_aggregate(c.name) else None
                args = [plain.value(a) for a in c.args]
                kind_of = user.returns if user else aggregate(b.frame, c.name, args[0] if args else None, c.distinct)[1].simpleString()
                for k, (a, t) in enumerate(args):
                    if not user and c.name in ("sum", "avg"):
                        a = a.cast(kind_of)
                    rows = rows.withColumn(f"__a{i}_{k}", a)
                specs.append((c.name, len(args), c.distinct, kind_of, user.make if user else None))
            if by is not None:
                at, t = plain.field(by)
                if not isinstance(t, T.TimestampType):
                    raise QueryError(f"SLIDE BY {by}: not a timestamp")
                rows = rows.withColumn("__by", F.unix_seconds(at)).where("__by is not null")
            out = self._folded(rows, folds.Aggregates(kind, tuple(specs), length))

            class Found(type(b)):
                def _call(self, x: Call):
                    if x in calls:
                        i = calls.index(x)
                        return F.col(f"__r{i}"), self.df.schema[f"__r{i}"].dataType
                    return super()._call(x)

            fields = Found(out, b.tuples, None, b.functions, b.context).items
            keep = [c for c in out.columns if c.startswith("__") and not c.startswith(("__a", "__r", "__by"))]
            return out.select(*[c.alias(n) for n, c in fields(items)], *keep)

        return self._stateful(run)

    # grouping
    def begin_group(self, *fields: str | Field) -> Stream:
        own = [Parser(f).field() if isinstance(f, str) else f for f in fields]
        n = len(self.keys)
        level = tuple((str(f), f"__g{n + i}") for i, f in enumerate(own))

        def keyed(df: DataFrame, bind: Callable[..., Binder]) -> DataFrame:
            b = bind(df, None)
            cols = {}
            for (_, k), f in zip(level, own):
                c, t = b.field(f)
                cols[k] = c.cast("string") if isinstance(t, T.NullType) else c
            return df.withColumns(cols)

        return replace(self._map(keyed), levels=(*self.levels, level))

    def end_group(self) -> Stream:
        if not self.levels:
            raise QueryError("END GROUP without BEGIN GROUP")
        gone = [k for _, k in self.levels[-1]]
        return replace(self._map(lambda df, _: df.drop(*gone)), levels=self.levels[:-1])

    def to_stream(self) -> Stream:
        return replace(self._map(lambda df, _: df.drop(*self.keys)), levels=())

    def partition(self, *fields: str | Field) -> Stream:
        own = [Parser(f).field() if isinstance(f, str) else f for f in fields]
        return self._map(lambda df, bind: df.repartition(*[bind(df, None).field(f)[0] for f in own]))

    # joins
    def lookup(self, fields: Sequence[str], fetch: Callable[[DataFrame, Binder, Sequence[str]], DataFrame]) -> Stream:
        """One row for each result of the lookup, with ``fields`` added; rows without a result go."""
        return self._map(lambda df, bind: fetch(df, bind(df, None), fields))

    def sent(self, fields: Sequence[Field | str]) -> list[DataFrame]:
        """The fields that EMIT sends of each tuple, and SEQ."""
        own = [Item(Parser(f).field() if isinstance(f, str) and f != "*" else Field((("*", ()),)) if f == "*" else f) for f in fields]
        outs = []
        for n, df in self.frames.items():
            outs.append(df.select(*[c.alias(m) for m, c in self._binder([n])(df, None).items(own)], SEQ))
        return outs

    def project(self, fields: Sequence[Field | str]) -> DataFrame:
        """The fields that EMIT sends, of all tuples."""
        outs = self.sent(fields)
        out = outs[0]
        for x in outs[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        return out.drop(SEQ)


def _calls(x: Any, out: list[Call], user: Callable[[str], bool]) -> None:
    """All aggregate calls in an expression, each once."""
    if isinstance(x, Call):
        if x.name in AGGREGATES or user(x.name):
            if x not in out:
                out.append(x)
        else:
            for a in x.args:
                _calls(a, out, user)
    elif isinstance(x, Arith):
        _calls(x.left, out, user)
        _calls(x.right, out, user)
    elif isinstance(x, Cast | Index):
        _calls(x.value, out, user)


def tuple_join(sides: Sequence[tuple[str, Stream]], on: Sequence[Sequence[tuple[Field, Field]]], to: Sequence[tuple[str, str, str | None]], expire: Period, alias: str) -> Stream:
    """Joins streams on equal fields, taking away what has matched.

    ``sides``: (tuple, stream); ``on[i]``: equalities of side i + 1 with earlier sides. Sides that share one
    key are folded together; a side with another key is joined with the result of those before it.
    """
    names = [n for n, _ in sides]
    if len(set(names)) != len(names):
        raise QueryError("a tuple is joined with itself: name one of them with AS")
    for n, f, _ in to:
        if n not in names:
            raise QueryError(f"TO names an unknown tuple {n}")
    first = sides[0][1]
    steps: list[tuple[list[str], dict[str, list[Field]]]] = []
    for (name, _), equal in zip(sides[1:], on):
        own: dict[str, list[Field]] = {}
        for a, b in equal:
            a, b = (a, b) if b.parts[0][0] == name else (b, a)
            if b.parts[0][0] != name or a.parts[0][0] not in names[: names.index(name)]:
                raise QueryError(f"ON must compare {name} with an earlier tuple")
            own.setdefault(name, []).append(b)
            own.setdefault(a.parts[0][0], []).append(a)
        others = [n for n in own if n != name]
        # the same key as before: one fold for all these sides
        if steps and all(o in steps[-1][1] and own[o] == steps[-1][1][o] for o in others) and len(others) == 1:
            steps[-1][0].append(name)
            steps[-1][1][name] = own[name]
        else:
            steps.append(([name], own))
    frames = {n: _payload(n, s) for n, s in sides}
    held_fields = {n: _held_fields(n, visible(df), to, steps) for n, df in frames.items()}
    done = frames[names[0]].select(F.struct(*[F.col(f"`{c}`") for c in held_fields[names[0]]]).alias(f"t_{names[0]}"), SEQ, CLOCK, *first.keys)
    held = [names[0]]
    for added, own in steps:
        done = _fold_join(done, held, added, own, frames, held_fields, expire, first.keys, first.context.delay)
        held += added
    cols, seen = [], set()
    for n, f, a in to:
        schema = done.schema[f"t_{n}"].dataType
        for one in schema.names if f == "*" else [f]:
            out = a or one
            if out in seen:
                raise QueryError(f"more than one field is named {out}")
            seen.add(out)
            cols.append((F.col(f"t_{n}").getField(one) if one in schema.names else F.lit(None).cast("string")).alias(out))
    return replace(first, frames={alias: done.select(*cols, SEQ, CLOCK, *first.keys)})


def _payload(name: str, s: Stream) -> DataFrame:
    return s.frames[name] if name in s.frames else next(iter(s.frames.values()))


def _held_fields(name: str, fields: Sequence[str], to: Sequence[tuple[str, str, str | None]], steps: Sequence[tuple[list[str], dict[str, list[Field]]]]) -> list[str]:
    """The fields of a tuple that wait with its rows: those that TO sends and those of keys; one at least, since a struct needs one."""
    sent = {f for n, f, _ in to if n == name}
    keys = {f.parts[1][0].lower() for _, own in steps for f in own.get(name, ()) if len(f.parts) > 1}
    return [c for c in fields if "*" in sent or c in sent or c.lower() in keys] or list(fields[:1])


def _fold_join(done: DataFrame, held: Sequence[str], added: Sequence[str], own: dict[str, list[Field]], frames: dict[str, DataFrame], held_fields: dict[str, list[str]], expire: Period, group: Sequence[str], delay: int | None = None) -> DataFrame:
    """The rows of ``done`` (a struct t_x for each held tuple) joined with those of ``added``."""

    def key(df: DataFrame, field_list: Sequence[Field], prefix: bool) -> list:
        out = []
        for f in field_list:
            if prefix:
                c = F.col(f"t_{f.parts[0][0]}")
                for n, _ in f.parts[1:]:
                    c = c.getField(n)
            else:
                c = Binder(df, [f.parts[0][0]]).field(f)[0]
            out.append(c.cast("string"))
        return out

    before = [f for n in held if n in own for f in own[n]]
    count = len(before)
    sides = [done.select(F.struct(*[f"t_{n}" for n in held]).alias("__p"), *[c.alias(f"__k{i}") for i, c in enumerate(key(done, before, True))], SEQ, CLOCK, *group)]
    for n in added:
        df = frames[n]
        sides.append(df.select(F.struct(*[F.col(f"`{c}`") for c in held_fields[n]]).alias("__p"), *[c.alias(f"__k{i}") for i, c in enumerate(key(df, own[n], False))], SEQ, CLOCK, *group))
    types = [s.schema["__p"].dataType for s in sides]
    keys = [*group, *[f"__k{i}" for i in range(count)]]
    both = None
    for i, s in enumerate(sides):
        rows = s.select(*[(F.col("__p") if j == i else F.lit(None).cast(t)).alias(f"__p{j}") for j, t in enumerate(types)], *keys, SEQ, CLOCK, F.lit(i).alias("__side"), F.unix_seconds(CLOCK).alias("__now"))
        both = rows if both is None else both.unionByName(rows)
    out = runner.run(both, keys, [CLOCK, SEQ, "__side"], folds.TupleJoin(expire.seconds, len(sides)), CLOCK, delay)
    cols = [F.col("__p0").getField(f"t_{n}").alias(f"t_{n}") for n in held]
    cols += [F.col(f"__p{i + 1}").alias(f"t_{n}") for i, n in enumerate(added)]
    return out.select(*cols, SEQ, CLOCK, *group)
