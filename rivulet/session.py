"""Sessions: declared tuples, views and functions, the queries of a topology, and its runs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.accounts import ROOT, Files, Users
from rivulet.errors import QueryError
from rivulet.functions.expressions import Binder, visible
from rivulet.functions.user import UserFunction, load
from rivulet.operators.stream import Context, Stream, tuple_join
from rivulet.plans.nodes import Clause, Command, Processor, Query, TupleJoin, show
from rivulet.plans.parser import parse, statements
from rivulet.shipping import ship
from rivulet.sources import embedded, lookups, readers, writers
from rivulet.types import TupleSchema, from_json_lines, type_text


@dataclass
class Emit:
    """A sink of the topology under construction."""

    number: int
    stream: Stream
    fields: tuple
    write: Callable[..., None]
    text: str
    #: Makes the sink anew where its arguments name the topology, which is known once it is submitted.
    make: Callable[[], Callable[..., None]] | None = None

    def df(self) -> DataFrame:
        return self.stream.project(self.fields)

    def send(self, batch: str | None = None) -> tuple[DataFrame, Callable[[DataFrame, str | None], None]]:
        """What the sink gets, and a function that writes it, or a batch of it, under the batch's name."""
        if getattr(self.write, "ordered", False):
            parts = self.stream.sent(self.fields)
            sends = [visible(p) for p in parts]
            out = parts[0].withColumn(writers.FROM, F.lit(0))
            for i, p in enumerate(parts[1:], 1):
                out = out.unionByName(p.withColumn(writers.FROM, F.lit(i)), allowMissingColumns=True)
            return out, lambda df, name: self.write(df, name, sends)
        if getattr(self.write, "by_batch", False):
            return self.df(), self.write
        return self.df(), lambda df, _: self.write(df)


@dataclass
class Topology:
    name: str
    emits: list[Emit]
    plan: list[str]
    comment: str | None = None
    status: str = "STOPPED"
    created: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat(timespec="seconds"))
    queries: list[Any] = field(default_factory=list)


class Session:
    """Runs statements. ``tables``: DataFrames or readers for declared tuples, as sources of every kind.

    ``collections``: DataFrames for lookups by (database, collection) or table name. ``sinks``: factories of
    writers by processor name, which take the processor's arguments. A source without a table gives the
    records that were posted. ``delay``: on streams, seconds that rows may come late before state that has
    expired goes. ``user``: whose statements these are.
    """

    def __init__(self, spark: SparkSession, warehouse: str | None = None, origin: int = 0, streaming: bool = False, reset_first_only: bool = False, delay: int | None = None, user: str = ROOT):
        self.spark, self.warehouse, self.streaming = spark, warehouse, streaming
        ship(spark)
        self.schemas: dict[str, TupleSchema] = {}
        self.views: dict[str, tuple[str, Any, str | None]] = {}
        self.functions: dict[str, UserFunction] = {}
        self.conf: dict[str, str] = {}
        self.tables: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self.collections: dict[Any, DataFrame] = {}
        self.posted: dict[str, list[tuple[int, str, float | None]]] = {}
        self.topologies: dict[str, Topology] = {}
        self.sinks: dict[str, Callable[..., Callable[[DataFrame], None]]] = dict(self._default_sinks())
        self.fetches: dict[str, Callable[..., lookups.Fetch]] = dict(self._default_fetches())
        self.sources: dict[str, Callable[..., DataFrame]] = dict(self._default_sources())
        self.context = Context(self.functions, {}, origin, reset_first_only, delay)
        self.arrivals = 0
        self.users, self.files = Users(user), Files(spark, f"{warehouse}/files" if warehouse else None)
        self.clear()

    def clear(self) -> None:
        """Forgets the topology under construction."""
        self.streams: dict[str, Stream] = {}
        self.emits: list[Emit] = []
        self.plan: list[str] = []
        self.numbers = 0

    # processors
    def _default_sinks(self):
        base = self.warehouse
        servers = lambda: self.conf.get("kafka.servers", "localhost:9092")

        def stored(db: str, collection: str, *more: Any):
            keys = more[-1] if more else ()
            keys = [keys] if isinstance(keys, str) else [k for k in keys] if isinstance(keys, list) else []
            if base is None:
                raise QueryError("mongo_persist needs a session with a warehouse folder, or a sink of its own")
            return writers.upsert(f"{base}/{db}/{collection}", keys)

        yield "kafka_emit", lambda topic, form="json": writers.kafka_emit(topic, form, servers())
        yield "mongo_persist", stored
        yield "jdbc_persist", writers.jdbc_persist
        yield "web_emit", writers.web_emit
        yield "log", lambda: writers.log()

    def _default_fetches(self):
        def mongo(db: str, collection: str, query: str, columns: list[str], *more: Any) -> lookups.Fetch:
            return lookups.mongo_fetch(self.collection((db, collection)), query, columns, *more)

        def jdbc(url: str, user: str, password: str, sql: str, *more: Any) -> lookups.Fetch:
            columns, table, keys, constants = lookups.jdbc_query(sql)
            own = self.collections.get(table)
            if own is None and embedded.driver_only(self.spark, url):
                own = embedded.read(self.spark, url, table, user, password, [*columns, *keys, *constants])
            elif own is None:
                own = self.spark.read.jdbc(url, table, properties={"user": user, "password": password})
            return lookups.table_lookup(own, keys, columns, constants)

        yield "mongo_fetch", mongo
        yield "jdbc_fetch", jdbc
        yield "web_fetch", lookups.web_fetch

    def _default_sources(self):
        def kafka(schema: TupleSchema, *args: Any) -> DataFrame:
            if schema.name in self.tables or schema.name in self.posted:
                return self.table(schema)
            topic = next((a for a in args if isinstance(a, str) and a not in ("json", "binary")), f"rivulet_{schema.name}")
            offset = next((a for a in args if isinstance(a, int) and not isinstance(a, bool)), None)
            options = readers.kafka_options(self.conf.get("kafka.servers", "localhost:9092"), topic, offset, any(a is True for a in args), partitions=int(self.conf.get("kafka.partitions", "1")))
            return readers.kafka_topic(self.spark, schema, options, self.streaming)

        yield "kafka_spout", kafka
        yield "memory_spout", lambda schema, *_: self.table(schema)
        yield "dummy_spout", lambda schema, *_: readers.dummy(self.spark, schema)

    def collection(self, key: tuple[str, str]) -> DataFrame:
        own = self.collections.get(key, self.collections.get(key[1]))
        if own is None:
            if self.warehouse is None:
                raise QueryError(f"no collection {'.'.join(key)}")
            own = writers.collection(self.spark, f"{self.warehouse}/{key[0]}/{key[1]}")
            if own is None:
                raise QueryError(f"no collection {'.'.join(key)}")
        return own

    # data
    def register(self, name: str, df: DataFrame, seq: str | None = None, clock: str | None = None) -> None:
        """A DataFrame as the rows of tuple ``name``; the tuple is declared by it if it isn't yet."""
        if name not in self.schemas:
            self.schemas[name] = TupleSchema(name, tuple((f.name, None) for f in df.schema if not f.name.startswith("__")))
        self.tables[name] = readers.prepared(df, seq, clock)

    def post(self, name: str, record: str | dict, at: float | None = None) -> None:
        """A JSON record of tuple ``name``, arriving at ``at`` (epoch seconds; now without one)."""
        if name not in self.schemas:
            raise QueryError(f"no tuple {name}")
        self.arrivals += 1
        at = datetime.now(timezone.utc).timestamp() if at is None else float(at)
        self.posted.setdefault(name, []).append((self.arrivals, record if isinstance(record, str) else json.dumps(record), at))

    def table(self, schema: TupleSchema) -> DataFrame:
        own = self.tables.get(schema.name)
        if own is not None:
            return own() if callable(own) else own
        rows = self.posted.get(schema.name, [])
        lines = self.spark.createDataFrame(rows, "__n bigint, value string, __at double")
        df = from_json_lines(lines, schema)
        clock = F.timestamp_micros((F.col("__at") * 1_000_000).cast("bigint"))
        if readers.TIME in schema.names():
            given = F.col(readers.TIME)
            given = F.timestamp_seconds(given.try_cast("double")) if dict(df.dtypes)[readers.TIME] == "string" else given
            df = df.withColumn(readers.TIME, F.coalesce(given, clock))
            clock = F.col(readers.TIME)
        return readers.prepared(df, F.col("__n"), clock).drop("__n", "__at")

    # statements
    def run(self, script: str) -> list[Any]:
        """All statements of a script; the results in order."""
        return [self.execute(s) for s in statements(script)]

    def execute(self, text: str) -> Any:
        own = parse(text)
        if isinstance(own, Query):
            self.query(own)
            return "OK"
        return self.command(own)

    def _number(self, kind: str) -> str:
        self.numbers += 1
        return f"{kind}_{self.numbers - 1}"

    def _spout(self, query: Query) -> Stream:
        """Reads all declared tuples that the clause names; it begins a new topology."""
        self.clear()
        plain: list[str] = []
        for s in query.sources:
            plain.extend(x.tuple for x in s.sides) if isinstance(s, TupleJoin) else plain.append(s.name)
        read = {n: self._read(n, query.processor) for n in dict.fromkeys(plain)}
        own = self._number("SPOUT")
        names = ", ".join(self.schemas[n].describe() if n in self.schemas else n for n in read)
        self.plan.append(f"{own}({show(query.processor)}, [{names}])")
        out = []
        for s in query.sources:
            if isinstance(s, TupleJoin):
                out.append(self._joined(s, {x.tuple: Stream({x.tuple: read[x.tuple]}, (), self.context) for x in s.sides}))
            else:
                out.append(Stream({s.alias or s.name: read[s.name]}, (), self.context))
        return Stream.merge(out)

    def _read(self, name: str, processor: Processor) -> DataFrame:
        if name in self.views:
            source, condition, _ = self.views[name]
            df = self._read(source, processor)
            return df.where(Binder(df, [source, name], None, self.functions).condition(condition))
        if name not in self.schemas:
            raise QueryError(f"no tuple {name}")
        if processor.name not in self.sources:
            raise QueryError(f"no source {processor.name}")
        df = self.sources[processor.name](self.schemas[name], *processor.args)
        keys = self.schemas[name].keys
        return df.repartition(*keys) if keys and self.conf.get("source.repartition") == "true" else df

    def _named(self, name: str) -> Stream:
        if name not in self.streams:
            raise QueryError(f"no stream {name}")
        return self.streams[name]

    def _joined(self, j: TupleJoin, sides: dict[str, Stream]) -> Stream:
        own = self._number("TUPLE_JOIN")
        self.plan.append(f"{own}({' JOIN '.join(x.tuple for x in j.sides)}, expire {j.expire.text}) AS {j.alias}")
        return tuple_join([(x.tuple, sides[x.tuple]) for x in j.sides], [x.on for x in j.sides[1:]], j.to, j.expire, j.alias)

    def _from(self, query: Query) -> Stream:
        out = []
        for s in query.sources:
            if isinstance(s, TupleJoin):
                sides = {x.tuple: self._side(x.stream, x.tuple) for x in s.sides}
                out.append(self._joined(s, sides))
                continue
            own = self._named(s.name)
            own = own.select(*s.tuples) if s.tuples else own
            out.append(own.rename(s.alias) if s.alias else own)
        return Stream.merge(out) if len(out) > 1 else out[0]

    def _side(self, stream: str | None, tuple_name: str) -> Stream:
        if stream is None:
            raise QueryError(f"{tuple_name}: name the stream it comes from")
        return self._named(stream).select(tuple_name)

    def query(self, query: Query) -> Stream:
        """Adds a query to the topology; the stream after its last clause."""
        s = self._spout(query) if query.processor else self._from(query)
        if not query.processor:
            self.plan.append("FROM " + ", ".join(x.alias if isinstance(x, TupleJoin) else x.name + (f"({', '.join(x.tuples)})" if x.tuples else "") + (f" AS {x.alias}" if x.alias else "") for x in query.sources))
        for c in query.clauses:
            s = self._clause(s, c)
        return s

    def _clause(self, s: Stream, c: Clause) -> Stream:
        a = c.args
        mark = f" parallelism={c.parallelism}" if c.parallelism else ""
        if c.kind == "INTO":
            self.streams[a["name"]] = s
            self.plan.append(f" INTO {a['name']}")
            return s
        if c.kind == "EMIT":
            return self._emit(s, c)
        if c.kind in ("BEGIN GROUP", "PARTITION"):
            self.plan.append(f" {c.kind} BY " + ", ".join(map(show, a["fields"])))
            return s.begin_group(*a["fields"]) if c.kind == "BEGIN GROUP" else s.partition(*a["fields"])
        if c.kind in ("END GROUP", "TO STREAM"):
            self.plan.append(f" {c.kind}")
            return s.end_group() if c.kind == "END GROUP" else s.to_stream()
        own = self._number(c.kind.replace(" ", "_"))
        if c.kind == "EACH":
            self.plan.append(f" {own}({show(a['items'])}){mark}")
            return s.each(a["items"])
        if c.kind == "FILTER":
            self.plan.append(f" {own}({show(a['condition'])}){mark}")
            return s.filter(a["condition"])
        if c.kind == "FILTER GROUP":
            self.plan.append(f" {own}(expire {a['expire'].text}, {show(a['conditions'])}){mark}")
            return s.filter_group(a["expire"], a["conditions"], a["state"])
        if c.kind == "SLIDE":
            by = f" BY {a['by']}" if a["by"] else ""
            self.plan.append(f" {own}(length({show(a['length'])}{by}), {show(a['items'])}){mark}")
            return s.slide(a["length"], a["items"], a["by"])
        if c.kind == "SNAPSHOT":
            end = f", expire({show(a['expire'])})" if a["expire"] else ""
            self.plan.append(f" {own}(interval({show(a['every'])}), {show(a['items'])}{end}){mark}")
            return s.snapshot(a["every"], a["items"], a["expire"])
        if c.kind == "LIMIT":
            self.plan.append(f" {own}({'first' if a['first'] else 'last'} every({show(a['every'])})){mark}")
            return s.limit(a["first"], a["every"])
        fetch: Processor = a["fetch"]
        if fetch.name not in self.fetches:
            raise QueryError(f"no lookup {fetch.name}")
        self.plan.append(f" {own}({show(fetch)}, [{', '.join(a['fields'])}]){mark}")
        return s.lookup(a["fields"], self.fetches[fetch.name](*fetch.args))

    def _emit(self, s: Stream, c: Clause) -> Stream:
        own, remake = self._number("EMIT"), None
        if "to" in c.args:
            name = c.args["to"]
            if name not in self.schemas:
                raise QueryError(f"no tuple {name}")
            write, text = self._reingest(name), f"TO {name}"
        else:
            sink: Processor = c.args["sink"]
            if sink.name not in self.sinks:
                raise QueryError(f"no sink {sink.name}")
            fill = lambda x: re.sub(r"\$\{(\w+)\}", lambda m: str(self.context.names.get(m[1].lower(), m[0])), x) if isinstance(x, str) else x
            make = lambda: self.sinks[sink.name](*map(fill, sink.args))
            write, text = make(), show(sink)
            if any(isinstance(x, str) and "${" in x for x in sink.args):
                remake = make
        self.plan.append(f" {own}({text}, {show(c.args['fields'])})" + (f" parallelism={c.parallelism}" if c.parallelism else ""))
        self.emits.append(Emit(len(self.emits), s, c.args["fields"], write, text, remake))
        return s

    def _reingest(self, name: str) -> Callable[[DataFrame], None]:
        """Rows become records of another tuple: in the warehouse's folder for it, from which the tuple is then read."""
        schema = self.schemas[name]

        def write(df: DataFrame, batch: str | None = None) -> None:
            if self.warehouse is None:
                raise QueryError("EMIT TO needs a session with a warehouse folder")
            path = f"{self.warehouse}/tuples/{name}"
            lines = writers.as_json(df.select(*[c for c in df.columns if c in schema.names()]))
            writers.appended(lines, path, lambda w, p: w.text(p), batch)
            self.tables[name] = lambda: readers.json_folder(self.spark, path, schema, self.streaming)

        write.by_batch = True
        return write

    # commands
    def command(self, c: Command) -> Any:
        a, kind = c.args, c.kind
        if kind == "CREATE TUPLE":
            schema = TupleSchema(a["name"], tuple(dict(a["fields"]).items()), a["keys"], a["comment"])
            if a["name"] in self.schemas or a["name"] in self.views:
                raise QueryError(f"{a['name']} exists already")
            for k in schema.keys:
                if k not in schema.names():
                    raise QueryError(f"PARTITIONED BY: no field {k}")
            self.schemas[a["name"]] = schema
            return "OK"
        if kind == "CREATE VIEW":
            if a["source"] not in self.schemas:
                raise QueryError(f"no tuple {a['source']}")
            if a["name"] in self.schemas or a["name"] in self.views:
                raise QueryError(f"{a['name']} exists already")
            self.views[a["name"]] = (a["source"], a["condition"], a["comment"])
            return "OK"
        if kind == "CREATE FUNCTION":
            self.functions[a["name"].lower()] = load(a["name"].lower(), a["location"], self.files.text(a["location"]))
            return "OK"
        if kind in ("DESC TUPLE", "DROP TUPLE"):
            schema = self._known(self.schemas, a["name"], "tuple")
            if kind == "DESC TUPLE":
                return json.dumps({"name": schema.name, "fields": {n: type_text(t) or "auto detect" for n, t in schema.fields}, "partitioned": list(schema.keys), "comment": schema.comment})
            if any(v[0] == a["name"] for v in self.views.values()):
                raise QueryError(f"{a['name']} has views")
            del self.schemas[a["name"]]
            return "OK"
        if kind in ("DESC VIEW", "DROP VIEW"):
            source, condition, comment = self._known(self.views, a["name"], "view")
            if kind == "DESC VIEW":
                return json.dumps({"name": a["name"], "from": source, "filter": show(condition), "comment": comment})
            del self.views[a["name"]]
            return "OK"
        if kind in ("DESC FUNCTION", "DROP FUNCTION"):
            f = self._known(self.functions, a["name"].lower(), "function")
            if kind == "DESC FUNCTION":
                return json.dumps({"name": f.name, "type": "UDAF" if f.aggregate else "UDF", "location": f.location, "returns": f.returns})
            del self.functions[a["name"].lower()]
            return "OK"
        if kind in ("CREATE USER", "ALTER USER"):
            (self.users.create if kind == "CREATE USER" else self.users.alter)(a["name"], a["password"])
            return "OK"
        if kind == "DROP USER":
            self.users.drop(a["name"], a["name"] == self.users.owner and bool(self.schemas or self.topologies))
            return "OK"
        if kind in ("DESC USER", "SHOW USERS"):
            return self.users.describe() if kind == "DESC USER" else self.users.show()
        if kind == "UPLOAD":
            self.files.upload(a["path"])
            return "OK"
        if kind == "DROP FILE":
            self.files.drop(a["name"])
            return "OK"
        if kind in ("DESC FILE", "SHOW FILES"):
            return json.dumps(self.files.known(a["name"]) if kind == "DESC FILE" else list(self.files.all.values()))
        if kind == "POST":
            self.post(a["name"], a["record"])
            return "OK"
        if kind.startswith("SHOW "):
            own = {"TUPLES": self.schemas, "VIEWS": self.views, "FUNCTIONS": self.functions}.get(kind[5:])
            return json.dumps(sorted(own)) if own is not None else json.dumps([{"name": t.name, "status": t.status} for t in self.topologies.values()])
        if kind == "SET":
            if a["value"] is None:
                return json.dumps(self.conf if not a["key"] else {a["key"]: self.conf.get(a["key"])})
            self.conf[a["key"]] = a["value"]
            return "OK"
        if kind == "CLEAR":
            self.clear()
            return "OK"
        if kind == "EXPLAIN":
            return self.explain(a["extended"], a["name"])
        if kind == "DESC CLUSTER":
            sc = self.spark.sparkContext
            return json.dumps({"master": sc.master, "version": sc.version, "parallelism": sc.defaultParallelism, "application": sc.applicationId})
        return self._topology(kind, a)

    @staticmethod
    def _known(own: dict, name: str, what: str) -> Any:
        if name not in own:
            raise QueryError(f"no {what} {name}")
        return own[name]

    def _topology(self, kind: str, a: dict) -> Any:
        if kind == "SUBMIT TOPOLOGY":
            return self.submit(a["name"], a["comment"])
        if kind == "DESC TOPOLOGY" and a["name"] is None:
            return json.dumps({"name": None, "plan": self.plan})
        if kind == "STATS TOPOLOGY" and a["name"] is None:
            return json.dumps([self._stats(t, a["extended"]) for t in self.topologies.values()])
        t: Topology = self._known(self.topologies, a["name"], "topology")
        if kind == "DESC TOPOLOGY":
            return json.dumps({"name": t.name, "status": t.status, "created": t.created, "comment": t.comment, "plan": t.plan})
        if kind == "STATS TOPOLOGY":
            return json.dumps(self._stats(t, a["extended"]))
        if kind == "STOP TOPOLOGY":
            for q in t.queries:
                q.stop()
            t.queries, t.status = [], "STOPPED"
        elif kind == "START TOPOLOGY":
            if t.status == "RUNNING":
                raise QueryError(f"{t.name} is running")
            self._start(t)
        else:
            if t.status == "RUNNING" and t.queries:
                raise QueryError(f"{t.name} is running")
            del self.topologies[t.name]
        return "OK"

    @staticmethod
    def _stats(t: Topology, extended: bool) -> dict:
        return {"name": t.name, "status": t.status, "queries": [{"id": str(q.id), "status": q.status, **({"progress": [json.loads(p.json) for p in q.recentProgress]} if extended else {})} for q in t.queries]}

    def submit(self, name: str | None, comment: str | None = None) -> str:
        """Runs the sinks of the topology: streams start, bounded data is written now."""
        if not self.emits:
            raise QueryError("the topology has no EMIT")
        if name in self.topologies:
            raise QueryError(f"topology {name} exists already")
        self.context.names["topology_id"] = self.context.names["topology_name"] = name
        t = Topology(name, list(self.emits), list(self.plan), comment)
        self.topologies[name] = t
        self._start(t)
        return "OK"

    def _start(self, t: Topology) -> None:
        t.status = "RUNNING"
        for e in t.emits:
            if e.make:
                e.write = e.make()
            df, write = e.send()
            if df.isStreaming:
                name = re.sub(r"\W", "_", f"{t.name}-{e.number}")
                out = df.writeStream.outputMode("append").foreachBatch(lambda batch, n, write=write, name=name: write(batch, f"{name}_{n}"))
                if self.warehouse:
                    out = out.option("checkpointLocation", f"{self.warehouse}/checkpoints/{t.name}/{e.number}")
                if self.conf.get("trigger") == "available":
                    out = out.trigger(availableNow=True)
                t.queries.append(out.start())
            else:
                write(df, None)

    def explain(self, extended: bool = False, name: str | None = None) -> str:
        """The operators of the topology; with ``extended`` the fields of each sink and Spark's plan too."""
        t = self._known(self.topologies, name, "topology") if name else None
        lines, emits = ["Explain:", *(t.plan if t else self.plan)], t.emits if t else self.emits
        if extended:
            lines.append("Output fields:")
            for e in emits:
                df = e.df()
                lines.append(f" {e.text}: [{', '.join(visible(df))}]")
                lines.append(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(lines)


def stream(df: DataFrame, name: str = "t", seq: str | None = None, clock: str | None = None, context: Context | None = None) -> Stream:
    """A stream of one tuple from a DataFrame, for use without statements."""
    ship(df.sparkSession)
    return Stream({name: readers.prepared(df, seq, clock)}, (), context or Context())
