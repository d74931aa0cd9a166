"""The parsed form of expressions and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Const:
    value: Any
    type: str  # string, tinyint, smallint, int, bigint, float, double, boolean


@dataclass(frozen=True)
class Field:
    """A dotted path; each part is (name, subscripts). A part named * stands for all fields."""

    parts: tuple[tuple[str, tuple[Any, ...]], ...]

    @property
    def star(self) -> bool:
        return self.parts[-1][0] == "*"

    @property
    def name(self) -> str:
        return self.parts[-1][0]

    def __str__(self) -> str:
        return ".".join(n + "".join(f"[{show(s)}]" for s in subs) for n, subs in self.parts)


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Index:
    """An element of a function's result."""

    value: Any
    key: Any


@dataclass(frozen=True)
class Cast:
    value: Any
    type: str
    format: str | None = None


@dataclass(frozen=True)
class Compare:
    """op: = <> < <= > >= LIKE REGEXP IN ALL BETWEEN NULL."""

    op: str
    left: Any
    right: Any = None


@dataclass(frozen=True)
class Not:
    value: Any


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Item:
    """An expression of EACH, SLIDE or SNAPSHOT with its alias."""

    value: Any
    alias: str | None = None


@dataclass(frozen=True)
class Period:
    seconds: int
    text: str


@dataclass(frozen=True)
class Cron:
    text: str


@dataclass(frozen=True)
class Processor:
    name: str
    args: tuple[Any, ...] = ()


@dataclass(frozen=True)
class JoinSide:
    """One side of a tuple join. stream is None where the side is a declared tuple."""

    stream: str | None
    tuple: str
    on: tuple[tuple[Field, Field], ...] = ()


@dataclass(frozen=True)
class TupleJoin:
    sides: tuple[JoinSide, ...]
    to: tuple[tuple[str, str, str | None], ...]  # tuple, field or *, alias
    expire: Period
    cache: Processor | None
    alias: str


@dataclass(frozen=True)
class Source:
    """What FROM names: a tuple, or a stream with the tuples taken from it."""

    name: str
    tuples: tuple[str, ...] = ()
    alias: str | None = None


@dataclass(frozen=True)
class Clause:
    kind: str
    args: dict[str, Any] = field(default_factory=dict)
    parallelism: int | None = None


@dataclass(frozen=True)
class Query:
    sources: tuple[Source | TupleJoin, ...]
    processor: Processor | None
    clauses: tuple[Clause, ...]
    parallelism: int | None = None


@dataclass(frozen=True)
class Command:
    """Any statement that is no query: its words and arguments."""

    kind: str
    args: dict[str, Any] = field(default_factory=dict)


def show(x: Any) -> str:
    """The text of an expression, as EXPLAIN prints it."""
    if isinstance(x, Const):
        return f"'{x.value}'" if x.type == "string" else str(x.value).lower() if x.type == "boolean" else str(x.value)
    if isinstance(x, Arith):
        return f"({show(x.left)} {x.op} {show(x.right)})"
    if isinstance(x, Call):
        return f"{x.name}({'distinct ' * x.distinct}{', '.join(map(show, x.args))})"
    if isinstance(x, Index):
        return f"{show(x.value)}[{show(x.key)}]"
    if isinstance(x, Cast):
        return f"cast({show(x.value)}, {x.type}" + (f"('{x.format}')" if x.format else "") + ")"
    if isinstance(x, Compare):
        if x.op == "NULL":
            return f"{show(x.left)} IS NULL"
        right = " AND ".join(map(show, x.right)) if x.op == "BETWEEN" else "(" + ", ".join(map(show, x.right)) + ")" if x.op in ("IN", "ALL") else show(x.right)
        return f"{show(x.left)} {x.op} {right}"
    if isinstance(x, Not):
        return f"NOT ({show(x.value)})"
    if isinstance(x, Logic):
        return "(" + f" {x.op} ".join(map(show, x.values)) + ")"
    if isinstance(x, Item):
        return show(x.value) + (f" AS {x.alias}" if x.alias else "")
    if isinstance(x, Period | Cron):
        return x.text
    if isinstance(x, Processor):
        return f"{x.name}({', '.join(map(show, x.args))})"
    if isinstance(x, tuple | list):
        return "[" + ", ".join(map(show, x)) + "]"
    return str(x)
