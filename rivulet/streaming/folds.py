"""Operators that must see a group's rows one by one, in order of arrival.

A fold has a state for each group and turns one row into output rows. The same fold runs on bounded data
(rows of a group stream past in order; only its state is held) and in Structured Streaming (the state
lives in the state store). Clocks are whole epoch seconds in ``__now``.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import product
from typing import Any

Row = dict[str, Any]


class Fold:
    """``added``: name and Spark type of the columns that are put on an output row."""

    added: tuple[tuple[str, str], ...] = ()

    def reads(self, column: str) -> bool:
        """Whether the fold looks at the column's values; others it only passes on."""
        return column == "__now" or column.startswith("__c") and column[3:].isdigit()

    def payload(self, column: str) -> bool:
        """Whether an output row may have the column from another row."""
        return False

    def start(self) -> Any:
        raise NotImplementedError

    def row(self, state: Any, row: Row) -> Iterable[Row]:
        raise NotImplementedError

    def until(self, state: Any) -> int | None:
        """The last second at which the state matters: after it, a new one gives the same. None if it always does."""
        return None


@dataclass
class LimitTime(Fold):
    """FIRST: a row, then none until ``seconds`` have passed. LAST: the row before the first one after that time."""

    seconds: int
    first: bool

    def start(self) -> dict:
        return {"until": None, "last": None}

    def row(self, state: dict, row: Row) -> list[Row]:
        now, out = row["__now"], []
        if self.first:
            if state["until"] is None or now > state["until"]:
                state["until"] = now + self.seconds
                out = [row]
            return out
        if state["until"] is None:
            state["until"] = now + self.seconds
        elif now > state["until"]:
            out, state["until"] = [state["last"]], now + self.seconds
        state["last"] = row
        return out

    def until(self, state: dict) -> int | None:
        return state["until"] if self.first else None


@dataclass
class LimitRows(Fold):
    every: int
    first: bool

    def start(self) -> dict:
        return {"n": 0}

    def row(self, state: dict, row: Row) -> list[Row]:
        state["n"] += 1
        return [row] if state["n"] % self.every == (1 % self.every if self.first else 0) else []


@dataclass
class FilterGroup(Fold):
    """A row passes once all conditions (``__c0``, ...) have held within ``seconds`` of each other; then all start anew.

    ``first_only``: only the first condition starts anew. ``state_to``: column with the instants up to which each held.
    """

    seconds: int
    conditions: int
    state_to: str | None = None
    first_only: bool = False

    def __post_init__(self):
        if self.state_to:
            self.added = ((self.state_to, "array<timestamp>"),)

    def start(self) -> list[int]:
        return [0] * self.conditions

    def row(self, state: list[int], row: Row) -> list[Row]:
        now = row["__now"]
        for i in range(self.conditions):
            if state[i] < now:
                state[i] = 0
            if row[f"__c{i}"]:
                state[i] = now + self.seconds
        if not all(state):
            return []
        out = dict(row)
        if self.state_to:
            out[self.state_to] = [datetime.fromtimestamp(x, timezone.utc) for x in state]
        for i in range(1 if self.first_only else self.conditions):
            state[i] = 0
        return [out]

    def until(self, state: list[int]) -> int | None:
        return max(state)


@dataclass
class TupleJoin(Fold):
    """Rows of ``sides`` kinds (``__side``) wait until every side has a live one; then all combinations go out and all are taken away.

    A row lives ``seconds`` from its arrival on. Output rows hold each side's ``__payload`` as ``__s0``, ...
    """

    seconds: int
    sides: int

    def reads(self, column: str) -> bool:
        return column in ("__now", "__side")

    def payload(self, column: str) -> bool:
        return column.startswith("__p") and column[3:].isdigit()

    def start(self) -> list[list[tuple[int, Any]]]:
        return [[] for _ in range(self.sides)]

    def row(self, state: list, row: Row) -> Iterable[Row]:
        now, side = row["__now"], row["__side"]
        if state[side] and state[side][-1][0] > now + self.seconds:  # a late row goes where its time is
            bisect.insort(state[side], (now + self.seconds, row[f"__p{side}"]), key=lambda x: x[0])
        else:
            state[side].append((now + self.seconds, row[f"__p{side}"]))
        for own in state:
            if own and own[0][0] < now:  # the live ones begin after all that have expired
                del own[: bisect.bisect_left(own, now, key=lambda x: x[0])]
        if not all(state):
            return ()
        taken = [[p for _, p in own] for own in state]
        for own in state:
            own.clear()
        rest = {k: v for k, v in row.items() if not k.startswith("__p")}
        return ({**rest, **{f"__p{i}": p for i, p in enumerate(one)}} for one in product(*taken))

    def until(self, state: list) -> int | None:
        return max((own[-1][0] for own in state if own), default=0)


# aggregates with eviction, for SLIDE, SNAPSHOT and running EACH in streams, and for user-defined ones


class Accumulator:
    """evaluate takes a value in, exclude takes it out again; both may be given None."""

    def evaluate(self, *x: Any) -> None: ...
    def exclude(self, *x: Any) -> None: ...
    def clear(self) -> None: ...
    def result(self) -> Any: ...


class CountRows(Accumulator):
    def __init__(self):
        self.n = 0

    def evaluate(self, *x):
        self.n += not x or x[0] is not None

    def exclude(self, *x):
        self.n -= not x or x[0] is not None

    def clear(self):
        self.n = 0

    def result(self):
        return self.n


class Sum(Accumulator):
    def __init__(self):
        self.clear()

    def evaluate(self, x):
        if x is not None:
            self.total, self.n = self.total + x, self.n + 1

    def exclude(self, x):
        if x is not None:
            self.total, self.n = self.total - x, self.n - 1

    def clear(self):
        self.total, self.n = 0, 0

    def result(self):
        """Integers wrap at 64 bits."""
        return (self.total + (1 << 63)) % (1 << 64) - (1 << 63) if isinstance(self.total, int) else self.total


class Average(Sum):
    def result(self):
        if not self.n:
            return None
        total = super().result()
        if isinstance(total, int):
            return total // self.n if total >= 0 else -(-total // self.n)
        return total / self.n


class CollectList(Accumulator):
    def __init__(self):
        self.values = deque()

    def evaluate(self, x):
        if x is not None:
            self.values.append(x)

    def exclude(self, x):
        if x is not None:
            self.values.popleft()

    def clear(self):
        self.values.clear()

    def result(self):
        return list(self.values)


class Distinct(Accumulator):
    """Passes a value on when it comes first, and takes it out when its last one goes."""

    def __init__(self, inner: Accumulator):
        self.inner, self.counts = inner, {}

    def evaluate(self, x):
        if x is not None:
            key = repr(x) if isinstance(x, list | dict) else x
            self.counts[key] = self.counts.get(key, 0) + 1
            if self.counts[key] == 1:
                self.inner.evaluate(x)

    def exclude(self, x):
        if x is not None:
            key = repr(x) if isinstance(x, list | dict) else x
            self.counts[key] -= 1
            if not self.counts[key]:
                del self.counts[key]
                self._out(x)

    def _out(self, x):
        if isinstance(self.inner, CollectList):
            self.inner.values.remove(x)
        else:
            self.inner.exclude(x)

    def clear(self):
        self.counts.clear()
        self.inner.clear()

    def result(self):
        return self.inner.result()


class UserAggregate(Accumulator):
    """A class or module with evaluate, exclude and clear; evaluate returns the result so far."""

    def __init__(self, make):
        self.make, self.own, self.last = make, make(), None

    def evaluate(self, *x):
        self.last = self.own.evaluate(*x)

    def exclude(self, *x):
        self.last = self.own.exclude(*x)

    def clear(self):
        self.own.clear()
        self.last = None

    def result(self):
        return self.last


def accumulator(name: str, distinct: bool, user=None) -> Accumulator:
    if user is not None:
        return UserAggregate(user)
    plain = {"count": CountRows, "sum": Sum, "avg": Average, "collect_list": CollectList, "collect_set": CollectList}[name]()
    return Distinct(plain) if distinct or name == "collect_set" else plain


@dataclass
class Aggregates(Fold):
    """Puts the aggregates ``__r0``, ... of the arguments ``__a0_0``, ... on rows.

    ``kind``: running (each row), rows (each row, over the last ``length``), time (each row, over the last
    ``length`` seconds of ``__by``), snapshot (each ``length``-th row, then all start anew).
    ``specs``: (name, number of arguments, distinct, result type, user class or None).
    """

    kind: str
    specs: tuple[tuple[str, int, bool, str, Any], ...]
    length: int = 0
    added: tuple[tuple[str, str], ...] = field(init=False)

    def reads(self, column: str) -> bool:
        return column == "__by" or column.startswith("__a")

    def __post_init__(self):
        self.added = tuple((f"__r{i}", s[3]) for i, s in enumerate(self.specs))

    def start(self) -> dict:
        return {"acc": [accumulator(n, d, u) for n, _, d, _, u in self.specs], "rows": deque(), "n": 0, "ordered": True}

    def _args(self, row: Row) -> list[tuple]:
        return [tuple(row[f"__a{i}_{k}"] for k in range(s[1])) for i, s in enumerate(self.specs)]

    def row(self, state: dict, row: Row) -> list[Row]:
        args, acc = self._args(row), state["acc"]
        for a, x in zip(acc, args):
            a.evaluate(*x)
        state["n"] += 1
        if self.kind in ("rows", "time"):
            kept, by = state["rows"], row.get("__by")
            if kept and self.kind == "time" and by < kept[-1][0]:
                state["ordered"] = False
            kept.append((by, args))
            gone = []
            if self.kind == "rows":
                if len(kept) > self.length:
                    gone.append(kept.popleft())
            elif state["ordered"]:  # what has expired stands at the head
                while kept[0][0] < by - self.length:
                    gone.append(kept.popleft())
            else:
                gone = [x for x in kept if x[0] < by - self.length]
                if gone:
                    state["rows"] = deque(x for x in kept if x[0] >= by - self.length)
            for _, old in gone:
                for a, x in zip(acc, old):
                    a.exclude(*x)
        if self.kind == "snapshot" and state["n"] % self.length:
            return []
        out = {**row, **{f"__r{i}": a.result() for i, a in enumerate(acc)}}
        if self.kind == "snapshot":
            for a in acc:
                a.clear()
        return [out]
