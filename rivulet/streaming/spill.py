"""Sorts more items than memory should hold: sorted runs go to a file without a name and are merged."""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from operator import itemgetter
from typing import Any

#: Items and bytes of a run, items of a block that is read at a time, and runs that are merged at a time.
RUN_ITEMS, RUN_BYTES, BLOCK, FAN = 1 << 15, 8 << 20, 256, 64

Run = list[tuple[int, int]]


def in_order(packed: Iterable[bytes]) -> Iterator[tuple]:
    """The pickled tuples, unpickled, by their first field; equal ones stay as they come."""
    key = itemgetter(0)
    items: list[tuple] = []
    size = 0
    file = None
    levels: list[list[Run]] = []
    try:
        for one in packed:
            items.append(pickle.loads(one))
            size += len(one)
            if len(items) < RUN_ITEMS and size < RUN_BYTES:
                continue
            if file is None:
                own = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                file = tempfile.TemporaryFile(dir=own if os.path.isdir(own) else None)
            items.sort(key=key)
            _add(file, levels, 0, _write(file, items))
            items, size = [], 0
        items.sort(key=key)
        if file is None:
            yield from items
        else:  # runs of higher levels hold earlier items
            yield from heapq.merge(*[_read(file, r) for level in reversed(levels) for r in level], items, key=key)
    finally:
        if file is not None:
            file.close()


def _add(file: Any, levels: list[list[Run]], at: int, run: Run) -> None:
    while len(levels) <= at:
        levels.append([])
    levels[at].append(run)
    if len(levels[at]) >= FAN:
        merged = _write(file, heapq.merge(*[_read(file, r) for r in levels[at]], key=itemgetter(0)))
        levels[at] = []
        _add(file, levels, at + 1, merged)


def _write(file: Any, items: Iterable[tuple]) -> Run:
    run, block = [], []

    def put() -> None:
        raw = pickle.dumps(block)
        run.append((file.seek(0, os.SEEK_END), len(raw)))
        file.write(raw)
        block.clear()

    for x in items:
        block.append(x)
        if len(block) >= BLOCK:
            put()
    if block:
        put()
    file.flush()
    return run


def _read(file: Any, run: Run) -> Iterator[tuple]:
    for at, length in run:
        yield from pickle.loads(os.pread(file.fileno(), length, at))
