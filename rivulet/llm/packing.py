"""Best-fit packing of token pieces into sequences, certified by dual feasible functions.

Each partition packs its pieces by best-fit decreasing and compares the number of sequences with a
lower bound from dual feasible functions. A partition that meets its bound is done. The others give
the pieces of their loosely filled sequences to a common pool, which is dealt anew and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import written
from rivulet.llm.encoders import ByteBpe, per_process, vocabulary

#: Pieces that one task packs; a task holds a few bytes for each.
GROUP_PIECES = 1 << 16
#: Rounds of exchange at most; the last one keeps whatever it packs.
ROUNDS = 4
#: A sequence with more free places than capacity / LOOSE gives its pieces to the pool.
LOOSE = 64

_PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths, capacity: int) -> int:
    """No packing of ``lengths`` needs fewer bins: the best over two families of dual feasible functions."""
    return bound_of_counts(np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` where counts[x] items have length x."""
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    # items above the middle are alone; those from a on fill what these leave
    half, n, s = capacity // 2, np.cumsum(counts[::-1])[::-1], np.cumsum((counts * x)[::-1])[::-1]
    n, s = np.append(n, 0), np.append(s, 0)
    for a in range(1, half + 1):
        alone, room = n[half + 1], (n[half + 1] - n[capacity - a + 1]) * capacity - (s[half + 1] - s[capacity - a + 1])
        best = max(best, int(alone) + max(0, -(-int(s[a] - s[half + 1] - room) // capacity)))
    for k in range(1, 33):  # rounds (k + 1) x down to k-ths, exact multiples stay
        up = (k + 1) * x
        value = np.where(up % capacity == 0, k * x, up // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the free places of each bin.

    Bins are kept by their free places; a bit mask of those in use gives the fullest bin that still fits.
    """
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and not 0 < lengths.min() <= lengths.max() <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, rooms = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        if fits := mask >> x:
            room = x + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = room = room - x
        if room:
            if not by_room[room]:
                mask |= 1 << room
            by_room[room].append(b)
    return bins, offsets, np.array(rooms, np.int64)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which may be shorter."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each whole text's ids and end id; no shuffle. The id keeps its type."""
    kind = docs.schema[doc_id].dataType.simpleString()
    key, blob = vocabulary(docs.sparkSession, tokenizer)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(ByteBpe, key, blob)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]  # the first has the row of each piece
            for i, own in enumerate(coder.batch(batch.column(1).to_pylist())):
                ids = np.append(own.astype("<u4"), np.array([end_id], "<u4"))
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(out, (i, k, a, n, zlib.crc32(ids[a : a + n].tobytes()))):
                        column.append(x)
            columns = [pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, _PIECES.format(kind=kind))


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with a ``length``) plus sequence_id and offset. Each sequence holds at most ``capacity`` tokens, without gaps.

    Pieces are dealt evenly whatever their ids, so no key can fill a task, and a task holds at most about
    ``group_pieces`` of them. Every round is written to the shared folder before the next one reads it.
    """
    names = pieces.columns
    schema = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("done")).schema

    def packed(k: int, last: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
            if rows is None or not rows.num_rows:
                return
            lengths = rows.column("length").to_numpy()
            bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
            certified = len(rooms) <= lower_bound(lengths, capacity)
            done = np.ones(len(bins), bool) if certified or last else (rooms <= capacity // LOOSE)[bins]
            first = (k << 56) + (TaskContext.get().partitionId() << 32)
            rows = rows.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).append_column("done", pa.array(done))
            yield from rows.to_batches(max_chunksize=1 << 14)

        return pack

    parts, pool, n = [], pieces, pieces.count()
    for k in range(rounds):
        groups = max(1, -(-n // group_pieces))
        last = k == rounds - 1 or groups == 1
        out = written(pool.repartition(groups).mapInArrow(packed(k, last), schema), f"packed{k}")
        parts.append(out.where("done").drop("done"))
        if last:
            break
        pool = out.where("not done").select(*names)
        if not (n := pool.count()):
            break
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """(sequences used, least number that any packing of all these pieces needs). Equal numbers prove the packing best.

    The bound is that of all pieces together, from a table of how many there are of each length.
    """
    lengths = dict(map(tuple, packed.groupBy("length").count().collect()))
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(lengths)] = list(lengths.values())
    used = packed.where("offset = 0").count()
    return used, bound_of_counts(counts, capacity)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs the ids of all whole texts, each followed by ``end_id``, into sequences of ``capacity`` tokens.

    Returns doc_id (of any type), piece, start, length, ids_crc32, sequence_id, offset; ``certificate`` tells
    how near the best it is. A null or empty text is its end id alone. Rows of one id, or of a null id, are packed each on its own. Other columns are not read.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces"), capacity)
