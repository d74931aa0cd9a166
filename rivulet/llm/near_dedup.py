"""Near-duplicate detection with SetSketch registers.

A sketch has REGISTERS exponentially spaced, truncated minima. Bands of equal register values propose
candidates; the registers of a pair give its similarity by maximum likelihood; what may reach the
threshold is verified on the full shingle sets. Documents of one shingle set are one node. Inside a band
bucket every node is first paired with the bucket's smallest node, so a bucket of n nodes gives n - 1
pairs. Where a bucket's nodes then are in one component, nothing is left to find; in the others, nodes
of different components are compared in blocks of bounded size, each pair in the first band it shares,
and a block sends on one link for each node and component, not all pairs. Buckets of more than one block
are first filed anew by the rarest shingles of their nodes, if that leaves less to compare, so that texts
that share much but stay below the threshold do not cost the square of their number. Sets are of 64-bit
hashes of shingles, on which links are confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import encoders
from rivulet.llm.common import stable, with_locator, written
from rivulet.llm.shingles import mix, shingle_set

#: BANDS of ROWS registers: a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 32 < 4e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Base, rate and limit of the registers; the base keeps equal registers about as likely as equal minima.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: An estimate this far below the threshold (six standard errors) rules a pair out.
MARGIN = 0.2
#: Nodes of a block, and shingles of each that a block holds: the smallest hashes, for most texts all of them.
BLOCK, HELD = 512, 512
#: Shingles that more nodes than this have are ordered by their number; of these there are at most MOST_OFTEN.
RARE, MOST_OFTEN = 16, 1_000_000
#: Margin of estimates from HELD hashes (five standard errors).
HELD_MARGIN = 0.1

_FACTORS = mix(np.arange(1, REGISTERS // 2 + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, as unsigned 16-bit registers. The larger of two sketches' registers is that of the union."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    half = REGISTERS // 2
    for a in range(0, len(shingles), 1024):
        x = shingles[a : a + 1024]
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        least[:half] = np.minimum(least[:half], np.multiply.outer(_FACTORS, low).min(axis=1))
        least[half:] = np.minimum(least[half:], np.multiply.outer(_FACTORS, high).min(axis=1))
    waits = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(waits) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def bands(regs: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band, different between bands."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in regs.reshape(BANDS, ROWS).T:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return total.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 64) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood, from their registers (rows of ``a`` and ``b``) and set sizes."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    more, less = p(u - v * j), p(v - u * j)
    likelihood = up * np.log(more) + down * np.log(less) + (a.shape[1] - up - down) * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), likelihood.argmax(1)]


def sketched(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key (unique), doc_id, its place, n_shingles, and for non-empty sets digest, registers and bands. Written once."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(a, 1024), []
                for x in part.column(0).to_pylist():
                    own = shingle_set(x, size)
                    if len(own):
                        r = registers(own)
                        rows.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), r.tobytes(), bands(r)))
                    else:
                        rows.append((0, None, None, None))
                n, digests, regs, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(range(key, key + len(rows)), pa.int64()), part.column(1), part.column(2), part.column(3), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["key", "doc_id", "_file", "_row", "n_shingles", "digest", "regs", "bands"])
                key += len(rows)

    rows = with_locator(docs, F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    return written(rows.mapInArrow(sketch, f"key long, doc_id {kind}, _file string, _row long, n_shingles long, digest binary, regs binary, bands array<long>"), "sketches")


def _close(percent: int):
    """UDF (registers, sizes of both) -> whether the pair may reach the threshold."""

    @F.arrow_udf("boolean")
    def close(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ra, rb, na, nb in batches:
            a, b = (np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(-1, REGISTERS) for x in (ra, rb))
            yield pa.array(estimate(a, b, na.to_numpy(), nb.to_numpy()) >= percent / 100 - MARGIN)

    return close


def _sets(docs: DataFrame, places: DataFrame, size: int, text: str) -> DataFrame:
    """node, shingles (the full set) of the rows of ``docs`` at ``places`` (node, _file, _row)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x, size).tobytes() for x in part.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    rows = with_locator(docs, F.col(text).alias("text")).join(places, ["_file", "_row"])
    return written(rows.select("node", "text").mapInArrow(sets, "node long, shingles binary"), "sets")


def _linked(percent: int):
    """UDF (full sets of both) -> whether 100 * intersection >= percent * union."""

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for sa, sb in batches:
            out = []
            for x, y in zip(sa, sb):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    return linked


def verified(nodes: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, written.

    The sizes must allow it and the registers' estimate must not rule it out; then the sets of both are compared.
    """
    of = lambda x, *more: nodes.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more])
    near = pairs.join(of("a", "regs", "n_shingles"), "a").join(of("b", "regs", "n_shingles"), "b")
    near = near.where(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
    near = written(near.where(_close(percent)("regs_a", "regs_b", "n_shingles_a", "n_shingles_b")).select("a", "b"), "candidates")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return written(both.where(_linked(percent)("sa", "sb")).select("a", "b"), "links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of ``links``.

    Large-star and small-star steps by turns: every step points a node's neighbours at the smallest one,
    by an aggregate and a join. Each round is written; it ends when a round changes nothing.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        # large star: of each node's neighbours, the larger ones go to the smallest of all
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: of each node's smaller neighbours, all go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _exact(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of a sorted set with each of ``others`` (none of them empty)."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    starts = np.cumsum([0, *map(len, others)])[:-1]
    return np.add.reduceat((own[at] == every).astype(np.int64), starts)


def _by_smallest(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the similarity of two sets from their smallest hashes."""
    union = np.union1d(a, b)[: min(len(a), len(b))]
    return float(np.isin(union, a[np.isin(a, b)]).mean())


def _compared(block: pa.Table, percent: int, most: int = HELD) -> tuple[list[int], list[int]]:
    """Links, and pairs that may be links, between nodes of side 1 and of side 0 in other components.

    Sets of ``most`` shingles or fewer are compared in full. A node's links into one component are as good as one.
    """
    side, node, comp, n, band = (block.column(k).to_numpy() for k in ("side", "node", "component", "n_shingles", "band"))
    regs = np.frombuffer(b"".join(block.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    held = [np.frombuffer(x, np.uint64) for x in block.column("held").to_pylist()]
    right, out = np.flatnonzero(side == 0), ([], [])
    for i in np.flatnonzero(side == 1).tolist():
        fit = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        if not len(fit):
            continue
        here = np.flatnonzero(bands(regs[i]) == band[i])
        if len(here):  # a bucket of sketches, not of beginnings: each pair in the first band it shares
            fit = fit[(regs[fit] == regs[i]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == here[0]]
        if len(fit):
            fit = fit[estimate(np.broadcast_to(regs[i], (len(fit), REGISTERS)), regs[fit], np.full(len(fit), n[i]), n[fit], 32) >= percent / 100 - MARGIN]
        small = fit[n[fit] <= most] if n[i] <= most else fit[:0]
        found = [j for j in fit.tolist() if n[i] > most or n[j] > most]
        found = [j for j in found if _by_smallest(held[i], held[j]) >= percent / 100 - HELD_MARGIN]
        if len(small):
            both = _exact(held[i], [held[j] for j in small.tolist()])
            linked = small[100 * both >= percent * (n[i] + n[small] - both)]
            found += linked[np.unique(comp[linked], return_index=True)[1]].tolist()
        out[0].extend(min(int(node[j]), int(node[i])) for j in found)
        out[1].extend(max(int(node[j]), int(node[i])) for j in found)
    return out


def _beginnings(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """band, node, component: nodes (``rows``: node, component) filed under each shingle of their beginning.

    Shingles have one order for all nodes, the rarest first. Of n shingles the first n - ceil(percent * n / 100)
    + 1 are the beginning: two sets that reach the threshold share one of these, so no link is lost, and texts
    that share only what many have are not filed together. Rare ones are not told apart by their number.
    """
    rows = rows.join(sets, "node").select("node", "component", "shingles")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)] or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h, "n": n})

    counts = written(rows.select("shingles").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") > max(RARE, total // MOST_OFTEN)).toArrow()  # at most MOST_OFTEN
    h, n = often.column("h").to_numpy(), often.column("n").to_numpy()
    order = np.argsort(h)
    shared = rows.sparkSession.sparkContext.broadcast((h[order], n[order]))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            for node, component, x in zip(*(batch.column(k) for k in range(3))):
                own = np.frombuffer(x.as_buffer(), np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, counts[at], 0)
                first = own[np.lexsort((own, rank))[: len(own) - -(-percent * len(own) // 100) + 1]]
                for a in range(0, len(first), 1 << 14):
                    part = first[a : a + (1 << 14)]
                    yield pa.RecordBatch.from_pydict({"band": part, "node": np.full(len(part), node.as_py()), "component": np.full(len(part), component.as_py())})

    return written(rows.mapInArrow(filed, "band long, node long, component long"), "beginnings")


def _mixed(rows: DataFrame) -> DataFrame:
    """band, home (the component most of the band's nodes are in), m nodes, o of them elsewhere, for bands of several components."""
    own = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    homes = own.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.sum("n").alias("m"), F.max("n").alias("most"))
    return homes.select("band", "home", "m", (F.col("m") - F.col("most")).alias("o")).where("o > 0")


def _crossed(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, most: int = HELD) -> DataFrame:
    """Pairs (a, b) of one bucket but different components that may reach the threshold.

    ``buckets``: band, node, component; they are read several times. What isn't in the component most of a
    bucket's nodes are in is compared with all other nodes of the bucket, in blocks of about BLOCK by BLOCK
    nodes. Where buckets need more than one block, their nodes are filed anew by the beginnings of their sets
    if that leaves fewer pairs to compare.
    """
    sizes = written(_mixed(buckets).where("m > 2"), "sizes")
    rows = buckets.join(sizes, "band").select("band", "node", "component", "home", "m", "o")
    cost = lambda df: df.agg(F.coalesce(F.sum(F.col("m").cast("double") * F.col("o")), F.lit(0.0))).first()[0]
    large = sizes.where(F.col("m") > BLOCK)
    if (before := cost(large)) > 0:
        again = _beginnings(rows.where(F.col("m") > BLOCK).select("node", "component").distinct(), sets, percent)
        less = written(_mixed(again), "mixed")
        if cost(less) < before:
            rows = rows.where(F.col("m") <= BLOCK).unionByName(again.join(less, "band").select("band", "node", "component", "home", "m", "o"))
    own = nodes.select(F.col("key").alias("node"), "regs", "n_shingles").join(sets.select("node", F.substring("shingles", 1, 8 * most).alias("held")), "node")
    rows = rows.join(own, "node")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    ways = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    order, more = ["band", "x", "y"], ["node", "component", "regs", "n_shingles", "held"]
    members = rows.select("band", (spread % ways("m")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), ways("o") - 1)).alias("y"), F.lit(0).alias("side"), *more)
    apart = rows.where("component != home").select("band", F.explode(F.sequence(F.lit(0).cast("long"), ways("m") - 1)).alias("x"), (spread % ways("o")).alias("y"), F.lit(1).alias("side"), *more)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = _compared(pa.Table.from_batches(held), percent, most)
                if a:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in order])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if at is not None and tuple(keys[:, s]) != at:
                    yield from done()
                    held = []
                at = tuple(keys[:, s])
                held.append(batch.slice(s, e - s))
        yield from done()

    return members.union(apart).repartition(*order).sortWithinPartitions(*order).mapInArrow(blocks, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, is_kept, and its place (_file, _row).

    Two rows are linked when 100 * intersection >= ``percent`` * union of their sets of ``shingle``-word
    shingles. component_id is the smallest id reachable over links; that row is kept (of rows that share
    the smallest id, one). A text without words, or null, has an empty set and is linked with nothing. A
    row with a null id counts as larger than all others; its component_id is null where no row has one.
    """
    docs = stable(docs)
    rows = sketched(docs, shingle, doc_id, text)
    low = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = written(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("key").alias("node"), F.min(low).alias("low")), "classes")
    nodes = written(rows.drop("doc_id", "digest").join(classes.select(F.col("node").alias("key")), "key", "left_semi"), "nodes")
    banded = nodes.select(F.col("key").alias("node"), F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = written(banded.join(heads, "band"), "buckets")
    stars = buckets.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    places = nodes.select(F.col("key").alias("node"), "_file", "_row").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = _sets(docs, places, shingle, text)
    links = verified(nodes, sets, stars, percent)
    found = components(links)
    placed = written(buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("n")).where("p != q and n > 2").select("band")
    several = written(placed.join(mixed, "band", "left_semi").select("band", "node", "component"), "several")
    crossed = written(_crossed(several, nodes, sets, percent, held), "crossed")
    if not crossed.isEmpty():
        links = links.union(verified(nodes, sets, crossed, percent))
        found = components(links)
    # from nodes to rows
    place = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = place.groupBy("component").agg(F.min("low").alias("low"))
    place = place.select("digest", "component").join(lows, "component").select("digest", "low")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    full = rows.select("key", "doc_id", "_file", "_row", "n_shingles", "digest").join(place, "digest", "left").withColumn("low", F.coalesce("low", own))
    return full.select("doc_id", "n_shingles", F.col("low.doc_id").alias("component_id"), (F.col("low.key") == F.col("key")).alias("is_kept"), "_file", "_row")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component of near-duplicates (see ``near_duplicates``)."""
    docs = stable(docs)
    kept = near_duplicates(docs, shingle, percent, doc_id, text).where("is_kept").select("_file", "_row")
    return with_locator(docs).join(kept, ["_file", "_row"], "left_semi").select("row.*")
