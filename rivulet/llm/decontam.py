"""Benchmark decontamination with SimHash windows, by built-in functions only.

Texts are read as lower-cased words of letters and digits. Where a text shares a word shingle with a
benchmark item, a window of exactly the item's number of words is laid over the place at which the item
would stand. Without a shared shingle the similarity is 0, so no window of any use is left out, and the
number of windows follows the shared shingles, not all places times all sizes. Each window and each item
has a 64-bit SimHash of its weighted shingles. Fingerprints are cut into RADIUS + 1 blocks: any two within
RADIUS agree in one block at least, so an equality join by block finds them all. For these candidates the
weighted Jaccard similarity of the shingles is computed exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import stable, with_locator, written

#: Differing bits allowed between fingerprints. At a similarity of 0.8 the mean is 9 and at most two of a thousand pairs differ in more.
RADIUS = 19
#: Weights are counted in parts of so many for the fingerprint.
PARTS = 16
#: Tables made of the items (shingles, their places, blocks) of up to so many rows are broadcast, each by its own count; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(own: Column, k: int) -> Column:
    """(place, hash) of each run of ``k`` words."""
    last = F.size(own) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(own, i + 1, k)).alias("h"))))


def _any_size(own: Column, n: Column, shingle: int, sizes: Sequence[int]) -> Column:
    """Hashes of the shingles of a window or item of ``n`` words: of ``shingle`` words, or of all n if there are fewer."""
    out = F.lit(None).cast("array<struct<at:int,h:bigint>>")
    for k in sizes:
        out = F.when(F.least(n, F.lit(shingle)) == k, _shingles(own, k)).otherwise(out)
    return F.transform(out, lambda s: s["h"])


def _fingerprints(shingles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, fp and total weight, from rows (keys, h, n, weight): n times the shingle h of that weight."""
    part = F.greatest(F.round(F.col("weight") * PARTS), F.lit(1)).cast("long") * F.col("n")
    lane = lambda b: F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(0x0000000100000001)) * part).alias(f"s{b}")
    sums = shingles.groupBy(*keys).agg(F.sum(F.col("n") * F.col("weight")).alias("total"), F.sum(part).alias("parts"), *[lane(b) for b in range(32)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        own = F.col(f"s{b % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if b < 32 else F.shiftrightunsigned(f"s{b % 32}", 32)
        fp = fp.bitwiseOR(F.shiftleft((2 * own > F.col("parts")).cast("long"), b))
    return sums.select(*keys, fp.alias("fp"), "total")


def _blocks(fp: Column, radius: int) -> Column:
    """(number, bits) of radius + 1 blocks that make up the fingerprint."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(ends, ends[1:]))])


def _leaks(rows: DataFrame, row: Sequence[str], keys: Sequence[str], items: DataFrame, shingle: int, threshold: float, radius: int) -> DataFrame:
    """``keys`` and ``row``, item_id, start, n_words, similarity of all windows that hold an item.

    ``rows``: ``row`` (columns that tell rows apart), ``keys``, text. ``items``: item (unique), item_id, own (words), size.
    """
    ids = [*row, *[k for k in keys if k not in row]]
    sizes = sorted(r[0] for r in items.select(F.least("size", F.lit(shingle))).distinct().collect()) or [shingle]
    placed = items.select("item", "size", "own", F.explode(F.coalesce(*[F.when(F.least("size", F.lit(shingle)) == k, _shingles(F.col("own"), k)) for k in sizes])).alias("s")).select("item", "size", F.col("s.at").alias("j"), F.col("s.h").alias("h"))
    weights = placed.groupBy("h").agg((1.0 / F.count_distinct("item")).alias("weight"))
    item_rows = written(placed.groupBy("item", "size", "h").agg(F.count(F.lit(1)).alias("n")).join(weights, "h"), "items")
    anchors = written(placed.select("h", "size", "j").distinct(), "anchors")
    n_items, n_rows, n_anchors = items.count(), item_rows.count(), anchors.count()
    held = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df

    # windows where a shingle of an item of that size stands
    small = n_anchors <= BROADCAST_ROWS
    base = rows.select(*ids, words(F.col("text")).alias("own"))
    found = None
    for k in sizes:
        own = anchors.where(F.least("size", F.lit(shingle)) == k)
        at = base.select(*ids, *(["own"] if small else []), F.size("own").alias("length"), F.explode(_shingles(F.col("own"), k)).alias("s"))
        at = at.select(*ids, *(["own"] if small else []), "length", F.col("s.at").alias("at"), F.col("s.h").alias("h")).join(held(own, n_anchors), "h")
        found = at if found is None else found.unionByName(at)
    start = F.greatest(F.least(F.col("at") - F.col("j"), F.col("length") - F.col("size")), F.lit(0)).alias("start")
    place = [*ids, "size", "start"]
    if small:
        windows = found.select(*ids, "size", start, "own")
    else:  # the words, which every shingle else would carry through the shuffle, come back for the hits
        windows = found.select(*ids, "size", start).distinct().join(base.select(*row, "own"), list(row))
    windows = windows.select(*place, F.slice("own", F.col("start") + 1, F.col("size")).alias("own")).where(F.size("own") > 0).distinct()
    window_rows = windows.select(*place, F.explode(_any_size(F.col("own"), F.size("own"), shingle, sizes)).alias("h")).groupBy(*place, "h").agg(F.count(F.lit(1)).alias("n"))
    weights = item_rows.select("h", "weight").distinct()
    window_rows = written(window_rows.join(held(weights, n_rows), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))), "windows")

    # candidates by blocks of the fingerprints
    item_fps = _fingerprints(item_rows, ["item", "size"]).withColumnRenamed("total", "item_total")
    window_fps = _fingerprints(window_rows, place)
    by_block = item_fps.select("item", "size", "item_total", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), radius)).alias("block"))
    pairs = window_fps.select(*place, "fp", "total", F.explode(_blocks(F.col("fp"), radius)).alias("block")).join(held(by_block, n_items * (radius + 1)), ["size", "block"])
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*place, "item", "total", "item_total").distinct()

    # exact similarity
    each = pairs.join(window_rows.select(*row, "size", "start", "h", F.col("n").alias("n_window"), "weight"), [*row, "size", "start"])
    both = each.join(held(item_rows.select("item", "size", "h", F.col("n").alias("n_item")), n_rows), ["item", "size", "h"])
    inter = both.groupBy(*place, "item", "total", "item_total").agg(F.sum(F.least("n_window", "n_item") * F.col("weight")).alias("inter"))
    scored = inter.withColumn("similarity", F.col("inter") / (F.col("total") + F.col("item_total") - F.col("inter"))).where(F.col("similarity") >= threshold - 1e-9)
    named = scored.join(held(items.select("item", "item_id"), n_items), "item")
    return named.select(*ids, "item_id", "start", F.col("size").alias("n_words"), F.least(F.col("similarity"), F.lit(1.0)).alias("similarity"))


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    own = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("own")).where(F.size("own") > 0).distinct()
    return written(own.select(F.xxhash64(F.struct("item_id", "own"), F.col("item_id").isNull()).alias("item"), "item_id", "own", F.size("own").alias("size")), "benchmark")


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``keys``, item_id, start, n_words, similarity: for each row of ``docs`` and each item that it holds, the most similar window.

    similarity is the weighted Jaccard similarity of the shingles of window and item, a shingle weighing
    its number divided by the number of items that have it; only ``threshold`` and more is reported. start
    counts words. Items of fewer than ``shingle`` words are one shingle. Null or wordless texts and items
    hold and match nothing. Rows are told apart by their place in their file and items by id and words, so
    ids may be null or repeat: what rows equal in ``keys``, or items of one id, hold is reported as one row,
    the most similar window of all.
    """
    keys = list(keys)
    # (the row's columns get names of their own: keys may have any)
    rows = with_locator(docs, *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text")).withColumn("_file", F.xxhash64("_file"))
    own = [f"k{i}" for i in range(len(keys))]
    leaks = _leaks(rows, ("_file", "_row"), own, _items(benchmark, item_id, item_text), shingle, threshold, radius)
    best = leaks.groupBy(*own, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select(*[F.col(a).alias(k) for a, k in zip(own, keys)], "item_id", (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    docs = stable(docs)
    rows = with_locator(docs, F.col(text).alias("text"))
    leaks = _leaks(rows, ("_file", "_row"), (), _items(benchmark, item_id, item_text), shingle, threshold, radius).select("_file", "_row").distinct()
    return with_locator(docs).join(leaks, ["_file", "_row"], "left_anti").select("row.*")
