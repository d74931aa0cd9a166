"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts the class of the next word from the one before: the frequent words are classes of
their own, all others are dealt into classes by a hash of their ending. Its score for class w after
class v is C[v] . R[w] + b[w]; one matrix product normalises all of them. Inside a shared class, words
follow their smoothed counts. All counts are of the whole training corpus: word counts grow with it and
stay in a table; the class pairs, of bounded number, are what the noise-contrastive training sees, so no
training text is left out. The expectation over the noise distribution is taken in full, not sampled.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import encoders
from rivulet.llm.common import word_lists, written

#: Words that are classes of their own (the end of a text is one), classes of the others, and bytes of the ending.
FREQUENT, SHARED, ENDING = 1024, 256, 3
#: Frequent words whose counts are broadcast (rarer ones are joined), and bytes of the longest of these.
BROADCAST_WORDS, LONGEST = 300_000, 64
#: Noise words for each word, dimensions and steps of the training.
NOISE, DIMENSIONS, STEPS = 20, 32, 200
#: The end of a text; no word holds a blank.
END = b" end"
#: Words that one row of the rare-word table holds at most; distinct words, and bytes of text, counted before a flush.
_TOGETHER, _FLUSH, _FLUSH_BYTES = 4096, 1 << 20, 1 << 26


def ending_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-ENDING:]) % SHARED


def train(pairs: np.ndarray, steps: int = STEPS, dimensions: int = DIMENSIONS, noise: float = NOISE, seed: int = 0) -> np.ndarray:
    """Natural log-probabilities of each class (columns) after each one (rows), from the pairs' counts.

    Adam on the noise-contrastive objective: a pair's score, less the log of its expected noise count,
    is the log-odds that it is data. The final scores are normalised.
    """
    n = pairs.sum(1, keepdims=True).astype(np.float64)
    q = pairs.sum(0) + 0.5
    q = q / q.sum()
    rng = np.random.default_rng(seed)
    k = len(q)
    c, r = (rng.normal(0, 0.1, (k, dimensions)).astype(np.float32) for _ in range(2))
    b = np.log(q).astype(np.float32)
    data, fake, shift = pairs.astype(np.float32), (noise * n * q).astype(np.float32), np.log(noise * q).astype(np.float32)
    scale = np.float32(1 / max(1.0, n.sum() / k))
    own = [c, r, b]
    m, v = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own]
    ridge = (np.float32(1e-3), np.float32(1e-3), np.float32(0))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(c @ r.T + b - shift, -60, 60)))
        g = (data * (1 - p) - fake * p) * scale
        grads = (g @ r - ridge[0] * c, g.T @ c - ridge[1] * r, g.sum(0))
        rate = 0.05 * min(1.0, 2 * (1 - t / (steps + 1)))
        for x, d, mm, vv in zip(own, grads, m, v):
            mm += 0.1 * (d - mm)
            vv += 0.01 * (d * d - vv)
            x += np.float32(rate) * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + np.float32(1e-8))
    s = (c @ r.T + b).astype(np.float64)
    top = s.max(1, keepdims=True)
    return (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))).astype(np.float32)


@dataclass
class Model:
    """``table``: log10 probabilities of classes; ``known``: counts of broadcast words; ``inside``: log10 of each shared class's smoothed total; ``whole``: that of the base model."""

    classes: dict[bytes, int]
    known: dict[bytes, int]
    table: np.ndarray
    inside: np.ndarray
    whole: float
    tokens: int

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.classes.get
        return np.array([i if (i := get(w)) is not None else ending_class(w) for w in words], np.int64)

    def parts(self, text: str | None) -> tuple[int, int, float, float, list[bytes]]:
        """Tokens, known ones among the broadcast words, base and model scores, and the words whose counts are still to be found.

        For these, log10(count + 0.5) is to be added to both scores: classes of their own are always known. A
        text is read a megabyte at a time.
        """
        tokens, unknown, base, score, rare, before = 0, 0, 0.0, 0.0, [], self.classes[END]
        for words in itertools.chain(word_lists(text), [[END]]):
            if not words:
                continue
            ids = self.ids(words)
            score += float(self.table[np.concatenate(([before], ids[:-1])), ids].sum(dtype=np.float64))
            before = ids[-1]
            shared = ids >= FREQUENT
            score -= float(self.inside[ids[shared] - FREQUENT].sum())
            counts = list(map(self.known.get, words))
            rare += [w for w, n in zip(words, counts) if n is None]
            logs = self.logs(counts)
            here = np.array([n is not None for n in counts])
            base += float(logs[here].sum()) - self.whole * len(words)
            score += float(logs[here & shared].sum())
            tokens += len(words)
            unknown += sum(n == 0 for n in counts)
        return tokens, tokens - len(rare) - unknown, base, score, rare

    @staticmethod
    def logs(counts: list[int | None]) -> np.ndarray:
        return np.log10(np.array([n or 0 for n in counts]) + 0.5)


def count_words(docs: DataFrame, text: str = "text", train_on: str = "train") -> DataFrame:
    """word, n (in texts to learn from), m (in all) over all texts; each task adds up before the shuffle. The end of a text is a word of its own."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        own, other, size = Counter(), Counter(), 0
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = own if t else other
                held[END] += 1
                for words in word_lists(x):
                    held.update(words)
                    size += min(len(x) * 4, 1 << 20)
                    if size >= _FLUSH_BYTES and len(own) + len(other) >= _FLUSH // 8 or len(own) + len(other) >= _FLUSH:
                        yield from _rows(own, other)
                        size = 0
        yield from _rows(own, other)

    def _rows(own: Counter, other: Counter) -> Iterator[pa.RecordBatch]:
        for held, learned in ((own, True), (other, False)):
            words, n = list(held.keys()), list(held.values())
            held.clear()
            for a in range(0, len(words), 1 << 15):
                m = pa.array(n[a : a + (1 << 15)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 15)], pa.binary()), m if learned else pa.array([0] * len(m), pa.int64()), m], names=["word", "n", "m"])

    return docs.select(text, train_on).mapInArrow(counts, "word binary, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def count_pairs(docs: DataFrame, classes: dict[bytes, int], text: str = "text") -> np.ndarray:
    """Counts of class pairs over all texts; a task sends its non-zero cells, and at most (FREQUENT + SHARED) ** 2 sums reach the driver."""
    size = FREQUENT + SHARED
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        get = shared.value.get
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                before = 0  # class 0 is the end, and stands before the first word too
                for words in itertools.chain(word_lists(x), [[END]]):
                    if words:
                        ids = np.array([before, *[i if (i := get(w)) is not None else ending_class(w) for w in words]], np.int64)
                        at, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
                        total[at] += n
                        before = ids[-1]
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 15):
            own = at[a : a + (1 << 15)]
            yield pa.RecordBatch.from_pydict({"cell": own, "n": total[own]})

    rows = docs.select(text).mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def _frequent(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The words of the greatest ``by``, ``most`` at the most and none longer than LONGEST.

    A histogram of the counts' logarithms gives the bound that keeps to that number; no task sorts all words.
    """
    counts = counts.where((F.octet_length("word") <= LONGEST) & (F.col(by) > 0))
    step = F.floor(F.log2(by) * 16)
    bound, total = None, 0
    for k, n in sorted(map(tuple, counts.groupBy(step.alias("k")).count().collect()), reverse=True):
        if (total := total + n) > most:
            break
        bound = k
    return counts.where(step >= bound if bound is not None else F.lit(False))


def fit(docs: DataFrame, text: str = "text", train_on: str = "train", steps: int = STEPS) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs`` where ``train_on``, and the table of word counts (word, n)."""
    counts = written(count_words(docs, text, train_on), "words")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # frequent in any text: words that the training texts lack are known to be lacking
    table = _frequent(counts, "m", BROADCAST_WORDS).select("word", "n").toArrow()
    known = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
    top = sorted(((w, n) for w, n in _frequent(counts, "n", 4 * FREQUENT).select("word", "n").collect() if w != END), key=lambda x: (-x[1], x[0]))
    own = [(END, ends), *((bytes(w), n) for w, n in top[: FREQUENT - 1])]
    known |= dict(own)  # a class of its own never needs the join
    frequent = [w for w, _ in own]
    classes = {w: i for i, w in enumerate(frequent)}
    pairs = count_pairs(docs.where(train_on), classes, text)
    # words and tokens of each shared class, without the frequent words
    bucket = (F.crc32(F.expr(f"substring(word, -{ENDING})")) % SHARED).cast("int")
    rest = counts.where("n > 0").join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in frequent], "word binary")), "word", "left_anti")
    inside = np.full(SHARED, 0.5)
    for k, n, v in rest.groupBy(bucket.alias("k")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        inside[k] = n + 0.5 * (v + 1)
    table = train(pairs, steps) / np.log(10)
    whole = float(np.log10(tokens + 0.5 * (kinds + 1)))
    return Model(classes, known, table.astype(np.float32), np.log10(inside), whole, int(tokens)), counts


def score_texts(docs: DataFrame, train_on: Column, doc_id: str = "doc_id", text: str = "text", steps: int = STEPS) -> DataFrame:
    """One row per row of ``docs``: its id, held_out (not ``train_on``), n_tokens, n_known, train_tokens, base_score, score.

    Every whole text is scored; a null or empty one is the end token alone. Rows of one id, or a null id,
    are scored each on its own. Broadcast are a fixed number of words and classes. What rarer words a text
    has is written to the shared folder, joined with the table of all counts, and summed up by row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(train_on, F.lit(False))).alias("held_out"))
    model, counts = fit(rows.select("text", (~F.col("held_out")).alias("train")), "text", "train", steps)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("key", "first", "n_tokens", "n_known", "base_score", "score", "rare")}
            ids, held, at = batch.column(0), batch.column(2), []
            for i, x in enumerate(batch.column(1).to_pylist()):
                n, known, base, score, rare = shared.value.parts(x)
                for a in range(0, max(1, len(rare)), _TOGETHER):
                    own = (key, True, n, known, base, score) if a == 0 else (key, False, 0, 0, 0.0, 0.0)
                    for column, y in zip(out.values(), (*own, rare[a : a + _TOGETHER])):
                        column.append(y)
                    at.append(i)
                key += 1
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), held.take(pa.array(at)), *[pa.array(y, t) for y, t in zip(out.values(), kinds)]], names=["doc_id", "held_out", *out])

    schema = f"doc_id {kind}, held_out boolean, key long, first boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    scored = written(rows.select("doc_id", "text", "held_out").mapInArrow(parts, schema), "scored")
    rare = scored.select("key", F.explode("rare").alias("word"))
    found = rare.join(counts.where("n > 0").select("word", "n"), "word", "left").groupBy("key").agg(F.count("n").alias("n_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"))
    total = scored.where("first").drop("rare", "first").join(found.withColumnRenamed("n_known", "_known"), "key", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return total.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
