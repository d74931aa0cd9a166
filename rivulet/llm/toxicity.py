"""Toxicity by two class-conditional Kneser-Ney bigram models.

The models back off from bigrams to words, from these to their beginnings, and from these to a
distribution that both classes share; below the bigrams a class counts in how many contexts something
stands. At each order the classes are discounted alike. What is rare so has the probability of its
beginning, and what begins rarely the same one under both models, which says nothing and needs no entry:
the model holds all that the discounts leave. A text's length-normalised log-likelihoods are compared, over
the whole text and over the words that speak most for the toxic class (a few words among many ordinary
ones are lost in the mean of all), and a logistic calibration on rows that gave no counts turns that into
the probability of the label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import encoders
from rivulet.llm.common import word_lists, written

#: Labelled rows of each class that the models are fitted on, about.
ROWS_PER_CLASS = 4000
#: Taken off the contexts of a word and the counts of a bigram in the smaller class (the larger one loses as much in proportion). Repeated texts give bigrams high counts, but words few contexts.
DISCOUNT, PAIR_DISCOUNT = 2.0, 4.0
#: Characters of a word's beginning.
BEGINNING = 4
#: Parts of the sampled rows, of which one is kept for the calibration.
PARTS = 5
_START = b" start of a text"


def beginning(word: bytes) -> bytes:
    return b" " + word.decode("utf-8", "replace")[:BEGINNING].encode()


@dataclass
class Model:
    """Log-likelihood ratios (toxic over ordinary): ``single`` of a word or of a beginning (its key follows a blank) by its number (0: any other), ``direct`` of the sorted bigram ``keys``."""

    words: dict[bytes, int]
    single: np.ndarray
    keys: np.ndarray
    direct: np.ndarray
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def ids(self, text: str | None) -> np.ndarray:
        get = self.words.get
        return np.fromiter((i if (i := get(w)) is not None else get(beginning(w), 0) for words in word_lists(text) for w in words), np.int64)

    def ratios(self, ids: np.ndarray) -> np.ndarray:
        """The ratio of each word, given the one before."""
        out = self.single[ids]
        if len(self.keys):
            keys = np.concatenate(([self.words[_START]], ids[:-1])) * len(self.single) + ids
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.direct[at], out)
        return out

    def features(self, ids: np.ndarray) -> np.ndarray:
        """Mean ratio of the text, log of its length, and mean ratios of the words that speak most for the toxic class."""
        r = self.ratios(ids)
        top = np.sort(np.partition(r, -8)[-8:] if len(r) > 8 else r)[::-1]
        return np.array([r.mean(), np.log1p(len(r)), top[0], top[:3].mean(), top.mean()])

    def score(self, text: str | None) -> float:
        ids = self.ids(text)
        if not len(ids):
            return self.prior
        x = np.append((self.features(ids) - self.mean) / self.scale, 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))

    def calibrate(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression on rows of features, weighted to ``prior`` (the share of toxic labels)."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        share = min(max(toxic.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(toxic == 1, self.prior / share, (1 - self.prior) / (1 - share))
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton, with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 0.3 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def _pairs(rows: DataFrame) -> DataFrame:
    """v, w, n0, n1: how often word w follows v in ordinary and in toxic texts of ``rows`` (_text, _toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = _START
                for words in word_lists(text):
                    held = Counter(zip([before, *words[:-1]], words))
                    before = words[-1] if words else before
                    n, none = pa.array(list(held.values()), pa.int64()), pa.array([0] * len(held), pa.int64())
                    columns = [pa.array([k[i] for k in held], pa.binary()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*columns, *((none, n) if toxic else (n, none))], names=["v", "w", "n0", "n1"])

    out = rows.select("_text", "_toxic").mapInArrow(count, "v binary, w binary, n0 long, n1 long")
    return out.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def kneser_ney(rows: DataFrame, prior: float) -> Model:
    """Both models from ``rows`` (_text, _toxic). Counts are made on executors; the driver gets those above the discounts."""
    pairs = written(_pairs(rows), "pairs")

    def totals(df: DataFrame, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums of n0 and n1, and what is taken off each."""
        n = np.maximum(np.array(df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n0", "n1")]).first(), np.float64), 1)
        return n, discount * n / n.min()

    def left(c: int, off: np.ndarray) -> Column:
        return F.greatest(F.col(f"n{c}") - F.lit(float(off[c])), F.lit(0.0)).alias(f"l{c}")

    def parts(table: DataFrame) -> tuple[list[Column], np.ndarray, Callable]:
        """Columns with what is left of each class, its share of all, and the classes' own parts in equal shares."""
        n, off = totals(table, DISCOUNT)
        kept = [left(0, off), left(1, off)]
        mass = np.array(table.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in kept]).first()) / n
        return kept, mass.min(), lambda t, c: t.column(f"l{c}").to_numpy() / n[c] * (mass.min() / mass[c] if mass[c] else 0)

    count = [F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"), F.count(F.lit(1)).alias("n")]
    x = F.substring(F.col("w").cast("string"), 1, BEGINNING).cast("binary")
    words = written(pairs.groupBy("w").agg(*count).withColumn("x", x), "words")
    begun = written(words.groupBy("x").agg(*[F.sum(k).alias(k) for k in ("n0", "n1", "n")]), "beginnings")
    contexts, kinds = begun.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # beginnings, backed by what both classes share
    kept, mass, own = parts(begun)
    first = begun.select("x", "n", *kept).toArrow().sort_by("x")
    nx = first.column("n").to_numpy()
    start = [own(first, c) + (1 - mass) * (nx + 0.5) / (contexts + 0.5 * (kinds + 1)) for c in (0, 1)]
    place = {k: i for i, k in enumerate(first.column("x").to_pylist())}
    # words, backed by their beginnings
    kept, mass, own = parts(words)
    _, pair_off = totals(pairs, PAIR_DISCOUNT)
    some = pairs.select("*", left(0, pair_off), left(1, pair_off)).where("l0 > 0 or l1 > 0")
    need = some.select(F.col("v").alias("w")).union(some.select("w")).distinct().withColumn("need", F.lit(True))
    single = words.select("w", "x", "n", *kept).join(need, "w", "left").where("l0 > 0 or l1 > 0 or need").toArrow().sort_by("w")
    of = np.array([place[k] for k in single.column("x").to_pylist()], np.int64)
    known = [own(single, c) + (1 - mass) * start[c][of] * single.column("n").to_numpy() / nx[of] for c in (0, 1)]
    names = {w: k for k, w in enumerate([b" other", _START, *(b" " + k for k in place), *single.column("w").to_pylist()])}
    each = [np.concatenate((np.ones(2), start[c], known[c])) for c in (0, 1)]
    # bigrams: of each class what is left, in equal shares; else half of the count in either class, half of the words
    after = some.groupBy("v").agg(F.sum("l0").alias("s0"), F.sum("l1").alias("s1"), F.sum(F.col("n0") + F.col("n1")).alias("s"))
    after = after.join(pairs.groupBy("v").agg(F.sum("n0").alias("v0"), F.sum("n1").alias("v1")), "v")
    found = some.join(after, "v").select("v", "w", *[F.col(x).cast("double") for x in ("n0", "n1", "l0", "l1", "s0", "s1", "s", "v0", "v1")]).toArrow()
    of = {x: found.column(x).to_numpy() for x in found.column_names[2:]}
    own = np.minimum(of["s0"] / np.maximum(of["v0"], 1), of["s1"] / np.maximum(of["v1"], 1))
    at = np.array([names[w] for w in found.column("w").to_pylist()], np.int64)
    both = of["v0"] + of["v1"]
    p = [own * of[f"l{c}"] / np.maximum(of[f"s{c}"], 1e-9) + (1 - own) * (0.5 * (of["n0"] + of["n1"]) / both + (1 - 0.5 * of["s"] / both) * each[c][at]) for c in (0, 1)]
    keys = np.array([names[v] for v in found.column("v").to_pylist()], np.int64) * len(names) + at
    order = np.argsort(keys)
    return Model(names, np.log(each[1] / each[0]), keys[order], np.log(p[1] / p[0])[order], prior, np.zeros(5), np.ones(5), np.zeros(6))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Model | None:
    """Fits on a sample of the labelled rows, about ``rows_per_class`` of each class, by a hash of the id.

    A label counts once however often it repeats, an id with both marks once in each class; of rows that
    repeat an id the smallest text is read. Labels that are null or whose id is null or not in ``docs`` are
    not learned from. Texts are read whole, whatever their length. None where a class has no row.
    """
    marks = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_toxic")).distinct()
    sizes = dict(map(tuple, marks.groupBy("_toxic").count().collect()))
    if len(sizes) < 2:
        return None
    place = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_toxic") == 1, rows_per_class / sizes[1]).otherwise(rows_per_class / sizes[0])
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = found.join(F.broadcast(marks.where(place < share)), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    rows = written(rows.withColumn("_held", F.pmod(F.xxhash64("_id", F.lit("held")), F.lit(PARTS)) == 0), "labelled")
    classes = {(r[0], r[1]): r[2] for r in rows.groupBy("_held", "_toxic").count().collect()}
    if not all(any((h, c) in classes for h in (False, True)) for c in (0, 1)):
        return None
    # too few rows to keep some for the calibration: all are used for both
    apart = min(classes.get((h, c), 0) for h in (False, True) for c in (0, 1)) >= 5
    model = kneser_ney(rows.where("not _held") if apart else rows, sizes[1] / (sizes[0] + sizes[1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [shared.value.ids(x) for x in batch.column(0).to_pylist()]
            some = [i for i, x in enumerate(ids) if len(x)]
            if some:
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some)), pa.array([shared.value.features(ids[i]).tolist() for i in some])], names=["toxic", "x"])

    use = (rows.where("_held") if apart else rows).select("_text", "_toxic").mapInArrow(features, "toxic int, x array<double>").toArrow()
    if use.num_rows:
        x, y = np.array(use.column("x").to_pylist()), use.column("toxic").to_numpy()
        order = np.lexsort((*x.T, y))  # sums then do not depend on the order of partitions
        model.calibrate(x[order], y[order])
    return model


def toxicity(model: Model | None, docs: DataFrame, text: str = "text") -> Column:
    """Column with the probability (0 to 1) that a whole text is toxic; null texts and those without words get the share of toxic labels, and all get 0 without a model."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders.forget()
        for batch in batches:
            yield pa.array([shared.value.score(x) for x in batch.to_pylist()], pa.float64())

    return score(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus score and predicted (1 if score >= ``threshold``). Models learn from ``learn_from`` (else ``docs``) and its ``labels``; the model's size is bounded by the sample."""
    model = fit(docs if learn_from is None else learn_from, labels, doc_id, text)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*names, toxicity(model, docs, text).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
