"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The classifier is trained by follow-the-regularised-leader with elastic-net penalties and calibrated by
a temperature, on a bounded sample of labelled rows. Prediction covers every whole text.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import encoders

#: Distinct texts of each language that the classifier is fitted on, about.
ROWS_PER_LANG = 600
#: n-grams are hashed to 2 ** HASH_BITS features.
HASH_BITS = 14
#: Characters that are turned into n-grams together.
_STRETCH = 1 << 20
UNDETERMINED = "und"
#: Trigrams are hashed to 2 ** KNOWN_BITS places; known are those in this share of a language's sampled texts; texts with a larger share of others are not kept.
KNOWN_BITS, KNOWN_SHARE, MOST_UNKNOWN = 20, 0.01, 0.5
#: No text makes its trigrams usual alone in a language of so many sampled texts, of which all but the longest have so many trigrams.
FEW_TEXTS, FEW_TRIGRAMS = 10, 4000


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


def _stretches(text: str) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """Of each stretch, whether it has a letter, and the hashes of its 1-, 2- and 3-grams."""
    last = np.array([32], np.uint32)
    for a in range(0, len(text), _STRETCH):
        x = np.frombuffer(text[a : a + _STRETCH].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[np.minimum(x, 0x10FFFF)]
        x = np.concatenate((last, np.where(letter, x, 32).astype(np.uint32), [] if a + _STRETCH < len(text) else [32])).astype(np.uint32)
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
        one, two = x * np.uint32(0x9E3779B1), x[:-1] * np.uint32(0x85EBCA6B) + x[1:] * np.uint32(0xC2B2AE35)
        three = two[:-1] * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)
        k = len(last)  # what the stretch before has counted
        yield bool(letter.any()), (one[k:], two[k - 1 :], three[max(k - 2, 0) :])
        last = x[-2:]


def ngram_counts(text: str | None, bits: int = HASH_BITS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the lower-cased text, runs of other characters being one blank; None without a letter."""
    if not text:
        return None
    total, any_letter = np.zeros(1 << bits, np.int64), False
    for letters, hashes in _stretches(text):
        any_letter |= letters
        for h in hashes:
            total += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return total if any_letter else None


def trigrams(text: str) -> np.ndarray:
    """The hashed 3-grams of the text, one after the other."""
    return np.concatenate([hashes[2] for _, hashes in _stretches(text)] or [np.empty(0, np.uint32)]) >> np.uint32(32 - KNOWN_BITS)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    known: np.ndarray | None = None

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(counts)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return UNDETERMINED, 0.0
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())

    def unknown(self, text: str) -> float:
        """The share of the text's trigrams that are in no language's usual ones."""
        own = trigrams(text)
        return 1 - float(self.known[own].mean()) if len(own) else 0.0

    def keeps(self, text: str | None, least: float, most_unknown: float) -> bool:
        lang, score = self.predict(text)
        return lang != UNDETERMINED and score >= least and self.unknown(text) <= most_unknown


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 0) -> Model:
    """FTRL-proximal with L1 and L2 on nine tenths of the rows (indices and counts); the rest fits the temperature."""
    langs, size = sorted(set(labels)), 1 << HASH_BITS
    place = {x: i for i, x in enumerate(langs)}
    y = np.array([place[x] for x in labels], np.int64)
    df = np.zeros(size)
    for at, _ in counts:
        df[at] += 1
    model = Model(langs, np.log((1 + len(counts)) / (1 + df)) + 1, np.zeros((size, len(langs))), np.zeros(len(langs)))
    if len(langs) < 2:
        return model
    rows = []
    for at, n in counts:
        x = np.log1p(n) * model.idf[at]
        rows.append((at, (x / np.sqrt((x * x).sum())).astype(np.float32)))
    order = np.random.default_rng(seed).permutation(len(rows))
    held = set(order[: max(1, len(rows) // 10)].tolist()) if len(rows) >= 20 else set()
    z, n = np.zeros((size + 1, len(langs))), np.zeros((size + 1, len(langs)))  # the last row is the bias

    def solved(at: np.ndarray) -> np.ndarray:
        own, root = z[at], np.sqrt(n[at])
        return np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((beta + root) / alpha + l2))

    for _ in range(epochs):
        for i in order.tolist():
            if i in held:
                continue
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = solved(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = np.outer(x, p)
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    w = solved(np.arange(size + 1))
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    if held:
        s = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in sorted(held)])
        right = y[sorted(held)]

        def loss(t: float) -> float:
            v = s / t
            return float((np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)) + v.max(1) - v[np.arange(len(v)), right]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def sampled(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, usual: bool = False) -> DataFrame:
    """lang, and places and counts of the n-grams, of a sample of ``labelled``: about ``rows_per_lang`` distinct texts of each language, taken by a hash of the text.

    A text counts once for a language, however many rows repeat it. Every language is there; one with fewer
    texts gives all of them. Rows with null language, or whose text has no letter, are left out. With
    ``usual`` the places of the trigrams come too.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"))
    sizes = known.groupBy("lang").agg((F.lit(float(rows_per_lang)) / F.approx_count_distinct("h", 0.02)).alias("share"))
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(sizes), "lang").where(place < F.col("share")).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                out: list[list] = [[], [], [], []]
                for x, own in zip(batch.column(0).slice(a, 64).to_pylist(), batch.column(1).slice(a, 64).to_pylist()):
                    if (c := ngram_counts(x)) is not None:
                        at = np.flatnonzero(c)
                        for column, v in zip(out, (own, at.astype("<u4").tobytes(), c[at].astype("<u4").tobytes(), np.unique(trigrams(x)).astype("<u4").tobytes() if usual else b"")):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["lang", "at", "n", "three"])

    return sample.mapInArrow(grams, "lang string, at binary, n binary, three binary")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, usual: bool = False) -> Model:
    """Fits on a sample of ``labelled`` (see ``sampled``). Executors count the n-grams, and one task fits the
    model to the sample, of at most 2 ** HASH_BITS numbers for each text; the driver gets the model only. With
    ``usual`` it knows each language's usual trigrams too.
    """

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        rows: list[tuple[str, bytes, bytes, bytes]] = []
        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in range(4)))
        if rows:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(_learned(sorted(rows), usual))], pa.binary())})

    rows = sampled(labelled, text, lang, rows_per_lang, usual).repartition(1).mapInArrow(learned, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0))


def _usual(threes: list[np.ndarray]) -> np.ndarray:
    """Whether a trigram's place is a usual one of the language whose texts have these (each at most once)."""
    sizes = [len(x) for x in threes]
    others = len(threes) >= FEW_TEXTS and sum(sizes) - max(sizes) >= FEW_TRIGRAMS
    return np.bincount(np.concatenate(threes), minlength=1 << KNOWN_BITS) >= max(2 if others else 1, KNOWN_SHARE * len(threes))


def _learned(rows: list[tuple[str, bytes, bytes, bytes]], usual: bool) -> Model:
    """The model of rows (lang, n-grams' places, their counts, trigrams' places)."""
    model = train([(np.frombuffer(at, "<u4").astype(np.int32), np.frombuffer(n, "<u4")) for _, at, n, _ in rows], [x for x, *_ in rows])
    if usual:
        model.known = np.zeros(1 << KNOWN_BITS, bool)
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            model.known |= _usual([np.frombuffer(r[3], "<u4") for r in own])
    return model


def predicted(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """Column struct(lang_pred, score) for each whole text; (und, 0) for null texts and those without a letter.

    The model holds 2 ** HASH_BITS numbers for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders.forget()
        for batch in batches:
            got = [shared.value.predict(x) for x in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["lang_pred", "score"])

    return predict(F.col(text))


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` plus lang_pred and score by a classifier fitted on ``labelled``. Other columns play no part; columns of those names are replaced."""
    model = fit(labelled, text, lang)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*names, predicted(model, docs, text).alias("_found")).select(*names, "_found.lang_pred", "_found.score")


def keep_identified(docs: DataFrame, labelled: DataFrame, least: float = 0.5, text: str = "text", lang: str = "lang", most_unknown: float = MOST_UNKNOWN) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more, and whose text is of a learned language.

    It is where at most ``most_unknown`` of its trigrams are in less than KNOWN_SHARE of the sampled texts of
    each language, or in one text alone. Unlike the score, that share does not depend on the number of
    languages. In a language of fewer than FEW_TEXTS texts, or of little text, each is taken as usual.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled, text, lang, usual=True))

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders.forget()
        for batch in batches:
            yield pa.array([shared.value.keeps(x, least, most_unknown) for x in batch.to_pylist()], pa.bool_())

    return docs.where(kept(F.col(text)))
