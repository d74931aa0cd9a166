"""Parts of the operators that need no Spark."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import encoders, lang_id, lm, near_dedup, packing
from rivulet.llm.common import words_of
from rivulet.llm.elias_fano import SAMPLED, EliasFano
from rivulet.llm.shingles import shingle_set, word_hashes
from rivulet.llm.token_files import TokenBlock, pack_block

path = encoders.default_path


@given(st.lists(st.integers(0, 1 << 40), max_size=400))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values.sort()
    own, end = EliasFano.from_bytes(b"xy" + (raw := EliasFano.encode(values).to_bytes()), 2)
    assert [v for k in range(-(-len(values) // SAMPLED)) for v in own.stretch(k).tolist()] == values and end == len(raw) + 2
    assert [own.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        own.select(len(values))
    with pytest.raises(IndexError):
        own.stretch(-(-len(values) // SAMPLED))


def test_elias_fano_is_small_and_checks_order():
    values = np.arange(100_000) * 700
    assert len(EliasFano.encode(values).to_bytes()) < 100_000 * 12 // 8
    with pytest.raises(ValueError):
        EliasFano.encode([2, 1])


def test_elias_fano_opens_without_unpacking():
    """Boundaries of a million documents: opening reads no bit, select and stretch a few bytes, and the stored samples cost a quarter of a bit each."""
    ends = np.cumsum(np.random.default_rng(1).integers(1, 900, 1_000_000))
    raw = EliasFano.encode(ends).to_bytes()
    assert 8 * len(raw) / len(ends) < 2 + np.log2(450) + 0.6
    own, _ = EliasFano.from_bytes(raw)
    parts = (own.samples, own.lower, own.upper)
    assert all(not x.flags.owndata for x in parts) and sum(x.nbytes for x in parts) <= len(raw)
    at = [0, 1, 127, 128, 129, 999_999, 500_000]
    assert [own.select(i) for i in at] == ends[at].tolist() and (own.stretch(77) == ends[77 * SAMPLED : 78 * SAMPLED]).all()


def test_token_block():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 2], [2], list(range(300)))]
    block = TokenBlock(pack_block(docs))
    assert len(block) == 3 and [block.doc(i).tolist() for i in range(3)] == [d.tolist() for d in docs] and [(a, x.tolist()) for a, x in block.docs()] == [(0, [5, 6, 2]), (3, [2]), (4, list(range(300)))]
    with pytest.raises(ValueError):
        TokenBlock(b"something else")


def texts():
    rng = random.Random(3)
    parts = [*"ab ,.\n\t   　é'1Z▁", "<|endoftext|>", "'s", "</s>", "\x1f", "日本", "Wort.\nNeu", " the"]
    return ["", None, "a" * 500, " " * 300, "x " * 3000, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]]


def test_byte_bpe_is_the_librarys():
    with open(path("byte_bpe_50k.json"), "rb") as f:
        coder = encoders.ByteBpe(f.read())
    own = texts()
    for t, got in zip(own, coder.batch(own)):
        assert got.tolist() == (coder.tokenizer.encode(t, add_special_tokens=False).ids if t else []), repr(t)


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(encoders, "MOST_KEPT", 5)
    test_byte_bpe_is_the_librarys()
    test_piece_counts_are_the_librarys()


def test_piece_counts_are_the_librarys():
    with open(path("piece_bpe_32k.model"), "rb") as f:
        coder = encoders.PieceCounts(f.read(), {"the": 1})
    assert coder.exact
    own = texts()
    for t, got in zip(own, coder.batch(own)):
        assert got == (len(coder.model.encode(t)) if t else 0), repr(t)


def test_words_and_shingles():
    text = "One  two\tTHREE\nfour\x0bfive É"
    assert words_of(text) == [b"one", b"two", b"three", b"four", b"five", "É".encode()] and len(word_hashes(text)) == 6
    assert (word_hashes("a bb a")[[0, 2]] == word_hashes("zz a")[1]).all() and word_hashes("b")[0] != word_hashes("bb")[0]
    assert len(shingle_set(text, 4)) == 3 and len(shingle_set("a b", 4)) == 1 and len(shingle_set(" ", 4)) == 0
    long = " ".join(f"w{i}" for i in range(300_000))
    assert len(set(word_hashes(long).tolist())) == 300_000
    assert (shingle_set("a b", 4) == shingle_set("A  B", 4)).all() and shingle_set("a b", 4)[0] not in shingle_set("a b c d", 4)


@pytest.mark.parametrize("same", [0.0, 0.5, 0.8, 0.95])
def test_registers_estimate_similarity(same):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    shared = round(2000 * 2 * same / (1 + same))
    b = np.concatenate((a[:shared], rng.integers(0, 2**63, 2000 - shared).astype(np.uint64)))
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    j = near_dedup.estimate(ra[None], rb[None], np.array([2000]), np.array([2000]))[0]
    assert abs(j - same) < 0.12
    # sketches are merged by the larger register
    assert (np.maximum(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    assert len(set(near_dedup.bands(ra).tolist())) == near_dedup.BANDS


def test_bands_find_pairs_at_the_threshold():
    rng, found = np.random.default_rng(2), 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate((a[:160], rng.integers(0, 2**63, 20).astype(np.uint64)))  # 160 / 200
        found += bool(set(near_dedup.bands(near_dedup.registers(a)).tolist()) & set(near_dedup.bands(near_dedup.registers(b)).tolist()))
    assert found == 200


@given(st.lists(st.integers(1, 60), min_size=1, max_size=120))
@settings(max_examples=80, deadline=None)
def test_best_fit_and_bound(lengths):
    bins, offsets, rooms = packing.best_fit_decreasing(lengths, 60)
    at: dict = {}
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        at.setdefault(b, []).append((o, n))
    for b, own in at.items():
        own.sort()
        assert own[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:])) and sum(n for _, n in own) == 60 - rooms[b]
    assert packing.lower_bound(lengths, 60) <= len(rooms) <= max(1, 11 * packing.lower_bound(lengths, 60) // 9 + 1)


def test_bounds_and_cuts():
    assert packing.lower_bound([31] * 10, 60) == 10 and packing.lower_bound([21] * 10, 60) == 5 and packing.lower_bound([], 60) == 0
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(20, 10) == [(0, 10), (10, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]
    with pytest.raises(ValueError):
        packing.best_fit_decreasing([61], 60)


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    size = 40
    pairs = rng.poisson(1, (size, size))
    pairs[np.arange(size), (np.arange(size) + 1) % size] += 300  # each class is followed by the next one
    table = lm.train(pairs, steps=150, dimensions=16)
    assert np.allclose(np.exp(table.astype(np.float64)).sum(1), 1, atol=1e-4)
    unigram = np.log(pairs.sum(0) / pairs.sum())
    assert -(pairs * table).sum() < 0.6 * -(pairs * unigram).sum()


def test_language_id_learns():
    rng = random.Random(0)
    words = {"en": ["the", "house", "and", "with"], "de": ["das", "haus", "und", "mit"], "fr": ["la", "maison", "et", "avec"]}
    rows = [(lang, " ".join(rng.choices(words[lang], k=12))) for lang in words for _ in range(60)]
    counts = []
    for _, t in rows:
        c = lang_id.ngram_counts(t)
        at = np.flatnonzero(c)
        counts.append((at, c[at]))
    model = lang_id.train(counts, [lang for lang, _ in rows])
    for lang in words:
        assert model.predict(" ".join(words[lang]))[0] == lang and 0 <= model.predict(words[lang][1])[1] <= 1
    assert (model.weights == 0).mean() > 0.5
    for t in (None, "", "12 .\n"):
        assert model.predict(t) == ("und", 0.0)
    whole = "maison avec la " * 100_000
    assert lang_id.ngram_counts(whole)[lang_id.ngram_counts("a") > 0].max() >= 100_000


def test_language_id_stretches(monkeypatch):
    text = "Das Haus -- und  die Maus; " * 40
    want = lang_id.ngram_counts(text)
    monkeypatch.setattr(lang_id, "_STRETCH", 97)
    assert (lang_id.ngram_counts(text) == want).all()


def test_no_data_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, names in os.walk(os.path.join(root, "rivulet")) for f in names if f.endswith((".parquet", ".model", ".json"))]
