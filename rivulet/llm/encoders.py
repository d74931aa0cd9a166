"""Exact tokenising through caches of short chunks.

Both kinds of tokenizer used here never merge over the space that opens a word. A text is cut
where such a space stands, each chunk is looked up, and only chunks not met before are encoded
by the library. Every worker process holds one bounded cache for each vocabulary file; a full
cache takes no new chunks, which then are encoded each time.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Chunks longer than this (in characters) are never kept.
LONGEST_KEPT = 48
#: Entries a worker keeps.
MOST_KEPT = 600_000
#: Characters of texts that are looked up together.
TOGETHER = 1 << 20

#: White space other than the blank and the line end, and pairs of these two.
_ODD = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))

_PROCESS: dict[tuple, object] = {}


class ChunkCache:
    """Encodings by chunk. ``encode`` gets a list of distinct new chunks and returns theirs."""

    def __init__(self, encode: Callable[[list[str]], list], known: dict | None = None):
        self.encode, self.kept = encode, dict(known or {})
        self.most = MOST_KEPT + len(self.kept)

    def values(self, texts: list[list[str]]) -> list[list]:
        """The encodings of each list of chunks."""
        get, out, misses = self.kept.get, [], []
        for chunks in texts:
            found = list(map(get, chunks))
            out.append(found)
            if None in found:
                misses.append((found, chunks, [i for i, x in enumerate(found) if x is None]))
        new = list(dict.fromkeys(chunks[i] for _, chunks, at in misses for i in at))
        if new:
            own = dict(zip(new, self.encode(new), strict=True))
            for found, chunks, at in misses:
                for i in at:
                    found[i] = own[chunks[i]]
            if (room := self.most - len(self.kept)) > 0:
                self.kept.update([x for x in own.items() if len(x[0]) <= LONGEST_KEPT][:room])
        return out


@contextlib.contextmanager
def _no_collection() -> Iterator[None]:
    """Many small objects come and go here, none of them in cycles: the collector would look through them in vain."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _gathered(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Groups of consecutive texts of about TOGETHER characters, at least one text each."""
    group, n = [], 0
    for text in texts:
        group.append(text or "")
        n += len(group[-1])
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


class ByteBpe:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, add_special_tokens=False.

    Its pre-tokenizer lets a single space open the next pre-token and sets apart the last blank before
    a non-blank, so a cut before a space or a line end that a non-blank follows never parts a pre-token;
    special strings in a text hold no blank, and no cut is made right before one. A chunk is kept without the space before it; one that begins
    with a line end has none. A new chunk of letters, with full stops or commas after them at most, is a
    few pre-tokens and goes straight to the library's BPE model; any other is encoded as text.
    """

    _JOINED = 4096

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode("utf-8"))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        other = "".join(f"(?!{re.escape(t.content)})" for t in added.values())
        self.cut = re.compile(rf" (?=\S){other}|(?=\n{other}\S)")
        self.odd = (*_ODD, *(t.content for t in added.values()))
        self.between, self.mark = next(((i, t.content) for i, t in added.items() if t.special), (None, None))
        self.cache = ChunkCache(self._encode)
        self.first = ChunkCache(lambda new: [self._whole(c) for c in new])
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # it would hold what is kept here anyway
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.printed = {b: 256 + k for k, b in enumerate(hidden)}  # how the byte-level alphabet writes a byte
        self.line = self._whole("\n")
        self.direct = all(self._letters(x) == self._whole(" " + x) and self.line + self._letters(x, "") == self._whole("\n" + x) for x in ("aé", "Ünder", "日本"))
        self.ends: dict[str, bytes] = {"": b""}

    def _letters(self, word: str, space: str = "Ġ") -> bytes:
        """Ids of a word of letters and the space before it."""
        seen = space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.printed))
        ids = [t.id for t in self.model.tokenize(seen)]
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def chunks(self, text: str) -> list[str]:
        """The text cut into chunks. Where blanks and line ends stand alone, plain splitting makes the same cuts."""
        if text[-1:] in ("", " ", "\n") or any(x in text for x in self.odd):
            return self.cut.split(text)
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def _text(chunk: str) -> str:
        return chunk if chunk[0] == "\n" else " " + chunk

    def _encode(self, new: list[str]) -> list[bytes]:
        """Many chunks at once: the special token set between them marks where each one ends."""
        out: dict[str, bytes] = {}
        plain = []
        for c in new:
            core = c.rstrip(".,")
            word = core[1:] if c[0] == "\n" else core
            if self.direct and len(c) <= LONGEST_KEPT and word.isalpha():
                if (end := self.ends.get(c[len(core) :])) is None:
                    end = self.ends[c[len(core) :]] = self._whole(c[len(core) :])
                if word is not core:
                    out[c] = self.line + self._letters(word, "") + end
                else:
                    out[c] = (self.cache.kept.get(word) or self._letters(word)) + end
            elif self.mark is None or self.mark in c or len(c) > LONGEST_KEPT:
                out[c] = self._whole(self._text(c))
            else:
                plain.append(c)
        groups = [plain[i : i + self._JOINED] for i in range(0, len(plain), self._JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(map(self._text, g)) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            ends = np.append(np.flatnonzero(ids == self.between), len(ids))
            raw, w, begin = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
            for c, end in zip(group, ends.tolist(), strict=True):
                out[c] = raw[begin * w : end * w]
                begin = end + 1
        return [out[c] for c in new]

    def batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each whole text, in order; none for a null or empty one."""
        for group in _gathered(texts):
            with _no_collection():
                cut = [self.chunks(t) for t in group]
                heads = self.first.values([[c[0]] if c[0] else [] for c in cut])
                tails = self.cache.values([c[1:] for c in cut])
            for head, tail in zip(heads, tails):
                yield np.frombuffer(b"".join(head + tail), self.dtype)

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.batch([text]))


class PieceCounts:
    """Number of pieces of a sentencepiece model for whole texts.

    ``exact`` tells whether the model keeps all spaces and has no piece in which a space mark follows
    another character; else texts are encoded whole. ``frequent``: lengths of frequent chunks.
    """

    _CUT = re.compile("(?<=[^ ▁]) ")
    _PROBE = "a  b c　ﬁ\t\n d "

    def __init__(self, blob: bytes, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.cache = ChunkCache(self.lengths, frequent)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.exact = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.decode(self.model.encode(self._PROBE)) == self._PROBE

    def lengths(self, new: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(new, num_threads=1)]

    def chunks(self, text: str) -> list[str]:
        """Cuts before each space that follows another character; a space at the end is left as an empty chunk."""
        return self._CUT.split(text)

    def batch(self, texts: Iterable[str | None]) -> Iterator[int]:
        """Number of pieces of each whole text, in order."""
        for group in _gathered(texts):
            if not self.exact:
                yield from self.lengths(group)
                continue
            cut = [self.chunks(t) for t in group]
            for chunks, found in zip(cut, self.cache.values(cut)):
                # the empty chunk after a last space stands for that space, one piece
                yield sum(found) + (len(chunks) > 1 and chunks[-1] == "")

    def count(self, text: str | None) -> int:
        return next(self.batch([text]))


def per_process(kind: type, key: str, *blobs):
    """One encoder for each key in this worker process. ``blobs``: broadcasts, read at first use."""
    k = (kind.__name__, key)
    if k not in _PROCESS:
        _PROCESS[k] = kind(*(b.value for b in blobs))
    return _PROCESS[k]


def forget() -> None:
    """Frees the encoders that an earlier operator has left in this worker process."""
    _PROCESS.clear()


def vocabulary(spark, path: str, most: int = 64 << 20):
    """(digest, broadcast) of a vocabulary file on the driver; its size is checked, and does not depend on the corpus."""
    with open(path, "rb") as f:
        blob = f.read()
    if len(blob) > most:
        raise ValueError(f"{path}: a vocabulary file of over {most} bytes is not broadcast")
    return hashlib.sha256(blob).hexdigest(), spark.sparkContext.broadcast(blob)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
