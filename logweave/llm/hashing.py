"""Word hashes of many texts at once, in NumPy.

A word is a run of bytes other than space and 09-0D, as everywhere in this package.
Its 64-bit hash is a sum of its bytes' numbers times powers of an odd base, so the hashes of all words of a
buffer come from one running sum, without a Python object per word.  A word's shape keeps
letter case, digits and signs, with runs collapsed: ``Water!!`` and ``Und!`` have the shape ``Aa!``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MULTIPLY", "mix", "words_of", "groups"]

_GROUP = 1 << 19  # bytes of text hashed at once
_PIECE = 1 << 18
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_WHITE_RUN = re.compile(rb"[\x20\x09-\x0d]")
# Each byte has a 64-bit number; a word's hash is the sum of its bytes' numbers times powers of an odd base.
_NUMBERS = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([i]), seed=27) for i in range(256)), "<u8").copy()
_BASE = 0xD1342543DE82EF95
# Shape classes of bytes (upper case, lower case and non-ASCII, digits; others stand for themselves).
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_SHAPE[0x80:] = ord("a")
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, store={}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - kept per process
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(store.get("up", ())) < n:
        size = max(n, 2 * _PIECE)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                store[name] = np.multiply.accumulate(steps)
    return store["up"][:n], store["down"][:n]


def _collapsed(piece: np.ndarray) -> np.ndarray:
    """The bytes' classes with runs collapsed; white space still parts the same words."""
    kinds = _SHAPE[piece]
    return kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]


def _hash_words(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a byte array."""
    white = _WHITE[piece]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    if not white[-1]:
        edge = np.append(edge, len(piece))
    first, last = edge[0::2], edge[1::2]
    up, down = _powers(len(piece))
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_NUMBERS[piece] * up, out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), first


def _word_hashes(text: bytes, shapes: bool = False):
    """(hash, start, shape hash) of every word of ``text``, which ends in white space; in pieces cut at white space."""
    hashes, starts, forms, at = [], [], [], 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            cut = _WHITE_RUN.search(text, end)
            end = cut.end() if cut else len(text)
        piece = np.frombuffer(text, np.uint8)[at:end]
        w, first = _hash_words(piece)
        hashes.append(w)
        starts.append(first + at)
        if shapes:
            forms.append(mix(_hash_words(_collapsed(piece))[0] + np.uint64(1)))
        at = end
    joined = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((hashes, np.uint64), (starts, np.int64), (forms, np.uint64))]
    return joined[0], joined[1], joined[2] if shapes else None


def words_of(texts: list, lower: bool = False, shapes: bool = False):
    """(hashes, owner, n_words, shape hashes): the words of all texts in order, and the text each belongs to.

    ``lower`` folds A-Z alone, as ``bytes.lower`` does."""
    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts) + b"\n"
    w, starts, forms = _word_hashes(joined.lower() if lower else joined, shapes)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(ends, starts, "right")
    return w, owner, np.bincount(owner, minlength=len(texts)), forms


def groups(batches: Iterator[pa.RecordBatch]):
    """(batch, first row, texts) runs of about ``_GROUP`` bytes of text; only a run's texts are Python objects."""
    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        first, size = 0, 0
        for i, n in enumerate(sizes):
            size += n
            if size >= _GROUP or i == len(sizes) - 1:
                yield batch, first, column.slice(first, i + 1 - first).to_pylist()
                first, size = i + 1, 0
        pa.default_memory_pool().release_unused()
