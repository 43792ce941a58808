"""Vectorised tokenising and hashing of whole Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. UTF-8 never uses these bytes
inside a longer character, so the work is done on bytes. A word's 64-bit hash is a polynomial over a random table of
byte values, taken from prefix sums, so no Python loop runs over words. Texts are handled in slices of bounded size;
only a single text that is longer than a slice makes a larger one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_TEXTS = 60_000
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for k, base in enumerate((_MUL, pow(_MUL, -1, 2**64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers are reused, and two share an executor."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


@dataclass
class Words:
    """The words of some texts: first and past-the-end byte, number of the text in the slice, hash."""

    lower: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    sums: np.ndarray
    n_docs: int
    first: int  # of the slice's texts, its place in the batch

    def prefix_hash(self, k: int) -> np.ndarray:
        """Hashes of the words' first ``k`` bytes."""
        return _spans(self.sums, self.start, np.minimum(self.start + k, self.end))

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def _spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SLICE_BYTES together (or a single longer text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n, i + SLICE_TEXTS)
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    """Tokenise the texts between consecutive ``offsets``."""
    lo, n = offsets[0], int(offsets[-1] - offsets[0])
    raw = data[lo : lo + n]
    lower = LOWER[raw]
    gap = IS_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets - lo] = True
    begins, ends = ~gap, ~gap
    if n:
        begins[1:] &= gap[:-1] | cut[1:n]
        ends[:-1] &= gap[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[lower] * powers(n + 1)[0][:n], out=sums[1:])
    doc = np.searchsorted(offsets - lo, start, "right") - 1
    return Words(lower, start, end, doc.astype(np.int64), _spans(sums, start, end), sums, len(offsets) - 1, first)


def each_slice(column: pa.Array) -> Iterator[Words]:
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        yield words_of(data, offsets[i : j + 1], i)


#: Odd multipliers of the places in an n-gram.
PLACES = (_rng.integers(1, 2**63 - 1, 64, dtype=np.uint64) << _U(1)) | _U(1)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each run of ``width`` words; a text with fewer words has its whole sequence as one."""
    n = len(w.hash)
    counts = w.per_doc()
    short = np.flatnonzero((counts > 0) & (counts < width))
    docs, hashes = [], []
    if n >= width:
        m = n - width + 1
        h = np.zeros(m, np.uint64)
        for k in range(width):
            h += w.hash[k : k + m] * PLACES[k]
        whole = w.doc[:m] == w.doc[width - 1 :]
        docs.append(w.doc[:m][whole])
        hashes.append(mix(h[whole]))
    if len(short):
        at = np.concatenate(([0], np.cumsum(counts)))[short]
        h = counts[short].astype(np.uint64) * PLACES[63]
        for k in range(width - 1):
            has = counts[short] > k
            h[has] += w.hash[at[has] + k] * PLACES[k]
        docs.append(short)
        hashes.append(mix(h))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def sorted_by_doc(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by text, then key. Texts of a slice fit 16 bits, for which numpy's stable sort is a radix sort."""
    order = np.argsort(key)
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def first_of_run(*keys: np.ndarray) -> np.ndarray:
    """Whether each element differs from its predecessor in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def long_of(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark stores."""
    return x.astype(np.uint64).view(np.int64)
