"""Vectorised text primitives for Arrow batches.

Everything works on the UTF-8 bytes of a whole batch at once: a *slice* is a run of
consecutive documents of about ``SLICE_BYTES`` (a longer document is a slice of its own),
so temporary arrays stay bounded whatever the batch size.

Hashes of substrings come from one prefix sum of ``T[byte] * B**position`` modulo 2**64;
``B`` is odd, hence invertible, so any substring hash costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def _splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64; wraps around silently."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix = _splitmix
_TABLE = _splitmix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest slice seen."""

    def __init__(self) -> None:
        self.n, self.fwd, self.inv = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = 1 << (n - 1).bit_length()
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            f, i = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, inverse, np.uint64)
            f[0] = i[0] = 1
            self.fwd, self.inv, self.n = np.multiply.accumulate(f), np.multiply.accumulate(i), size
        return self.fwd, self.inv


_powers = _Powers()

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IDENTITY = np.arange(256, dtype=np.uint8)

#: Words are runs of bytes that are not whitespace.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII letters or digits (after lower-casing) and of non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``target`` bytes, one document at least."""
    d, n = 0, len(offs) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offs, offs[d] + target, "right")) - 1)
        yield d, e
        d = e


def prefix_hash(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums (length n+1) and inverse powers, for ``span_hash``."""
    n = len(low)
    fwd, inv = _powers.upto(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[low] * fwd[:n], out=sums[1:])
    return sums, inv


def span_hash(sums: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    return _splitmix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of one slice. Positions are bytes within the slice's ``buf``."""

    buf: np.ndarray  #: as mapped (lower-cased or not)
    offs: np.ndarray  #: document offsets within buf
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: index of each document's first word; length docs + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        sums, inv = prefix_hash(self.buf)
        return span_hash(sums, inv, self.start, self.end)


def split_words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lut: np.ndarray = LOWER) -> Words:
    """Words of a slice; no word crosses a document's end."""
    offs = offs - offs[0]
    low = lut[buf]
    w = is_word[low]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf) + 1, bool)
    before[0], before[1:] = False, w
    inner = w & before[:-1] & ~edge[:-1]
    start = np.flatnonzero(w & ~inner)
    after = np.empty(len(buf) + 1, bool)
    after[:-1], after[-1] = inner, False
    end = np.flatnonzero(w & ~after[1:]) + 1
    return Words(low, offs, start, end, np.searchsorted(start, offs))


def doc_words(col: pa.Array, is_word: np.ndarray, lut: np.ndarray = LOWER) -> Iterator[tuple[int, int, Words]]:
    """(first document, last document + 1, words) for each slice of a column."""
    buf, offs = column_bytes(col)
    for d, e in slices(offs):
        yield d, e, split_words(buf[offs[d] : offs[e]], offs[d : e + 1], is_word, lut)


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (length n-k+1), documents ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> _U(29))) * _U(0xFF51AFD7ED558CCD) + h[j : j + n]
    return _splitmix(out)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
