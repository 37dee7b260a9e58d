"""Vectorised handling of Arrow text batches as flat UTF-8 bytes.

Every text operator works on the same picture: a slice of documents is one uint8 array
with document offsets, a word is a maximal run of bytes outside {0x20, 0x09-0x0D}, and
strings are compared by 64-bit polynomial hashes taken from one prefix-sum array. No step
loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents of one numpy slice together hold about this many bytes (a longer document is a slice alone).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(_U, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _byte_values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed)) | _U(1)


_TABLES: dict[tuple[int, bool], np.ndarray] = {}
_POWERS: dict[str, np.ndarray] = {}


def byte_table(seed: int, lower: bool) -> np.ndarray:
    if (seed, lower) not in _TABLES:
        t = _byte_values(seed)
        _TABLES[seed, lower] = t[LOWER] if lower else t
    return _TABLES[seed, lower]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n (mod 2**64)."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", _INV)):
                p = np.full(size, b, dtype=_U)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j over j < i."""
    up, _ = powers(len(values))
    p = np.empty(len(values) + 1, dtype=_U)
    p[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal spans get equal hashes wherever they stand."""
    _, down = powers(len(p))
    with np.errstate(over="ignore"):
        return mix((p[end] - p[start]) * down[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


class Slice:
    """Some whole documents: ``data`` bytes, ``off`` their offsets (n + 1), ``rows`` their row numbers in the batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first = data, off, first
        self.n = len(off) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of each word, its document in the slice, and the documents' word offsets (n + 1)."""
        space = SPACE[self.data]
        edge = np.empty(len(space), bool)
        if len(space):
            edge[0] = True
            edge[1:] = space[:-1]
            inner = self.off[1:-1]
            edge[inner[inner < len(space)]] = True
            start = np.flatnonzero(edge & ~space)
            edge[-1] = True
            edge[:-1] = space[1:]
            last = self.off[1:] - 1
            edge[last[last >= 0]] = True
            end = np.flatnonzero(edge & ~space) + 1
        else:
            start = end = np.zeros(0, np.int64)
        at = np.searchsorted(start, self.off)
        return start, end, np.repeat(np.arange(self.n), np.diff(at)), at

    def word_hashes(self, lower: bool, seed: int = 1):
        start, end, doc, at = self.words()
        p = prefix_hash(byte_table(seed, lower)[self.data])
        return span_hash(p, start, end), start, end, doc, at

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(text: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a text column (null: empty) into slices of whole documents in row order."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
    if text.null_count:
        text = text.fill_null("")
    big = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    if not len(text):
        return
    _, offs, data = text.buffers()
    off = np.frombuffer(offs, np.int64 if big else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(text)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Slice(raw[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within each document, and the first word's index.

    A word's hash stands for its text, so equal word sequences get equal hashes.
    """
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    p = prefix_hash(h)
    first = np.arange(len(h) - n + 1)
    ends = np.repeat(at[1:], np.diff(at))[: len(first)]
    first = first[first + n <= ends]
    return span_hash(p, first, first + n), first


def raw_shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-word shingles of each document as (hash, document), in no order and with repeats.

    A document of fewer than n words (but at least one) has its whole sequence as its one shingle;
    one without words has none.
    """
    g, first = grams(h, at, n)
    d = np.repeat(np.arange(len(at) - 1), np.diff(at))[first]
    count = np.diff(at)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        g = np.concatenate([g, span_hash(prefix_hash(h), at[short], at[short + 1])])
        d = np.concatenate([d, short])
    return g, d


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of raw_shingles, sorted by document and hash."""
    g, d = raw_shingles(h, at, n)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        keep = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
        g, d = g[keep], d[keep]
    return g, d


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of [lo, hi) of each pair, one after another."""
    n = np.maximum(hi - lo, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = n > 0
    lo, n = lo[keep], n[keep]
    ends = np.cumsum(n)
    out[0] = lo[0]
    out[ends[:-1]] = lo[1:] - (lo[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` consecutive hashes the index of its smallest one (leftmost).

    Windows with equal content choose the same place, so a repeated window always has a repeated minimizer.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    # The place fills the low bits, so one sliding minimum (prefix and suffix minima of blocks) gives hash and place.
    low = _U((1 << max(1, int(n).bit_length())) - 1)
    packed = np.full(-(-n // width) * width, ~_U(0), _U)
    packed[:n] = (h & ~low) | np.arange(n, dtype=_U)
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
