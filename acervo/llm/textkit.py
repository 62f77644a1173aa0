"""Vectorised text primitives over Arrow string arrays (numpy, no per-word Python).

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  All functions
work on one byte buffer with document offsets, in blocks of bounded size; a
document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` bytes (one document at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each document (``n + 1``)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~SPACE[buf]
    first = full.copy()
    first[1:] &= ~full[:-1]
    last = full.copy()
    last[:-1] &= ~full[1:]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    first[edge] = full[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = full[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets).astype(np.int64)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hashes of byte spans, the same wherever a span stands."""
    n = len(buf) + 1
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BACK))), dtype=np.uint64)
        _powers[:] = [up, down]
    total = np.zeros(n, np.uint64)
    np.cumsum(_CODE[buf] * _powers[0][: n - 1], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def ngrams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words of one document, and the index of their first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _MIX[j]
    left = np.zeros(n + 1, np.int32)
    inner = first[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    np.add.at(left, np.maximum(inner - k + 1, 0), 1)
    np.add.at(left, inner, -1)
    at = np.flatnonzero(np.cumsum(left)[: n - k + 1] == 0)
    return mix(total[at]), at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``concat(arange(s, s + c))`` for all pairs."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, counts)


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k``-word shingle by document (``n + 1`` bounds), repeats included.

    A document of 1 to ``k - 1`` words gives its whole sequence as one shingle;
    one without words gives none.
    """
    starts, ends, first = words(buf, offsets)
    hashes = span_hash(buf, starts, ends)
    grams, at = ngrams(hashes, first, k)
    n_words = np.diff(first)
    counts = np.maximum(n_words - k + 1, 0)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if not len(short):
        return grams, np.concatenate(([0], np.cumsum(counts)))
    own = n_words[short].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for j in range(k - 1):
        has = n_words[short] > j
        own[has] += hashes[first[short[has]] + j] * _MIX[j + 64]
    counts[short] = 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(bounds[-1]), np.uint64)
    put = np.ones(len(out), bool)
    put[bounds[short]] = False
    out[put] = grams
    out[bounds[short]] = mix(own)
    return out, bounds
