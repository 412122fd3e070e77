"""Vectorised text helpers: whole Arrow batches of UTF-8 are hashed into words and shingles without a Python loop per row.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D`` with A-Z lower-cased. A null text is an empty one.
Hashes are 64 bits wide; they stand for the word (or shingle) itself in counting and comparing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Span hashes are polynomials at two points modulo a prime; a power of two as modulus would let long regular texts collide.
PRIME = (1 << 31) - 1
_POINTS = (0x3C6EF35F, 0x1F83D9AB)
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_powers: dict[int, np.ndarray] = {}
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_quick = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo the prime: under 2**34, and under 2**33 for ``x`` under 2**63."""
    return (x & _P) + (x >> _BITS)


def residue(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = _folded(_folded(x))
    return np.minimum(x, x - _P)  # below the prime the difference wraps around and is the greater one


def powers(point: int, n: int) -> np.ndarray:
    """The point's powers 0..n-1 modulo the prime, doubled in length until there are enough."""
    out = _powers.get(point, np.ones(1, np.uint32))
    while len(out) < n:
        out = np.concatenate([out, residue(out.astype(np.uint64) * np.uint64(pow(point, len(out), PRIME))).astype(np.uint32)])
    _powers[point] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()  # workers are used again by the next stage


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more at the end)."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    word = ~SPACE[raw]
    begins, ends = word.copy(), word
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word & edge[1:]
    ends[:-1] |= word[:-1] & ~word[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


class Spans:
    """64-bit hashes of byte spans (or spans of letters under 2**31), equal for equal ones wherever they stand; running sums are made once."""

    def __init__(self, raw: np.ndarray):
        n, self.sums = len(raw), []
        small = raw.dtype == np.uint8 and n <= 1 << 24
        for point in _POINTS:
            terms = (raw.astype(np.uint64) + np.uint64(1)) * powers(point, n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(terms if small else residue(terms), out=total[1:])
            self.sums.append((total, powers(pow(point, -1, PRIME), n + 1)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (residue(_folded(total[ends] - total[starts]) * down[starts]) for total, down in self.sums)
        return mix((one | two << np.uint64(32)) + (ends - starts).astype(np.uint64) * _STEP)


class QuickSpans:
    """Cheaper hashes of byte spans, modulo a power of two: equal for equal spans, but long regular ones may collide.

    They choose and search; where equality decides a result, ``Spans`` or the bytes themselves must confirm it.
    """

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(_quick[0]) < n + 1:
            for k, base in enumerate((_BASE, _UNBASE)):
                x = np.full(n + n // 4 + 1, base, np.uint64)
                x[0] = 1
                _quick[k] = np.cumprod(x, dtype=np.uint64)
        self.down = _quick[1]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _quick[0][:n], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _STEP)

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from each place on."""
        return mix((self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(raw)(starts, ends)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting (much faster here than hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the first word of each row (one more at the end)."""
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, at)
    return span_hashes(raw, starts, ends), first


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each place on; the last ``width - 1`` places are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = x * _BASE + words[k : k + n]
    return mix(x + np.uint64(width))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of ``width`` words that stay within a row, with their row; a shorter row with words is one shingle."""
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    base = np.cumsum(np.maximum(counts - width + 1, 0))
    place = np.arange(len(rows)) - np.repeat(base - np.maximum(counts - width + 1, 0), np.maximum(counts - width + 1, 0)) + first[:-1][rows]
    hashes = combine(words, width)[place] if len(rows) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.array([combine(words[first[r] : first[r + 1]], int(counts[r]))[0] for r in short], np.uint64)
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, own])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes
