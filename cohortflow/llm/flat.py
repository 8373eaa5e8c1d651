"""Texts of an Arrow batch as flat numpy arrays: bytes, words, rolling hashes, winnowed anchors.

Everything works on slices of whole documents, a few MB at a time, so a task needs some 60 bytes of
memory for each byte of a slice (or of its longest single document).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Hashes are polynomials modulo the prime 2^61 - 1. Two families: pairs that agree in one by chance differ in the other.
PRIME = np.uint64((1 << 61) - 1)
_BASES = (0x0E3779B97F4A7C15, 0x1B54A32D192ED03F)
#: Numbers that are worked on at once: they stay in a core's cache.
BLOCK = 1 << 13
_powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

#: Bytes that separate words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
#: ASCII marks that never join a letter before them in a pre-token; an apostrophe may, and | < > [ ] can
#: be within a special token.
IS_MARK = np.array([chr(b).isascii() and 0x20 < b < 0x7F and not chr(b).isalnum() and chr(b) not in "'|<>[]" for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit values that spreads every bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)  # x - PRIME wraps to a huge number where x is below PRIME


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 bits, so that nothing exceeds 64 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a family's base and of its inverse modulo PRIME, at least n of each."""
    if len(_powers[family][0]) < n:
        out = []
        for base, known in zip((_BASES[family], pow(_BASES[family], -1, int(PRIME))), _powers[family], strict=True):
            while len(known) < n:
                known = np.concatenate([known, times(known, np.uint64(pow(base, len(known), int(PRIME))))])
            out.append(known)
        _powers[family] = (out[0], out[1])
    return _powers[family]


def prefix(values: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * base**i; with span_hash() any span's polynomial hash in constant time. Bytes
    count from 1, so that zeros tell; their products with half a power need no reduction."""
    up, _ = powers(len(values) + 1, family)
    half, low31, low30 = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    out = np.zeros(len(values) + 1, np.uint64)
    last = np.uint64(0)
    for lo in range(0, len(values), BLOCK):
        hi = min(lo + BLOCK, len(values))
        if values.dtype == np.uint8:
            v = values[lo:hi].astype(np.uint64) + np.uint64(1)
            low, high = np.cumsum((up[lo:hi] & low31) * v), np.cumsum((up[lo:hi] >> half) * v)
        else:
            term = times(up[lo:hi], reduced(values[lo:hi]))
            low, high = np.cumsum(term & low31), np.cumsum(term >> half)
        out[lo + 1 : hi + 1] = reduced(((high & low30) << half) + (high >> np.uint64(30)) + low + last)
        last = out[hi]
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    _, down = powers(len(sums), family)
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), BLOCK):
        a, b = start[lo : lo + BLOCK], end[lo : lo + BLOCK]
        value = times(reduced(sums[b] + (PRIME - sums[a])), down[a])
        out[lo : lo + BLOCK] = mix(value ^ (b - a).astype(np.uint64) << np.uint64(40))
    return out


@dataclass
class Slice:
    """Rows lo..hi of a batch: data holds their bytes, off where each row starts (and the end)."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string or binary column (null: empty) into slices of whole rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte spans start..end, and first[r]..first[r+1] are the words of row r."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(s: Slice) -> Words:
    word = ~IS_SPACE[s.data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    filled = s.off[:-1] < s.off[1:]
    a, b = s.off[:-1][filled], s.off[1:][filled] - 1
    begin[a], stop[b] = word[a], word[b]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(start, end, np.searchsorted(start, s.off), span_hash(prefix(s.data), start, end))


def chunks(s: Slice) -> Words:
    """Spans that together cover the slice: white space with the word that follows it, and marks.

    A cut lies where an ASCII space follows a byte that cannot end a Unicode space, and where an ASCII
    mark follows an ASCII letter: every pre-tokenizer that joins neither pair treats the spans
    independently. Spans have no hashes: they are told apart by their bytes.
    """
    data = s.data
    space = IS_SPACE[data]
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        ascii_end = (data[:-1] < 0x80) & ~space[:-1]
        latin = np.zeros(len(data) - 1, bool)
        latin[1:] = (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xC5)
        cut[1:] = space[1:] & (ascii_end | latin) | IS_LETTER[data[:-1]] & IS_MARK[data[1:]]
    filled = s.off[:-1] < s.off[1:]
    cut[s.off[:-1][filled]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data)) if len(start) else start
    return Words(start, end, np.searchsorted(start, s.off), np.zeros(0, np.uint64))


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span: its bytes and length, if they are seven at most; else a hash of them."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    size = end - start
    low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes

    def block(rows: np.ndarray | slice, k: int) -> np.ndarray:
        at = start[rows] + 8 * k
        return eight[at].view("<u8")[:, 0] & low[np.minimum(end[rows] - at, 8)]

    out = block(slice(None), 0) | np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56)
    rows = np.flatnonzero(size >= 8)
    h, k = mix(out[rows] ^ (size[rows].astype(np.uint64) << np.uint64(40))), 1
    while len(rows):
        more = size[rows] > 8 * k
        out[rows[~more]] = h[~more] | np.uint64(1 << 63)
        rows, h = rows[more], h[more]
        h, k = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ block(rows, k)), k + 1
    return out


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span of more than seven bytes equals span number other[i], byte for byte."""
    rows = np.flatnonzero((end - start > 7) & (other != np.arange(len(start))))
    size = end[rows] - start[rows]
    if (size != end[other[rows]] - start[other[rows]]).any():
        return False
    for lo in range(0, len(rows), BLOCK):
        part, n = rows[lo : lo + BLOCK], size[lo : lo + BLOCK]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(start[part], n) + step] != data[np.repeat(start[other[part]], n) + step]).any():
            return False
    return True


def leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the position of the first smallest value of h[i : i + width]."""
    v, p = h, np.arange(len(h), dtype=np.int32 if len(h) < 2**31 else np.int64)
    step = 1
    while step < width:
        s = min(step, width - step)
        if s >= len(v):
            return p[:0]
        right = v[s:] < v[:-s]
        v, p = np.where(right, v[s:], v[:-s]), np.where(right, p[s:], p[:-s])
        step += s
    return p


@dataclass
class Anchors:
    """Windows that share their smallest inner hash: row, first window (in the row), count, hashes."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    span: np.ndarray


def anchors(sums: np.ndarray, first: np.ndarray, window: int, inner: int) -> Anchors:
    """Winnow: each window of `window` units belongs to the first smallest hash of its `inner`-grams.

    Equal windows have equal keys, and windows of one anchor differ from one another. `sums` are the
    prefix sums of all units, first[r]..first[r+1] the units of row r.
    """
    n, width = len(sums) - 1, window - inner + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return Anchors(none, none, none, none, none)
    i = np.arange(n - inner + 1)
    h = span_hash(sums, i, i + inner)
    at = leftmost_min(h, width)
    size = np.diff(first)
    ok = np.zeros(n + 1, np.int32)
    big = size >= window
    np.add.at(ok, first[:-1][big], 1)
    np.add.at(ok, first[1:][big] - window + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    ok = ok[: len(at)]
    head = ok.copy()
    head[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    tail = ok.copy()
    tail[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
    starts = first[:-1][big]
    head[starts] = True
    before = starts[starts > 0] - 1
    tail[before[before < len(tail)]] |= ok[before[before < len(tail)]]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    row = np.searchsorted(first, a, "right") - 1
    return Anchors(row, a - first[row], b - a + 1, h[at[a]].view(np.int64), span_hash(sums, a, b + window).view(np.int64))
