"""Pairs of entities that meet on items, within tasks: made from lists of members, sent as packed columns, added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that a task makes at a time (some 100 bytes of memory each).
CHUNK = 1 << 21
KINDS = {"one": np.dtype("<i4"), "two": np.dtype("<i4"), "d": np.dtype("<f8")}


def packed(x: np.ndarray) -> bytes:
    """A column by places of its bytes: high bytes are much alike, so that zstd leaves little of them."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind)[:, 0]


def members(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the lists, and all their entities and values."""
    e, x = lists.flatten().flatten()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), e.to_numpy(zero_copy_only=False), x.to_numpy(zero_copy_only=False)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where lists are so long that they have more than some CHUNK / 4 members."""
    for batch in batches:
        size = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("near", "far"))
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // max(1, CHUNK // 4)))
        for lo, hi in zip([0, *(cuts + 1)], [*(cuts + 1), len(batch)], strict=True):
            yield batch.slice(lo, hi - lo)


def meet(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """part, n, one, two, d from rows own, near, far: n pairs of entities with the distance of their values, packed. `near`
    meets itself if own, else `far`. Which of two comes first, and so the part, does not depend on where they meet."""
    for batch in sliced(batches):
        own = batch.column("own").to_numpy(zero_copy_only=False)
        (size, e, x), (far, f, y) = members(batch.column("near")), members(batch.column("far"))
        place = np.arange(len(e))
        own, end, far_end, far = (np.repeat(v, size) for v in (own, np.cumsum(size), len(e) + np.cumsum(far), far))
        start = np.where(own, place + 1, far_end - far)
        many = np.where(own, end, far_end) - start
        before = np.concatenate([[0], np.cumsum(many)])
        e, x, lo = np.concatenate([e, f]), np.concatenate([x, y]), 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + CHUNK, "right")) - 1)
            n = many[lo:hi]
            left = np.repeat(place[lo:hi], n)
            right = np.arange(len(left)) + np.repeat(start[lo:hi] - before[lo:hi] + before[lo], n)
            yield from dealt(e[left], e[right], distance(x[left], x[right]), parts)
            lo = hi


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):  # of infinite values: NaN, as in SQL
        return np.abs(x - y)


def dealt(e: np.ndarray, f: np.ndarray, d: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each part as a row. Of two entities, the smaller comes first if both are odd or even, else the larger:
    so each comes first in some half of its pairs."""
    swap = ((e ^ f) & 1 == 1) == (e < f)
    one, two = np.where(swap, f, e), np.where(swap, e, f)
    part = one % parts
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    one, two, d = one[order], two[order], d[order]
    n = np.bincount(part, minlength=parts)
    ends, found = np.cumsum(n), np.flatnonzero(n)
    columns = [[packed(x[ends[p] - n[p] : ends[p]]) for p in found] for x in (one, two, d)]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["part", "n", *KINDS])


def mean_distances(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """One row s, n: the sum of the mean distances of a task's pairs, and the number of these pairs. They stay packed, and are
    added up in rounds of some `rows` pairs."""
    sent = [r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in ("n", *KINDS)], strict=True)]
    rounds, s, pairs = -(-sum(r[0] for r in sent) // rows), 0.0, 0
    for k in range(rounds):
        keys, far = [], []
        for n, *columns in sent:
            one, two, d = (unpacked(c, n, kind) for c, kind in zip(columns, KINDS.values(), strict=True))
            mine = two % rounds == k if rounds > 1 else slice(None)
            keys.append((one[mine].astype(np.int64) << 32) | two[mine])
            far.append(d[mine])
        key, d = np.concatenate(keys), np.concatenate(far)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            s += float((np.add.reduceat(d[order], first) / np.diff(first, append=len(key))).sum())
            pairs += len(first)
    yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.float64()), "n": pa.array([pairs], pa.int64())})
