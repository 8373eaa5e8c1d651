"""Suffix-array dedup (operator 8): bytes covered by a 100-byte string that also starts earlier.

spans.py first narrows all texts to rows of windows that may repeat; rows that are equal as a whole are
judged there. The texts of the rest (one for each distinct surrounding of a repeated passage) are dealt
to shards by hash. A shard builds one suffix array over its texts by Larsson-Sadakane refinement, takes
Kasai's common prefixes of neighbours, and groups window starts whose common prefix reaches the window.
If the texts of one hash fill several shards, a shard's first windows are merged with the sorted
windows of the shards before by binary search. Crowded hashes (spans.py) are dealt by window instead: each
window is a row of its own (at >= CROWDED), dealt by its own hash; of equal windows in a task (their bytes are compared) only
the first is sent, and where those of one hash meet, digests of 128 bits tell them apart: their bytes would be most
of what the operator sends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, spans
from .common import keyed

WINDOW, INNER = 100, 24
SHARD_BYTES = 2 << 20
#: Bytes of the digest that stands for a window of a crowded hash.
DIGEST = 16
#: Windows of crowded hashes that a task compares before it sends them.
TOGETHER = 1 << 18


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, big-endian, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of `data` in the order of their suffixes; a suffix stops at end[i], the end of its text,
    where it is smaller than any byte; ends of later texts are smaller than those of earlier ones.

    Larsson and Sadakane: suffixes sorted by h units form groups; sorting each group by the group
    numbers h positions on sorts by 2h. Groups of one are done and are not touched again.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    short = np.minimum(end - place, 7).astype(np.uint64)
    beyond = np.uint64(8) * (np.uint64(8) - short)  # low bits that belong to other texts, or to the eighth byte
    head = eights(data) >> beyond << beyond | short
    sa = np.argsort(head, kind="stable")
    change = np.concatenate([[True], head[sa[1:]] != head[sa[:-1]]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(change, place, 0))
    h = 7
    while True:
        single = change & np.append(change[1:], True)
        left = np.flatnonzero(~single)
        if not len(left):
            return sa
        s = sa[left]
        on = s + h
        inside = on < end[s]
        second = np.where(inside, rank[np.minimum(on, n - 1)] + n, n - end[s])
        first = rank[s]
        order = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort(first << 32 | second, kind="stable")
        s, first, second = s[order], first[order], second[order]
        sa[left] = s
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        change[left] = new
        rank[s] = np.maximum.accumulate(np.where(new, left, 0))
        h *= 2


def common_prefixes(data: np.ndarray, end: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each place r > 0 of the suffix array the length of the common prefix with place r - 1, up to
    cap (first: 0).

    Kasai's observation: going one position on in the text shortens the common prefix with the
    predecessor by one at most. Where the bytes before a suffix and its predecessor agree, it is exactly
    one less, so only the other positions are compared, 8 bytes at a time, all at once.
    """
    n = len(sa)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0)
    fresh[1:] |= data[:-1] != data[np.maximum(before[1:], 1) - 1]
    fresh[1:] |= (end[:-1] != end[1:]) | (end[np.maximum(before[1:], 1) - 1] != end[np.maximum(before[1:], 0)])
    fresh[1:] |= before[1:] != before[:-1] + 1  # equal runs keep their predecessors side by side
    at = np.flatnonzero(fresh & (before >= 0))
    other = before[at]
    length = np.zeros(len(at), np.int64)
    limit = np.minimum(np.minimum(end[at] - at, end[other] - other), n)
    words = eights(data)
    todo = np.arange(len(at))
    done = 0
    while len(todo) and done < n:
        a, b = np.minimum(at[todo] + done, n - 1), np.minimum(other[todo] + done, n - 1)
        differ = words[a] ^ words[b]
        same = np.where(differ == 0, 8, (63 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64)))).astype(np.int64) // 8)
        length[todo] += same
        todo = todo[(differ == 0) & (length[todo] < limit[todo])]
        done += 8
    known = np.zeros(n, np.int64)
    known[at] = np.minimum(length, limit)
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    plcp = np.where(before >= 0, np.maximum(known[last] - (i - last), 0), 0)
    return np.minimum(plcp[sa], cap)


def window_classes(texts: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, window number and class of the first counts[t] windows of each text; equal windows
    have equal classes, and classes are in byte order."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum(size) - size
    end = np.repeat(off + size, size)
    sa = suffix_array(data, end)
    lcp = common_prefixes(data, end, sa, window)
    number = np.cumsum(lcp < window)
    text = np.repeat(np.arange(len(texts)), size)[sa]
    k = sa - off[text]
    start = k < counts[text]
    return text[start], k[start], number[start]


class SortedRun:
    """Distinct windows in byte order with the first place of each; the state of a hash across shards."""

    def __init__(self, window: int):
        self.width = -(-window // 8)
        self.rows = np.zeros((0, self.width), np.uint64)
        self.first = np.zeros((0, 2), np.int64)

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each row belongs, and whether it is there: binary search, all rows at once."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.rows))
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(rows), bool)
            open_ = lo < hi
            for c in range(self.width):
                x, y = self.rows[np.minimum(mid, len(self.rows) - 1), c], rows[:, c]
                less |= open_ & (x < y)
                open_ &= x == y
            move = lo < hi
            lo, hi = np.where(move & less, mid + 1, lo), np.where(move & ~less, mid, hi)
        there = np.zeros(len(rows), bool)
        near = lo < len(self.rows)
        there[near] = (self.rows[lo[near]] == rows[near]).all(1)
        return lo, there

    def merge(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Add windows (sorted, distinct, later in place than all before); which were there already."""
        at, there = self.find(rows)
        self.rows = np.insert(self.rows, at[~there], rows[~there], axis=0)
        self.first = np.insert(self.first, at[~there], first[~there], axis=0)
        return there


def judge_shards(batches: Iterator[pa.RecordBatch], window: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp, key, at: key and at of the windows that also start earlier in another row, and of
    the rows without text, which are judged already."""
    texts: list[bytes] = []
    fps: list[int] = []
    keys: list[int] = []
    ats: list[int] = []
    size, run, run_fp = 0, SortedRun(window), None

    def shard() -> pa.RecordBatch:
        nonlocal run, run_fp
        fp, key, at = np.array(fps), np.array(keys), np.array(ats)
        text, k, number = window_classes(texts, at & 255, window)
        order = np.lexsort((k, text, number))  # within a class in order of key and place, as the rows came
        text, k, number = text[order], k[order], number[order]
        head = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
        gone = ~head
        for edge in dict.fromkeys((int(fp[0]), int(fp[-1]))):  # hashes that other shards may share
            if edge != run_fp:
                run, run_fp = SortedRun(window), edge
            mine = head & (fp[text] == edge)
            cut = np.zeros((int(mine.sum()), 8 * run.width), np.uint8)
            for row, (t, j) in enumerate(zip(text[mine].tolist(), k[mine].tolist(), strict=True)):
                cut[row, :window] = np.frombuffer(texts[t], np.uint8, window, j)
            rows = cut.view(">u8").astype(np.uint64)
            gone[np.flatnonzero(mine)] |= run.merge(rows, np.stack([key[text[mine]], k[mine]], 1))
        t, j = text[gone], k[gone]
        return pa.RecordBatch.from_arrays([pa.array(key[t]), pa.array(((at[t] >> 8) + j) << 8 | 1)], ["key", "at"])

    seen_fp, seen = None, set()
    for batch in batches:
        done = batch.filter(batch.column(3).is_null())
        if done.num_rows:
            yield done.select(["key", "at"])
            batch = batch.filter(batch.column(3).is_valid())
        single = pc.greater_equal(batch.column(2), spans.CROWDED)
        alone = batch.filter(single)
        if alone.num_rows:
            later = []
            for i, (x, cut) in enumerate(zip(alone.column(0).to_pylist(), alone.column(3).to_pylist(), strict=True)):
                if x != seen_fp:
                    seen_fp, seen = x, {cut}
                elif cut in seen:
                    later.append(i)
                else:
                    seen.add(cut)
            gone = alone.take(pa.array(later, pa.int64()))
            yield pa.RecordBatch.from_arrays([gone.column(1), pc.subtract(gone.column(2), spans.CROWDED)], ["key", "at"])
            batch = batch.filter(pc.invert(single))
        fp, key, at = (batch.column(i).to_pylist() for i in range(3))
        for i, text in enumerate(batch.column(3).to_pylist()):
            if size + len(text) > shard_bytes and texts:
                yield shard()
                texts, fps, keys, ats, size = [], [], [], [], 0
            texts.append(text), fps.append(fp[i]), keys.append(key[i]), ats.append(at[i])
            size += len(text)
    if texts:
        yield shard()


SNIPPET = ["fp", "key", "at", "cut"]


def first_windows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """found: hash, key, first, bytes of windows. One row with a digest for each distinct window, its first;
    rows without one for all others, which stand earlier too."""
    fp, key, first, cut = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, key, fp))
    fp, key, first, cut = fp[order], key[order], first[order], cut[order]
    gone = np.zeros(len(fp), bool)
    gone[1:] = (fp[1:] == fp[:-1]) & (cut[1:] == cut[:-1]).all(1)
    k, at = spans.runs(key[gone], first[gone])
    yield pa.RecordBatch.from_arrays([pa.array(spans.spread(k, at)), pa.array(k), pa.array(at), pa.nulls(len(k), pa.binary())], SNIPPET)
    texts = pa.array([hashlib.blake2b(window, digest_size=DIGEST).digest() for window in np.ascontiguousarray(cut[~gone])], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(fp[~gone]), pa.array(key[~gone]), pa.array(first[~gone] << 8 | 1 | spans.CROWDED), texts], SNIPPET)


def snippets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    found, size = [], 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for s in flat.slices(batch.column(1), 1 << 20):
            row, fp, at, crowded = spans.listed(batch.column(2), s.lo, s.hi)
            crowded = crowded.astype(bool)
            if crowded.any():
                sums = flat.prefix(s.data)
                r, first = row[crowded], at[crowded] >> 8
                count = at[crowded] & 255
                step = TOGETHER // 256  # edges, of at most 255 windows
                for lo in range(0, len(r), step):
                    c = count[lo : lo + step]
                    e = np.repeat(np.arange(lo, lo + len(c)), c)
                    f = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(c) - c, c)
                    i = s.off[r[e] - s.lo] + f
                    h = flat.span_hash(sums, i, i + window).view(np.int64)
                    found.append((h, keys[r[e]], f, s.data[i[:, None] + np.arange(window)]))
                    size += len(e)
                    if size >= TOGETHER:
                        yield from first_windows(found)
                        found, size = [], 0
                row, fp, at = row[~crowded], fp[~crowded], at[~crowded]
            raw = s.data.tobytes()
            begin = s.off[row - s.lo] + (at >> 8)
            end = begin + (at & 255) - 1 + window
            cut = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(keys[row]), pa.array(at), pa.array(cut, pa.binary())], SNIPPET)
    if found:
        yield from first_windows(found)


def repeated(docs: DataFrame, window: int = WINDOW, inner: int = INNER, shard_bytes: int = SHARD_BYTES, columns: tuple = ()) -> DataFrame:
    """key, list: the windows of each document that also start earlier (first << 8 | count, in bytes)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowd = spans.crowded(docs, "bytes", window, inner)
    rows = spans.placed(docs, "bytes", window, inner, crowd).repartition(parts, "fp")
    judged = spans.judged(rows, later_only=True).where("whole OR edge")
    edges = spans.lists(judged.where("edge"), F.struct("fp", "at", "crowded"))
    cuts = spans.with_text(docs, edges, "inner", partial(snippets, window=window), "fp long, key long, at long, cut binary", *columns)
    shards = cuts.repartition(parts, "fp").sortWithinPartitions("fp", "key", "at")
    single = shards.mapInArrow(partial(judge_shards, window=window, shard_bytes=shard_bytes), "key long, at long")
    return spans.lists(judged.where("whole").select("key", "at").union(single), F.col("at"))


def removed(docs: DataFrame, repeats: DataFrame, window: int, texts: bool, *columns: str) -> DataFrame:
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(2).to_pylist()
            size, gone, runs, kept = [], [], [], []
            for s in flat.slices(batch.column(1), 1 << 20):
                for r in range(s.lo, s.hi):
                    text = s.data[s.off[r - s.lo] : s.off[r - s.lo + 1]]
                    out = spans.covered(windows[r] or [], len(text), window)
                    size.append(len(text))
                    gone.append(int(out.sum()))
                    runs.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
                    left = text[~out].tobytes()
                    kept.append(left if texts else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary() if texts else pa.string())], [*batch.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept"])

    columns = ("doc_id", *columns)
    out = spans.with_text(docs, repeats, "left", run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}", *columns)
    return out if texts else out.withColumnRenamed("kept", "kept_sha256")


def dedup(docs: DataFrame, *columns: str, window: int = WINDOW, inner: int = INNER, texts: bool = False) -> DataFrame:
    """Remove every byte in a `window`-byte string that also starts earlier: in a document of smaller
    doc_id, or earlier in its own.

    Null and empty texts have no bytes; texts shorter than the window lose none. Repeated and null
    doc_ids are documents of their own, nulls first, equal ids in order of their texts. An empty table
    gives no rows. kept is the rest of the text as bytes (texts) or its sha256.
    """
    docs = keyed(docs, "doc_id", "text", *columns)
    return removed(docs, repeated(docs, window, inner, columns=("doc_id", *columns)), window, texts, *columns)
