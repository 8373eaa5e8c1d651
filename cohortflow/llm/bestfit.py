"""Best-fit packing (operator 12): best-two-fit over counts of equal lengths.

A sequence takes the longest document that is left, then again and again the longest that still fits. If a gap
stays, the sequence's smallest document makes way for two unpacked ones, should two fit the wider gap more
tightly. Documents of one length are alike to this rule, so it runs over how many there are of each length from 1
to the window: one step fills as many sequences alike as the counts allow, without changing any choice. The
counts are a row for each length, however many documents there are; Spark makes them, and hands each document,
by its number among those of its length, its place in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flat
from .bpe import SpanEncoder
from .common import small_batches, stored

WINDOW, END_ID = 1024, 2
#: Lengths times partitions up to which their first numbers are broadcast (some 40 bytes each); else joined by shuffle.
BROADCAST_STARTS = 1 << 18


def fill(left: np.ndarray, gap: int) -> Counter:
    """The longest that fits, again and again: how many of each length. Takes them from left."""
    out: Counter = Counter()
    while gap > 0 and len(fitting := np.flatnonzero(left[: gap + 1])):
        length = int(fitting[-1])
        out[length] = min(int(left[length]), gap // length)
        left[length] -= out[length]
        gap -= out[length] * length
    return out


def best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two lengths of left whose sum is largest within room (ties: the longest first); 0, 0 if there are none."""
    have = np.flatnonzero(left[:room])
    below = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(len(left[: room + 1])), 0))
    most = np.minimum(room - have, have)
    most -= (most == have) & (left[have] < 2)
    total = np.where(below[most] > 0, have + below[most], 0)
    if not total.any():
        return 0, 0
    i = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(have[i]), int(below[most][i])


def next_sequence(left: np.ndarray, window: int) -> tuple[Counter, int]:
    """What best-two-fit puts into the next sequence, and how many sequences alike it fills in a row."""
    after = left.copy()
    first = fill(after, window)
    used, gap, again = Counter(first), window - sum(k * n for k, n in first.items()), Counter()
    smallest = min(used)
    if gap and used.total() > 1:
        a, b = best_two(after, gap + smallest)
        if a + b > smallest:
            used[smallest] -= 1
            used.update((a, b))
            after[smallest] += 1
            after[[a]] -= 1
            after[[b]] -= 1
            again = fill(after, gap + smallest - a - b)
            used += again
    used = +used
    if again:
        return used, 1
    spare = {k: int(left[k]) - first[k] for k in used}  # as long as none, one, or two and more stay, choices stay
    return used, 1 + min((spare[k] - min(2, spare[k])) // n for k, n in used.items())


def plan(counts: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Rows: the documents number lo to hi of a length lie in sequences from `sequence` on, `per` in each, from
    `offset` on. counts[k] documents have length k. At most some 3 * window steps of at most sqrt(2 * window) rows."""
    left, done = counts.astype(np.int64), np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    while left.any():
        used, times = next_sequence(left, window)
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length] * times
            rows.append((length, done[length], done[length] + n, sequence, used[length], offset))
            done[length] += n
            left[length] -= n
            offset += used[length] * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("length", "lo", "hi", "sequence", "per", "offset"), table.T, strict=True))


def places(plan: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of documents, given their numbers among those of their length."""
    at = np.searchsorted(plan["length"] << 44 | plan["lo"], length << 44 | number, "right") - 1
    i = number - plan["lo"][at]
    return plan["sequence"][at] + i // plan["per"][at], plan["offset"][at] + i % plan["per"][at] * length


def cut(docs: DataFrame, vocabulary: str, window: int, end_id: int | None, tokens: bool, byte_level: bool) -> DataFrame:
    """The pieces of each document, and `number`, of those of its length in the same partition. Written to the shared folder."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "number", *["ids"] * tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = SpanEncoder.get(vocabulary, byte_level, specials=True), np.zeros(window + 1, np.int64)
        for batch in batches:
            for s in flat.slices(batch.column(1), 1 << 20):
                ids, first = enc.encode(s)
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    first = first + np.arange(len(first))
                n = np.diff(first)
                count = -(-n // window)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * window
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * window)
                length = np.where(piece == 0, head[row], window)
                raw, begin = memoryview(ids.astype("<u4").tobytes()), first[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                lengths = np.bincount(length, minlength=window + 1)
                number = np.empty(len(row), np.int64)
                number[order] = seen[length[order]] + np.arange(len(row)) - (np.cumsum(lengths) - lengths)[length[order]]
                seen += lengths
                out = [batch.column(0).slice(s.lo, s.hi - s.lo).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, number))]
                if tokens:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, first[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)
        enc.reset()  # idle workers hold nothing

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long" + ", ids array<int>" * tokens)
    return stored(out.withColumn("part", F.spark_partition_id()))


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = END_ID, tokens: bool = False, byte_level: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and (tokens) ids.

    Documents of up to `window` tokens, their end id included, stay whole. Longer ones are cut into pieces of the
    window's length, but for the first, which takes the rest. Null and empty texts are their end id alone (without an
    end id they have no piece); repeated and null ids and repeated rows are packed each for itself; an empty
    table gives no pieces; columns other than doc_id and text are not read, whatever their names.
    """
    pieces = cut(docs, vocabulary, window, end_id, tokens, byte_level)
    sums = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = np.zeros(window + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `window` rows at most
        counts[r.length] = r.n
    plan_rows = plan(counts, window)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    few = sums.count() <= BROADCAST_STARTS
    joined = pieces.join(F.broadcast(starts) if few else starts, ["length", "part"])
    others = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * tokens]
    numbered = joined.select((F.col("base") + F.col("number")).alias("number"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, length = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            sequence, offset = places(plan_rows, length, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence), pa.array(offset)], [*others, "sequence_id", "offset"])

    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", sequence_id long, offset long")
