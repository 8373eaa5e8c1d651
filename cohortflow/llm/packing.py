"""Mixture-controlled packing (operator 3): deficit round-robin over source queues.

Each source is a queue of tokens. A queue earns credit in proportion to its weight and, when its credit
reaches a quantum, pays a quantum of tokens: its next documents, cut where the quantum ends. What is not
paid is carried, as a deficit, into the next window and across partitions, so that in any stretch of
windows a queue is within a quantum of its share. Because credit grows evenly, the deficits have a closed
form: quantum u of a queue of weight m falls due at (2u + 1) / (2m), and the sequences are cut from the
quanta in order of due time (ties: queue number). Any task can so tell the place of any token from the
queue lengths alone - no sequential scan over windows. Plain deficit round-robin visits the queues in a
fixed circle instead and lets a queue pay for whole documents only. A queue that runs dry leaves its share to
the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flat
from .bpe import SpanEncoder
from .common import small_batches, stored

WINDOW = 2048
END_ID = 1
#: Tokens of a queue that stay together, of a window of 2,048.
QUANTUM = 256
#: Sources that get queues of their own: those of the mixture, then those with most tokens. All others
#: share SHARED_QUEUES by hash, source after source in each, with the weight of their tokens.
MAX_QUEUES, SHARED_QUEUES = 4096, 64
#: Sources times partitions up to which their starts are broadcast (some 40 bytes each); else joined by shuffle.
BROADCAST_STARTS = 1 << 18


class Schedule:
    """The order in which queues pay their quanta."""

    def __init__(self, totals: list[int], weights: list[float], quantum: int):
        self.total = np.array(totals, np.int64)
        self.quantum = quantum
        self.units = -(-self.total // quantum)
        self.rate = np.array(weights, np.float64) / quantum

    def paid(self, due: np.ndarray, strictly: bool = False) -> np.ndarray:
        """Tokens of each queue that fall due until each time (before it, if strictly)."""
        due = due[:, None]
        n = np.floor(np.clip(due * self.rate + 0.5, 0, self.units.astype(np.float64))).astype(np.int64)
        for _ in range(2):  # floor() may be off by one where the division rounds
            later = (2 * n + 1) / (2 * self.rate)
            n += (later < due) if strictly else (later <= due)
            before = (2 * n - 1) / (2 * self.rate)
            n -= ((before >= due) if strictly else (before > due)) & (n > 0)
        return np.minimum(np.clip(n, 0, self.units) * self.quantum, self.total)

    def rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Place of token j of a queue among all tokens."""
        out, step = np.empty(len(j), np.int64), max(1, (1 << 19) // len(self.total))
        for lo in range(0, len(j), step):
            q, t = queue[lo : lo + step], j[lo : lo + step]
            due = (2 * (t // self.quantum) + 1) / (2 * self.rate[q])
            number = np.arange(len(self.total))
            ahead = np.where(number < q[:, None], self.paid(due), self.paid(due, strictly=True))
            out[lo : lo + step] = np.where(number == q[:, None], 0, ahead).sum(1) + t
        return out


def tokenised(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, source_col: str = "source") -> DataFrame:
    """doc_id, source, part, ids (little-endian, end id included; 16 bits each if all ids of the vocabulary
    have that, else 32), n, before: the tokens of the same source that stand earlier in the same partition.
    Written to the shared folder."""
    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession)
    packed = id_type(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = SpanEncoder.get(vocabulary, False), {}
        for batch in batches:
            sources = batch.column(1).to_pylist()
            for s in flat.slices(batch.column(2)):
                ids, first = enc.encode(s)
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    first = first + np.arange(len(first))
                n = np.diff(first)
                before = []
                for src, k in zip(sources[s.lo : s.hi], n.tolist(), strict=True):
                    before.append(seen.get(src, 0))
                    seen[src] = before[-1] + k
                ids = ids.astype(packed)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(first * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), batch.column(1).slice(s.lo, s.hi - s.lo), raw.cast(pa.binary()), pa.array(n), pa.array(before, pa.int64())], ["doc_id", "source", "ids", "n", "before"])
        enc.reset()  # idle workers hold nothing

    rows = docs.select("doc_id", F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, source string, ids binary, n long, before long")
    return stored(out.withColumn("part", F.spark_partition_id()))


def id_type(vocabulary: str, end_id: int | None) -> str:
    ids = SpanEncoder.get(vocabulary, False).tokenizer.get_vocab(with_added_tokens=True).values()
    return "<u2" if max(*ids, end_id or 0) < 1 << 16 else "<u4"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = END_ID, mixture: dict[str, float] | None = None, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens; only the last sequence may be shorter.

    Null and empty texts are their end id alone; null and empty sources share a queue; repeated, equal and
    null doc_ids and repeated rows are packed each for itself; an empty table gives no pieces; columns other
    than doc_id, source and text are not read, whatever their names. Documents of a source are packed in the
    order in which they are read. `mixture` maps sources to weights (others: the smallest of them); without it
    weights are the sources' token counts, so that every window has the corpus's own proportions and all
    queues end together. A document is cut where a quantum of its queue or a window ends.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.
    """
    if not 0 < quantum <= window:
        raise ValueError("quantum: from 1 to window")
    if mixture and len(mixture) > MAX_QUEUES:
        raise ValueError(f"a mixture of more than {MAX_QUEUES} sources")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    tokens = tokenised(docs, vocabulary, end_id)
    packed = id_type(vocabulary, end_id)
    sums = stored(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")))
    named = F.col("source").isin(list(mixture or {}))
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc(named), F.desc("n"), "source").limit(MAX_QUEUES).collect()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"
    if not largest:
        return spark.createDataFrame([], schema)
    own = sorted(r.source for r in largest)
    names = spark.createDataFrame([(source, i) for i, source in enumerate(own)], "source string, queue int")
    shared = (F.pmod(F.xxhash64("source"), F.lit(SHARED_QUEUES)) + len(own)).cast("int")
    # at most MAX_QUEUES rows
    queued = sums.join(F.broadcast(names), "source", "left").withColumn("queue", F.coalesce("queue", shared))
    totals = {r.queue: r.n for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MAX_QUEUES + SHARED_QUEUES at most
    order = sorted(totals)
    number = {q: i for i, q in enumerate(order)}
    least = min(mixture.values()) if mixture else 1.0
    weights = [float(mixture.get(own[q], least) if q < len(own) else least) if mixture else float(totals[q]) for q in order]
    plan = Schedule([totals[q] for q in order], weights, quantum)
    # within a queue: by partition, then by source (shared queues), then as read
    starts = queued.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("part", "source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source", "part", "queue", "base")
    few = sums.count() <= BROADCAST_STARTS
    placed = tokens.join(F.broadcast(starts) if few else starts, ["source", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pieces(batch, plan, number, window, packed)

    return placed.mapInArrow(run, schema)


def split(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of the spans begin..end between multiples of size: number of the span, begin, end."""
    first = begin // size
    count = (end - 1) // size - first + 1
    row = np.repeat(np.arange(len(count)), count)
    k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, np.maximum(begin[row], k * size), np.minimum(end[row], (k + 1) * size)


def pieces(batch: pa.RecordBatch, plan: Schedule, number: dict[int, int], window: int, packed: str) -> pa.RecordBatch:
    queue_ids, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    queue = np.array([number[q] for q in queue_ids.tolist()], np.int64)
    row, begin, end = split(at, at + n, plan.quantum)
    place = plan.rank(queue[row], begin)
    # quanta of a document that follow one another in the sequences are one piece
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + (end - begin)[:-1])
    head = np.flatnonzero(new)
    row, start, place = row[head], (begin - at[row])[head], place[head]
    length = np.add.reduceat(end - begin, head) if len(head) else np.zeros(0, np.int64)
    which, first, last = split(place, place + length, window)
    row, start, length = row[which], start[which] + first - place[which], last - first
    raw = [np.frombuffer(x.as_buffer(), packed).astype("<u4").tobytes() for x in batch.column(4)]
    crc = [zlib.crc32(memoryview(raw[r])[4 * a : 4 * (a + k)]) for r, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
    out = [batch.column(0).take(pa.array(row)), start, length, np.array(crc, np.int64), n[row], first // window, first % window, queue_ids[row]]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)
