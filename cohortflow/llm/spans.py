"""Windows of texts that stand elsewhere too: what substring dedup by words (4) and by bytes (8) share.

1. winnowed(): each text's windows, grouped by their smallest inner hash (flat.anchors): some 2 rows per
   window length instead of one row per window. Equal windows always lie in rows of equal `fp`.
2. Rows whose fp occurs once are done. Rows with equal `span` (hash of all text the row's windows cover)
   hold the same windows: they are judged as a whole.
3. What is left - one row of each kind, where an fp has several kinds - are `edges` of repeated
   passages. Their windows are compared one by one (by the operator).
4. removed(): one list of removed windows per document meets the text again.

Columns: fp, span, key (of the document), at = first window << 8 | number of windows. Third and further
copies within TOGETHER rows of a task are marked at once (at < 0, fp spread over all partitions): a passage that
a third of all documents share then sends two rows in TOGETHER, not one a document, to its partition.

A passage in ever different surroundings has one fp and as many kinds. crowded() finds such fps in a sample of
the documents; it decides only how rows are dealt(), never what is removed. Their rows (at >= CROWDED, fp ^ span
for fp) are spread over all partitions by kind, all kinds are edges, and their windows are dealt one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flat
from .common import stored

TOGETHER = 1 << 18
CROWDED = 1 << 62
#: An fp is crowded with CROWD rows or more in one of SAMPLE documents: some 256 rows in all.
SAMPLE, CROWD = 32, 8
#: Crowded fps up to which they go with the tasks (8 bytes each); more of them are joined by shuffle.
BROADCAST_CROWD = 1 << 18
ROWS = "fp long, span long, key long, at long"


def units(s: flat.Slice, by: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over the units (words or bytes) of a slice, and where rows start in them."""
    if by == "words":
        w = flat.words(s)
        return flat.prefix(w.hash), w.first
    return flat.prefix(s.data), s.off


def copies_before(fp: np.ndarray, span: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many rows with the same fp and span are smaller by key and at, whatever the order of the rows."""
    order = np.lexsort((at, key, span, fp))
    a, b = order[1:], order[:-1]
    same = np.zeros(len(order), bool)
    same[1:] = (fp[a] == fp[b]) & (span[a] == span[b])
    i = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = i - np.maximum.accumulate(np.where(same, 0, i))
    return out


def spread(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An fp of its own for rows that need no others."""
    return flat.mix(key.view(np.uint64) * np.uint64(3) + at.view(np.uint64)).view(np.int64)


def runs(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key and at of runs of consecutive windows, given each window by itself."""
    order = np.lexsort((first, key))
    key, first = key[order], first[order]
    i = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1] + 1)
    new |= (i - np.maximum.accumulate(np.where(new, i, 0))) % 128 == 0  # counts have 8 bits
    start = np.flatnonzero(new)
    return key[start], first[start] << 8 | np.diff(np.append(start, len(key)))


def crowded(docs: DataFrame, by: str, window: int, inner: int, path: str | None = None) -> DataFrame:
    """fp: the crowded ones, a stored table of rows / (SAMPLE * CROWD) at most."""
    sample = docs.where(F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(SAMPLE)) == 0)
    counts = winnowed(sample, by, window, inner).where("at >= 0").groupBy("fp").count()
    return stored(counts.where(F.col("count") >= CROWD).select("fp"), path)


def few(crowd: DataFrame) -> np.ndarray | None:
    """The crowded fps in order, if they are BROADCAST_CROWD at most."""
    found = crowd.limit(BROADCAST_CROWD + 1).toArrow().column(0).to_numpy()
    return np.sort(found) if len(found) <= BROADCAST_CROWD else None


def by_kind(fp: np.ndarray, span: np.ndarray, at: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fp and at, those of crowded fps dealt by kind."""
    if not len(crowd):
        return fp, at
    mine = (at >= 0) & (at < CROWDED) & (crowd[np.minimum(np.searchsorted(crowd, fp), len(crowd) - 1)] == fp)
    return np.where(mine, fp ^ span, fp), np.where(mine, at | CROWDED, at)


def dealt(rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """rows as winnowed() makes them, those of crowded fps (fp, distinct) dealt by kind."""
    known = few(crowd)
    if known is None:
        of_crowd = F.col("c").isNotNull() & (F.col("at") >= 0) & (F.col("at") < F.lit(CROWDED))
        fp = F.when(of_crowd, F.col("fp").bitwiseXOR(F.col("span"))).otherwise(F.col("fp"))
        at = F.when(of_crowd, F.col("at") + F.lit(CROWDED)).otherwise(F.col("at"))
        return rows.join(crowd.withColumn("c", F.lit(True)), "fp", "left").select(fp.alias("fp"), "span", "key", at.alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, at = by_kind(*(batch.column(i).to_numpy() for i in (0, 1, 3)), known)
            yield pa.RecordBatch.from_arrays([pa.array(fp), batch.column(1), batch.column(2), pa.array(at)], ["fp", "span", "key", "at"])

    return rows.select("fp", "span", "key", "at").mapInArrow(run, ROWS) if len(known) else rows


def placed(docs: DataFrame, by: str, window: int, inner: int, crowd: DataFrame) -> DataFrame:
    """winnowed(), dealt()."""
    known = few(crowd)
    return dealt(winnowed(docs, by, window, inner), crowd) if known is None else winnowed(docs, by, window, inner, known)


def winnowed(docs: DataFrame, by: str, window: int, inner: int, crowd: np.ndarray | None = None) -> DataFrame:
    """docs: _key, text. crowd: fps whose rows are dealt by kind."""
    if window - inner > 254:
        raise ValueError("windows that share an inner hash are counted in 8 bits: window - inner is at most 254")

    def flush(found: list) -> pa.RecordBatch:
        fp, span, key, at = (np.concatenate(x).astype(np.int64, copy=False) for x in zip(*found, strict=True))
        more = copies_before(fp, span, key, at) >= 2
        at = np.where(more, -1 - at, at)
        if crowd is not None:
            fp, at = by_kind(fp, span, at, crowd)
        fp = np.where(more, spread(key, at), fp)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, span, key, at)], ["fp", "span", "key", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for s in flat.slices(batch.column(1), 1 << 18):
                a = flat.anchors(*units(s, by), window, inner)
                found.append((a.key, a.span, keys[s.lo + a.row], a.start << 8 | a.count))
                size += len(a.key)
                if size >= TOGETHER:
                    yield flush(found)
                    found, size = [], 0
        if found:
            yield flush(found)

    return docs.select("_key", "text").mapInArrow(run, ROWS)


def judged(rows: DataFrame, later_only: bool) -> DataFrame:
    """rows plus `whole` (all its windows go), `edge` (its windows need comparing one by one), `crowded`.

    later_only: a window goes if it also starts earlier; else if it starts anywhere else too.
    """
    kind = W.partitionBy("fp", "span")
    in_order = kind.orderBy("key", "at")
    rows = rows.withColumn("rn", F.row_number().over(in_order)).withColumn("kinds", F.sum(F.when(F.col("rn") == 1, 1).otherwise(0)).over(W.partitionBy("fp")))
    twice = F.col("rn") > 1 if later_only else F.count("*").over(kind) > 1
    crowd = F.col("at") >= CROWDED
    place = F.when(F.col("at") < 0, -1 - F.col("at")).when(crowd, F.col("at") - F.lit(CROWDED)).otherwise(F.col("at"))
    edge = (F.col("at") >= 0) & (F.col("rn") == 1) & ((F.col("kinds") > 1) | crowd)
    return rows.select("fp", "key", place.alias("at"), ((F.col("at") < 0) | twice).alias("whole"), edge.alias("edge"), crowd.alias("crowded"))


def lists(rows: DataFrame, what: Column) -> DataFrame:
    """One list per document; it is no longer than the document."""
    return rows.groupBy("key").agg(F.collect_list(what).alias("list"))


def listed(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """The structs in the lists of rows lo..hi: row numbers, then each field."""
    part = column.slice(lo, hi - lo)
    row = np.repeat(np.arange(lo, hi), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat_structs = part.flatten()
    return row, *(x.to_numpy(zero_copy_only=False) for x in flat_structs.flatten())


def with_text(docs: DataFrame, per_doc: DataFrame, how: str, run: Callable, schema: str, *columns: str) -> DataFrame:
    """Join lists to texts by document and map the result. The texts are shuffled by key, once for all
    calls within a query that ask for the same columns; lists are never broadcast, however few they are."""
    joined = docs.select("_key", "text", *columns).join(per_doc.withColumnRenamed("key", "_key").hint("merge"), "_key", how)
    return joined.select("_key", "text", "list", *columns).mapInArrow(run, schema)


def covered(windows: list[int] | np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n units lie in one of the windows (first << 8 | count)."""
    x = np.asarray(windows, np.int64)
    start, end = x >> 8, (x >> 8) + (x & 255) - 1 + window
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0
