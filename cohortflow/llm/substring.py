"""Substring dedup by words (operator 4): a log-structured fingerprint index.

An index is a list of immutable runs, tables of winnowed window hashes bucketed and sorted by hash.
append() writes a batch's hashes as a new run and merge-joins it with the runs before it (equal
buckets: no shuffle); hashes found in more than one place are kept as hits. When a level holds `fanout`
runs they are compacted into one run of the next level. repeated() verifies: windows behind hits
are compared by 128 bits of their own hashes, so that equal samples alone remove nothing. Rows of crowded
hashes (spans.py) are hits anyway: they lie in the runs by kind, and take no part in the merge-joins.

Each append ends by writing a manifest (runs by level, number of hit tables and tables of crowded hashes) into the index's folder: a
later session opens the index from there and appends to it. An append that was cut short leaves no manifest, so
that it can be repeated.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flat, spans
from .common import drop_stored, keyed, shared_dir, stored

WINDOW, INNER = 35, 12
MANIFEST = "appends int, change int, state string"
#: Rows of a run that lie by their own fp.
BY_FP = f"at >= 0 AND at < {spans.CROWDED}"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


class FingerprintIndex:
    def __init__(self, spark: SparkSession, window: int = WINDOW, inner: int = INNER, fanout: int = 4, buckets: int | None = None, folder: str | None = None):
        """A new index, in a folder of its own below the shared one unless `folder` names another."""
        self.spark, self.window, self.inner, self.fanout = spark, window, inner, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = (folder or shared_dir(spark)).rstrip("/")
        self.levels: list[list[str]] = [[]]
        self.retired: list[str] = []
        self.hits: list[DataFrame] = []
        self.crowds: list[DataFrame] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that the newest manifest in `folder` describes; its runs are entered in this session's catalog."""
        newest = spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/manifest_*").orderBy(F.desc("appends"), F.desc("change")).first()
        state = json.loads(newest.state)
        index = cls(spark, state["window"], state["inner"], state["fanout"], state["buckets"], folder)
        index.levels, index.retired = state["levels"], state["retired"]
        index.hits, index.crowds = ([spark.read.schema("fp long").parquet(f"{index.folder}/{kind}_{k}") for k in range(newest.appends)] for kind in ("hits", "crowd"))
        for name in [*index.runs(), *index.retired]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({spans.ROWS}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{index.folder}/{name}'")
        return index

    def save(self, change: int = 0) -> None:
        state = {x: getattr(self, x) for x in ("window", "inner", "fanout", "buckets", "levels", "retired")}
        row = self.spark.createDataFrame([(len(self.hits), change, json.dumps(state))], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest_{len(self.hits)}_{change}")

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def write_run(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(self.buckets, "fp").sortWithinPartitions("fp")
        sorted_rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def append(self, docs: DataFrame) -> None:
        """docs: _key (unique over all batches), text."""
        mine = spans.crowded(docs, "words", self.window, self.inner, f"{self.folder}/crowd_{len(self.crowds)}")
        crowd = union([*self.crowds, mine]).distinct()
        name = self.write_run(spans.placed(docs, "words", self.window, self.inner, crowd))
        new = self.spark.table(name).where(BY_FP).select("fp")
        found = [new.groupBy("fp").count().where("count > 1").select("fp")]
        for old in self.runs():
            found.append(new.join(self.spark.table(old).where(BY_FP).select("fp").hint("merge"), "fp", "left_semi"))
        self.hits.append(stored(union([*found, crowd]).distinct(), f"{self.folder}/hits_{len(self.hits)}"))
        self.crowds.append(mine)
        self.levels[0].append(name)
        self.compact()
        self.save()

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                name = self.write_run(merged)
                self.retired += level
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(name)

    def vacuum(self) -> None:
        """Delete the runs that compaction replaced, once no result that was made before it is still to be read."""
        for old in self.retired:
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            drop_stored(self.spark, f"{self.folder}/{old}")
        self.retired = []
        self.save(change=1)

    def repeated(self, docs: DataFrame, columns: tuple = ()) -> DataFrame:
        """key, list: for each indexed document of docs the windows that also start anywhere else
        (first << 8 | count, in words)."""
        hits = union(self.hits).distinct()
        rows = marked = None
        for name in self.runs():
            run = self.spark.table(name)
            part, done = run.where(BY_FP).join(hits, "fp", "left_semi"), run.where("at < 0")
            rows, marked = (part, done) if rows is None else (rows.unionByName(part), marked.unionByName(done))
        # in earlier runs, hashes that became crowded later, or over all batches together, still lie by their own fp
        rows = spans.dealt(rows, union([*self.crowds, spans.crowded(docs, "words", self.window, self.inner)]).distinct())
        for name in self.runs():
            rows = rows.unionByName(self.spark.table(name).where(f"at >= {spans.CROWDED}"))
        judged = spans.judged(rows, later_only=False)
        whole = judged.where("whole").select("key", "at").union(marked.select("key", (-1 - F.col("at")).alias("at")))
        edges = spans.lists(judged.where("edge"), F.struct(F.when(F.col("crowded"), F.lit(0)).otherwise(F.col("fp")).alias("fp"), "at", "whole"))
        same = W.partitionBy("fp", "h1", "h2")
        compared = spans.with_text(docs, edges, "inner", partial(window_hashes, window=self.window), "fp long, h1 long, h2 long, key long, at long, whole boolean", *columns)
        single = compared.withColumn("n", F.count("*").over(same)).where("(n > 1 OR at < 0) AND NOT whole").select("key", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"))
        return spans.lists(whole.union(single), F.col("at"))


def window_hashes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of the edges: over the words' hashes, and over their bytes' hashes of the other family.

    Third and further copies within spans.TOGETHER windows go (at < 0, in runs); the two before them tell others.
    """
    def flush(found: list) -> pa.RecordBatch:
        fp, h1, h2, key, at, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        more = spans.copies_before(h1, h2, key, at) >= 2
        go = more & ~whole
        k, run = spans.runs(key[go], at[go] >> 8)
        apart, no = spans.spread(k, run), np.zeros(len(k), np.int64)
        rows = zip((no, apart, no, k, -1 - run, no.astype(bool)), (fp, h1, h2, key, at, whole), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y[~more]])) for x, y in rows], ["fp", "h1", "h2", "key", "at", "whole"])

    found, size = [], 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for s in flat.slices(batch.column(1), 1 << 18):
            w = flat.words(s)
            sums, raw = flat.prefix(w.hash), flat.prefix(s.data, 1)
            row, fp, at, whole = spans.listed(batch.column(2), s.lo, s.hi)
            count = at & 255
            e = np.repeat(np.arange(len(at)), count)
            first = (at >> 8)[e] + np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count)
            i = w.first[row[e] - s.lo] + first
            inside = np.zeros(len(e), np.uint64)
            for k in range(window):  # words alone, not the white space between them
                inside = flat.mix(inside + flat.span_hash(raw, w.start[i + k], w.end[i + k], 1))
            found.append((fp[e], flat.span_hash(sums, i, i + window).view(np.int64), inside.view(np.int64), keys[row[e]], first << 8 | 1, whole[e].astype(bool)))
            size += len(e)
            if size >= spans.TOGETHER:
                yield flush(found)
                found, size = [], 0
    if found:
        yield flush(found)


def removed(docs: DataFrame, repeated: DataFrame, window: int, *columns: str, texts: bool = False) -> DataFrame:
    """doc_id, columns, n_words, n_removed, and kept_sha256 or (texts) kept: the kept words joined by spaces,
    but the text as it was where all words stay."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for s in flat.slices(batch.column(1), 1 << 20):
                w = flat.words(s)
                raw = s.data.tobytes()
                for r in range(s.lo, s.hi):
                    a, b = w.first[r - s.lo], w.first[r - s.lo + 1]
                    gone = spans.covered(windows[r] or [], b - a, window)
                    stay = np.flatnonzero(~gone) + a
                    if texts and len(stay) == b - a:
                        text = raw[s.off[r - s.lo] : s.off[r - s.lo + 1]]
                    else:
                        text = b" ".join([raw[i:j] for i, j in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)])
                    n_words.append(b - a)
                    n_removed.append(b - a - len(stay))
                    kept.append(text.decode("utf-8", "replace") if texts else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*batch.schema.names[3:], "n_words", "n_removed", "kept"])

    columns = ("doc_id", *columns)
    out = spans.with_text(docs, repeated, "left", run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_words long, n_removed long, kept string", *columns)
    return out if texts else out.withColumnRenamed("kept", "kept_sha256")


def dedup(docs: DataFrame, *columns: str, window: int = WINDOW, inner: int = INNER, batches: int = 2, texts: bool = False) -> DataFrame:
    """Remove every word in a window of `window` words that also starts anywhere else in docs.

    The documents enter the index in `batches` batches, as they would day by day, with as many runs to a level
    (from two to four), so that a level is compacted. Null and empty texts
    have no words; texts shorter than a window lose none; repeated doc_ids are separate documents (so
    identical rows remove one another); an empty table gives no rows. Extra columns do no harm.
    """
    docs = keyed(docs, "doc_id", "text", *columns)
    index = FingerprintIndex(docs.sparkSession, window, inner, fanout=max(2, min(4, batches)))
    for k in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64("_key"), F.lit(batches)) == k))
    return removed(docs, index.repeated(docs, ("doc_id", *columns)), window, *columns, texts=texts)
