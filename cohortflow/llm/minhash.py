"""MinHash near-dedup (operator 2) with DartMinHash signatures.

Darts (Christiani 2020): over the plane of an element's weight and time, darts fall as a Poisson process,
the same for every document that holds the element; each carries one of `size` coordinates. A
document keeps, for each coordinate, the earliest dart that falls within its elements' weights. Two
signatures agree in a coordinate with probability of the weighted Jaccard similarity. Only darts until
all coordinates are hit need throwing: some size * (ln size + 4) for a whole document, instead of
size for every element.

Signatures are cut into bands; documents that share a band meet. Copies of a text meet once, as one
class. Within a band documents are not paired with one another but with the band's hub, and the exact
Jaccard similarity decides. Documents of bands that the hubs have not connected - near copies below the
threshold may be thousands, and each of their pairs shares some band - then meet where they share a
rare shingle (rare_pairs), which loses no pair of the threshold and makes no rows for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import aside, back, drop_stored, keyed, shared_dir, stored
from .components import components


@dataclass(frozen=True)
class Params:
    """A pair of similarity 0.8 shares one of 30 bands of 6 with probability 1 - 1e-4."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 30
    rows: int = 6
    counted: bool = False  # weight of a shingle: its count; else 1


#: Time is cut at FIRST, 2 FIRST, 4 FIRST, ..., weight at 1, 2, 4, ...
FIRST = 2.0**-12


@lru_cache(256)
def poisson_table(mean: float) -> np.ndarray:
    """P(count <= n) for n = 0, 1, ... until it is 1."""
    n = int(mean + 12 * mean**0.5 + 24)
    i = np.arange(n + 1)
    log = i * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(i[1:]))])
    return np.cumsum(np.exp(log))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def throw(earliest: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, time_band: int, weight_band: int, size: int) -> None:
    """Throw the darts of one cell of the plane for all elements; earliest: (docs, size) times."""
    t0, dt = (0.0, FIRST) if time_band == 0 else (FIRST * 2.0 ** (time_band - 1), FIRST * 2.0 ** (time_band - 1))
    w0, dw = (0.0, 1.0) if weight_band == 0 else (2.0 ** (weight_band - 1), 2.0 ** (weight_band - 1))
    cell = flat.mix(element ^ flat.mix(np.uint64(time_band << 8 | weight_band) + np.uint64(0x51ED)))
    count = np.searchsorted(poisson_table(size * dt * dw), uniform(cell), "right")
    some = np.flatnonzero(count)
    n = count[some]
    e = np.repeat(some, n)
    i = (np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    dart = flat.mix(cell[e] + (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    inside = w0 + dw * uniform(flat.mix(dart + np.uint64(1))) <= weight[e]
    e, dart = e[inside], dart[inside]
    slot = doc[e] * size + (dart % np.uint64(size)).astype(np.int64)
    np.minimum.at(earliest.reshape(-1), slot, t0 + dt * uniform(flat.mix(dart + np.uint64(2))))


def signatures(first: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """(docs, size) earliest times; element[first[d]:first[d+1]] are the hashes of document d's elements,
    repeats do no harm. Documents without elements have infinite times."""
    docs = len(first) - 1
    earliest = np.full((docs, size), np.inf)
    doc = np.repeat(np.arange(docs), np.diff(first))
    total = np.bincount(doc, weight, docs)
    need = (np.log(size) + 4) / np.maximum(total, 1e-9) / FIRST
    last = np.ceil(np.log2(np.maximum(need, 1))).astype(np.int64)  # the time band that likely completes it
    top = int(np.ceil(np.log2(max(1.0, weight.max(initial=1.0))))) if len(weight) else 0
    band, open_ = 0, np.flatnonzero(total > 0)
    while len(open_):
        mine = np.isin(doc, open_) if len(open_) < docs else slice(None)
        for weight_band in range(top + 1):
            low = 0 if weight_band == 0 else 2.0 ** (weight_band - 1)
            d, e, w = doc[mine], element[mine], weight[mine]
            if low:
                d, e, w = d[w > low], e[w > low], w[w > low]
            throw(earliest, d, e, w, band, weight_band, size)
        open_ = open_[(last[open_] > band) | np.isinf(earliest[open_]).any(1)]
        band += 1
    return earliest


def shingles(s: flat.Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `words` words of each row, and where rows start in them. A text of fewer
    words is one run; one without words has none."""
    w = flat.words(s)
    sums, n = flat.prefix(w.hash), np.diff(w.first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = w.first[row] + np.arange(len(row)) - first[row]
    return flat.span_hash(sums, start, start + np.minimum(words, n[row])), first


def counted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row with their counts."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(h)))
    return h[head], count, np.searchsorted(row[head], np.arange(len(first)))


def sign(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """_key, copy (128-bit digest of the text), bands."""
    size = p.bands * p.rows
    for batch in batches:
        copies, bands, lengths = [], [], []
        for s in flat.slices(batch.column(1), 1 << 18):
            h, first = shingles(s, p.words)
            weight = np.ones(len(h))
            if p.counted:
                h, weight, first = counted(h, first)
            sig = signatures(first, h, weight.astype(np.float64), size).view(np.uint64).reshape(-1, p.bands, p.rows)
            value = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), sig.shape[:2])
            for k in range(p.rows):
                value = flat.mix(value * np.uint64(31) + sig[:, :, k])
            bands.append(value[np.diff(first) > 0].reshape(-1))
            lengths.append(np.where(np.diff(first) > 0, p.bands, 0))
            raw = memoryview(s.data.tobytes())
            copies += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True)]
        if copies:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), pa.int32()), pa.array(np.concatenate(bands).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies, pa.binary()), lists], ["_key", "copy", "bands"])


def shingle_sets(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, sizes = [], []
        for s in flat.slices(batch.column(1), 1 << 20):
            h, count, first = counted(*shingles(s, p.words))
            if p.counted:  # the c-th time a shingle comes is an element of its own
                e = np.repeat(np.arange(len(h)), count)
                c = np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count)
                first = np.concatenate([[0], np.cumsum(count)])[first]
                h = flat.mix(h[e] + c.astype(np.uint64))
            lists.append(h)
            sizes.append(np.diff(first))
        if sizes:
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            values = pa.array(np.concatenate(lists).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)], ["key", "set"])


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of the pairs a, b with their sets those of Jaccard similarity `least` or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common >= least * (len(both) - common) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def least_common(x: Column, y: Column, least: float) -> Column:
    """How many elements two sets of these sizes have in common if their Jaccard similarity is `least`."""
    return F.ceil((x + y) * (least / (1 + least)) - 1e-6)


def rare_pairs(docs: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of docs (key, component, set) of different components whose sets can have the Jaccard
    similarity `least`: an exact prefix filter (Bayardo 2007, Xiao 2008) on shingles in order of rarity.

    Two such sets have one of the rarest shingles of both in common, early enough for what follows it to
    reach the common size; the join holds that condition, so a pair that cannot reach it is never a row. Within a
    shingle the documents of its largest component meet only those of others.
    """
    shingle = docs.select("key", "component", F.size("set").alias("n"), F.explode("set").alias("h"))
    shared = shingle.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    ranked = shingle.join(shared, "h").groupBy("key", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("in_order"))
    alone = F.col("n") - F.size("in_order")  # shingles of no other document come first, and cannot be met
    early = F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1
    front = ranked.select("key", "component", "n", F.posexplode(F.slice("in_order", 1, F.greatest(early - alone, F.lit(0)).cast("int"))).alias("i", "fh"), alone.alias("alone"))
    front = stored(front.select("key", "component", "n", F.col("fh.h").alias("h"), (F.col("n") - F.col("alone") - F.col("i") - 1).alias("after")))
    main = front.groupBy("h", "component").count().groupBy("h").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    columns = ("h", "key", "component", "n", "after")
    x = front.join(main, "h").where("component <> main").select(*[F.col(c).alias(f"{c}_x") for c in columns])
    y = front.select(*[F.col(c).alias(f"{c}_y") for c in columns])
    reach = 1 + F.least("after_x", "after_y") >= least_common(F.col("n_x"), F.col("n_y"), least)
    met = x.join(y, (F.col("h_x") == F.col("h_y")) & (F.col("component_x") != F.col("component_y")) & reach)
    return met.select(F.greatest("key_x", "key_y").alias("a"), F.least("key_x", "key_y").alias("b")).distinct()


#: Up to so many keys (8 bytes each) are broadcast; beyond that the join shuffles both sides.
BROADCAST_KEYS = 1 << 20


def of_keys(rows: DataFrame, keys: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """The rows whose `name` is in keys (left_anti: is not)."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, name, how)


def labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """rows (key, ...) with their component, their own key where no link is known."""
    if label is None:
        return rows.withColumn("component", F.col("key"))
    return rows.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))


def classes_of(docs: DataFrame, p: Params) -> DataFrame:
    """docs: _key, text. Returns _key, component (smallest _key of the class), copies."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    part = iter(range(100))

    def kept(df: DataFrame) -> DataFrame:
        return stored(df, f"{folder}/{next(part)}")

    signed = kept(docs.select("_key", "text").mapInArrow(partial(sign, p=p), "_key long, copy binary, bands array<long>"))
    classes = kept(signed.groupBy("copy").agg(F.min("_key").alias("key"), F.count("*").alias("copies")))
    members = signed.join(classes.select(F.col("key").alias("_key")), "_key", "left_semi").select(F.col("_key").alias("key"), F.explode("bands").alias("band"))
    size = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = kept(members.join(size, "band"))
    keys = members.select("key").distinct()
    sets = kept(of_keys(docs.select("_key", "text"), keys.select(F.col("key").alias("_key")), "_key").mapInArrow(partial(shingle_sets, p=p), "key long, set array<long>"))

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.withColumnRenamed("key", "a").withColumnRenamed("set", "x"), "a").join(sets.withColumnRenamed("key", "b").withColumnRenamed("set", "y"), "b")
        return kept(both.select("a", "b", "x", "y").mapInArrow(partial(similar, least=p.similarity), "a long, b long"))

    # each band's documents meet its hub, the one that meets most others in all its bands
    hubs = members.groupBy("key").agg(F.sum(F.col("size") - 1).alias("others"))
    ranked = members.join(hubs, "key")
    centre = ranked.groupBy("band").agg(F.max_by("key", F.struct("others", -F.col("key"))).alias("hub"))
    links = near(members.join(centre, "band").where("hub <> key").select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct())
    label = None if links.isEmpty() else components(links, f"{folder}/{next(part)}").withColumnRenamed("id", "key")
    # bands of three and more whose documents are not all connected: there the rarest shingles decide
    crowded = labelled(members.where("size > 2").select("key", "band"), label)
    mixed = crowded.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    rest = kept(crowded.join(mixed, "band", "left_semi").select("key", "component").distinct())
    if not rest.isEmpty():
        more = near(rare_pairs(rest.join(sets, "key"), p.similarity))
        if not more.isEmpty():
            links = links.union(more)
            label = components(links, f"{folder}/{next(part)}").withColumnRenamed("id", "key")
    of_class = labelled(classes, label)
    of_key = signed.select("_key", "copy").join(of_class.select("copy", "component", "copies"), "copy")
    out = stored(of_key.select("_key", "component", "copies"))
    drop_stored(spark, folder)
    return out


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept (doc_id = class_id), copies (documents of the
    same text): one row per document. Classes are what copies and pairs of Jaccard similarity >= 0.8 over
    runs of five words connect.

    Null texts count as empty; texts without words are classes of their own copies, texts of one to four
    words are one run. If doc_ids repeat or are null, documents are numbered by (doc_id, text), and
    class_id is the number. An empty table gives no rows; extra columns do no harm.
    """
    p = params or Params()
    docs = keyed(docs)
    of_key = classes_of(docs, p)
    return docs.select("_key", "doc_id").join(of_key, "_key").select("doc_id", F.col("component").alias("class_id"), (F.col("_key") == F.col("component")).alias("kept"), "copies")


def keep_one(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class."""
    renamed, others = aside(docs, "doc_id", "text")
    rows = keyed(renamed, "doc_id", "text", *others)
    later = classes_of(rows, params or Params()).where("_key <> component").select("_key")
    return back(of_keys(rows, later, "_key", "left_anti"), docs.columns, "doc_id", "text")
