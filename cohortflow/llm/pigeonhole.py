"""Embedding near-dedup (operator 5): subspace pigeonhole join.

Unit vectors of cosine c differ by a squared distance of 2 - 2c. Rotated at random and cut into blocks,
a pair within that distance is, in one block at least, within the block's share of it (its part of the
dimensions). Each block is range-joined for itself: points lie in a grid of cells as wide as the
block's radius, so partners are in the same or a neighbouring cell; cells meet as chunks of bounded
size. The union of the candidates is verified by exact cosine.

Equal vectors form one class first: copies meet nobody twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import stored
from .components import components


@dataclass(frozen=True)
class Params:
    cosine: float = 0.93
    blocks: int = 4
    grid: int = 1  # coordinates of a block that make its cells
    chunk: int = 1024  # points of a cell that go together, on average
    seed: int = 5


def blocks(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """key, label, part (dimension and block), cell, xs: each vector's coordinates in each block."""
    for batch in batches:
        keys, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for rows in V.by_dimension(batch.column(2)):
            x = V.matrix(batch.column(2).take(pa.array(rows)))
            d = x.shape[1]
            scale = np.abs(x).max(1, keepdims=True)
            x = x / scale
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ V.rotation(d, p.seed)
            for b, dims in enumerate(np.array_split(np.arange(d), min(p.blocks, d))):
                radius = np.sqrt((2 - 2 * p.cosine) * len(dims) / d) * (1 + 1e-5)
                cell = np.floor(x[:, dims[: p.grid]] / radius).astype(np.int64)
                xs = np.ascontiguousarray(x[:, dims], np.float32)
                packed = pa.array([r.tobytes() for r in xs], pa.binary())
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * cell.shape[1], pa.int32()), pa.array(cell.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(labels[rows]), pa.array(np.full(len(rows), d * 1000 + b)), cells, packed], ["key", "label", "part", "cell", "xs"])


def close(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Pairs of two chunks that are within the radius in this block."""
    for batch in batches:
        for r in batch.to_pylist():
            d = r["part"] // 1000
            x = np.frombuffer(b"".join(q["xs"] for q in r["left"]), np.float32).reshape(len(r["left"]), -1)
            y = np.frombuffer(b"".join(q["xs"] for q in r["right"]), np.float32).reshape(len(r["right"]), -1)
            budget = (2 - 2 * p.cosine) * x.shape[1] / d
            far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
            i, j = np.nonzero(far <= budget * (1 + 1e-4) + 1e-5)
            a = np.array([q["key"] for q in r["left"]], np.int64)[i]
            b = np.array([q["key"] for q in r["right"]], np.int64)[j]
            keep = a < b if r["same"] else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[keep]), pa.array(np.minimum(a, b)[keep])], ["a", "b"])


def verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for rows in V.by_dimension(batch.column(2)):
            x, y = (V.matrix(batch.column(c).take(pa.array(rows))) for c in (2, 3))
            x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
            keep[rows] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def links(points: DataFrame, p: Params) -> DataFrame:
    """a, b of all pairs with equal label and cosine >= p.cosine; points: key, label, vec (valid)."""
    placed = stored(points.select("key", "label", "vec").mapInArrow(partial(blocks, p=p), "key long, label long, part long, cell array<long>, xs binary"))
    where = ["label", "part", "cell"]
    size = placed.groupBy(*where).agg(F.ceil(F.count("*") / p.chunk).alias("chunks"))
    salted = placed.join(size, where).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("chunks")))
    chunks = stored(salted.groupBy(*where, "salt").agg(F.collect_list(F.struct("key", "xs")).alias("points")))
    steps = [s for s in product((-1, 0, 1), repeat=p.grid) if s >= (0,) * p.grid]  # itself and half of its neighbours
    reach = F.array(*[F.zip_with("cell", F.array(*[F.lit(x).cast("long") for x in s]), lambda a, b: a + b) for s in steps])
    left = chunks.select("label", "part", F.col("cell").alias("home"), F.col("salt").alias("salt_a"), F.col("points").alias("left"), F.explode(reach).alias("cell"))
    right = chunks.select(*where, F.col("salt").alias("salt_b"), F.col("points").alias("right"))
    met = left.join(right, where).where((F.col("home") != F.col("cell")) | (F.col("salt_a") <= F.col("salt_b")))
    same = (F.col("home") == F.col("cell")) & (F.col("salt_a") == F.col("salt_b"))
    pairs = met.select("part", "left", "right", same.alias("same")).mapInArrow(partial(close, p=p), "a long, b long").distinct()
    vecs = points.select("key", "vec")
    both = pairs.join(vecs.select(F.col("key").alias("a"), F.col("vec").alias("x")), "a").join(vecs.select(F.col("key").alias("b"), F.col("vec").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(partial(verify, least=p.cosine), "a long, b long")


def near_duplicates(vectors: DataFrame, params: Params | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id that links reach), kept: one row per vector.

    Null labels and vectors that are null, zero, or hold null or non-finite components have no links.
    Vectors of different dimension do not link. If ids repeat or are null, vectors are numbered by (id,
    vector, label), and component_id is the number. Equal vectors of a label link like others; a cosine of exactly the threshold
    links. An empty table gives no rows; other columns are not read, whatever their names.
    """
    p = params or Params()
    rows = V.keyed_vectors(vectors, id_col, vec_col, label_col)
    good = rows.where(V.valid(vec_col) & F.col(label_col).isNotNull()).select("_key", F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    classes = stored(good.groupBy("label", "vec").agg(F.min("_key").alias("key"), F.count("*").alias("copies")))
    found = stored(links(classes, p))
    copies = classes.select("key", "copies")
    ends = found.select(F.col("a").alias("key"), F.col("b").alias("other")).union(found.select("b", "a"))
    degree = ends.join(copies.select(F.col("key").alias("other"), "copies"), "other").groupBy("key").agg(F.sum("copies").alias("others"))
    label = components(found).withColumnRenamed("id", "key")
    of_class = classes.join(degree, "key", "left").join(label, "key", "left").select("label", "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component_id"))
    of_key = good.join(of_class, ["label", "vec"]).select("_key", "n_links", "component_id")
    out = rows.select("_key", F.col(id_col).alias("vec_id")).join(of_key, "_key", "left")
    component = F.coalesce("component_id", "_key")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("_key")).alias("kept"))
