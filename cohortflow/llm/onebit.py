"""Approximate nearest neighbours (operator 10): randomly rotated one-bit codes (RaBitQ, Gao and Long 2024).

A vector's direction, rotated at random, is kept as its signs: one bit a dimension. From the signs'
inner product with a rotated query, over the alignment of the signs with the vector itself, follows an
unbiased estimate of the cosine, with a known bound on its error. Distances are computed exactly only
where the bound leaves a chance to be among the nearest found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors as V
from .common import stored


@dataclass(frozen=True)
class Params:
    k: int = 10
    #: Standard deviations of the estimate that the bound allows for: 3 lose some 0.1 % of neighbours.
    epsilon: float = 3.0
    seed: int = 10
    chunk: int = 4096  # vectors that are searched together
    query_block: int = 1024  # queries, on average
    spread: int = 64  # parts of the chunks that a block of queries meets in different tasks


#: Norms whose squares and their sums are far from the limits of double precision. Vectors beyond them
#: have no estimate and are always reranked.
LEAST, MOST = 1e-120, 1e120


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms, by way of each vector's largest component, so that no square under- or overflows.
    A norm beyond LEAST and MOST is NaN."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / np.ldexp(1.0, np.frexp(largest)[1] - 1)
    size = np.linalg.norm(scaled, axis=1)
    with np.errstate(over="ignore"):
        norm = np.ldexp(size, np.frexp(largest[:, 0])[1] - 1)
    return scaled / size[:, None], np.where((norm >= LEAST) & (norm <= MOST), norm, np.nan)


def encode(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Chunks of the index: d, keys, the vectors themselves, their norms, codes and alignments."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for rows in V.by_dimension(batch.column(1)):
            for lo in range(0, len(rows), p.chunk):
                mine = rows[lo : lo + p.chunk]
                x = V.matrix(batch.column(1).take(pa.array(mine)))
                d = x.shape[1]
                unit, norm = directions(x)
                turned = unit @ V.rotation(d, p.seed)
                code = np.packbits(turned > 0, axis=1)
                alignment = np.abs(turned).sum(1) / np.sqrt(d)
                arrays = [np.array([d], np.int32), *([x.tobytes()] for x in (keys[mine].astype(np.int64), x, norm, code, alignment))]
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0]), *(pa.array(x, pa.binary()) for x in arrays[1:])], ["d", "keys", "vecs", "norms", "codes", "alignments"])


def estimate(code: np.ndarray, alignment: np.ndarray, norm: np.ndarray, query: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to each query (rows) as estimated, and the least they can well be."""
    d = query.shape[1]
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
    unit, size = directions(query)
    turned = (unit @ V.rotation(d, p.seed)).astype(np.float32)
    cosine = (turned @ signs.T) / np.sqrt(d) / alignment
    error = p.epsilon * np.sqrt(np.maximum(1 / alignment**2 - 1, 0) / max(d - 1, 1))
    base, twice = size[:, None] ** 2 + norm**2, 2 * size[:, None] * norm
    near, least = base - twice * cosine, base - twice * np.minimum(cosine + error, 1)
    return np.where(np.isnan(near), np.inf, near), np.where(np.isnan(least), -np.inf, least)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed from the first dimension to the last, so that the same vectors give the same
    number wherever and with whatever others they are. Where squares would under- or overflow they are scaled."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = x - q
        out = np.sqrt((gap**2).cumsum(1)[:, -1])
        largest = np.abs(gap).max(1)
        odd = np.flatnonzero((largest > 0) & ((largest < LEAST) | (largest > MOST)) & np.isfinite(largest))
        if len(odd):
            scale = np.ldexp(1.0, np.frexp(largest[odd])[1] - 1)
            out[odd] = scale * np.sqrt(((gap[odd] / scale[:, None]) ** 2).cumsum(1)[:, -1])
    return out


def search(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The k nearest of a chunk for each query of a block."""
    for batch in batches:
        for r in batch.to_pylist():
            d = r["d"]
            keys, norm, alignment = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["norms"]), np.frombuffer(r["alignments"])
            x, code = np.frombuffer(r["vecs"]).reshape(-1, d), np.frombuffer(r["codes"], np.uint8).reshape(len(keys), -1)
            query_keys = np.array([q["key"] for q in r["queries"]], np.int64)
            query = np.array([q["vec"] for q in r["queries"]], np.float64)
            near, least = estimate(code, alignment, norm, query, p)
            out: list[tuple] = []
            for i, q in enumerate(query):
                own = keys == query_keys[i]
                guess = np.where(own, np.inf, near[i])
                first = np.argpartition(guess, p.k - 1)[: p.k] if len(guess) > p.k else np.arange(len(guess))
                bound = distances(x[first[~own[first]]], q).max(initial=0) ** 2 if len(guess) > p.k else np.inf
                look = np.flatnonzero((least[i] <= bound * (1 + 1e-6)) & ~own)
                look = np.union1d(look, first[~own[first]])
                exact = distances(x[look], q)
                order = np.lexsort((keys[look], exact))[: p.k]
                out.append((np.full(len(order), query_keys[i]), keys[look[order]], exact[order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "key", "score"])


def nearest(vectors: DataFrame, is_query: Column, params: Params | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest rows of each query row.

    Queries meet all rows block by block; equal distances are ordered by vec_id. Vectors that are null,
    zero, or hold null or non-finite components take no part; vectors of another dimension are no
    candidates. Components of any size count, however small or large; a distance beyond double precision is
    infinite. Fewer candidates than k: all of them. Repeated vectors are candidates of one another; other columns
    are not read, whatever their names. If ids repeat or are null, rows are numbered by (id,
    vector) and ids in the result are the numbers. An empty table gives no rows.
    """
    p = params or Params()
    rows = V.keyed_vectors(vectors, id_col, vec_col)
    good = rows.where(V.valid(vec_col))
    index = stored(good.select("_key", vec_col).mapInArrow(partial(encode, p=p), "d int, keys binary, vecs binary, norms binary, codes binary, alignments binary").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(p.spread))))
    queries = good.where(is_query).select(F.size(vec_col).alias("d"), F.struct(F.col("_key").alias("key"), F.col(vec_col).alias("vec")).alias("q"), "_key")
    count = queries.count()
    blocks = max(1, -(-count // p.query_block))
    packed = queries.groupBy("d", F.pmod(F.xxhash64("_key"), F.lit(blocks)).alias("block")).agg(F.collect_list("q").alias("queries"))
    every_part = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.spread - 1).cast("long"))))
    met = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(every_part, ["d", "block", "salt"])
    found = met.select("d", "keys", "vecs", "norms", "codes", "alignments", "queries").mapInArrow(partial(search, p=p), "query long, key long, score double")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("score", "key"))).where(F.col("rank") <= p.k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("key").alias("vec_id"), "score")
