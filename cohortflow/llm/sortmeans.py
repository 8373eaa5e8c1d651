"""Centroid clustering (operator 13): sort-means (Phillips 2002) on integer vectors.

Each round orders, for each centroid, the others by their distance from it. A vector starts from the
centroid of its last assignment and looks at the others in that order; it stops where they lie strictly beyond
twice its distance from the first, since by the triangle inequality none of them can be nearer. Distances are squared
integers, so that bounds, ties and means are exact.

A round is one pass over the vectors, which are written with their new assignment: a lost executor repeats its
own tasks only. Of the vectors only a sum and a count for each centroid are brought together; the vectors of the
round before are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, shared_dir, stored
from .vectors import matrix


@dataclass(frozen=True)
class Params:
    clusters: int = 40
    rounds: int = 5
    dimension: int = 64
    scale: int = 256  # a component x becomes floor(scale * x)
    seed: str = "2:"

    #: Of a vector's squared length, as integers: squared distances are then below 2 ** 62, and fit 64 bits.
    longest: int = 1 << 60


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return (gap * gap).sum(-1)


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest centroid (ties: the smallest number) and its squared distance."""
    cluster, distance = start.astype(np.int64), np.empty(len(x), np.int64)
    for c in np.unique(cluster):
        apart = squared(centroids, centroids[c])
        rows = np.flatnonzero(start == c)
        own = squared(x[rows], centroids[c])
        far = np.argsort(-own, kind="stable")  # those that look furthest come first
        rows, own = rows[far], own[far]
        mine, best, near = x[rows], own.copy(), np.full(len(rows), c)
        for j in np.argsort(apart, kind="stable"):
            look = int(np.searchsorted(-own, -((apart[j] + 3) // 4), "right"))  # apart <= 4 * own
            if not look:
                break
            if j != c:
                d = squared(mine[:look], centroids[j])
                better = (d < best[:look]) | (d == best[:look]) & (j < near[:look])
                best[:look], near[:look] = np.where(better, d, best[:look]), np.where(better, j, near[:look])
        cluster[rows], distance[rows] = near, best
    return cluster, distance


def assigned(points: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """points: id, v, cluster (the last assignment). The same with new clusters, or (last) id, cluster, distance."""
    kinds = dict(points.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1)).astype(np.int64)
                cluster, distance = nearest(x, batch.column(2).to_numpy(), centroids)
                found = pa.array(cluster, pa.int32())
                out = [batch.column(0), found, pa.array(distance)] if last else [batch.column(0), batch.column(1), found]
                yield pa.RecordBatch.from_arrays(out, ["id", "cluster", "distance"] if last else ["id", "v", "cluster"])

    return points.mapInArrow(run, f"id {kinds['id']}, " + ("cluster int, distance long" if last else "v array<int>, cluster int"))


def means(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; empty clusters keep their centroid. One row a cluster is brought together."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in points.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(centroids.shape[1])]
    return out


def kept(vectors: DataFrame, p: Params, id_col: str, vec_col: str) -> DataFrame:
    """id, v, cluster: the vectors that take part, as integers, to start from centroid 0."""
    v = F.col("raw")
    whole = F.transform(v, lambda x: F.floor(x * p.scale))
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * p.scale + 1, 2))  # infinite and NaN components fail too
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & (size < p.longest)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("raw"))
    return rows.where((F.size(v) == p.dimension) & fine).select("id", whole.cast("array<int>").alias("v"), F.lit(0).alias("cluster"))


def first_centroids(points: DataFrame, p: Params) -> np.ndarray:
    drawn = F.sha2(F.concat(F.lit(p.seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.select(drawn.alias("h"), "v").orderBy("h", "v").limit(p.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, p.dimension)


def cluster(vectors: DataFrame, params: Params | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part.

    Vectors of another length, null, or with null or non-finite components take no part; nor do those so long (Params.longest;
    as integers some 2 ** 30, with components in the millions) that squared distances need not fit 64 bits. Zero
    vectors do. Repeated ids and repeated rows are vectors of their own (among first centroids: in order of
    their vectors); null ids are drawn as empty ones. Equal centroids: the smallest number has all. Fewer vectors than
    clusters: as many clusters. A sum of distances beyond 64 bits is null. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    p, spark = params or Params(), vectors.sparkSession
    path = shared_dir(spark)
    points = stored(kept(vectors, p, id_col, vec_col), f"{path}/0")
    centroids = first_centroids(points, p)
    for k in range(1, p.rounds + 1 if len(centroids) else 0):
        points = stored(assigned(points, centroids, last=False), f"{path}/{k}")
        drop_stored(spark, f"{path}/{k - 1}")
        centroids = means(points, centroids)
    found = stored(assigned(points, centroids, last=True), f"{path}/found")
    fits = lambda n: n if n < 1 << 63 else None
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    about = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(clusters), "cluster")  # at most p.clusters rows
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(p: Params) -> str:
    """All distances of all vectors in each round, and exact means, in DuckDB."""
    with_all = [
        f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({p.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {p.dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {p.dimension})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}' || vec_id)) - 1 AS c, v FROM k QUALIFY c < {p.clusters})",
    ]
    for i in range(p.rounds + 1):
        with_all.append(f"""a{i} AS MATERIALIZED (SELECT k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM k, c{i} c QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY d, c.c) = 1)""")
        if i < p.rounds:
            with_all.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
            SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {p.dimension + 1}) t(j) GROUP BY c, j) GROUP BY c) m USING (c))""")
    i = p.rounds
    return f"""WITH {", ".join(with_all)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{i} a JOIN c{i} c ON c.c = a.c"""
