"""Connected components of a graph of any size, in a few passes over its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, stored


def component_count(edges: DataFrame) -> int:
    """The number of components of the vertices in edges (a, b: of one type).

    Two steps in turn, until nothing changes: every vertex's larger neighbours are tied to the smallest vertex
    beside it, then its smaller ones and itself are. What is left are stars around each component's smallest vertex. A
    vertex's neighbours are never gathered; of a vertex with very many, Spark splits the join.
    """

    def tied(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").distinct()

    pairs, seen = stored(tied(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))), None
    alone = edges.where("a = b").select(F.col("a").alias("u")).distinct()
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tied(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = tied(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
        before, pairs = pairs, stored(small)
        dropped(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("u")).distinct()
    known = pairs.select("u").unionByName(roots)
    return roots.count() + alone.join(known, "u", "left_anti").count()
