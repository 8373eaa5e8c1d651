"""Connected components of a link table, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, shared_dir, stored


def nearest(links: DataFrame) -> DataFrame:
    """u and the smallest vertex among u and its neighbours (combined before the shuffle)."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """id, component (smallest id that links reach) of every vertex in links (a, b); none for others.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each hangs neighbours below the
    smallest one, until every vertex hangs below its component's smallest. No vertex's neighbours are
    ever gathered in one place; every round is written to `folder`, a new one of the shared folder if not given.
    """
    spark = links.sparkSession
    folder = folder or shared_dir(spark)
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, seen, k = stored(pairs, f"{folder}/0"), None, 0
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = nearest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        pairs = stored(small, f"{folder}/{k}")
        drop_stored(spark, f"{folder}/{k - 1}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
