"""Frozen reference subsets: eligible products, seeded choice, semi-joins, rating histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import payload as P


def rating(events: DataFrame):
    """outcomes.rating if that key is there (even null), else a top-level rating; numbers, booleans and
    numeric text are taken."""
    out = F.col("outcomes")
    inner = P.field(out, "rating")
    number, text = F.try_variant_get(inner, "$", "double"), F.try_variant_get(inner, "$", "string")
    # numbers, nearly all, are not spelled out to be read again
    value = F.when(P.kind(out, "rating").rlike(P.NUMBER), number).when(P.kind(out, "rating") == "BOOLEAN", F.try_variant_get(inner, "$", "boolean").cast("double")).otherwise(P.lenient_number(text))
    return F.when(inner.isNotNull(), value).otherwise(F.col("rating").cast("double") if "rating" in events.columns else F.lit(None).cast("double"))


def product(events: DataFrame):
    """product_id, else parent_asin; empty falls through."""
    own = F.nullif(F.col("product_id").cast("string"), F.lit(""))
    return F.coalesce(own, F.col("parent_asin")) if "parent_asin" in events.columns else own


def rated(events: DataFrame) -> DataFrame:
    rows = events.withColumn("_product", product(events)).withColumn("_rating", rating(events))
    return rows.where("_product IS NOT NULL AND _rating IS NOT NULL")


def eligible(events: DataFrame, min_ratings: int, known: DataFrame | None = None) -> DataFrame:
    """product_id, n of products with min_ratings rated events or more; known: only products recorded there."""
    rows = rated(events)
    if known is not None:
        rows = rows.join(known.select(F.col("product_id").alias("_product")), "_product", "left_semi")
    return rows.groupBy(F.col("_product").alias("product_id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_ratings)


def chosen(products: DataFrame, max_products: int | None, seed: int) -> DataFrame:
    """A seeded choice of max_products ids, the same in every run: the smallest by a seeded hash (ties by
    id). A top-k, so no more than k ids of a task travel."""
    if max_products is None:
        return products.select("product_id")
    return products.orderBy(identity.bits(seed, F.col("product_id")), "product_id").limit(max_products).select("product_id")


def product_ids(products: DataFrame) -> DataFrame:
    """The distinct ids of a product table; only that column is read."""
    return products.select("product_id").where("product_id <> ''").distinct()


def products_of(products: DataFrame, chosen_ids: DataFrame) -> DataFrame:
    """Product records of the chosen products, unchanged."""
    return products.join(chosen_ids.select("product_id"), "product_id", "left_semi")


def events_of(events: DataFrame, products: DataFrame) -> DataFrame:
    """Rated events of the chosen products, unchanged."""
    ids = products.select(F.col("product_id").alias("_product"))
    return rated(events).join(ids, "_product", "left_semi").select(*events.columns, "_product", "_rating")


def histogram(subset: DataFrame) -> DataFrame:
    """rating (5.0 as "5"), n."""
    return subset.groupBy(F.col("_rating").alias("value")).agg(F.count("*").alias("n")).select(P.number_label(F.col("value")).alias("rating"), "n")


def stats(subset: DataFrame) -> DataFrame:
    return subset.agg(F.count("*").alias("n_events"), F.count_distinct("_product").alias("n_products"), F.count_distinct("panelist_id").alias("n_panelists"), F.avg("_rating").alias("mean_rating"))
