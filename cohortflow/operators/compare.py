"""Comparison of conditions: one table of all evaluations with a `label`, one plan for all conditions.

rows: label, panelist_id, product_id, rating (double or null), raw_label (the rating as a grouping key,
whatever its type).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans.storage import stored
from . import distances as D


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place n div 2 (from 0) of each group, from its histogram: no group is sorted whole."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    part = W.partitionBy(*keys)
    upto = F.sum("n").over(part.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.withColumn("_upto", upto).withColumn("_n", F.sum("n").over(part))
    return placed.where(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def condition_metrics(rows: DataFrame, scale: int | None = None) -> DataFrame:
    """Per label: counts, mean, population standard deviation, upper median, entropy (raw ratings)."""
    base = rows.groupBy("label").agg(F.count("*").alias("n_evaluations"), F.count("rating").alias("n_ratings"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"), F.count_distinct("panelist_id").alias("n_panelists"), F.count_distinct("product_id").alias("n_products"))
    raw = rows.where("raw_label IS NOT NULL").groupBy("label", "raw_label").agg(F.count("*").alias("n")).groupBy("label").agg(S.entropy(F.col("n")).alias("entropy"), F.count("*").alias("observed"))
    out = base.join(upper_median(rows, ["label"], "rating"), "label", "left").join(raw, "label", "left")
    support = F.lit(scale).cast("bigint") if scale else F.col("observed")
    return out.withColumn("normalized_entropy", S.normalized(F.col("entropy"), support)).drop("observed")


def pivot(table: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """row by column; of several values in a cell the last (by _ord) stays."""
    return table.groupBy(row).pivot(column, columns).agg(F.max_by(value, "_ord"))


def js_matrix(rows: DataFrame) -> DataFrame:
    """left, right, jsd for all pairs of labels, from one histogram per label; few labels, few points."""
    counts = rows.where("rating IS NOT NULL").groupBy("label", "rating").agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("label"))).select("label", "rating", "p")
    a = share.select(F.col("label").alias("left"), "rating", F.col("p").alias("p"))
    b = share.select(F.col("label").alias("right"), "rating", F.col("p").alias("q"))
    common = a.join(b, "rating").withColumn("_t", S.plogp(F.col("p"), (F.col("p") + F.col("q")) / 2) + S.plogp(F.col("q"), (F.col("p") + F.col("q")) / 2)).select("left", "right", "_t", "p", "q")
    # where only one side has mass a term is p * log2(p / (p / 2)) = p: 1 less what is shared
    half = common.groupBy("left", "right").agg(F.sum("_t").alias("t"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    labels = share.select("label").distinct()
    every = labels.select(F.col("label").alias("left")).join(labels.select(F.col("label").alias("right")))  # a few conditions
    js = F.when(F.col("left") == F.col("right"), 0.0).otherwise(F.greatest((F.coalesce("t", F.lit(0.0)) + 2 - F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))) / 2, F.lit(0.0)))
    return every.join(half, ["left", "right"], "left").select("left", "right", js.alias("jsd"))


def rmse_matrix(rows: DataFrame) -> DataFrame:
    """left, right, rmse over shared (panelist, product); pairs without shared keys are left out. Partners
    meet on the key; there are no more of them per key than conditions."""
    cells = rows.where("rating IS NOT NULL").groupBy("label", "panelist_id", "product_id").agg(F.avg("rating").alias("x"))
    per_key = cells.groupBy("panelist_id", "product_id").agg(F.collect_list(F.struct("label", "x")).alias("all"))
    pairs = per_key.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    out = pairs.groupBy(F.col("a.label").alias("left"), F.col("b.label").alias("right"))
    return out.agg(F.sqrt(F.avg(F.pow(F.col("a.x") - F.col("b.x"), 2))).alias("rmse"), F.count("*").alias("n_shared"))


@dataclass(frozen=True)
class Counts:
    """What all comparisons with a reference need of the rows, counted once: label, product_id, rating, n (null ratings
    too) of the conditions, product_id, rating, n of the reference, and both sides' rows by product."""

    reference: DataFrame
    rows: DataFrame

    @classmethod
    def of(cls, reference: DataFrame, rows: DataFrame, keep: bool = False) -> Counts:
        """keep: written, for several comparisons; else each comparison counts for itself."""
        sides = [reference.select(F.lit(None).cast("string").alias("label"), F.lit(True).alias("_ref"), "product_id", "rating"), rows.select("label", F.lit(False).alias("_ref"), "product_id", "rating")]
        n = sides[0].unionByName(sides[1]).where("product_id IS NOT NULL").groupBy("_ref", "label", "product_id", "rating").agg(F.count("*").alias("n"))
        n = stored(n) if keep else n
        return cls(n.where("_ref").drop("_ref", "label"), n.where("NOT _ref").drop("_ref"))

    def products(self) -> DataFrame:
        """label, product_id, a, b: rows of each condition's products, with those of the reference (null: none)."""
        known = self.reference.groupBy("product_id").agg(F.sum("n").alias("a"))
        return self.rows.groupBy("label", "product_id").agg(F.sum("n").alias("b")).join(known, "product_id", "left")

    def rated(self, shared: DataFrame) -> DataFrame:
        """label, product_id, rating, a, b on the labels and products of `shared`."""
        keys = shared.select("label", "product_id")
        none = F.lit(0).cast("bigint")
        left = self.reference.where("rating IS NOT NULL").join(keys, "product_id").select("label", "product_id", "rating", F.col("n").alias("a"), none.alias("b"))
        right = self.rows.where("rating IS NOT NULL").join(keys, ["label", "product_id"]).select("label", "product_id", "rating", none.alias("a"), F.col("n").alias("b"))
        return left.unionByName(right).groupBy("label", "product_id", "rating").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _overlap(counts: Counts) -> DataFrame:
    size = counts.reference.agg(F.count_distinct("product_id").alias("n_reference"))
    out = counts.products().groupBy("label").agg(F.count("*").alias("n_condition"), F.count("a").alias("n_shared")).join(F.broadcast(size))  # one row
    union = F.col("n_reference") + F.col("n_condition") - F.col("n_shared")
    return out.withColumn("overlap_rate", S.ratio(F.col("n_shared"), F.col("n_reference"))).withColumn("jaccard", S.ratio(F.col("n_shared"), union))


def _review_share(counts: Counts) -> DataFrame:
    return D.jsd_l1(counts.products().where("a IS NOT NULL"), ["label"])


def _overall_rating(counts: Counts) -> DataFrame:
    shared = counts.rated(counts.products().where("a IS NOT NULL")).groupBy("label", "rating").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return D.summary(shared, ["label"], "rating").select("label", "jsd", "emd")


def _diagnostics(counts: Counts) -> DataFrame:
    found = D.summary(counts.rated(counts.products().where("a IS NOT NULL")), ["label", "product_id"], "rating").where("na > 0 AND nb > 0")
    return found.select("label", "product_id", F.col("na").alias("n_reference"), F.col("nb").alias("n_condition"), F.col("mean_a").alias("mean_reference"), F.col("mean_b").alias("mean_condition"), "jsd", "emd")


def overlap(reference: DataFrame, rows: DataFrame) -> DataFrame:
    """Per label: products shared with the reference, overlap rate and Jaccard."""
    return _overlap(Counts.of(reference, rows))


def review_share(reference: DataFrame, rows: DataFrame) -> DataFrame:
    """Per label: JSD and L1 of the products' shares of reviews, on shared products."""
    return _review_share(Counts.of(reference, rows))


def overall_rating(reference: DataFrame, rows: DataFrame) -> DataFrame:
    """Per label: JSD and EMD of the ratings on shared products."""
    return _overall_rating(Counts.of(reference, rows))


def diagnostics(reference: DataFrame, rows: DataFrame) -> DataFrame:
    """Per label and product rated on both sides: JSD, EMD, means and counts."""
    return _diagnostics(Counts.of(reference, rows))


def best_and_worst(diagnostics: DataFrame, k: int) -> DataFrame:
    """The k products of smallest and of largest EMD per label (they overlap where there are fewer than
    2k). Only the top k of each task travel: rank() filters are pushed below the shuffle."""
    out = None
    for bucket, order in (("best", [F.asc("emd"), F.asc("product_id")]), ("worst", [F.desc("emd"), F.desc("product_id")])):
        rank = F.row_number().over(W.partitionBy("label").orderBy(*order))
        part = diagnostics.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("bucket", F.lit(bucket))
        out = part if out is None else out.unionByName(part)
    return out


def weighted(diagnostics: DataFrame, reference: DataFrame, *metrics: str) -> DataFrame:
    """Per label: the plain mean of a product metric, and the mean weighted by the reference's reviews; of several
    metrics each under its name. reference: its rows, or product_id and n."""
    n = F.sum("n") if "n" in reference.columns else F.count("*")
    weight = reference.where("product_id IS NOT NULL").groupBy("product_id").agg(n.alias("w"))
    joined = diagnostics.join(weight, "product_id", "left")
    out = []
    for m in metrics:
        names = ("egalitarian", "utilitarian") if len(metrics) == 1 else (f"{m}_mean", f"{m}_weighted")
        known = F.when(F.col(m).isNotNull(), F.col("w"))
        out += [F.avg(m).alias(names[0]), F.try_divide(F.sum(F.col(m) * known), F.sum(known)).alias(names[1])]
    return joined.groupBy("label").agg(*out)


def benchmark(reference: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per condition: overlap, review shares, overall ratings, weighted product distances. The rows are read
    once, into counts that all parts share."""
    counts = Counts.of(reference, rows, keep=True)
    share = _review_share(counts).select("label", F.col("jsd").alias("share_jsd"), F.col("l1").alias("share_l1"))
    overall = _overall_rating(counts).select("label", F.col("jsd").alias("rating_jsd"), F.col("emd").alias("rating_emd"))
    products = weighted(_diagnostics(counts), counts.reference, "jsd", "emd")
    out = _overlap(counts)
    for part in (share, overall, products):
        out = out.join(part, "label", "left")
    return out


def mode(real: list[bool]) -> str:
    """cross without a real condition, benchmark with one; more are refused."""
    n = sum(real)
    if n > 1:
        raise ValueError("at most one condition may be real")
    return "benchmark" if n else "cross"
