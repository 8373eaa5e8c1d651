"""Distances between histograms, for any number of groups in one plan.

A histogram pair is a DataFrame: keys of the group, a support point, and counts a and b. Each distance is
one aggregation; the earth mover's needs a window over the few points of a support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S


def histogram_pair(left: DataFrame, right: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, point, a, b from rows of two sides: counts first on each side, then a union - no join."""
    side = lambda df, a, b: df.groupBy(*keys, point).agg(F.count("*").alias("n")).select(*keys, point, (F.col("n") * a).alias("a"), (F.col("n") * b).alias("b"))
    return side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys, point).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def shares(pair: DataFrame, keys: list[str]) -> DataFrame:
    """Adds totals na, nb and shares p, q (null where a side is empty)."""
    over = W.partitionBy(*keys) if keys else None
    if over is None:
        totals = pair.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        both = pair.join(F.broadcast(totals))  # one row
    else:
        both = pair.withColumn("na", F.sum("a").over(over)).withColumn("nb", F.sum("b").over(over))
    return both.withColumn("p", F.try_divide("a", "na")).withColumn("q", F.try_divide("b", "nb"))


def group(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys)


def js_terms() -> Column:
    m = (F.col("p") + F.col("q")) / 2
    return (S.plogp(F.col("p"), m) + S.plogp(F.col("q"), m)) / 2


def jsd_l1(pair: DataFrame, keys: list[str]) -> DataFrame:
    """Jensen-Shannon divergence in bits (null if a side is empty) and L1 distance of the shares (null if
    both are)."""
    rows = shares(pair, keys)
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    out = group(rows, keys).agg(F.sum(js_terms()).alias("_js"), F.sum(F.abs(p - q)).alias("_l1"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    js = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.greatest("_js", F.lit(0.0)))
    l1 = F.when((F.col("na") > 0) | (F.col("nb") > 0), F.col("_l1"))
    return out.select(*keys, js.alias("jsd"), l1.alias("l1"))


def emd(pair: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Earth mover's distance on the line; null if a side is empty, 0 for one point."""
    rows = shares(pair, keys)
    order = W.partitionBy(*keys).orderBy(point) if keys else W.orderBy(point)  # a support has few points
    gap = F.abs(F.sum(F.col("p") - F.col("q")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    step = F.lead(point).over(order) - F.col(point)
    moved = rows.withColumn("_m", gap * step)
    both = (F.max("na") > 0) & (F.max("nb") > 0)
    return group(moved, keys).agg(F.when(both, F.coalesce(F.sum("_m"), F.lit(0.0))).alias("emd"))


def summary(pair: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, na, nb, mean_a, mean_b, jsd, l1, emd of each group in one pass: jsd_l1(), emd() and the means, with one shuffle."""
    part = W.partitionBy(*keys)
    order = part.orderBy(point)
    rows = pair.withColumn("na", F.sum("a").over(part)).withColumn("nb", F.sum("b").over(part)).withColumn("p", F.try_divide("a", "na")).withColumn("q", F.try_divide("b", "nb"))
    gap = F.abs(F.sum(F.col("p") - F.col("q")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("_m", gap * (F.lead(point).over(order) - F.col(point)))
    p, q, both = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0)), (F.col("na") > 0) & (F.col("nb") > 0)
    mean = lambda n: F.try_divide(F.sum(F.col(point) * F.col(n)), F.sum(n))
    out = rows.groupBy(*keys).agg(F.max("na").alias("na"), F.max("nb").alias("nb"), mean("a").alias("mean_a"), mean("b").alias("mean_b"), F.sum(js_terms()).alias("_js"), F.sum(F.abs(p - q)).alias("_l1"), F.sum("_m").alias("_emd"))
    js, far = F.when(both, F.greatest("_js", F.lit(0.0))), F.when(both, F.coalesce("_emd", F.lit(0.0)))
    return out.select(*keys, "na", "nb", "mean_a", "mean_b", js.alias("jsd"), F.when((F.col("na") > 0) | (F.col("nb") > 0), F.col("_l1")).alias("l1"), far.alias("emd"))


def rmse_shared(left: DataFrame, right: DataFrame, keys: list[str], value: str, groups: list[str] = ()) -> DataFrame:
    """Root mean square difference of the means per key on both sides, over shared keys (null keys match)."""
    by = [*groups, *keys]
    mean = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias(name))
    a = mean(left, "x").select(*[F.col(k).alias(f"_{k}") for k in by], "x")
    b = mean(right, "y")
    on = [F.col(f"_{k}").eqNullSafe(b[k]) for k in by]
    both = b.join(a, on)
    return both.groupBy(*groups).agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2))).alias("rmse"), F.count("*").alias("n_shared"))
