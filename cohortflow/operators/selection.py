"""Selections: execution rules, set sizes, drop rates, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def execute(requested: Column, choice_set: Column, cap: int | None = None, fallback_first: bool = False) -> tuple[Column, Column]:
    """What of a request is executed and what is dropped: off-menu items go, repeats count once, the first
    `cap` stay. Dropped are off-menu items, then the overflow. fallback_first: the first item shown, if
    nothing is left."""
    if cap is not None and cap < 0:
        raise ValueError("cap must not be negative")
    asked = F.array_distinct(F.coalesce(requested, F.array().cast("array<string>")))
    on_menu = F.filter(asked, lambda x: F.array_contains(choice_set, x))
    off_menu = F.filter(asked, lambda x: ~F.array_contains(choice_set, x))
    if cap is None:
        done, over = on_menu, F.array().cast("array<string>")
    elif cap == 0:
        done, over = F.array().cast("array<string>"), on_menu
    else:
        done, over = F.slice(on_menu, 1, cap), F.slice(on_menu, cap + 1, F.greatest(F.size(on_menu) - cap, F.lit(0)))
    if fallback_first:
        done = F.when((F.size(done) == 0) & (F.size(choice_set) > 0), F.slice(choice_set, 1, 1)).otherwise(done)
    return done, F.concat(off_menu, over)


def length(items: str) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def summary(selections: DataFrame) -> DataFrame:
    """One row: number of selections, mean sizes, shares of empty requests and executions."""
    return selections.agg(
        F.count("*").alias("n_selections"), F.avg(length("choice_set")).alias("mean_choice_set"),
        F.avg(length("selected_product_ids")).alias("mean_requested"), F.avg(length("executed")).alias("mean_executed"),
        F.avg((length("selected_product_ids") == 0).cast("int")).alias("empty_requested_rate"), F.avg((length("executed") == 0).cast("int")).alias("empty_executed_rate"),
    )


def product_counts(selections: DataFrame, items: str) -> DataFrame:
    """product_id, n: how often each product is in the list column."""
    return selections.select(F.explode(items).alias("product_id")).groupBy("product_id").agg(F.count("*").alias("n"))


def top_products(selections: DataFrame, items: str, k: int = 10) -> DataFrame:
    """The k products most often in the list column; ties by first occurrence."""
    places = selections.select("_ord", F.posexplode(items).alias("pos", "product_id"))
    counts = places.groupBy("product_id").agg(F.count("*").alias("n"), F.min(F.struct("_ord", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("product_id", "n")


def concentration(selections: DataFrame, items: str) -> DataFrame:
    """One row: entropy of the products in the list column and how many there are."""
    return product_counts(selections, items).agg(S.entropy(F.col("n")).alias("entropy"), F.count("*").alias("observed"))


def metrics(selections: DataFrame, n_products: int | None = None) -> DataFrame:
    """One row of selection metrics; the support is n_products (from run metadata), else the products
    ever shown."""
    sizes = selections.agg(
        F.count("*").alias("n_selections"), F.sum(length("selected_product_ids")).alias("requested"), F.sum(length("executed")).alias("executed"), F.sum(length("dropped")).alias("dropped"),
        F.avg((length("selected_product_ids") == 0).cast("int")).alias("empty_requested_rate"), F.avg((length("executed") == 0).cast("int")).alias("empty_executed_rate"),
    )
    shown = product_counts(selections, "choice_set").agg(F.count("*").alias("support"))
    out = sizes.join(shown if n_products is None else shown.select(F.lit(n_products).cast("bigint").alias("support")))
    for name, items in (("requested", "selected_product_ids"), ("executed", "executed")):
        bits = concentration(selections, items).select(F.col("entropy").alias(f"{name}_entropy"), F.col("observed").alias(f"{name}_support"))
        out = out.join(bits)  # single rows
        out = out.withColumn(f"{name}_entropy_full", S.normalized(F.col(f"{name}_entropy"), F.col("support"))).withColumn(f"{name}_entropy_observed", S.normalized(F.col(f"{name}_entropy"), F.col(f"{name}_support")))
    return out.withColumn("executed_ratio", S.ratio(F.col("executed"), F.col("requested"))).withColumn("drop_rate", S.ratio(F.col("dropped"), F.col("requested")))
