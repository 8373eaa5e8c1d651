"""The star-schema test tables seen as a panel: reviews, item metadata, canonical events, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.selection import execute
from . import reviews as source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.datediff(ts, F.lit("1970-01-01")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review per line item; orders divisible by 97 have no user, seventh lines no rating."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rating = F.when(F.col("l_linenumber") != 7, 1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double")
    intent = F.when(F.col("l_tax") > 0.07, None).when(F.col("l_discount") < 0.03, "no").when(F.col("l_discount") < 0.07, "maybe").otherwise("yes")
    return joined.select(
        F.when(F.col("l_orderkey") % 97 != 0, F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("l_partkey").cast("string").alias("parent_asin"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).cast("string").alias("asin"),
        seconds(F.col("l_shipdate")).alias("timestamp"),
        rating.alias("rating"),
        (F.col("l_linestatus") == "F").alias("verified_purchase"),
        F.col("l_linenumber").cast("bigint").alias("helpful_vote"),
        intent.alias("intent"),
        F.when(F.col("l_returnflag") != "N", F.col("o_orderpriority")).alias("comment"),
        (F.col("l_suppkey") % 3).cast("string").alias("strategy"),
        (F.col("l_suppkey") % 2).cast("string").alias("model"),
        (F.col("l_returnflag") == "R").alias("real"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_ord"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item per part but every tenth; every seventh comes again, later, under another title."""
    part = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    again = part.where("p_partkey % 7 = 0")
    columns = [F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_brand").alias("store"), F.col("p_type").alias("main_category"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")]
    first = part.select(*columns, F.col("p_name").alias("title"), F.col("p_partkey").cast("bigint").alias("_ord"))
    later = again.select(*columns, F.concat("p_name", F.lit(" again")).alias("title"), (F.col("p_partkey") + 1_000_000_000_000).alias("_ord"))
    return first.unionByName(later)


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation events with open payloads, from the reviews that name a user."""
    rows = source.in_sequence(reviews(spark, sf_dir))
    return rows.select(
        F.concat(F.lit("e"), F.col("_ord").cast("string")).alias("event_id"), F.lit("evaluation").alias("event_type"), F.lit("manual").alias("policy"),
        F.col("user_id").alias("panelist_id"), "t", F.col("parent_asin").alias("product_id"),
        F.to_variant_object(F.struct("rating", "intent")).alias("outcomes"),
        F.to_variant_object(F.struct("comment")).alias("traces"), "model", "strategy", "real", "_ord",
    )


def selections(spark: SparkSession, sf_dir: str, cap: int = 2) -> DataFrame:
    """A selection event per order: its parts are shown, those not returned and one off the menu asked for."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = F.col("l_partkey").cast("string")
    menu = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(part)).alias("choice_set"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", part))).alias("wanted"))
    shown = lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    t = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    # numbered before the lists are there, which are not sent again
    asked = orders.select("o_orderkey", "o_custkey").join(shown, "o_orderkey", "left_semi").withColumn("t", t.cast("bigint"))
    rows = asked.join(menu, F.col("o_orderkey") == F.col("l_orderkey"))
    requested = F.concat("wanted", F.array(F.concat(F.lit("off-"), (F.col("o_orderkey") % 5).cast("string"))))
    rows = rows.select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("event_id"), F.lit("selection").alias("event_type"), F.lit("self_selection").alias("policy"),
        F.col("o_custkey").cast("string").alias("panelist_id"), "t", "choice_set", requested.alias("selected_product_ids"), F.col("o_orderkey").alias("_ord"),
    )
    executed, dropped = execute(F.col("selected_product_ids"), F.col("choice_set"), cap)
    return rows.withColumn("executed", executed).withColumn("dropped", dropped)
