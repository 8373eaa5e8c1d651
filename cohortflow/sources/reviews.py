"""Import of review logs: products, personas, sequenced canonical events, counts.

Raw reviews have user_id, parent_asin, asin, timestamp, rating, verified_purchase, helpful_vote and _ord
(the order of input); raw items have parent_asin, title and further attributes, and _ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import payload as P
from ..plans.storage import stored


def in_order(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows of the input; all without a limit."""
    return rows if limit is None else rows.orderBy("_ord").limit(limit)


def products(items: DataFrame) -> DataFrame:
    """The first row of each parent_asin in input order, as product records. Rows without a key go."""
    others = [c for c in items.columns if c not in ("parent_asin", "_ord")]
    keyed = items.where("parent_asin <> ''")
    first = keyed.groupBy("parent_asin").agg(F.min_by(F.struct(*others), "_ord").alias("row"))
    out = first.select(F.col("parent_asin").alias("product_id"), *[F.col("row")[c].alias(c) for c in others])
    return out.withColumn("display_name", F.coalesce(F.nullif(F.col("title"), F.lit("")), "product_id"))


def personas(reviews: DataFrame, min_reviews: int = 1) -> DataFrame:
    """Review counts and mean rating of each user with min_reviews reviews or more; "" is a user."""
    summary = reviews.where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("persona_id")).agg(
        F.count("*").alias("n_reviews"), F.count_distinct("parent_asin").alias("n_unique_products"),
        F.count_if(F.coalesce("verified_purchase", F.lit(False))).alias("n_verified_purchase_reviews"), F.avg("rating").alias("mean_rating"),
    )
    return summary.where(F.col("n_reviews") >= min_reviews)


def order_keys() -> list[Column]:
    return [F.coalesce("timestamp", F.lit(-1)), F.coalesce("parent_asin", F.lit("")), F.coalesce("asin", F.lit("")), F.col("_ord")]


def in_sequence(reviews: DataFrame) -> DataFrame:
    """The reviews with a user, and t, their place among the user's."""
    t = F.row_number().over(W.partitionBy("user_id").orderBy(*order_keys())) - 1
    return reviews.where("user_id IS NOT NULL").withColumn("t", t.cast("bigint"))


def sequenced(reviews: DataFrame, mode: str = "panelist_sequence") -> DataFrame:
    """Adds t: place among the user's reviews (no user: 0), among all reviews, or the timestamp itself."""
    if mode == "panelist_sequence":
        # rows without a user are not gathered for a sequence that they do not need
        return in_sequence(reviews).unionByName(reviews.where("user_id IS NULL").withColumn("t", F.lit(0).cast("bigint")))
    if mode == "raw_timestamp":
        return reviews.withColumn("t", F.greatest(F.coalesce("timestamp", F.lit(0)), F.lit(0)).cast("bigint"))
    if mode == "global_sequence":
        return numbered(reviews, order_keys(), "t")
    raise ValueError(f"unknown mode {mode!r}")


def numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Numbers all rows from 0 in the order of keys: a range sort, then the counts of its partitions. No
    task sees more than its range."""
    low = (1 << 33) - 1
    ranged = stored(rows.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    # one row per shuffle partition
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    joined = ranged.join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(low))).drop("_part", "_before", "_id")


#: What personas() counts.
COUNTS = ("n_reviews", "n_unique_products", "n_verified_purchase_reviews", "mean_rating")


def counted(reviews: DataFrame) -> DataFrame:
    """Adds the counts of personas() to each row with a user, prefixed by _person_, in the shuffle by user that a sequence needs."""
    user = W.partitionBy("user_id")
    known = F.col("parent_asin").isNotNull()
    product = F.dense_rank().over(user.orderBy(F.col("parent_asin").asc_nulls_last()))
    made = (F.count("*").over(user), F.coalesce(F.max(F.when(known, F.col("_rank"))).over(user), F.lit(0)).cast("bigint"), F.count_if(F.coalesce("verified_purchase", F.lit(False))).over(user), F.avg("rating").over(user))
    return reviews.where("user_id IS NOT NULL").withColumn("_rank", product).withColumns({f"_person_{c}": x for c, x in zip(COUNTS, made, strict=True)}).drop("_rank")


def matched(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Reviews with `matched`: user and product named, and the product known."""
    known = items.select(F.col("product_id").alias("parent_asin"), F.lit(True).alias("_known"))
    named = (F.col("user_id") != "") & (F.col("parent_asin") != "")
    return reviews.join(known, "parent_asin", "left").withColumn("matched", F.coalesce(F.col("_known") & named, F.lit(False))).drop("_known")


#: Texts of a review and their names among an event's traces.
TRACES = {"title": "review_title", "text": "review_text"}


def traces(reviews: DataFrame, names: dict[str, str] | None = None, raw: bool = False) -> Column:
    """VARIANT: the review's trimmed texts under their names, and its source (child_asin, timestamp; raw: the review's
    fields, nulls too). Absent and empty values are left out; nothing left: null."""
    names = TRACES if names is None else names
    texts = [P.clean_text(F.col(c)).alias(n) for c, n in names.items() if c in reviews.columns]
    parts = [F.col("asin").alias("child_asin"), F.col("timestamp").alias("timestamp")]
    if raw:
        fields = [c for c in ("asin", "parent_asin", "title", "text", "rating", "helpful_vote", "verified_purchase", "timestamp") if c in reviews.columns]
        parts.append(F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("raw"))
    source = F.to_json(F.struct(*parts))
    made = F.to_json(F.struct(*texts, F.when(source != "{}", F.parse_json(source)).alias("source")))
    return F.parse_json(F.nullif(made, F.lit("{}")))


def events(reviews: DataFrame, items: DataFrame, people: DataFrame | int, mode: str = "panelist_sequence", require_match: bool = False, trace_names: dict[str, str] | None = None, raw: bool = False) -> DataFrame:
    """Canonical evaluation events, with traces(). t is given before unmatched reviews go, so gaps stay. Products
    without metadata show "" and {}; users without a persona have no features. One shuffle by user
    serves the sequence and the persona lookup. people: personas, or the least number of reviews of one, whose
    counts are then made in that shuffle too."""
    if isinstance(people, int) and mode != "panelist_sequence":
        people = personas(reviews, people)
    if isinstance(people, int):
        rows = in_sequence(counted(reviews))
        about = {c: F.when(F.col("_person_n_reviews") >= people, F.col(f"_person_{c}")) for c in COUNTS}
    else:
        about = {c: F.col(f"_person_{c}") for c in people.columns if c != "persona_id"}
        rows = in_sequence(reviews) if mode == "panelist_sequence" else sequenced(reviews, mode)  # no row without a user is left below
        rows = rows.join(people.select(F.col("persona_id").alias("user_id"), *[F.col(c).alias(f"_person_{c}") for c in about]), "user_id", "left")
    rows = rows.where("user_id <> '' AND parent_asin <> ''")
    panelist_features = F.to_json(F.struct(*[x.alias(c) for c, x in about.items()]))  # {} of nulls; after the shuffles, as texts are longer
    features = [c for c in items.columns if c not in ("product_id", "display_name")]
    shown = items.select(F.col("product_id").alias("parent_asin"), "display_name", F.to_json(F.struct(*features)).alias("product_features"))
    joined = rows.join(shown, "parent_asin", "inner" if require_match else "left")
    ids = identity.imported_id(panelist_id=F.col("user_id"), product_id=F.col("parent_asin"), source_child_asin=F.col("asin"), timestamp=F.col("timestamp"), t=F.col("t"))
    empty = F.lit("{}")
    return joined.select(
        F.lit("0.1.0").alias("schema_version"), ids.alias("event_id"), F.lit("evaluation").alias("event_type"), F.lit("manual").alias("policy"),
        F.col("user_id").alias("panelist_id"), "t", F.lit(None).cast("string").alias("selection_id"), F.lit(None).cast("array<string>").alias("choice_set"),
        F.lit(None).cast("array<string>").alias("selected_product_ids"), F.col("parent_asin").alias("product_id"), F.coalesce("display_name", F.lit("")).alias("product_display"),
        F.parse_json(panelist_features).alias("panelist_features"), F.parse_json(F.coalesce("product_features", empty)).alias("product_features"),
        F.to_variant_object(F.struct("rating", "verified_purchase", "helpful_vote")).alias("outcomes"), traces(joined, trace_names, raw).alias("traces"), "_ord",
    )


def stats(reviews: DataFrame, raw_items: DataFrame, min_reviews: int = 1) -> DataFrame:
    """One row of import counts."""
    items = products(raw_items)
    seen = matched(reviews, items).agg(F.count("*").alias("n_reviews"), F.count_if(~F.col("matched")).alias("n_unmatched"))
    people = personas(reviews, min_reviews).agg(F.count("*").alias("n_personas"))
    raw = raw_items.agg(F.count("*").alias("n_raw_products"))
    known = items.agg(F.count("*").alias("n_products"))
    return seen.join(people).join(raw).join(known)  # single rows
