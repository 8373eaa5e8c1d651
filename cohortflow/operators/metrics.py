"""Single-run metrics: completeness, summaries, dispersion, entropy, distances between panelists."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import stats as S
from ..plans.storage import stored
from . import pairs as K
from .features import leaves


def evaluations(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'evaluation'")


def long_fields(events: DataFrame, payload: str, fields: list[str], *keep: str) -> DataFrame:
    """One row per event and declared field: keep, field, there, label, number, text. One pass."""
    one = [F.struct(F.lit(f).alias("field"), F.to_json(P.field(F.col(payload), f)).alias("j")) for f in fields]
    j = F.col("j")
    number = F.when(j.rlike("^-?[0-9]"), j.try_cast("double"))
    text = F.when(j.startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), j, F.lit("}")), "$.a"))
    rows = events.select(*keep, F.explode(F.array(*one)).alias("_f")).select(*keep, "_f.*")
    return rows.select(*keep, "field", F.coalesce(j != "null", F.lit(False)).alias("there"), P.json_label(j).alias("label"), number.alias("number"), text.alias("text"))


def run_summary(events: DataFrame) -> DataFrame:
    product = F.when(F.col("event_type") == "evaluation", F.col("product_id"))
    return events.agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "evaluation").alias("n_evaluations"), F.count_if(F.col("event_type") == "selection").alias("n_selections"), F.count_distinct("panelist_id").alias("n_panelists"), F.count_distinct(product).alias("n_products"), F.count_distinct("t").alias("n_periods"))


def counts_by(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"))


def numeric_summary(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy(*keys, "field").agg(F.count_if("there").alias("n_observed"), F.count_if(~F.col("there")).alias("n_missing"), F.avg("number").alias("mean"), F.min("number").alias("min"), F.max("number").alias("max"), S.variance(F.col("number")).alias("variance"))


def value_counts(long: DataFrame) -> DataFrame:
    return long.where("label IS NOT NULL").groupBy("field", "label").agg(F.count("*").alias("n"))


def top_values(long: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent labels of each field, ties by first occurrence (long has _ord)."""
    counts = long.where("label IS NOT NULL").groupBy("field", "label").agg(F.count("*").alias("n"), F.min("_ord").alias("first"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", place).where(F.col("rank") <= k).select("field", "label", "n", "rank")


def text_summary(long: DataFrame) -> DataFrame:
    n = F.length("text")
    return long.groupBy("field").agg(F.count("text").alias("n"), F.avg(n).alias("mean_chars"), F.min(n).cast("bigint").alias("min_chars"), F.max(n).cast("bigint").alias("max_chars"))


#: Which summary suits a declared type.
SUMMARIES = {"int": "numeric", "float": "numeric", "categorical": "categorical", "bool": "categorical", "text": "text"}


def value_summaries(long: DataFrame, types: dict[str, str]) -> DataFrame:
    """field, kind, n_observed, n_missing and what suits the field's declared type (others null), in one pass: mean, min,
    max, variance of numbers; values, entropy of categories; mean_chars of texts. Fields that are not declared, or of a
    type without a summary, are left out."""
    kinds = {f: SUMMARIES[t] for f, t in types.items() if t in SUMMARIES}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("field")]
    rows = long.where(F.col("field").isin(list(kinds))).withColumn("kind", kind)
    per_value = rows.groupBy("field", "kind", "label").agg(
        F.count_if("there").alias("n"), F.count_if(~F.col("there")).alias("gone"), F.count("number").alias("k"), F.sum("number").alias("s"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"),
    )
    # values are counted first; a label's numbers are all alike, so moments follow from the counts
    counted = F.when(F.col("label").isNotNull(), F.col("n"))
    mean = F.try_divide(F.sum("s"), F.sum("k"))
    square = F.try_divide(F.sum(F.when(F.col("k") > 0, F.col("s") * F.col("s") / F.col("k"))), F.sum("k"))
    out = per_value.groupBy("field", "kind").agg(
        F.sum("n").alias("n_observed"), F.sum("gone").alias("n_missing"), mean.alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"), F.when(F.sum("k") >= 2, F.greatest(square - mean * mean, F.lit(0.0))).alias("variance"),
        F.count_if(counted > 0).alias("values"), S.entropy(F.when(counted > 0, counted)).alias("entropy"), F.try_divide(F.sum("chars"), F.sum("texts")).alias("mean_chars"),
    )
    suits = {"numeric": ("mean", "min", "max", "variance"), "categorical": ("values", "entropy"), "text": ("mean_chars",)}
    return out.select("field", "kind", "n_observed", "n_missing", *[F.when(F.col("kind") == k, F.col(c)).alias(c) for k, names in suits.items() for c in names])


def missing_rates(long: DataFrame) -> DataFrame:
    return long.groupBy("field").agg(S.rate(~F.col("there")).alias("missing_rate"))


def quality(events: DataFrame) -> DataFrame:
    """One row: shares of evaluations with filled outcomes and of events with filled traces."""
    mine = F.col("event_type") == "evaluation"
    good = mine & P.filled(F.col("outcomes"))
    n = F.count_if(mine)
    return events.agg(F.coalesce(F.try_divide(F.count_if(good), n), F.lit(0.0)).alias("outcome_rate"), S.rate(P.filled(F.col("traces"))).alias("trace_rate"), n.alias("n_evaluations"))


def diversity(long: DataFrame, support: dict[str, int]) -> DataFrame:
    """Per field: n, observed and full support, entropy in bits, normalized both ways, mean, variance.
    Values are counted first; entropies come from the counts."""
    per_value = long.where("label IS NOT NULL").groupBy("field", "label").agg(F.count("*").alias("n"))
    bits = per_value.groupBy("field").agg(F.sum("n").alias("n"), F.count("*").alias("observed_support"), S.entropy(F.col("n")).alias("entropy"))
    moments = long.groupBy("field").agg(F.avg("number").alias("mean"), S.variance(F.col("number")).alias("variance"))
    full = F.coalesce(F.create_map(*[x for k, v in support.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])[F.col("field")], F.col("observed_support")) if support else F.col("observed_support")
    out = bits.join(moments, "field").withColumn("full_support", full)
    return out.withColumn("entropy_full", S.normalized(F.col("entropy"), F.col("full_support"))).withColumn("entropy_observed", S.normalized(F.col("entropy"), F.col("observed_support")))


def by_group(events: DataFrame, value: Column, *keys: str) -> DataFrame:
    """n, mean and population variance of a value in each group; a null key is a group."""
    rows = events.select(*keys, value.alias("_x")).where("_x IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), S.variance(F.col("_x")).alias("variance"))


def mean_within(events: DataFrame, value: Column, outer: str, inner: str) -> DataFrame:
    """One row: the mean, over groups of `outer` with two or more `inner` members, of the variance of the
    members' means."""
    cells = by_group(events, value, outer, inner)
    spread = cells.groupBy(outer).agg(S.variance(F.col("mean")).alias("variance")).where("variance IS NOT NULL")
    return spread.agg(F.avg("variance").alias("mean_variance"), F.count("*").alias("n_groups"))


#: Entities of an item that meet in one key, so that a key makes BLOCK * BLOCK pairs at most.
BLOCK = 1024
#: Pairs that a task adds up (some 100 bytes of memory each), and the most tasks: of more pairs, a task adds up some at a time.
PAIR_ROWS, PAIR_TASKS = 2_000_000, 10_000


def pairwise_work(events: DataFrame, value: Column, entity: str, item: str) -> DataFrame:
    """One row: how many pairs mean_pairwise_distance() would make, n (n - 1) / 2 for each item of n entities, with the
    number of items and the most entities of one. To look at before the run: one aggregation."""
    cells = by_group(events.where(F.col(entity).isNotNull() & F.col(item).isNotNull()), value, entity, item)
    n = F.col("n")
    per_item = cells.groupBy(item).agg(F.count("*").alias("n"))
    return per_item.agg(F.count("*").alias("n_items"), F.coalesce(F.max("n"), F.lit(0)).alias("most_entities"), F.coalesce(F.sum(F.floor(n * (n - 1) / 2)), F.lit(0)).alias("n_pair_rows"))


def numbered_cells(events: DataFrame, value: Column, entity: str, item: str) -> DataFrame:
    """e, i, x: the mean value of each entity and item, with the entities numbered from 0. One shuffle, by parts of the entities."""
    rows = events.select(F.col(entity).alias("name"), F.col(item).alias("i"), value.cast("double").alias("x")).where("name IS NOT NULL AND i IS NOT NULL AND x IS NOT NULL")
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = 8 * tasks
    cells = rows.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(spread)).cast("int")).repartition(tasks, "part").groupBy("part", "name", "i").agg(F.avg("x").alias("x"))
    placed = stored(cells.select("part", F.dense_rank().over(W.partitionBy("part").orderBy("name")).alias("place"), "i", "x"))
    counts = placed.groupBy("part").agg(F.max("place").cast("bigint").alias("n"))
    # `spread` rows
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    e = F.col("before") + F.col("place") - 1
    few = F.when(e < 1 << 31, e).otherwise(F.raise_error(F.lit("pairs of more than 2^31 entities")).cast("bigint"))
    return placed.join(F.broadcast(before), "part").select(few.cast("int").alias("e"), "i", "x")


def mean_pairwise_distance(events: DataFrame, value: Column, entity: str, item: str, block: int = BLOCK) -> DataFrame:
    """One row: the mean, over pairs of entities with shared items, of the mean absolute difference of
    their values; and the number of such pairs.

    Pairs meet on shared items only (pairwise_work() tells how many there are). The entities of an item that very many
    share are dealt to blocks, and blocks meet two by two, each pair of blocks in a list of its own. Pairs are made within
    tasks from the lists, and sent once, packed, to tasks in number with the pairs.
    """
    cells = numbered_cells(events, value, entity, item)
    sizes, n = stored(cells.groupBy("i").agg(F.count("*").alias("n"))), F.col("n")
    n_rows = sizes.agg(F.coalesce(F.sum(F.floor(n * (n - 1) / 2)), F.lit(0))).first()[0]
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(-(-n_rows // PAIR_ROWS), PAIR_TASKS), min(tasks, 1 + 8 * n_rows // PAIR_ROWS))
    many = [-(-n_rows // (8 * PAIR_ROWS))] if n_rows > 8 * PAIR_ROWS * tasks else []  # else as few tasks as the lists need: each sends to all parts
    shared = sizes.where(n > block).select("i", F.ceil(n / F.lit(block)).cast("int").alias("blocks"))  # a row per `block` cells at most
    blocked = cells.join(F.broadcast(shared), "i", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("e"), "blocks").cast("int"))
    each = blocked.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("e", "i", "x", "b", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"))
    side = lambda mine: F.collect_list(F.when(mine, F.struct("e", "x")))
    lists = each.repartition(*many, "i", "low", "high").groupBy("i", "low", "high").agg(side(F.col("b") == F.col("low")).alias("near"), side(F.col("b") != F.col("low")).alias("far"))
    sent = lists.select((F.col("low") == F.col("high")).alias("own"), "near", "far").mapInArrow(partial(K.meet, parts=parts), "part int, n long, one binary, two binary, d binary")
    sums = sent.repartitionById(parts, F.col("part")).drop("part").mapInArrow(partial(K.mean_distances, rows=2 * PAIR_ROWS), "s double, n long")
    return sums.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean_distance"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


#: What persona_metrics() gives, and by which entity (and items).
PERSONA = {
    "variance_of_panelist_means": ("panelist_id",), "variance_of_product_means": ("product_id",), "within_product_variance": ("product_id", "panelist_id"),
    "within_panelist_variance": ("panelist_id", "product_id"), "panelist_distance": ("panelist_id", "product_id"), "product_distance": ("product_id", "panelist_id"),
}


def persona_metrics(events: DataFrame, value: Column, *names: str) -> DataFrame:
    """One row of dispersion metrics of a numeric outcome: those named, or all. Only these are computed: the distances of pairs cost far
    more than the others, and a column that is dropped later would be computed still."""

    def metric(name: str) -> DataFrame:
        if name.endswith("_means"):
            return by_group(events, value, *PERSONA[name]).agg(S.variance(F.col("mean")).alias(name))
        made = (mean_within if name.endswith("_variance") else mean_pairwise_distance)(events, value, *PERSONA[name])
        return made.select(F.col(made.columns[0]).alias(name))

    out, *others = [metric(name) for name in names or PERSONA]
    for one in others:
        out = out.join(one)  # single rows
    return out


def labelled_values(rows: DataFrame, label: str, value: str, order: str = "value_desc", max_items: int | None = None) -> DataFrame:
    """Rows for a chart: sorted by label or value, the first max_items."""
    column, way = {"label": label, "value": value}[order.split("_")[0]], order.split("_")[1]
    first = F.col(column).desc() if way == "desc" else F.col(column).asc()
    out = rows.orderBy(first, F.col(label))
    return out if max_items is None else out.limit(max_items)


def flat_evaluations(events: DataFrame, outcomes: list[str], features: list[str] = ()) -> DataFrame:
    """Ids with a column per outcome (number, else text) and per panelist. / product. feature."""
    columns = [c for c in ("event_id", "panelist_id", "product_id", "t") if c not in outcomes]
    values = [P.label(F.col("outcomes"), f).alias(f) for f in outcomes]
    for f in features:
        side, path = f.split(".", 1)
        values.append(P.label(F.col(f"{side}_features"), path).alias(f))
    return evaluations(events).select(*columns, *values)


def feature_paths(events: DataFrame, payload: str) -> DataFrame:
    """path, value of all scalar leaves of an object, with dotted paths; lists are left out. The paths are found
    first (features.leaves), then all are read in one pass."""
    (found,) = leaves(events, payload)
    if not found:
        return events.select("event_id", F.lit("").alias("path"), F.lit("").alias("value")).limit(0)
    each = F.array(*[F.struct(F.lit(leaf.name).alias("path"), F.try_variant_get(F.col(payload), leaf.path, "variant").alias("v")) for leaf in found])
    rows = events.select("event_id", F.explode(each).alias("x")).select("event_id", "x.path", "x.v")
    return rows.where(F.col("v").isNotNull() & ~F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)")).select("event_id", "path", F.to_json("v").alias("value"))
