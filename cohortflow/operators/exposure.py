"""Exposure assignment: who sees which product in which period.

All randomness is counter-based - a hash of (seed, period, panelist, product) - so results do not depend
on order or partitioning, and a resumed run draws what the first would have drawn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity
from ..plans.storage import stored
from ..sources.reviews import numbered


def upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def periods(panelists: DataFrame, n_periods: int) -> DataFrame:
    """panelist_id, t of every panelist and period, dealt to all tasks: panelists come in a file or two, and draws are work."""
    parts = int(panelists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return panelists.select("panelist_id").repartition(parts, "panelist_id").select("panelist_id", F.explode(upto(n_periods)).alias("t"))


def balanced(panelists: DataFrame, products: DataFrame, n_periods: int = 1, per_period: int = 1, seed: int = 0) -> DataFrame:
    """panelist_id, t, slot, product_id: in each period product counts differ by one at most.

    Panelists and products are numbered in a seeded random order (a distributed sort); slot number s of
    a period takes product (s + shift(t)) mod m. A panelist's slots are consecutive, so it sees each product once; as
    many as there are, where per_period exceeds them.
    """
    people = numbered(panelists.select("panelist_id"), [identity.draw(seed, F.lit("panelist"), F.col("panelist_id")), F.col("panelist_id")], "i")
    goods = numbered(products.select("product_id"), [identity.draw(seed, F.lit("product"), F.col("product_id")), F.col("product_id")], "j")
    m = goods.agg(F.count("*")).first()[0]
    if not m:
        raise ValueError("no products to assign")
    per_period = min(per_period, m)
    slots = people.select("panelist_id", "i", F.explode(upto(n_periods)).alias("t")).select("panelist_id", "t", "i", F.explode(upto(per_period)).alias("slot"))
    shift = F.pmod(identity.bits(seed, F.lit("shift"), F.col("t")), F.lit(m))
    return slots.withColumn("j", F.pmod(F.col("i") * per_period + F.col("slot") + shift, F.lit(m))).join(goods, "j").select("panelist_id", "t", "slot", "product_id")


#: Products up to which the catalog of weighted() is broadcast whole (some 60 bytes each). A larger one is joined by
#: shuffle, but for its heavy classes: products of more than a thousandth of all weight, at most some 2,000.
BROADCAST_PRODUCTS = 200_000


def weight_classes(goods: DataFrame) -> tuple[DataFrame, list]:
    """goods: product_id, weight > 0. class (of weights within a factor of two), i (number within it), product_id, accept
    (weight over the class's largest); and the classes themselves: class, n, cap, in order. A double has some 2,000."""
    rows = goods.withColumn("class", F.floor(F.log2("weight")).cast("int"))
    classes = rows.groupBy("class").agg(F.count("*").alias("n"), F.max("weight").alias("cap")).orderBy("class").collect()
    first, starts = 0, {}
    for r in classes:
        starts[r["class"]], first = first, first + r.n
    about = goods.sparkSession.createDataFrame([(r["class"], starts[r["class"]], r.cap) for r in classes], "class int, first long, cap double")
    placed = numbered(rows, [F.col("class"), F.col("product_id")], "j").join(F.broadcast(about), "class")
    return stored(placed.select("class", (F.col("j") - F.col("first")).alias("i"), "product_id", (F.col("weight") / F.col("cap")).alias("accept"))), classes


def proposals(state: DataFrame, classes: list, k: int, draw: Callable[..., Column]) -> DataFrame:
    """state: panelist_id, t, drawn (class, i, product_id). Places of the catalog to try: class and i, in order of s, and v
    below which a product's `accept` must not lie. Products drawn before are passed over."""
    table = F.array(*[F.struct(F.lit(r["class"]).alias("class"), F.lit(r.n).cast("bigint").alias("n"), F.lit(float(r.cap)).alias("cap")) for r in classes])
    left = F.transform(table, lambda c: F.struct(c["class"].alias("class"), (c["n"] - F.size(F.filter("drawn", lambda d: d["class"] == c["class"]))).alias("n"), c["cap"].alias("cap")))
    left = F.filter(left, lambda c: c["n"] > 0)
    tries = state.withColumn("left", left).withColumn("mass", F.aggregate("left", F.lit(0.0), lambda a, c: a + c["n"] * c["cap"]))
    tries = tries.withColumn("s", F.explode(F.sequence(F.lit(0), 2 * (F.lit(k) - F.size("drawn")) + 1)))
    # the class in which a point of all mass falls; of rounding, the last
    start = F.struct((draw(F.lit("class")) * F.col("mass")).alias("rest"), F.lit(None).cast("struct<class:int,n:bigint,cap:double>").alias("found"))
    step = lambda a, c: F.struct((a["rest"] - F.when(a["found"].isNull(), c["n"] * c["cap"]).otherwise(0.0)).alias("rest"), F.when(a["found"].isNull() & (a["rest"] < c["n"] * c["cap"]), c).otherwise(a["found"]).alias("found"))
    tries = tries.withColumn("c", F.coalesce(F.aggregate("left", start, step)["found"], F.element_at("left", -1)))
    place = F.floor(draw(F.lit("place")) * F.col("c.n")).cast("bigint")
    gone = F.array_sort(F.transform(F.filter("drawn", lambda d: d["class"] == F.col("c.class")), lambda d: d["i"]))
    over = F.aggregate(gone, place, lambda at, i: F.when(at >= i, at + 1).otherwise(at))
    return tries.select("panelist_id", "t", "s", F.col("c.class").alias("class"), over.alias("i"), draw(F.lit("accept")).alias("v"))


def weighted(panelists: DataFrame, products: DataFrame, k: int, n_periods: int = 1, seed: int = 0) -> DataFrame:
    """k products for each panelist and period, one after the other with probabilities in proportion to the weights of
    those not drawn yet (products: product_id, weight; a missing weight is 0). k is at most the size of
    the catalog; fewer products of positive weight than that are refused. For catalogs of any size.

    Products are dealt to classes of weights within a factor of two. A try draws a class by what its products would
    weigh at its largest weight, a place within it, and keeps the product there with probability weight / largest, so
    every product is met in proportion to its own weight, and every second try at least is kept. Tries meet the catalog
    by class and place: the catalog is never sorted or carried for a panelist. Repeats are no draws; rows
    that lack products try anew, past those they have, in rounds that are written.
    """
    goods = products.select("product_id", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    low, n, every = goods.agg(F.min("weight"), F.count_if(F.col("weight") > 0), F.count("*")).first()
    if low is not None and low < 0:
        raise ValueError("weights must not be negative")
    k = min(k, every)
    if n < k:
        raise ValueError(f"{n} products of positive weight, {k} wanted")
    if k < 1:
        return periods(panelists, n_periods).select("panelist_id", "t", F.lit(0).cast("bigint").alias("slot"), F.lit("").alias("product_id")).limit(0)
    catalog, classes = weight_classes(goods.where("weight > 0"))
    total = sum(r.n * r.cap for r in classes)
    heavy = [r["class"] for r in classes if r.cap * 1000 >= total]
    done, turn = None, 0
    drawn = F.array().cast("array<struct<class:int,i:bigint,product_id:string>>")
    state = periods(panelists, n_periods).withColumn("drawn", drawn)
    while True:
        tries = proposals(state, classes, k, lambda what, turn=turn: identity.draw(seed, F.lit(turn), what, F.col("panelist_id"), F.col("t"), F.col("s")))
        if n <= BROADCAST_PRODUCTS:
            met = tries.join(F.broadcast(catalog), ["class", "i"])
        else:
            is_heavy = F.col("class").isin(heavy)
            met = tries.where(is_heavy).join(F.broadcast(catalog.where(is_heavy)), ["class", "i"]).unionByName(tries.where(~is_heavy).join(catalog.where(~is_heavy), ["class", "i"]))
        kept = met.where("v < accept").groupBy("panelist_id", "t").agg(F.array_sort(F.collect_list(F.struct("s", "class", "i", F.col("product_id").cast("string").alias("product_id")))).alias("new"))  # 2 k + 2 at most
        new = F.coalesce(F.transform("new", lambda x: F.struct(x["class"].alias("class"), x["i"].alias("i"), x["product_id"].alias("product_id"))), drawn)
        state = stored(state.join(kept, ["panelist_id", "t"], "left").select("panelist_id", "t", F.slice(F.array_distinct(F.concat("drawn", new)), 1, k).alias("drawn")))
        full = state.where(F.size("drawn") == k)
        done = full if done is None else done.unionByName(full)
        state = state.where(F.size("drawn") < k)
        turn += 1
        if state.isEmpty():
            break
    rows = done.select("panelist_id", "t", F.posexplode("drawn").alias("slot", "b"))
    return rows.select("panelist_id", "t", F.col("slot").cast("bigint").alias("slot"), F.col("b.product_id").cast(dict(products.dtypes)["product_id"]).alias("product_id"))


def uniform(panelists: DataFrame, products: DataFrame, k: int, n_periods: int = 1, seed: int = 0) -> DataFrame:
    """k distinct products, uniform, for each panelist and period, for catalogs of any size: a random start
    and stride over the numbered catalog (coprime strides visit each product once)."""
    goods = numbered(products.select("product_id"), [identity.draw(seed, F.lit("product"), F.col("product_id")), F.col("product_id")], "j")
    m = goods.agg(F.count("*")).first()[0]
    if k > m:
        raise ValueError(f"{m} products, {k} wanted")
    prime = next(p for p in range(max(m, 2), 4 * m + 8) if all(p % d for d in range(2, int(p**0.5) + 1)))
    # places beyond the catalog are skipped: the stride walk over a prime visits k real ones within k + prime - m steps
    start = F.pmod(identity.bits(seed, F.lit("start"), F.col("panelist_id"), F.col("t")), F.lit(prime))
    stride = F.pmod(identity.bits(seed, F.lit("stride"), F.col("panelist_id"), F.col("t")), F.lit(prime - 1)) + 1
    walk = F.transform(F.sequence(F.lit(0), F.lit(k + prime - m - 1)), lambda s: F.pmod(start + s.cast("bigint") * stride, F.lit(prime)))
    places = F.slice(F.filter(walk, lambda x: x < m), 1, k)
    rows = periods(panelists, n_periods).select("panelist_id", "t", F.posexplode(places).alias("slot", "j"))
    return rows.join(goods, "j").select("panelist_id", "t", F.col("slot").cast("bigint").alias("slot"), "product_id")


def choice_sets(panelists: DataFrame, products: DataFrame, n_periods: int = 1, size: int | None = None, seed: int = 0) -> DataFrame:
    """panelist_id, t, choice_set: the whole catalog in order of id, or `size` products at random. The
    whole catalog as a list in every row is for catalogs of up to 100,000 products."""
    if size is not None:
        shown = uniform(panelists, products, size, n_periods, seed)
        return shown.groupBy("panelist_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "product_id"))), lambda x: x["product_id"]).alias("choice_set"))
    if products.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 products to show at once: give a size")
    return shown_to_all(panelists, products, n_periods)


def shown_to_all(panelists: DataFrame, products: DataFrame, n_periods: int = 1, about: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """panelist_id, t, choice_set: the whole catalog in order of id. about: in place of the list, what it says of the list
    (name: column); that is found once, as all rows show the same list, and any number of products will do."""
    catalog = products.agg(F.array_sort(F.collect_list("product_id")).alias("choice_set"))
    if about is not None:
        # one row; written, so that the list is not made and judged anew beside each row
        catalog = stored(catalog.select(*[c.alias(n) for n, c in about(F.col("choice_set")).items()]))
    return periods(panelists, n_periods).join(F.broadcast(catalog))


def manual(panelists: DataFrame, schedule: DataFrame, n_periods: int = 1) -> DataFrame:
    """panelist_id, t, product_ids as scheduled, in order; an absent (panelist, t) has an empty list."""
    lists = schedule.groupBy("panelist_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "product_id"))), lambda x: x["product_id"]).alias("product_ids"))
    none = F.array().cast("array<string>")
    return periods(panelists, n_periods).join(lists, ["panelist_id", "t"], "left").withColumn("product_ids", F.coalesce("product_ids", none))


def counts(assigned: DataFrame) -> DataFrame:
    """Per period the least and the most often that a product of the period is assigned."""
    return assigned.groupBy("t", "product_id").agg(F.count("*").alias("n")).groupBy("t").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))
