"""Weighted draws from catalogs of any size, pairs of popular items in blocks."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import exposure as X
from cohortflow.operators import metrics as M

PEOPLE = 30_000


def inclusion(p):
    """Chance of each product to be first, and to be among two drawn one after the other."""
    p = np.array(p) / sum(p)
    ratio = (p / (1 - p)).sum() - p / (1 - p)
    return p, p + p * ratio


def chi_square(seen, chance, n):
    return float(((seen - n * chance) ** 2 / (n * chance * (1 - chance / chance.sum()))).sum())


@pytest.mark.parametrize("broadcast", [True, False])
def test_weighted_draws_follow_the_weights(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(X, "BROADCAST_PRODUCTS", 0)
    weights = [50.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 7.9, 8.0, 8.1, 16.0, 33.0]
    goods = spark.createDataFrame([(f"p{i:02d}", w) for i, w in enumerate(weights)] + [("none", 0.0), ("null", None)], "product_id string, weight double")
    people = spark.range(PEOPLE).select(F.col("id").cast("string").alias("panelist_id"))
    rows = X.weighted(people, goods, 2, 1, 11).collect()
    assert len(rows) == 2 * PEOPLE and len({(r.panelist_id, r.product_id) for r in rows}) == 2 * PEOPLE
    first, both = inclusion(weights)
    names = [f"p{i:02d}" for i in range(len(weights))]
    at_first, at_all = Counter(r.product_id for r in rows if r.slot == 0), Counter(r.product_id for r in rows)
    assert set(at_all) == set(names)
    # 11 degrees of freedom: beyond 31.3 in one case of a thousand
    assert chi_square(np.array([at_first[x] for x in names]), first, PEOPLE) < 31.3
    assert (((np.array([at_all[x] for x in names]) - PEOPLE * both) / np.sqrt(PEOPLE * both * (1 - both) + 1e-9)) ** 2).max() < 16


def test_weighted_draws_at_the_edges(spark):
    """Weights far apart, all products wanted, more than there are; draws do not depend on partitions."""
    people = spark.range(40).select(F.col("id").cast("string").alias("panelist_id"))
    apart = spark.createDataFrame([("a", 1e300), ("b", 1.0), ("c", 1e-300), ("d", 5e-324)], "product_id string, weight double")
    rows = X.weighted(people, apart, 4, 2, 3)
    lists = {(r.panelist_id, r.t): r.p for r in rows.groupBy("panelist_id", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "product_id"))), lambda x: x["product_id"]), "").alias("p")).collect()}
    assert len(lists) == 80 and set(lists.values()) == {"abcd"}
    assert X.weighted(people, apart, 9, 1, 3).count() == 160
    key = lambda r: (r.panelist_id, r.t, r.slot, r.product_id)
    many = spark.range(300).select(F.col("id").alias("product_id"), (1 + F.col("id") % 9).alias("weight"))
    one, two = (sorted(map(key, X.weighted(people.repartition(n), many.repartition(n), 5, 1, 8).collect())) for n in (1, 7))
    assert one == two and len({x[3] for x in one}) > 60 and all(isinstance(x[3], int) for x in one)
    with pytest.raises(ValueError):
        X.weighted(people, spark.createDataFrame([("a", 1.0), ("b", 0.0)], "product_id string, weight double"), 2)
    with pytest.raises(ValueError):
        X.weighted(people, spark.createDataFrame([("a", -1.0)], "product_id string, weight double"), 1)
    assert X.weighted(people, apart.limit(0), 2).count() == 0


def test_balanced_shows_each_product_once(spark):
    people = spark.createDataFrame([("a",), ("b",)], "panelist_id string")
    goods = spark.createDataFrame([("x",), ("y",), ("z",)], "product_id string")
    rows = X.balanced(people, goods, 2, 5, 1).collect()
    assert len(rows) == 12 and len({(r.panelist_id, r.t, r.product_id) for r in rows}) == 12


def test_pairs_in_blocks_are_the_same_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [("evaluation", f"e{e}", "hot" if rng.random() < 0.5 else f"i{rng.integers(0, 20)}", float(rng.integers(1, 6))) for e in range(120) for _ in range(4)]
    events = spark.createDataFrame(rows + [("evaluation", None, "hot", 1.0), ("evaluation", "e1", None, 1.0)], "event_type string, panelist_id string, product_id string, x double")
    value = F.col("x")
    cells = {}
    for _, e, i, x in rows:
        cells.setdefault(i, {}).setdefault(e, []).append(x)
    pairs = {}
    for members in cells.values():
        mean = {e: sum(x) / len(x) for e, x in members.items()}
        for e in mean:
            for f in mean:
                if e < f:
                    pairs.setdefault((e, f), []).append(abs(mean[e] - mean[f]))
    want = sum(sum(d) / len(d) for d in pairs.values()) / len(pairs)
    for block in (1, 7, 64, 1024):
        got = M.mean_pairwise_distance(events, value, "panelist_id", "product_id", block).first()
        assert got.n_pairs == len(pairs) and got.mean_distance == pytest.approx(want)
    work = M.pairwise_work(events, value, "panelist_id", "product_id").first()
    assert work.n_pair_rows == sum(len(m) * (len(m) - 1) // 2 for m in cells.values()) and work.most_entities == max(map(len, cells.values()))
    assert M.mean_pairwise_distance(events.limit(0), value, "panelist_id", "product_id").first().n_pairs == 0
