"""Findings of round 4: pairs were sent as rows, and distances computed that are not asked for."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortflow import queries as Q
from cohortflow.operators import metrics as M
from cohortflow.operators import pairs as K


def shuffled(spark, run):
    """Bytes written to shuffles while run() works, and its result."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = written()
    out = run()
    return sum(n for s, n in written().items() if s not in before), out


def cells(spark, seed=1, people=1500, items=300, each=20):
    rng = np.random.default_rng(seed)
    rows = {(f"person-{p:06d}", f"item-{q:06d}"): float(rng.integers(1, 6)) for p in range(people) for q in rng.integers(0, items, each)}
    return spark.createDataFrame([(*k, x) for k, x in rows.items()], "panelist_id string, product_id string, x double"), rows


def brute(rows, entity=0):
    of_item, pairs = {}, {}
    for key, x in rows.items():
        of_item.setdefault(key[1 - entity], []).append((key[entity], x))
    for members in of_item.values():
        for (e, x), (f, y) in itertools.combinations(sorted(members), 2):
            pairs.setdefault((e, f), []).append(abs(x - y))
    return sum(sum(d) / len(d) for d in pairs.values()) / len(pairs), len(pairs), sum(map(len, pairs.values()))


def test_pairs_of_products_are_sent_packed(spark):
    """A pair was a row of two names and two numbers: some 17 bytes in the shuffle and more."""
    frame, rows = cells(spark, people=4000, items=3000, each=30)
    sent, got = shuffled(spark, lambda: M.mean_pairwise_distance(frame, F.col("x"), "product_id", "panelist_id").first())
    mean, n, n_rows = brute(rows, 1)
    assert got.n_pairs == n and got.mean_distance == pytest.approx(mean, rel=1e-9)
    assert n_rows > 1_500_000 and sent < 6 * n_rows


def test_pairs_of_a_crowded_item_are_all_made(spark):
    """An item that 2,500 entities share, in 3 blocks, beside others; each pair of them is one, with ties and all."""
    x = {f"e{i}": float(i * i % 11) for i in range(2500)}
    rows = {(e, "hot"): v for e, v in x.items()} | {(f"e{i}", f"i{i % 100}"): float(i % 5) for i in range(2500)}
    frame = spark.createDataFrame([(*k, v) for k, v in rows.items()], "p string, q string, x double")
    mean, n, _ = brute(rows)
    got = M.mean_pairwise_distance(frame, F.col("x"), "p", "q").first()
    assert n == got.n_pairs == 2500 * 2499 // 2 and got.mean_distance == pytest.approx(mean, rel=1e-9)


def test_pairs_of_odd_keys_and_values(spark):
    for kind, names in (("long", [-5, 0, 2**40]), ("date", ["2020-01-01", "1969-12-31", "2262-04-11"])):
        frame = spark.createDataFrame([(str(a), b, x) for a, b, x in [(names[0], "", 1.0), (names[0], "", 3.0), (names[1], "", 5.0), (names[2], "z", 1.0), (names[2], "y", None), (names[0], None, 9.0)]], "p string, q string, x double")
        got = M.mean_pairwise_distance(frame.withColumn("p", F.col("p").cast(kind)), F.col("x"), "p", "q").first()
        assert tuple(got) == (3.0, 1)
    one = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "p string, q string, x double")
    assert tuple(M.mean_pairwise_distance(one, F.col("x"), "p", "q").first()) == (None, 0)
    far = spark.createDataFrame([("a", "x", math.inf), ("b", "x", math.inf), ("c", "x", 1.0)], "p string, q string, x double")
    got = M.mean_pairwise_distance(far, F.col("x"), "p", "q").first()
    assert math.isnan(got.mean_distance) and got.n_pairs == 3
    assert tuple(M.mean_pairwise_distance(one, F.col("x").cast("decimal(9,2)"), "q", "p").first()) == (1.0, 1)


@pytest.mark.parametrize(("chunk", "parts", "rows"), [(1, 1, 1), (7, 3, 4), (64, 70_000, 5), (1 << 21, 2, 1 << 20)])
def test_pairs_of_lists_in_any_chunks_and_rounds(monkeypatch, chunk, parts, rows):
    monkeypatch.setattr(K, "CHUNK", chunk)
    lists = [(True, [(3, 1.0), (9, 2.0), (4, 4.0), (1, 0.5)], []), (False, [(1, 2.0), (3, 7.0)], [(9, 1.0), (8, 1.0), (4, -2.0)]), (True, [], []), (False, [(5, 1.0)], []), (True, [(9, 0.0)], []), (True, [(4, 3.0), (3, 1.0)], [])]
    batch = lambda some: pa.RecordBatch.from_pylist([{"own": o, "near": [{"e": e, "x": x} for e, x in a], "far": [{"e": e, "x": x} for e, x in b]} for o, a, b in some], pa.schema([("own", pa.bool_()), *[(c, pa.list_(pa.struct([("e", pa.int32()), ("x", pa.float64())]))) for c in ("near", "far")]]))
    want = {}
    for own, near, far in lists:
        for (e, x), (f, y) in itertools.combinations(near, 2) if own else itertools.product(near, far):
            want.setdefault(frozenset((e, f)), []).append(abs(x - y))
    made = list(K.meet(iter([batch(lists[:4]), batch(lists[4:]), batch([])]), parts))
    s = n = 0
    for part in range(min(parts, 10)):
        mine = [b.filter(pa.array(b.column("part").to_numpy() == part)) for b in made]
        (got,) = K.mean_distances(iter(mine), rows)
        s, n = s + got.column("s")[0].as_py(), n + got.column("n")[0].as_py()
    assert n == len(want) and s == pytest.approx(sum(sum(d) / len(d) for d in want.values()))


def test_pairs_of_panelists_are_sent_packed(spark):
    frame, rows = cells(spark, 2, 3000, 600, 30)
    sent, got = shuffled(spark, lambda: M.mean_pairwise_distance(frame, F.col("x"), "panelist_id", "product_id").first())
    mean, n, n_rows = brute(rows)
    assert got.n_pairs == n and got.mean_distance == pytest.approx(mean, rel=1e-9)
    assert n_rows > 5_000_000 and sent < 5 * n_rows


def test_dispersion_computes_what_it_returns(spark, data, monkeypatch):
    """The query returns two variances; both distances of pairs were computed for it too, and dropped."""
    monkeypatch.setattr(M, "mean_pairwise_distance", None)
    out = Q.persona_dispersion(spark, data)
    assert out.columns == ["variance_of_panelist_means", "variance_of_product_means"] and None not in out.first()


def test_persona_metrics_are_whole(spark):
    frame, _ = cells(spark, 3, 60, 15, 6)
    row, x = M.persona_metrics(frame, F.col("x")).first(), F.col("x")
    assert list(row.asDict()) == list(M.PERSONA)
    assert row.variance_of_product_means == pytest.approx(np.var([r.m for r in frame.groupBy("product_id").agg(F.avg("x").alias("m")).collect()]))
    assert row.variance_of_panelist_means == pytest.approx(np.var([r.m for r in frame.groupBy("panelist_id").agg(F.avg("x").alias("m")).collect()]))
    for outer, inner in (("panelist", "product"), ("product", "panelist")):
        assert row[f"within_{outer}_variance"] == M.mean_within(frame, x, f"{outer}_id", f"{inner}_id").first().mean_variance
        assert row[f"{outer}_distance"] == pytest.approx(M.mean_pairwise_distance(frame, x, f"{outer}_id", f"{inner}_id").first().mean_distance)
