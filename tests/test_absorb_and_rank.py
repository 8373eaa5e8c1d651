"""Absorbed fixed effects, rank by QR, duplicates, ordered models of three classes, degenerate targets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import absorb, designs
from cohortflow.operators import regression as R
from cohortflow.plans.components import component_count


def panel(n=1500, people=50, goods=30, seed=0):
    rng = np.random.default_rng(seed)
    p, q = rng.integers(0, people, n), rng.integers(0, goods, n)
    x1, x2 = rng.standard_normal(n) + p / 30, rng.standard_normal(n) + q / 20
    y = 2 * x1 - x2 + 0.3 * p - 0.2 * q + rng.standard_normal(n)
    return pd.DataFrame({"y": y, "x1": x1, "age": 1.5 * p, "x2": x2, "p": [f"p{i:02d}" for i in p], "q": [f"q{i:02d}" for i in q]})


def dense(d, columns, effects):
    """Coefficients, residuals and bread of least squares with a dummy a level."""
    x = np.column_stack([np.ones(len(d)), d[columns], *[pd.get_dummies(d[e], drop_first=True, dtype=float) for e in effects]])
    bread = np.linalg.pinv(x.T @ x)
    b = bread @ x.T @ d.y
    return x, b, (d.y - x @ b).to_numpy(), bread


def clustered(x, e, bread, groups, k):
    s = pd.DataFrame(x * e[:, None]).groupby(groups).sum().to_numpy()
    return len(s) / (len(s) - 1) * (len(x) - 1) / (len(x) - k) * bread @ s.T @ s @ bread


def test_two_effects_equal_dummies(spark):
    d = panel()
    frame = spark.createDataFrame(d)
    x, b, e, bread = dense(d, ["x1", "x2"], ["p", "q"])
    n, k = x.shape
    both = clustered(x, e, bread, d.p.to_numpy(), k) + clustered(x, e, bread, d.q.to_numpy(), k) - clustered(x, e, bread, (d.p + d.q).to_numpy(), k)
    want = {"nonrobust": bread * (e @ e) / (n - k), "HC1": bread @ (x.T @ (x * (e**2)[:, None])) @ bread * n / (n - k), "cluster_two_way": both}
    for covariance, v in want.items():
        out = absorb.fit(frame, "y", ["x1", "age", "x2"], ["p", "q"], covariance, "p", "q")
        assert out.result.terms == ["x1", "x2"] and out.result.dropped == [("age", "absorbed")]
        assert np.allclose(out.result.estimate, b[1:3], atol=1e-8)
        assert np.allclose(np.diag(out.result.covariance), np.diag(v)[1:3], rtol=1e-6)
    assert (out.levels, out.components) == ({"p": 50, "q": 30}, 1) and out.change < 1e-8
    assert out.result.fit["r2"] == pytest.approx(1 - e @ e / ((d.y - d.y.mean()) ** 2).sum())
    effects = {(r.effect, r.level): r.estimate for r in out.effects.collect()}
    names = [(c, v) for c in "pq" for v in sorted(d[c].unique())[1:]]
    assert np.allclose([effects[x] for x in names], b[3:], atol=1e-6) and effects["p", "p00"] == effects["q", "q00"] == 0


def test_one_effect_nested_in_its_clusters(spark):
    d = panel(400, 20, 10, 1)
    x, b, e, bread = dense(d, ["x1"], ["p"])
    frame = spark.createDataFrame(d)
    full = absorb.fit(frame, "y", ["x1"], ["p"], "cluster_panelist", "p", "q")
    assert np.allclose(full.result.covariance[0, 0], clustered(x, e, bread, d.p.to_numpy(), 21)[1, 1], rtol=1e-8)
    less = absorb.fit(frame, "y", ["x1"], ["p"], "cluster_panelist", "p", "q", count_nested=False)
    assert np.allclose(less.result.covariance[0, 0], clustered(x, e, bread, d.p.to_numpy(), 2)[1, 1], rtol=1e-8)
    other = absorb.fit(frame, "y", ["x1"], ["p"], "cluster_product", "p", "q", count_nested=False)
    assert np.allclose(other.result.covariance[0, 0], clustered(x, e, bread, d.q.to_numpy(), 21)[1, 1], rtol=1e-8)


def test_apart_levels_slow_graphs_and_nulls(spark):
    """Two panels that share no level, one of them a chain, where means travel slowly; rows with nulls go."""
    rng = np.random.default_rng(2)
    chain = [(i, i + j) for i in range(12) for j in (0, 1) for _ in range(3)]
    p, q = np.array(chain + [(100 + i % 3, 100 + i % 4) for i in range(48)]).T
    x = rng.standard_normal(len(p)) + p / 50
    d = pd.DataFrame({"y": x + p * 0.1 + rng.standard_normal(len(p)), "x1": x, "p": p.astype(str), "q": q.astype(str)})
    _, b, e, _ = dense(d, ["x1"], ["p", "q"])
    gaps = pd.DataFrame({"y": [1.0, None, 2.0], "x1": [None, 1.0, 3.0], "p": ["0", "1", None], "q": ["0", "1", "2"]})
    frame = spark.createDataFrame(pd.concat([d, gaps]).astype(object).where(lambda x: x.notna(), None), "y double, x1 double, p string, q string")
    out = absorb.fit(frame, "y", ["x1"], ["p", "q"], tolerance=1e-11)
    assert out.components == 2 and out.result.fit["n"] == len(d)
    assert out.result.estimate[0] == pytest.approx(b[1], abs=1e-7) and out.result.df == len(d) - 1 - (15 + 17 - 2)
    with pytest.raises(ValueError):
        absorb.fit(frame.where("p = 'none'"), "y", ["x1"], ["p"])
    with pytest.raises(ValueError):
        absorb.fit(frame.withColumn("y", F.col("p").cast("double")), "y", ["x1"], ["p"])
    with pytest.raises(ValueError):
        absorb.fit(frame, "y", ["x1"], [])


def test_more_levels_than_a_dense_design_takes(spark):
    rows = spark.range(9000).select((F.col("id") % 3001).cast("string").alias("p"), F.sin(F.col("id") * 1.7).alias("x"), "id").withColumn("y", 3 * F.col("x") + F.col("p").cast("long") % 7)
    out = absorb.fit(rows.select("p", "x", (F.col("y") + F.cos(F.col("id") * 0.3)).alias("y")), "y", ["x"], ["p"])
    assert out.levels == {"p": 3001} and out.result.estimate[0] == pytest.approx(3, abs=0.1) and out.effects.count() == 3001
    with pytest.raises(ValueError):
        R.one_hot(rows, "p")


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), ("c", "a"), ("y", "y")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    assert component_count(spark.createDataFrame(edges, "a string, b string")) == 4
    assert component_count(spark.createDataFrame([], "a string, b string")) == 0


def greedy(x, n):
    """Columns that raise the rank, in order: the rule by brute force."""
    kept = []
    for j in range(x.shape[1]):
        if np.linalg.matrix_rank(x[:, [*kept, j]]) > len(kept):
            kept.append(j)
    return kept


def test_columns_that_go(spark):
    rng = np.random.default_rng(4)
    n = 500
    a, b = rng.standard_normal(n) + 40, rng.standard_normal(n) * 1e-3
    columns = {"seven": np.full(n, 7.0), "tenth": np.full(n, 0.1), "a": a, "b": b, "again": a.copy(), "sum": a - 3 * b, "near": a + rng.standard_normal(n) * 1e-5, "b2": b.copy(), "nearly": np.where(np.arange(n) == 3, a + 1e-9, a)}
    frame = spark.createDataFrame(pd.DataFrame(columns | {"y": a + rng.standard_normal(n)}))
    out = R.fit(R.Design(frame, "y", tuple(columns)))
    assert out.terms == ["const", "a", "b", "near", "nearly"]
    assert dict(out.dropped) == {"seven": "constant", "tenth": "constant", "again": "duplicate", "b2": "duplicate", "sum": "rank_deficient"}
    x = np.column_stack([np.ones(n), *[columns[c] for c in ("a", "b", "near")]])
    fine = R.fit(R.Design(frame, "y", ("a", "b", "near")))
    want = np.linalg.lstsq(x, frame.toPandas().y, rcond=None)[0]
    assert np.allclose(fine.estimate, want, rtol=1e-4)


def test_a_feature_that_is_constant_within_an_id_stays(spark):
    """As encoders that put numbers before dummies have it: the feature stays, the last dummy of its id goes."""
    d = panel(600, 6, 5, 5).rename(columns={"p": "panelist_id", "q": "product_id", "age": "panelist.age", "x1": "panelist.x"})
    d["product.kind"] = np.where(d.product_id < "q03", "low", "top")
    out = R.fit(designs.build(spark.createDataFrame(d.drop(columns="x2")), "features_plus_two_way_fe", "y"))
    x = pd.get_dummies(d[["panelist_id", "product_id", "panelist.age", "panelist.x", "product.kind"]], columns=["panelist_id", "product_id", "product.kind"], drop_first=True, dtype=float)
    x.insert(0, "const", 1.0)
    kept = [x.columns[j] for j in greedy(x.to_numpy(), len(x))]
    assert out.terms == kept and "panelist.age" in kept and "panelist_id_p05" not in kept
    assert dict(out.dropped) == {"panelist_id_p05": "rank_deficient", "product.kind_top": "rank_deficient"}
    assert np.allclose(out.estimate, np.linalg.lstsq(x[kept].to_numpy(), d.y, rcond=None)[0], atol=1e-7)


@pytest.mark.parametrize("family", ["ordered_logit", "ordered_probit"])
def test_ordered_models_of_three_classes(spark, family):
    """Estimates where the likelihood is flat, errors from its curvature there, both by differences."""
    rng = np.random.default_rng(11)
    n = 400
    x = rng.standard_normal((n, 2))
    y = np.digitize(x @ [0.7, -0.5] + 0.9 * rng.standard_normal(n), [-0.5, 0.8])
    rows = spark.createDataFrame(pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "y": y.astype(float)}))
    out = R.fit(R.Design(rows, "y", ("x1", "x2")), family, classes=3)
    assert out.terms == ["x1", "x2", "0/1", "1/2"]
    cdf = R.normal_cdf if family == "ordered_probit" else lambda z: 1 / (1 + np.exp(-z))

    def likelihood(t):
        up = np.where(y == 2, np.inf, np.where(y == 1, t[3], t[2]) - x @ t[:2])
        low = np.where(y == 0, -np.inf, np.where(y == 2, t[3], t[2]) - x @ t[:2])
        return np.log(cdf(up) - cdf(low)).sum()

    def slope(f, t, h):
        e = np.eye(len(t)) * h
        return np.array([(f(t + d) - f(t - d)) / (2 * h) for d in e])

    t = np.array(out.estimate)
    assert likelihood(t) == pytest.approx(out.fit["llf"]) and np.abs(slope(likelihood, t, 1e-4)).max() < 1e-3
    curvature = slope(lambda u: slope(likelihood, u, 1e-3), t, 1e-3)
    assert np.allclose(np.linalg.inv(-curvature), out.covariance, rtol=1e-3, atol=1e-6)
    assert np.abs(t - [0.7, -0.5, -0.5, 0.8] * np.array(1.6 / 0.9 if family == "ordered_logit" else 1 / 0.9)).max() < 0.4


def test_targets_of_one_value_or_unknown_categories_are_refused(spark):
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "y double, x double")
    for family in ("ols", "logit", "ordered_logit"):
        with pytest.raises(ValueError):
            R.fit(R.Design(one, "y", ("x",)), family)
    with pytest.raises(ValueError):
        R.fit(R.Design(one.limit(0), "y", ("x",)))
    words = spark.createDataFrame([("low",), ("high",), (None,)], "y string")
    assert [r.y for r in R.coded(words, "y", ["low", "high"]).collect()] == [0.0, 1.0, None]
    with pytest.raises(Exception, match="undeclared"):
        R.coded(words, "y", ["low"]).collect()
