import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import components, onebit, pigeonhole, urls

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 24))
    out = {}
    for i in range(400):
        v = centres[i % 12] + rng.standard_normal(24) * rng.choice([0.02, 0.2, 0.4])
        out[i] = (v.tolist(), int(i % 12) // 2)
    for i in range(400, 420):
        out[i] = (out[3][0], out[3][1])
    bad = [None, [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, []]
    for k, v in enumerate(bad):
        out[500 + k] = (v, 1)
    out[510] = (out[3][0], None)
    out[511] = (out[3][0], 99)
    out[512] = ([1e-200] * 24, 5)
    out[513] = ([2e-200] * 24, 5)
    return out


@pytest.fixture(scope="module")
def frame(spark, vectors):
    return spark.createDataFrame([(i, v, l) for i, (v, l) in vectors.items()], SCHEMA)


def test_pigeonhole(frame, vectors):
    usable = {i: (np.array(v) / max(map(abs, v)) if v and None not in v and np.all(np.isfinite(v)) and any(v) else v, l) for i, (v, l) in vectors.items()}
    links = brute.vector_links({i: (None if v is None else list(v), l) for i, (v, l) in usable.items()})
    degree = {i: 0 for i in vectors}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    component = brute.components(vectors, links)
    got = pigeonhole.near_duplicates(frame).collect()
    assert {r.vec_id: r.n_links for r in got} == degree
    assert {r.vec_id: r.component_id for r in got} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_pigeonhole_of_odd_rows(spark, frame):
    assert pigeonhole.near_duplicates(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.1], 1)], SCHEMA)
    assert [r.n_links for r in pigeonhole.near_duplicates(twice).collect()] == [2, 2, 2]
    named = frame.selectExpr("*", "label AS key", "vec_id AS a", "embedding AS vec", "vec_id AS _key")
    assert sorted(map(tuple, pigeonhole.near_duplicates(named).collect())) == sorted(map(tuple, pigeonhole.near_duplicates(frame).collect()))
    small = pigeonhole.Params(chunk=3)
    assert sorted(map(tuple, pigeonhole.near_duplicates(frame, small).collect())) == sorted(map(tuple, pigeonhole.near_duplicates(frame).collect()))


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.id, r.component) for r in components.components(links).collect()} == {(i, 0) for i in range(201)}


def exact(vectors, queries, k=10):
    good = {i: np.array(v, float) for i, (v, _) in vectors.items() if v and None not in v and np.all(np.isfinite(v)) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            out[q] = sorted((float(np.sqrt(((x - good[q]) ** 2).sum())), i) for i, x in good.items() if i != q)[:k]
    return out


def test_onebit(frame, vectors):
    want = exact(vectors, [i for i in vectors if i % 50 == 0])
    rows = onebit.nearest(frame.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, onebit.Params(chunk=64, query_block=4, spread=3)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        x, y = np.array(vectors[r.query_id][0]), np.array(vectors[r.vec_id][0])
        assert r.score == pytest.approx(np.sqrt(((x - y) ** 2).sum()), abs=1e-12)
    assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_onebit_of_few_rows(spark, frame):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in onebit.nearest(v, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert onebit.nearest(v.limit(0), F.col("vec_id") == 0).count() == 0


def test_onebit_recall_on_the_table(spark, data):
    emb = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = {r.vec_id: (list(map(float, r.embedding)), r.label) for r in emb.collect()}
    want = exact(vectors, [i for i in vectors if i % 100 == 0])
    got = onebit.nearest(emb.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0).collect()
    hits = sum((r.score, r.vec_id)[1] in {i for _, i in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


PAGES = [
    (1, "http://Shop.NET/a?b", "shop.net", "/a", "net/", "block"),
    (2, "https://example.net/en/x#y", "example.net", "/en/x", "example.net/en/", "allow"),
    (3, "https://a.example.net/fr/", "a.example.net", "/fr/", "net/", "block"),
    (4, "https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
    (5, "x://site.org/fr/", "site.org", "/fr/", "org/fr/", "allow"),
    (6, None, "", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, "http://notnet/", "notnet", "/", None, "allow"),
    (9, "http://net/", "net", "/", "net/", "block"),
    (10, "http://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
    (11, "http://u.com?x=://q/", "u.com", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(p[0], p[1], "x") for p in PAGES], "page_id long, url string, host string")
    labels = spark.createDataFrame([(10, 1, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert got == {p[0]: p[2:] for p in PAGES}
    assert urls.judge(pages.limit(0), labels).count() == 0
    assert urls.judge(pages, labels.limit(0)).count() == len(PAGES)


def test_url_reputation(spark):
    """A host whose labelled pages are bad is blocked, and so are unseen pages of it; a clean one is not."""
    rows = [(i, f"http://bad.com/{i}") for i in range(40)] + [(100 + i, f"http://good.com/{i}") for i in range(40)] + [(200, "http://bad.com/new"), (201, "http://good.com/new"), (202, "http://sub.bad.com/new")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert got[200] == "block" and got[201] == "allow" and got[202] == "block"


def test_onebit_keeps_tiny_and_huge_vectors(spark):
    """Squares of such components vanish or overflow; the vectors are candidates and queries all the same."""
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((400, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = {i: unit[i] for i in range(400)} | {500: np.full(16, 1e-200), 600: np.full(16, 3e-200), 700: np.full(16, 1e200), 800: np.full(16, 2e200), 801: unit[0], 802: unit[0]}
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows.items()], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in sorted(onebit.nearest(frame, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    length = lambda v: float(np.abs(v).max() and np.abs(v).max() * np.linalg.norm(v / np.abs(v).max()))
    for q in (0, 100, 500, 600, 700, 800):
        want = sorted((length(rows[i] - rows[q]), i) for i in rows if i != q)[:10]
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in want], rel=1e-9)
    assert [i for i, _ in got[0]][:2] == [801, 802] and 500 in [i for i, _ in got[0]]
    assert got[500][0][0] == 600 and got[700][0][0] == 800
