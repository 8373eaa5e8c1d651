"""What the registered queries do not show: refusals, discovery, golden hashes, full designs, streams."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import identity
from cohortflow.operators import compare, designs, generate, runs
from cohortflow.operators import regression as R
from cohortflow.operators.validate import Field, parse_fields
from cohortflow.sources import jsonl, raw_files
from cohortflow.streaming import events as S


def test_policies_and_configurations_are_checked(spark):
    one = spark.createDataFrame([("a",)], "panelist_id string")
    with pytest.raises(ValueError):
        runs.Policy("lottery")
    with pytest.raises(ValueError):
        runs.decide(runs.Policy("manual"), one, one.select(F.col("panelist_id").alias("product_id")))
    with pytest.raises(ValueError):
        runs.build({"policy": {"name": "random"}}, one, one)
    with pytest.raises(ValueError):
        jsonl.load_schedule(spark, "x", "xml")
    assert compare.mode([False, False]) == "cross" and compare.mode([True, False]) == "benchmark"
    with pytest.raises(ValueError):
        compare.mode([True, True])


def test_questionnaires_are_found():
    spec = {"outcomes": [{"name": "rating", "type": "int", "min": 1, "max": 5}], "traces": [{"name": "why", "type": "text", "required": False}]}
    out, traces = runs.declared_fields({"a": [1, {"config_snapshot": {"questionnaire": spec}}]})
    assert [f.name for f in out] == ["rating"] and [f.name for f in traces] == ["why"]
    assert runs.declared_fields({"outcomes": ["x"]}) == ([], [])
    assert [runs.example_value(f) for f in (*out, *traces, Field("c", "categorical", True, ("b", "a")))] == [1, "text", "b"]
    bad = [{"name": "x", "type": "date"}, {"name": "x", "type": "categorical"}, {"name": "x", "type": "categorical", "choices": ["a"], "analysis_type": "binary"}, {"name": "x", "type": "categorical", "choices": ["a", "b"], "analysis_type": "ordinal", "choice_order": ["a"]}]
    for raw in bad:
        with pytest.raises(ValueError):
            parse_fields([raw])


def test_outcomes_suit_families():
    fields = parse_fields([{"name": "n", "type": "int"}, {"name": "c", "type": "categorical", "choices": ["x", "y"]}, {"name": "o", "type": "categorical", "choices": ["x", "y", "z"], "analysis_type": "ordinal", "choice_order": ["z", "y", "x"]}])
    assert designs.resolve(fields, "n", "ols")[1] == []
    assert designs.resolve(fields, "c", "logit")[1] == ["x", "y"]
    assert designs.resolve(fields, "o", "ordered_probit")[1] == ["z", "y", "x"]
    for name, family in (("n", "logit"), ("c", "ols"), ("absent", "ols")):
        with pytest.raises(ValueError):
            designs.resolve(fields, name, family)


def test_golden_hashes(spark):
    assert runs.nonce("personas", 7, 0) == hashlib.sha256(b'{"batch_idx":0,"kind":"personas","seed":7}').hexdigest()[:12]
    assert runs.message_digest([{"role": "user", "content": " hi "}]) == runs.message_digest([{"content": "hi"}])
    row = spark.createDataFrame([("p", "it's \\ \u200b\n", 3, ["a,b", "c"], ["c"])], "panelist_id string, product_id string, t long, choice_set array<string>, selected array<string>")
    blake = lambda text: hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
    c, none = F.col, F.lit(None).cast("string")
    ids = row.select(
        identity.evaluation_id("ns", F.lit("random"), c("panelist_id"), c("t"), c("product_id"), none).alias("plain"), identity.evaluation_id("ns", F.lit("self_selection"), c("panelist_id"), c("t"), c("product_id"), F.lit("s1")).alias("chosen"),
        identity.selection_id("ns", F.lit("self_selection"), c("panelist_id"), c("t"), c("choice_set"), c("selected")).alias("selection"),
    ).first()
    start = "ns|event_type='evaluation'|panelist_id='p'|"
    assert ids.plain == blake(start + r"""policy='random'|product_id="it's \\ \u200b\n"|schema_version='0.1.0'|selection_id=null|t=3""")
    assert ids.chosen == blake(start + r"""policy='self_selection'|product_id="it's \\ \u200b\n"|schema_version='0.1.0'|selection_id='s1'|t=3""")
    assert ids.selection == blake("ns|choice_set=['a,b','c']|event_type='selection'|panelist_id='p'|policy='self_selection'|schema_version='0.1.0'|selected_product_ids=['c']|t=3")
    assert identity.shown({"b": [1, None, True], "a": 2.5}) == "{a:2.5,b:[1,null,True]}"
    row = spark.createDataFrame([("p", None, 3)], "panelist_id string, product_id string, t long")
    made = generate.deterministic(row.withColumn("product_id", F.lit("q")), [Field("rating", "int", True, (), 1, 5), Field("f", "float", True, (), 0, 2), Field("b", "bool")]).first()
    u = int.from_bytes(hashlib.blake2b(b"p|q|3", digest_size=8).digest(), "big")
    assert (made.rating, made.f, made.b) == (1 + u % 5, 2.0 * (u % 10_000) / 10_000, u % 2 == 1)


def test_designs_against_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 400
    p, q, x = rng.integers(0, 4, n), rng.integers(0, 3, n), rng.standard_normal(n)
    city = rng.choice(["a", "b", "c"], n)
    y = 1 + p * 0.5 - q + 2 * x + (city == "b") + rng.standard_normal(n) / 10
    rows = [(f"p{a}", f"q{b}", float(v), str(c), float(t)) for a, b, v, c, t in zip(p, q, x, city, y)]
    frame = spark.createDataFrame(rows, "panelist_id string, product_id string, x double, city string, y double").withColumnsRenamed({"x": "panelist.x", "city": "product.city"})
    dummies = lambda v, levels: [(v == k).astype(float) for k in levels[1:]]
    effects = dummies(p, range(4)) + dummies(q, range(3))
    parts = {"two_way_fe": effects, "panelist_plus_product_features": [x, *dummies(city, "abc")], "features_plus_two_way_fe": [x, *effects, *dummies(city, "abc")]}
    for name, columns in parts.items():
        out = R.fit(designs.build(frame, name, "y"))
        want = np.linalg.lstsq(np.column_stack([np.ones(n), *columns]), y, rcond=None)[0]
        assert np.allclose(out.estimate, want, atol=1e-8), name
    assert out.terms == ["const", "panelist.x", "panelist_id_p1", "panelist_id_p2", "panelist_id_p3", "product_id_q1", "product_id_q2", "product.city_b", "product.city_c"]
    shown = {r.term for r in designs.selected(out.frame(spark), intercept=False, fixed_effects=False).collect()}
    assert shown == {"panelist.x", "product.city_b", "product.city_c"}
    with pytest.raises(ValueError):
        designs.build(frame.drop("panelist.x"), "panelist_features", "y")
    with pytest.raises(ValueError):
        designs.build(frame, "two_way", "y")


def test_p_values_keep_their_tails():
    assert R.two_sided(10.0, None) == pytest.approx(1.5239706e-23, rel=1e-6)
    assert R.two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert 0 < R.two_sided(40.0, 200) < 1e-90


def test_broken_lines_fail_or_go(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"user_id": "u", "rating": "5", "timestamp": 3.9}\n\n[1]\n{"user_id": 7, "helpful_vote": null, "helpful_votes": 4}\n')
    rows = raw_files.review_rows(spark, str(tmp_path / "r.jsonl"), strict=False).orderBy("_ord").collect()
    assert [(r.user_id, r.rating, r.timestamp, r.helpful_vote) for r in rows] == [("u", None, 3, None), ("7", None, None, None)]
    with pytest.raises(Exception, match="no JSON object"):
        raw_files.review_rows(spark, str(tmp_path / "r.jsonl")).collect()


def test_streams(spark, tmp_path):
    lines = '{"schema_version": "0.1.0", "event_id": "e1", "event_type": "evaluation", "policy": "manual", "panelist_id": "p", "t": 0, "product_id": "q", "product_display": "Q"}\nnonsense\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(lines + lines)
    good = S.valid(S.read(spark, str(tmp_path / "in"))).select(F.try_variant_get("row", "$.event_id", "string").alias("event_id"), "arrived", F.lit(2.0).alias("value"))
    S.run_available(S.first_of_id(good), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["e1"]
