"""Findings of round 3: work that grew faster than the input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow import queries as Q
from cohortflow.operators import absorb as B
from cohortflow.operators import exposure as X
from cohortflow.operators import generate as G
from cohortflow.operators import metrics as M
from cohortflow.operators import regression as R
from cohortflow.operators import subset as U
from cohortflow.operators import validate as V
from cohortflow.sources import adapters as A
from cohortflow.sources import jsonl as J
from cohortflow.sources import landing as L
from cohortflow.sources import reviews as I


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_codes_are_not_judged_twice_for_a_filter(spark, data):
    """A filter on the codes used to be pushed below the parts: hundreds of fetches of fields a row."""
    plan = optimized(V.violations(Q.raw_events(spark, data)))
    assert plan.count("schema_version)") < 20 and "Filter (size(" not in plan and len(plan) < 60_000


def test_report_counts_and_lists_in_order(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else '{"event_id": 1}') for i in range(9)], "_ord long, j string").select("_ord", F.try_parse_json(F.coalesce("j", F.lit('{"schema_version": "0.1.0", "event_id": "a", "event_type": "evaluation", "policy": "manual", "panelist_id": "p", "t": 0, "product_id": "x", "product_display": "x"}'))).alias("row"))
    assert V.report(rows, 2) == (9, 3, [(0, "schema_version"), (3, "schema_version")])


def test_whole_catalog_beyond_a_hundred_thousand_products(spark, tmp_path):
    """The list that all rows share is made once, so its digest has no bound (100,000 products before)."""
    n = 100_050
    spark.range(2).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = Q.choice_set_all_products(spark, str(tmp_path)).collect()
    digest = hashlib.md5(",".join(sorted(str(i) for i in range(n))).encode()).hexdigest()
    assert len(rows) == 4 and {(r.shown, r.digest) for r in rows} == {(n, digest)}


def test_first_lines_are_chosen_before_they_are_parsed(spark, tmp_path):
    """Lines after the first max_rows are not parsed (a broken one there failed the scan)."""
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert [r._raw for r in J.scan(spark, f"{tmp_path}/a.jsonl", max_rows=2).collect()] == ['{"a": 1}', '{"a": 2}']
    assert [r._raw for r in J.scan(spark, f"{tmp_path}/a.jsonl", strict=False, max_rows=3).collect()] == ['{"a": 1}', '{"a": 2}']


def test_lines_are_written_compressed(spark, tmp_path):
    J.write_jsonl(spark.range(3), f"{tmp_path}/x.jsonl", compression="gzip")
    assert list((tmp_path / "x.jsonl").glob("*.gz")) and J.scan(spark, f"{tmp_path}/x.jsonl").count() == 3


def test_panelists_of_one_file_are_dealt_to_all_tasks(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("panelist_id")).coalesce(1).write.parquet(f"{tmp_path}/p")
    assert X.periods(spark.read.parquet(f"{tmp_path}/p"), 2).rdd.getNumPartitions() == 8


def test_pairs_are_dealt_to_tasks_in_number_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIR_ROWS", 10)
    rows = spark.createDataFrame([(f"p{i}", f"q{j}", float((i * j) % 5)) for i in range(20) for j in range(3)], "p string, q string, x double")
    out = M.mean_pairwise_distance(rows, F.col("x"), "p", "q")
    want = [sum(abs((a * j) % 5 - (b * j) % 5) for j in range(3)) / 3 for a in range(20) for b in range(a)]
    row = out.first()
    assert row.n_pairs == 190 and abs(row.mean_distance - sum(want) / 190) < 1e-12
    assert ", 57" in out._jdf.queryExecution().optimizedPlan().toString()  # 570 pair rows


def test_a_newton_step_is_one_pass(spark, monkeypatch):
    """Likelihood and derivatives of a step come from one pass, the moments before from two."""
    calls, real = [], R.summed
    monkeypatch.setattr(R, "summed", lambda *a: calls.append(1) or real(*a))
    rows = spark.range(400).select((F.col("id") % 7 < 3).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("x"))
    out = R.fit(R.Design(rows, "y", ("x",)), "logit")
    assert out.fit["converged"] == 1 and len(calls) <= 10


def test_a_reply_is_parsed_twice_at_most(spark):
    rows = spark.createDataFrame([("Yes: {\"selected_product_ids\": [\"b\", \"b\", \"z\"]}", ["a", "b"]), ("none", ["a"])], "reply string, choice_set array<string>")
    out = G.read_selection(rows, cap=2, fallback_first=False)
    assert [(r.requested, r.executed, r.dropped) for r in out.select("requested", "executed", "dropped").collect()][0] == (["b", "z"], ["b"], ["z"])
    assert optimized(out).count("regexp_extract") == 1


def test_ratings_of_all_kinds(spark):
    texts = ['{"rating": 3}', '{"rating": 2.5}', '{"rating": "1_0"}', '{"rating": true}', '{"rating": null}', '{"rating": "x"}', '{"rating": 1e20}', "{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").select("i", F.parse_json("j").alias("outcomes"))
    assert [r.x for r in rows.select("i", U.rating(rows).alias("x")).orderBy("i").collect()] == [3.0, 2.5, 10.0, 1.0, None, None, 1e20, None]


def test_means_of_a_chain_settle_in_as_many_rounds_as_it_has_levels(spark):
    """Alternating means, which sent all cells twice a round, were not done by then."""
    rng = np.random.default_rng(3)
    p, q = np.array([(i, i + j) for i in range(7) for j in (0, 1) for _ in range(3)]).T
    x = rng.standard_normal(len(p))
    y = x + p + rng.standard_normal(len(p))
    frame = spark.createDataFrame([(float(a), float(b), str(c), str(d)) for a, b, c, d in zip(y, x, p, q, strict=True)], "y double, x double, p string, q string")
    out = B.fit(frame, "y", ["x"], ["p", "q"], tolerance=1e-10, max_rounds=11)
    dummies = np.column_stack([x, *[p == i for i in range(7)], *[q == i for i in range(1, 8)]]).astype(float)
    assert out.change <= 1e-10 and out.components == 1
    assert out.result.estimate[0] == pytest.approx(np.linalg.lstsq(dummies, y, rcond=None)[0][0], abs=1e-9)


def test_lines_are_read_once_for_events_and_personas(spark, data):
    """They were read, joined and shuffled three times: for the sequence, the personas, and rows without a user, which are not asked for."""
    for name in ("import_left_lookup", "import_require_metadata_semi"):
        assert optimized(Q.QUERIES[name](spark, data)).count("Relation [l_orderkey") == 1


def test_counts_within_the_sequence_are_those_of_personas(spark):
    """Users below the least count, empty and null ones, null and empty products, null flags and ratings."""
    rows = [(u, p, f"a{i}", i % 5, float(i % 4) if i % 3 else None, [True, False, None][i % 3], i % 2, i) for i, (u, p) in enumerate([("u", "x"), ("u", "x"), ("u", None), ("u", "y"), ("u", ""), ("v", None), ("v", None), ("", "x"), ("", "y"), (None, "x"), ("w", "x")] * 2)]
    reviews = spark.createDataFrame([*rows, ("z", "x", "a", 1, 2.0, True, 1, 99)], "user_id string, parent_asin string, asin string, timestamp long, rating double, verified_purchase boolean, helpful_vote long, _ord long")
    items = I.products(spark.createDataFrame([("x", "t", 1)], "parent_asin string, title string, _ord long"))
    for require in (False, True):
        a, b = (I.events(reviews, items, people, require_match=require) for people in (2, I.personas(reviews, 2)))
        show = [sorted(r.j for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect()) for df in (a, b)]
        assert show[0] == show[1] and any('"n_unique_products":3' in j for j in show[0]) and any('"panelist_features":{}' in j for j in show[0])
    assert a.columns == b.columns and I.events(reviews, items, 2, "raw_timestamp").count() > 0


def test_selections_are_numbered_before_they_have_lists(spark, data):
    """The lists of an order were sent to its customer's place, to be numbered there."""
    below = optimized(A.selections(spark, data)).split("Window [row_number")[1].split("collect_set")[0]
    assert "Aggregate [l_orderkey" in below and "LeftSemi" in below.split("Aggregate [l_orderkey")[0]


def test_landed_files_are_zstd(spark, tmp_path):
    L.land(spark.range(3).select(F.lit("a").alias("event_type"), F.to_variant_object(F.struct("id")).alias("outcomes")), f"{tmp_path}/x", [])
    assert list((tmp_path / "x/event_type=a").glob("*.zstd.parquet")) and L.landed(spark, f"{tmp_path}/x").count() == 3


def test_gz_lines_in_many_files_are_not_dealt_again(spark, tmp_path):
    """Lines of .gz were sent to as many tasks as a shuffle has, even if they already stood in that many files."""
    spark.range(16).repartition(8).select(F.format_string('{"a": %d}', "id").alias("value")).write.option("compression", "gzip").text(f"{tmp_path}/many.gz")
    spark.range(16).coalesce(1).select(F.format_string('{"a": %d}', "id").alias("value")).write.option("compression", "gzip").text(f"{tmp_path}/one.gz")
    many, one = J.scan(spark, f"{tmp_path}/many.gz"), J.scan(spark, f"{tmp_path}/one.gz")
    assert many.count() == one.count() == 16
    assert "Repartition" not in optimized(many) and "Repartition" in optimized(one)
