"""Order of lines over files, landed events, features that no one declared, results on disk."""

import json

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import features, metrics
from cohortflow.operators import regression as R
from cohortflow.operators.validate import parse_fields
from cohortflow.sources import jsonl, landing, raw_files, reviews


@pytest.mark.parametrize("sizes", [(3000, 10, 400), (10, 3000, 1), (1, 1, 5000)])
def test_lines_are_in_order_of_files(spark, tmp_path, sizes):
    """Keep-first and a limit over three files, whatever their sizes and the splits in which they are read."""
    n = 0
    for name, size in zip("abc", sizes):
        lines = []
        for i in range(size):
            lines.append(json.dumps({"parent_asin": f"p{i % 7}", "title": f"{name}{i}", "at": n}))
            n += 1
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.scan(spark, str(tmp_path)).withColumn("at", F.try_variant_get("row", "$.at", "long"))
        assert [r["at"] for r in rows.orderBy("_ord").select("at").collect()] == list(range(n))
        items = raw_files.item_rows(spark, str(tmp_path))
        first = {r.product_id: r.title for r in reviews.products(items).collect()}
        want = {}
        for name, size in zip("abc", sizes):
            for i in range(size):
                want.setdefault(f"p{i % 7}", f"{name}{i}")
        assert first == want
        assert sorted(r.title for r in raw_files.item_rows(spark, str(tmp_path), 5).select("title").collect()) == sorted((f"{x}{i}" for x, s in zip("abc", sizes) for i in range(s)), key=lambda t: (t[0], int(t[1:])))[:5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_subset_lines_leave_as_they_came(spark, tmp_path):
    lines = ['{"b":1.50,  "a": "x"}', '{"a":"y", "b":2e0}', '{ "a":"x","b":3}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n")
    rows = jsonl.scan(spark, str(tmp_path / "in.jsonl"))
    raw_files.write_lines(rows.where(F.try_variant_get("row", "$.a", "string") == "x"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [lines[0], lines[2]]


def test_landed_events_are_pruned(spark, tmp_path):
    fields = parse_fields([{"name": "rating", "type": "int"}, {"name": "ok", "type": "bool"}, {"name": "why", "type": "text"}])
    rows = [("e1", "evaluation", '{"rating": 5, "ok": true, "why": "x"}'), ("e2", "evaluation", '{"rating": "5", "ok": 1, "why": 3}'), ("e3", "selection", None), ("e4", "evaluation", '{"rating": 2}')]
    events = spark.createDataFrame(rows, "event_id string, event_type string, o string").withColumn("outcomes", F.parse_json("o")).withColumn("traces", F.parse_json("o"))
    folder = str(tmp_path / "landed")
    landing.land(events, folder, fields, fields[2:])
    read = landing.landed(spark, folder)
    got = {r.event_id: (r.outcome_rating, r.outcome_ok, r.outcome_why, r.trace_why) for r in read.collect()}
    assert got == {"e1": (5.0, True, "x", "x"), "e2": (None, None, None, None), "e3": (None,) * 4, "e4": (2.0, None, None, None)}
    picked = read.where("event_type = 'evaluation' AND outcome_rating >= 3").select("event_id")
    assert [r.event_id for r in picked.collect()] == ["e1"]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and "GreaterThanOrEqual(outcome_rating,3.0)" in plan
    assert "outcomes" not in plan.split("ReadSchema")[1] and "trace" not in plan.split("ReadSchema")[1]
    landing.land(events.limit(0), str(tmp_path / "none"), fields)


def test_features_of_any_shape(spark):
    texts = [
        '{"age": 30, "home": {"city": "x", "size": 1.5}, "flag": true, "tags": ["a"], "odd": 1, "none": null, "a.b": {"it\'s": 2}}',
        '{"age": 31.5, "home": {"city": "y"}, "flag": false, "odd": {"in": {"ner": "z"}}, "more": "m"}',
        '{"odd": "text", "home": null, "age": null}', "[1]", None,
    ]
    events = spark.createDataFrame(list(enumerate(texts)), "event_id long, text string").withColumn("p", F.try_parse_json("text"))
    (found,) = features.leaves(events, "p")
    assert {x.name: x.kind for x in found} == {"a.b.it's": "double", "age": "double", "flag": "boolean", "home.city": "string", "home.size": "double", "more": "string", "none": "void", "odd": "variant", "odd.in.ner": "string"}
    out = features.as_columns(events, {"panelist": "p"}).orderBy("event_id").collect()
    values = lambda name: [r[f"panelist.{name}"] for r in out]
    assert values("age") == [30.0, 31.5, None, None, None] and values("flag") == [True, False, None, None, None]
    assert values("home.city") == ["x", "y", None, None, None] and values("a.b.it's") == [2.0, None, None, None, None]
    assert values("odd") == ["1", None, '"text"', None, None] and values("odd.in.ner") == [None, "z", None, None, None]
    assert "panelist.none" not in out[0] and "panelist.tags" not in out[0]
    paths = {(r.event_id, r.path, r.value) for r in metrics.feature_paths(events, "p").collect()}
    assert (1, "odd.in.ner", '"z"') in paths and (2, "odd", '"text"') in paths and (0, "odd", "1") in paths and not any(p == "tags" for _, p, _ in paths)
    assert features.leaves(events.limit(0), "p") == [[]] and features.as_columns(events.where("event_id = 4"), {"x": "p"}).columns == events.columns


def test_traces_leave_nulls_out(spark):
    rows = spark.createDataFrame([(" a ", "", "c", 5), (None, None, None, None)], "title string, text string, asin string, timestamp long")
    got = [r.j for r in rows.select(F.to_json(reviews.traces(rows)).alias("j")).collect()]
    assert [json.loads(x) if x else None for x in got] == [{"review_title": "a", "source": {"child_asin": "c", "timestamp": 5}}, None]
    raw = [json.loads(r.j) for r in rows.select(F.to_json(reviews.traces(rows, {}, raw=True)).alias("j")).collect()]
    assert raw[1] == {"source": {"raw": {"asin": None, "title": None, "text": None, "timestamp": None}}}


def test_a_fit_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), float(i * i % 7), 1.0) for i in range(40)], "y double, a double, b double, one double")
    tables = raw_files.fit_tables(spark, R.fit(R.Design(rows, "y", ("a", "one", "b"))), "d", "y", 1)
    raw_files.write_tables(tables, str(tmp_path))
    read = {n: spark.read.csv(f"{tmp_path}/{n}.csv", header=True).collect() for n in tables}
    assert [r.term for r in read["coefficients_full"]] == ["const", "a", "b"] and [(r.term, r.reason) for r in read["dropped_columns"]] == [("one", "constant")]
    assert {r.term for r in read["coefficients_attributes"]} == {"a", "b"} and len(read["coefficients_top_attributes"]) == 1
    assert float(read["summary"][0].fit_r2) == pytest.approx(R.fit(R.Design(rows, "y", ("a", "b"))).fit["r2"])
    meta = raw_files.run_metadata(rows.selectExpr("y AS panelist_id", "a AS product_id", "b AS t"), 3).first()
    assert tuple(meta.counts) == (40, 40, 3, rows.select("b").distinct().count()) and meta.config_hash_sha256 is None and meta.generated_at_utc.endswith("Z")
