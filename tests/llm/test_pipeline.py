"""The pipeline against plain Python: each stage is judged on its own input."""

import brute
from test_text_operators import check_packed, ids_of

import corpus_pipeline
from cohortflow.llm import quality


def test_pipeline(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, at = [], docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, data).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        names.append(name)
        kept[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes
    assert names == ["quality", "near_dedup", "substring_dedup", "packing"]

    model = quality.fit_on_labels(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept["quality"]} == good

    texts = {r.doc_id: r.text for r in kept["quality"]}
    assert {r.doc_id for r in kept["near_dedup"]} == set(brute.near_classes(texts).values())

    cut = brute.substring({r.doc_id: r.text for r in kept["near_dedup"]})
    want = {i: x for i, x in cut.items() if x[1] == 0 or x[1] < x[0]}
    got = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert set(got) == set(want)
    assert all(brute.words(got[i]) == want[i][2] for i in got)
    assert all(got[i] == texts[i] for i in got if want[i][1] == 0)

    check_packed(kept["packing"], ids_of(got), 2048)
    assert corpus_pipeline.run(spark, data).count() == len(kept["packing"])


def test_stages_on_odd_rows(spark, data, docs, odd, none, tmp_path):
    """Nulls in every column, null and repeated ids, repeated rows, an empty table, columns named as the
    operators' own: no stage fails, and all but the last keep the columns of their input."""
    nulls = spark.createDataFrame([(None,) * len(docs.columns)] * 2, docs.schema)
    rows = docs.unionByName(odd).unionByName(nulls)
    for which, at in (("rows", rows), ("none", none)):
        n = at.count()
        for name, stage in corpus_pipeline.STAGES[1:]:
            path = str(tmp_path / which / name)
            stage(spark, at, data).write.parquet(path)
            out = spark.read.parquet(path)
            if name == "packing":
                assert out.where("start = 0").count() == n and ("sequence_id" in out.columns)
            else:
                assert out.dtypes == at.dtypes and out.count() <= n
                at, n = out, out.count()
        assert (n > 0) == (which == "rows")
    quality_of = dict(corpus_pipeline.STAGES)["quality"]
    labelled = spark.read.parquet(f"{data}/documents.parquet")
    for column in ("key", "kept", "score", "predicted", "label", "_key"):
        labelled = labelled.withColumn(column, labelled.doc_id)
    more = labelled.unionByName(labelled.limit(3)).unionByName(nulls, allowMissingColumns=True).drop("list")
    out = quality_of(spark, more, data)
    assert out.columns == more.columns and 0 < out.count() < more.count()
    assert out.where("doc_id IS NOT NULL AND NOT score <=> doc_id").count() == 0
    assert quality_of(spark, more.limit(0), data).count() == 0 and quality_of(spark, more.limit(0), data).columns == more.columns
