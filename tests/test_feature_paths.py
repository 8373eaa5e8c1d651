from pyspark.sql import functions as F

from cohortflow.operators.metrics import feature_paths


def test_feature_paths_of_any_depth(spark):
    rows = [(1, '{"a": 1, "b": {"c": {"d": {"e": {"f": {"g": "x"}, "h": 2}}}}, "list": [1]}'), (2, '{"a": {}}')]
    events = spark.createDataFrame(rows, "event_id long, text string").select("event_id", F.parse_json("text").alias("product_features"))
    got = {(r.event_id, r.path, r.value) for r in feature_paths(events, "product_features").collect()}
    assert got == {(1, "a", "1"), (1, "b.c.d.e.h", "2"), (1, "b.c.d.e.f.g", '"x"')}
    assert feature_paths(events.limit(0), "product_features").count() == 0
