"""Windowed counts and links on streams of files that arrive in several batches."""

import json
import os

from pyspark.sql import functions as F

from cohortflow.streaming import events as S

SCHEMA = "event_id string, selection_id string, product_id string, value double, at timestamp"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def arrive(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        os.utime(folder / f"{i}.json", (1.7e9 + i, 1.7e9 + i))  # files are read from the oldest on


def test_windowed_counts_drop_what_is_too_late(spark, tmp_path):
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    arrive(tmp_path / "in", [[{"product_id": "p", "value": 1, "at": at(1)}, {"product_id": "p", "value": 3, "at": at(4)}, {"product_id": "q", "value": 5, "at": at(6)}], [{"product_id": "p", "value": 9, "at": at(50)}], [{"product_id": "p", "value": 9, "at": at(51)}], [{"product_id": "p", "value": 7, "at": at(2)}, {"product_id": "p", "value": 1, "at": at(55)}]])
    counts = S.windowed_counts(stream(spark, tmp_path / "in"), "at", "5 minutes", "10 minutes", "product_id")
    S.run_available(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.window.start.minute, r.product_id): (r.n, r.mean_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0, "p"] == (2, 2.0) and got[5, "q"] == (1, 5.0)  # the late seventh value is in no window


def test_links_across_batches(spark, tmp_path):
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    arrive(tmp_path / "selections", [[{"event_id": "s1", "at": at(0)}, {"event_id": "s2", "at": at(1)}], [{"event_id": "s9", "at": at(600)}], [{"event_id": "s10", "at": at(700)}]])
    arrive(tmp_path / "evaluations", [[{"event_id": "e1", "selection_id": "s1", "at": at(5)}, {"event_id": "e2", "selection_id": "s2", "at": at(90)}, {"event_id": "e3", "selection_id": "none", "at": at(3)}], [{"event_id": "e9", "selection_id": "s9", "at": at(601)}], [{"event_id": "e10", "selection_id": "x", "at": at(700)}]])
    linked = S.linked(stream(spark, tmp_path / "evaluations"), stream(spark, tmp_path / "selections"), "at", "30 minutes")
    S.run_available(linked.select("event_id", F.col("selected_at").isNotNull().alias("found")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.event_id: r.found for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["e1"] and got["e9"] and got["e2"] is False and got["e3"] is False
