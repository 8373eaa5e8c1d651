"""The quality classifier on the tables' labels: held-out accuracy, order and calibration."""

from pathlib import Path

import numpy as np
import pytest

from cohortflow.llm import quality

LARGER = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not LARGER.exists(), reason="needs the larger test tables")
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_on_labels(docs.select("doc_id", "text"), labels)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.held_out()).select("score", "predicted", "quality").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert len(rows) > 50 and 0 < label.mean() < 1
    good, bad = score[label == 1], score[label == 0]
    order = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert order > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert ((score - label) ** 2).mean() < 0.08 and abs(score.mean() - label.mean()) < 0.08
