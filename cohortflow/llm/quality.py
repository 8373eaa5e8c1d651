"""Compression classifier (operator 1): which dictionary, of good or of bad text, shortens a text more?

Two zstandard dictionaries are trained on labelled texts. A text is compressed with each; the
difference of the two sizes over the text's length (plus a constant, for short texts) is its evidence,
and a logistic curve, fitted on labelled texts that the dictionaries have not seen, turns evidence,
compressed share and length into the probability of label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import small_batches


@dataclass(frozen=True)
class Params:
    """rows_per_label and sample_chars bound what the driver gathers to fit: 2 x 4000 texts of at most
    16,000 characters each. Longer labelled texts are not sampled; all texts are scored whole."""

    rows_per_label: int = 4000
    sample_chars: int = 16_000
    dictionary_bytes: int = 65_536
    level: int = 3
    smooth: float = 24.0
    threshold: float = 0.3


@dataclass
class Model:
    params: Params
    dictionaries: tuple[bytes, bytes] | None  # of label 0, of label 1; None: too few labels
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5
    _made: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def features(self, s: flat.Slice) -> np.ndarray:
        if self._made is None:
            import zstandard

            self._made = tuple(zstandard.ZstdCompressor(level=self.params.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in self.dictionaries)
        raw = memoryview(s.data.tobytes())
        spans = list(zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True))
        bad, good = (np.array([len(c.compress(raw[a:b])) for a, b in spans], float) for c in self._made)
        size = np.diff(s.off)
        x = (bad - good) / (size + self.params.smooth)
        share = good / (size + self.params.smooth)
        log = np.log1p(size) / 10
        return np.stack([np.ones(len(x)), 10 * x, 10 * np.minimum(x, 0), share, share * share, log, log * share, 10 * x * log], 1)

    def score(self, s: flat.Slice) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(s.off) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(s) @ np.array(self.weights), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a little ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, marks: DataFrame, params: Params | None = None) -> Model:
    """Fit on docs (doc_id, text) and marks (doc_id, label 0 or 1; one row per doc_id). Null texts are left
    out.

    The sample of each label is the rows_per_label documents with the smallest hash of doc_id (ties: doc_id)
    among those of at most sample_chars characters: random, but the same in any partitioning. Only ids and
    lengths are shuffled; the sample's texts are then picked by a broadcast of its ids. Class weights
    restore the labels' shares. With fewer than 8 texts of a label the model returns the share of label 1
    for every text.
    """
    p = params or Params()
    sizes = docs.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n_text"))
    rows = sizes.join(marks.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")), "doc_id").persist()
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = [rows.where((F.col("label") == k) & (F.col("n_text") <= p.sample_chars)).select("doc_id", "label").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(p.rows_per_label) for k in (0, 1)]
    picked = ids[0].union(ids[1])  # bounded by params
    texts = docs.where(F.length("text") <= p.sample_chars).select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").collect()
    rows.unpersist()
    texts.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.text))
    samples = [[r.text.encode() for r in texts if r.label == k][: p.rows_per_label] for k in (0, 1)]
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2)
    if min(len(x) for x in samples) < 8:
        return Model(p, None, prior=prior)
    import zstandard

    try:
        dictionaries = tuple(zstandard.train_dictionary(p.dictionary_bytes, x[::2]).as_bytes() for x in samples)
    except zstandard.ZstdError:  # too little text for zstandard's trainer
        dictionaries = tuple(b"".join(x[::2])[-p.dictionary_bytes :] or b"\0" * 8 for x in samples)
    model = Model(p, dictionaries, prior=prior)
    x, y, w = [], [], []
    for label in (0, 1):
        seen = samples[label][1::2]
        for s in flat.slices(pa.array(seen, pa.binary())):
            x.append(model.features(s))
        y += [label] * len(seen)
        w += [counts[label] / total / len(seen) * min(len(samples[0]), len(samples[1]))] * len(seen)
    model.weights = logistic(np.concatenate(x), np.array(y, float), np.array(w) * 2).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, then score (0..1, higher: label 1 likelier) and predicted (1 if score >=
    params.threshold). Null and empty texts are scored as texts of length 0. One pass, no shuffle;
    own columns named score or predicted are replaced."""
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dictionary_bytes at most
    threshold = model.params.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.score(s) for s in flat.slices(batch.column("text"))]
            if values:
                v = np.concatenate(values)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v), pa.array((v >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """Fit on `labels.quality` of the documents that are not held out. The labels are reduced to one per
    doc_id (the smallest) so that repeated rows count once."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    return fit(docs.where(~held_out()), marks, params)
