"""From documents to packed training sequences: quality, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import minhash, packing, quality, substring
from cohortflow.llm.common import aside, back, shared_dir, table
from cohortflow.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have a score as others do; repeated rows
    are judged each for itself; an empty table stays empty."""
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    renamed, _ = aside(docs, "doc_id", "text")
    return back(quality.score(renamed, model).where(F.col("predicted") == 1), docs.columns, "doc_id", "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the first by id (null ids first). Null texts count as
    empty; empty texts are copies of one another; texts of one to four words are near copies of equal words only."""
    return minhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing is left. Others
    stay as they are, but null texts become empty."""
    plain = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    renamed, others = aside(docs, *plain)
    out = substring.dedup(renamed, *others, texts=True)
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    left = left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return back(left, docs.columns, *plain)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; null and empty texts are their end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: No stage is expressible in SQL as a whole; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
