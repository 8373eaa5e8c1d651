"""Small helpers that the operators share: tables, shared folder, document keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local folder is set for the session on one machine; a cluster has no folder
    that all see then, and is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cohortflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cohortflow-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of an Arrow batch where the session has Spark's default of 10,000: whole texts are long, and a batch
#: is held several times on both sides of the pipe to Python.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS, unless the user chose a number of rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def aside(docs: DataFrame, *plain: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but `plain` under names that clash with nothing, and those names."""
    others = [c for c in docs.columns if c not in plain]
    names = [f"_other{i}" for i in range(len(others))]
    return docs.select(*plain, *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]), names


def back(docs: DataFrame, columns: list[str], *plain: str) -> DataFrame:
    """The columns of aside() under their own names, in order of `columns`."""
    others = iter(range(len(columns)))
    return docs.select(*[F.col(c) if c in plain else F.col(f"_other{next(others)}").alias(c) for c in columns])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """Columns _key (unique long, ordered as id_col), id_col, text_col and `others`.

    Usually _key is the id itself. If ids repeat or are null, rows are sorted by (id, text), nulls
    first, and numbered in that order, so that every row stays a document of its own.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(id_col, F.col(text_col).cast("string").alias(text_col), *others)
    odd = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count()
    if not odd and dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        # no null is left; with the filter, inner and outer joins read the same exchange of the texts
        return docs.select(F.col(id_col).cast("bigint").alias("_key"), "*").where(F.col("_key").isNotNull())
    ordered = docs.orderBy(F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    return stored(ordered.select(F.monotonically_increasing_id().alias("_key"), "*"))
