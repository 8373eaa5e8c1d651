"""JSON lines and records: strict scans, typed dimension records, schedules, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.identity import canonical_digest


class BadRows(ValueError):
    pass


#: Where a line stands: its file, the start of the split in which it was read, and its place after that. Splits of a file
#: are read from their start on by one task, so this orders lines of any number of files however Spark packs them.
ORDER = "struct<file:string,start:bigint,line:bigint>"


def in_files(rows: DataFrame) -> DataFrame:
    """Adds _ord, the order of lines by file name and place, to rows as they are read from text files."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("_ord", place)


def scan(spark: SparkSession, path: str, strict: bool = True, max_rows: int | None = None) -> DataFrame:
    """_ord (order of input: by file name, then as they stand), _raw, row (VARIANT) of each line that is not blank; .gz
    is unpacked, one task a file, and then spread if files are fewer than cores. strict: a line that is no JSON object is an error, raised when
    the rows are read, which names the line's text. max_rows: the first ones; later lines are neither parsed nor sent, but
    for strict=False, where rows are counted after the others went."""
    lines = in_files(spark.read.text(path)).where("trim(value) <> ''")
    if strict and max_rows is not None:
        lines = lines.orderBy("_ord").limit(max_rows)
    elif path.endswith(".gz") and len(lines.inputFiles()) < spark.sparkContext.defaultParallelism:
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = lines.select("_ord", F.col("value").alias("_raw"), F.try_parse_json("value").alias("row"))
    if not strict:
        rows = rows.where(P.is_object(F.col("row")))
        return rows if max_rows is None else rows.orderBy("_ord").limit(max_rows)
    wrong = F.raise_error(F.concat(F.lit("no JSON object: "), F.left("_raw", F.lit(200)))).cast("variant")
    return rows.withColumn("row", F.when(P.is_object(F.col("row")), F.col("row")).otherwise(wrong))


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def records(spark: SparkSession, path: str, key: str, variant: str, missing_ok: bool = False) -> DataFrame:
    """Dimension records (personas or products) with defaults: version 0.1.0, variant "default", spec_key
    from the attributes where it is absent. missing_ok: a missing path is an empty table."""
    schema = f"{key} string, {variant} string, schema_version string, text string, attributes variant, spec_key string, _ord {ORDER}"
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    row = F.col("row")
    text = "persona_text" if key == "persona_id" else "display_text"
    # the attributes' own text: parse_json() would rewrite numbers before they are hashed
    attributes = F.get_json_object("_raw", "$.attributes")
    return scan(spark, path).select(
        P.string(row, key).alias(key), F.coalesce(P.string(row, variant), F.lit("default")).alias(variant), F.coalesce(P.string(row, "schema_version"), F.lit("0.1.0")).alias("schema_version"),
        P.string(row, text).alias("text"), P.field(row, "attributes").alias("attributes"), F.coalesce(P.string(row, "spec_key"), canonical_digest(attributes)).alias("spec_key"), "_ord",
    )


def of_variant(records: DataFrame, variant_col: str, variant: str = "default") -> DataFrame:
    return records.where(F.col(variant_col) == variant)


def merge(base: DataFrame, incoming: DataFrame, keys: list[str], prefer_incoming: list[str]) -> DataFrame:
    """Upsert: rows of both sides by key; in prefer_incoming columns the incoming value wins if not null,
    elsewhere the base value does."""
    others = [c for c in base.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in others])
    both = base.join(new, keys, "full_outer")
    value = {c: F.coalesce(f"_new_{c}", c) if c in prefer_incoming else F.coalesce(c, f"_new_{c}") for c in others}
    return both.select(*keys, *[value[c].alias(c) for c in others])


def schedule(rows: DataFrame, default_t: int = 0, panelists: DataFrame | None = None, products: DataFrame | None = None, on_unknown: str = "error") -> DataFrame:
    """A manual schedule (panelist_id, product_id, t as text or number, _ord): trimmed, blank t the
    default, repeats of a product within (panelist, t) dropped after the first. Columns panelist_id, t,
    pos, product_id. Empty ids fail, as do unknown ones unless on_unknown is "drop"."""
    t = F.coalesce(P.lenient_int(F.col("t").cast("string")), F.lit(default_t)).cast("bigint")
    clean = rows.select(P.clean_text(F.col("panelist_id")).alias("panelist_id"), P.clean_text(F.col("product_id")).alias("product_id"), t.alias("t"), "_ord")
    empty = F.col("panelist_id").isNull() | F.col("product_id").isNull()
    clean = clean.withColumn("panelist_id", F.when(empty, F.raise_error(F.lit("empty id in schedule")).cast("string")).otherwise(F.col("panelist_id")))
    for known, key in ((panelists, "panelist_id"), (products, "product_id")):
        if known is None:
            continue
        ids = known.select(key).distinct()
        if on_unknown == "error":
            marked = clean.join(ids.withColumn("_known", F.lit(True)), key, "left")
            bad = F.raise_error(F.concat(F.lit(f"unknown {key} "), F.col(key))).cast("string")
            clean = marked.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(bad)).drop("_known")
        else:
            clean = clean.join(ids, key, "left_semi")
    first = clean.groupBy("panelist_id", "t", "product_id").agg(F.min("_ord").alias("_ord"))
    pos = F.row_number().over(W.partitionBy("panelist_id", "t").orderBy("_ord", "product_id")) - 1
    return first.select("panelist_id", "t", pos.cast("bigint").alias("pos"), "product_id")


def schedule_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    rows = in_files(spark.read.csv(path, header=True))
    if "t" not in rows.columns:
        rows = rows.withColumn("t", F.lit(None).cast("string"))
    return schedule(rows, **options)


def schedule_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """{panelist: [products]} (t = 0) or {panelist: {t: [products]}}."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("panelist_id", "value"))
    by_t = F.when(F.ltrim("value").startswith("["), F.create_map(F.lit("0"), F.from_json("value", "array<string>"))).otherwise(F.from_json("value", "map<string,array<string>>"))
    rows = whole.select("panelist_id", F.explode(by_t).alias("t", "items")).select("panelist_id", "t", F.posexplode("items").alias("_ord", "product_id"))
    return schedule(rows, **options)


def load_schedule(spark: SparkSession, path: str, format: str = "csv_long", **options) -> DataFrame:
    """A schedule file of either format."""
    readers = {"csv_long": schedule_csv, "json": schedule_json}
    if format not in readers:
        raise ValueError(f"unknown format {format!r}: {sorted(readers)}")
    return readers[format](spark, path, **options)


def json_line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, single_file: bool = False, compression: str = "none") -> None:
    """Lines with sorted keys, nulls kept; atomic through the output committer."""
    lines = df.select(json_line(df).alias("value"))
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").option("compression", compression).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Sorted columns with a header; nested columns as JSON."""
    nested = {n for n, k in df.dtypes if k.startswith(("array", "map", "struct", "variant"))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in sorted(df.columns)]).write.mode("overwrite").csv(path, header=True)
