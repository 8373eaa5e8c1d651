"""Raw review and item files: JSON lines, plain or gzip, as typed columns; import bundles and their export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.identity import canonical_json, json_digest
from ..operators.designs import selected, top_attributes
from ..operators.regression import Result
from . import reviews as R
from .jsonl import scan, write_jsonl


def any_text(row: Column, name: str) -> Column:
    """A scalar field as text, whatever its JSON type; null for absent, null, lists and objects."""
    return F.when(P.kind(row, name).rlike("^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(P.field(row, name), "$", "string"))


def text_or_list(row: Column, name: str) -> Column:
    """A text, or a list of texts with blank lines between them; empty ones are null."""
    return F.coalesce(P.joined(P.strings(row, name)), P.clean_text(any_text(row, name)))


def flag(row: Column, name: str) -> Column:
    return F.when(P.kind(row, name) == "BOOLEAN", F.try_variant_get(P.field(row, name), "$", "boolean"))


def review_rows(spark: SparkSession, path: str, max_rows: int | None = None, strict: bool = True) -> DataFrame:
    """user_id, parent_asin, asin, timestamp, rating, verified_purchase, helpful_vote, title, text, _ord.

    Lenient timestamps and votes; a rating that is no number is null; helpful_vote counts if that key is
    there (even null), else helpful_votes. max_rows: the first ones in the order of the file.
    """
    rows, row = scan(spark, path, strict, max_rows), F.col("row")
    votes = F.when(P.field(row, "helpful_vote").isNotNull(), any_text(row, "helpful_vote")).otherwise(any_text(row, "helpful_votes"))
    return rows.select(
        *[any_text(row, c).alias(c) for c in ("user_id", "parent_asin", "asin")], P.lenient_int(any_text(row, "timestamp")).alias("timestamp"), P.number(row, "rating").alias("rating"),
        flag(row, "verified_purchase").alias("verified_purchase"), P.lenient_int(votes).alias("helpful_vote"), P.clean_text(any_text(row, "title")).alias("title"), P.clean_text(any_text(row, "text")).alias("text"), "_ord",
    )


def item_rows(spark: SparkSession, path: str, max_rows: int | None = None, strict: bool = True, features_for_text: bool = True) -> DataFrame:
    """parent_asin, title, display_text (the description, else the features), main_category, store, price,
    average_rating, rating_number, categories, details, _ord."""
    rows, row = scan(spark, path, strict, max_rows), F.col("row")
    text = F.coalesce(text_or_list(row, "description"), text_or_list(row, "features")) if features_for_text else text_or_list(row, "description")
    details = F.when(P.is_object(P.field(row, "details")), P.field(row, "details")).otherwise(F.parse_json(F.lit("{}")))
    return rows.select(
        any_text(row, "parent_asin").alias("parent_asin"), P.clean_text(any_text(row, "title")).alias("title"), text.alias("display_text"), any_text(row, "main_category").alias("main_category"), any_text(row, "store").alias("store"),
        *[P.lenient_number(any_text(row, c)).alias(c) for c in ("price", "average_rating")], P.lenient_int(any_text(row, "rating_number")).alias("rating_number"), P.clean_list(P.strings(row, "categories")).alias("categories"), details.alias("details"), "_ord",
    )


@dataclass(frozen=True)
class Bundle:
    """An import: canonical events with the records that they refer to."""

    events: DataFrame
    personas: DataFrame
    products: DataFrame
    stats: DataFrame


def bundle(reviews: DataFrame, items: DataFrame, mode: str = "panelist_sequence", min_reviews: int = 1, require_match: bool = False) -> Bundle:
    people, goods = R.personas(reviews, min_reviews), R.products(items)
    return Bundle(R.events(reviews, goods, min_reviews, mode, require_match), people, goods, R.stats(reviews, items, min_reviews))


def export(b: Bundle, folder: str, compression: str = "none") -> None:
    """events, personas, products and stats as folders of JSON lines (compression gzip: of .gz files) below `folder`."""
    for name in ("events", "personas", "products", "stats"):
        df = getattr(b, name)
        write_jsonl(df.drop("_ord") if "_ord" in df.columns else df, f"{folder}/{name}.jsonl", compression=compression)


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows of scan(), filtered or joined meanwhile, as the lines that they were, in order."""
    rows.orderBy("_ord").select("_raw").write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str, overwrite: bool = True) -> None:
    """Results (metrics, comparisons, coefficients, subsets) as Parquet and CSV tables, nested columns as JSON in the
    latter; overwrite=False leaves those alone that are there."""
    mode = "overwrite" if overwrite else "ignore"
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")
        flat = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct", "variant")) else F.col(f"`{c}`") for c, k in df.dtypes]
        df.select(*flat).write.mode(mode).option("escape", '"').csv(f"{folder}/{name}.csv", header=True)


def fit_tables(spark: SparkSession, fit: Result, design: str = "", outcome: str = "", top: int = 20) -> dict[str, DataFrame]:
    """What a regression leaves: a summary row, all coefficients, those of attributes, the top ones, dropped columns."""
    coefficients = fit.frame(spark)
    known = {k: v for k, v in fit.fit.items() if v == v}
    summary = spark.createDataFrame([(fit.family, design, outcome, float(fit.n), len(fit.terms), fit.df)], "family string, design string, outcome string, n double, n_terms long, df double")
    return {
        "summary": summary.select("*", *[F.lit(float(v)).alias(f"fit_{k}") for k, v in known.items()]), "coefficients_full": coefficients,
        "coefficients_attributes": selected(coefficients, intercept=False, thresholds=False, fixed_effects=False), "coefficients_top_attributes": top_attributes(coefficients, top),
        "dropped_columns": spark.createDataFrame(fit.dropped, "term string, reason string"),
    }


def run_metadata(events: DataFrame, seed: int, policy: str | None = None, config: dict | None = None, schema_version: str = "0.1.0", extra: dict | None = None) -> DataFrame:
    """One row that describes a run: counts of its events, seed, policy, and the configuration with its hash (absent and
    empty ones: null)."""
    seen = events.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(n) for c, n in (("panelist_id", "panelists"), ("product_id", "products"), ("t", "periods"))])
    texts = {"policy": policy, "config_hash_sha256": json_digest(config) if config else None, "config_snapshot": canonical_json(config) if config else None, "extra": canonical_json(extra) if extra else None}
    return seen.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at_utc"), F.lit(schema_version).alias("schema_version"), F.lit(seed).cast("bigint").alias("seed"),
        F.struct("rows", "panelists", "products", "periods").alias("counts"), *[F.lit(v).cast("string").alias(k) for k, v in texts.items()],
    )
