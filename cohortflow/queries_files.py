"""Registered queries over files: each writes a sample of the test tables as raw files, then reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import identity
from .functions import payload as P
from .operators import metrics as M
from .operators import runs as N
from .operators import subset as U
from .operators import validate as V
from .plans.storage import scratch
from .queries import EVENTS, INTENT, ITEMS, RATING, REVIEWS, bits, frozen, query, r6, raw_events
from .sources import adapters as A
from .sources import jsonl as J
from .sources import landing as L
from .sources import raw_files as W
from .sources import reviews as I


def review_lines(spark, sf, compression: str = "none") -> str:
    """Files of raw reviews, in order of their names, with votes under either name and some timestamps as padded text."""
    rows = A.reviews(spark, sf).orderBy("_ord")
    votes = [F.when(F.col("_ord") % 2 == k, F.col("helpful_vote")).alias(n) for k, n in ((0, "helpful_vote"), (1, "helpful_votes"))]
    stamp = F.when(F.col("_ord") % 5 == 0, F.concat(F.lit(" "), F.col("timestamp").cast("string"))).otherwise(F.col("timestamp").cast("string"))
    path = scratch(spark) + (".jsonl.gz" if compression == "gzip" else ".jsonl")
    struct = F.struct("user_id", "parent_asin", "asin", stamp.alias("timestamp"), "rating", "verified_purchase", *votes, F.concat(F.lit("  "), F.col("comment")).alias("title"), F.col("_ord").alias("id"))
    rows.select(F.to_json(struct).alias("value")).write.option("compression", compression).text(path)
    return path


IMPORTED = "SELECT user_id, parent_asin, asin, ts AS timestamp, rating, verified AS verified_purchase, CAST(ord % 10 AS BIGINT) AS helpful_vote, comment AS title FROM reviews"


@query(f"WITH {REVIEWS} {IMPORTED}")
def raw_review_import(spark, sf):
    rows = W.review_rows(spark, review_lines(spark, sf, "gzip"))
    return rows.select("user_id", "parent_asin", "asin", "timestamp", "rating", "verified_purchase", "helpful_vote", "title")


@query(f"WITH {REVIEWS} {IMPORTED} ORDER BY ord LIMIT 500")
def raw_review_gzip_limit(spark, sf):
    rows = W.review_rows(spark, review_lines(spark, sf, "gzip") + "/part-*.gz", 500)
    return rows.select("user_id", "parent_asin", "asin", "timestamp", "rating", "verified_purchase", "helpful_vote", "title")


def item_lines(spark, sf) -> str:
    k = F.col("p_partkey")
    rows = A.table(spark, sf, "part").orderBy("p_partkey").select(
        F.when(k % 11 != 0, k.cast("string")).alias("parent_asin"), F.concat(F.col("p_name"), F.lit(" ")).alias("title"),
        F.when(k % 3 == 0, F.array(F.col("p_type"), F.lit("  "))).alias("description"), F.array(F.lit("made by"), F.col("p_brand")).alias("features"), F.col("p_brand").alias("store"),
        F.when(k % 4 == 0, "none").otherwise(F.col("p_retailprice").cast("string")).alias("price"), (F.col("p_size") + 0.5).alias("rating_number"), F.array(F.lit(" a "), F.lit(""), F.col("p_type")).alias("categories"),
    )
    path = scratch(spark) + ".jsonl"
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


ITEM_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS product_id, trim(p_name) AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'made by' || chr(10) || chr(10) || p_brand END AS display_text, p_brand AS store, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price, CAST(p_size AS BIGINT) AS rating_number, 'a,' || p_type AS categories FROM part WHERE p_partkey % 11 <> 0"


@query(ITEM_SQL)
def raw_item_import(spark, sf):
    goods = I.products(W.item_rows(spark, item_lines(spark, sf)))
    return goods.select("product_id", "title", "display_text", "store", "price", "rating_number", F.array_join("categories", ",").alias("categories"))


@query(f"SELECT product_id, title FROM ({ITEM_SQL.replace('FROM part', 'FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100)')})")
def raw_item_limit(spark, sf):
    return I.products(W.item_rows(spark, item_lines(spark, sf), 100)).select("product_id", "title")


@query(f"WITH {REVIEWS}, {ITEMS}, e AS (SELECT count(*) AS n FROM reviews WHERE user_id IS NOT NULL), p AS (SELECT count(*) AS n FROM (SELECT user_id FROM reviews WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)) SELECT 'events' AS name, n FROM e UNION ALL SELECT 'personas', n FROM p UNION ALL SELECT 'products', count(*) FROM items UNION ALL SELECT 'stats', CAST(1 AS BIGINT)")
def bundle_export(spark, sf):
    """An import exported as JSON lines, and the lines of each file counted."""
    folder = scratch(spark)
    W.export(W.bundle(A.reviews(spark, sf), A.metadata(spark, sf), min_reviews=3), folder, "gzip")
    counts = [J.scan(spark, f"{folder}/{n}.jsonl").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("events", "personas", "products", "stats")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 5 THEN p_size END AS size FROM part")
def jsonl_round_trip(spark, sf):
    path = scratch(spark)
    J.write_jsonl(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("size")), path)
    row = F.col("row")
    return J.scan(spark, path).select(P.number(row, "id").cast("bigint").alias("id"), P.string(row, "name").alias("name"), P.number(row, "size").cast("int").alias("size"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, '[\"' || p_type || '\"]' AS kinds, CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def csv_cells(spark, sf):
    path = scratch(spark)
    J.write_csv(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_type").alias("kinds"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("size")), path)
    return spark.read.csv(path, header=True, escape='\\')


@query("SELECT CAST(0 AS BIGINT) AS n")
def missing_file_is_empty(spark, sf):
    return J.records(spark, scratch(spark) + "/absent.jsonl", "persona_id", "persona_text_variant", missing_ok=True).agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS persona_id, CASE WHEN c_custkey % 3 = 0 THEN 'short' ELSE 'default' END AS variant, '0.1.0' AS schema_version, 'buys for ' || c_mktsegment AS text, sha256('{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}') AS spec_key FROM customer")
def record_scan(spark, sf):
    k, path = F.col("c_custkey"), scratch(spark)
    attributes = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    rows = A.table(spark, sf, "customer").select(k.cast("string").alias("persona_id"), F.when(k % 3 == 0, "short").alias("persona_text_variant"), F.concat(F.lit("buys for "), F.col("c_mktsegment")).alias("persona_text"), attributes.alias("attributes"))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return J.records(spark, path, "persona_id", "persona_text_variant").select("persona_id", F.col("persona_text_variant").alias("variant"), "schema_version", "text", "spec_key")


@query("SELECT CAST(c_custkey AS VARCHAR) AS persona_id FROM customer WHERE c_custkey % 3 = 0")
def record_variant_filter(spark, sf):
    rows = A.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("persona_id"), F.when(F.col("c_custkey") % 3 == 0, "short").otherwise("default").alias("persona_text_variant"))
    return J.of_variant(rows, "persona_text_variant", "short").select("persona_id")


SCHEDULE = "SELECT CAST(o_custkey AS VARCHAR) AS panelist_id, CAST(o_orderkey % 2 AS BIGINT) AS t, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, 'p' || o_orderkey AS product_id FROM orders WHERE o_orderkey % 5 = 0"


def planned(spark, sf):
    return A.table(spark, sf, "orders").where("o_orderkey % 5 = 0").orderBy("o_orderkey").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("panelist_id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("product_id"), F.when(F.col("o_orderkey") % 2 == 1, "1").alias("t"))


@query(SCHEDULE)
def schedule_from_csv(spark, sf):
    path = scratch(spark)
    planned(spark, sf).write.csv(path, header=True)
    return J.load_schedule(spark, path, "csv_long")


@query(SCHEDULE)
def schedule_from_json(spark, sf):
    path, rows = scratch(spark), planned(spark, sf)
    lists = rows.groupBy(F.btrim("panelist_id").alias("panelist_id"), F.coalesce("t", F.lit("0")).alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("product_id", 2, 20).cast("bigint").alias("o"), "product_id"))), lambda x: x["product_id"]).alias("items"))
    one = lists.groupBy("panelist_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "items"))).alias("by_t"))
    # a schedule file is one JSON object; here one file for each group of panelists
    one.groupBy(F.pmod(F.xxhash64("panelist_id"), F.lit(64))).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("panelist_id", "by_t")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return J.load_schedule(spark, path, "json")


@query(f"WITH {EVENTS} SELECT count(*) AS n_rows, count(*) FILTER (ord % 23 BETWEEN 1 AND 10) AS n_invalid FROM ev")
def validation_report(spark, sf):
    n, bad, _ = V.report(raw_events(spark, sf), 10)
    return spark.createDataFrame([(n, bad)], "n_rows long, n_invalid long")


@query("SELECT CAST(p_partkey AS VARCHAR) AS event_id, path, value FROM part, LATERAL (VALUES ('brand', '\"' || p_brand || '\"'), ('deep.a.b.c.d.size', CAST(p_size AS VARCHAR)), ('deep.a.name', '\"' || p_name || '\"')) v(path, value)")
def nested_features(spark, sf):
    deep = F.struct(F.struct(F.struct(F.struct(F.struct(F.col("p_size").alias("size")).alias("d")).alias("c")).alias("b"), F.col("p_name").alias("name")).alias("a"))
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("event_id"), F.to_variant_object(F.struct(F.col("p_brand").alias("brand"), F.array("p_type").alias("list"), deep.alias("deep"))).alias("product_features"))
    return M.feature_paths(rows, "product_features").select("event_id", "path", "value")


@query(f"WITH {REVIEWS}, k AS (SELECT *, user_id AS panelist_id, parent_asin AS product_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, parent_asin, asin, ord) - 1 AS t FROM reviews WHERE user_id IS NOT NULL) SELECT ord AS id, 'evt_' || left(sha256('{{\"panelist_id\":\"' || panelist_id || '\",\"product_id\":\"' || product_id || '\",\"source_child_asin\":\"' || asin || '\",\"t\":' || t || ',\"timestamp\":' || ts || '}}'), 16) AS event_id FROM k")
def imported_event_ids(spark, sf):
    reviews = A.reviews(spark, sf)
    return I.events(reviews, I.products(A.metadata(spark, sf)), 3).select(F.col("_ord").alias("id"), "event_id")


@query(f"WITH {EVENTS} SELECT count(*) AS n, count(DISTINCT (panelist_id, product_id, t)) AS n_distinct, CAST(32 AS BIGINT) AS width, TRUE AS hex FROM ev")
def event_id_shape(spark, sf):
    ids = A.evaluations(spark, sf).select(identity.evaluation_id("events", F.col("policy"), F.col("panelist_id"), F.col("t"), F.col("product_id"), F.lit(None).cast("string")).alias("e"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("e").alias("n_distinct"), F.max(F.length("e")).cast("bigint").alias("width"), F.bool_and(F.col("e").rlike("^[0-9a-f]{32}$")).alias("hex"))


@query("SELECT p_partkey AS id, trim(p_name) || chr(10) || chr(10) || p_brand AS text, left(p_name, 7) || CASE WHEN length(p_name) > 7 THEN '…' ELSE '' END AS excerpt FROM part")
def clean_lists(spark, sf):
    items = F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")), F.lit(" "), F.lit(None).cast("string"), F.col("p_brand"))
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), P.joined(items).alias("text"), P.excerpt(F.col("p_name"), 7).alias("excerpt"))


@query(f"WITH {EVENTS} SELECT name, n FROM (SELECT 'rating' AS name, count(*) AS n FROM ev UNION ALL SELECT 'intent', count(*) FROM ev)")
def observed_outcome_fields(spark, sf):
    rows = A.evaluations(spark, sf)
    return N.observed_fields(rows.withColumn("outcomes", F.parse_json(F.to_json(F.struct(P.number(F.col("outcomes"), "rating").alias("rating"), P.string(F.col("outcomes"), "intent").alias("intent")), {"ignoreNullFields": "false"}))), "outcomes")


@query(f"WITH {ITEMS} SELECT product_id FROM items")
def product_id_scan(spark, sf):
    return U.product_ids(A.metadata(spark, sf).withColumnRenamed("parent_asin", "product_id"))


@query(f"WITH {EVENTS}, {ITEMS}, p AS (SELECT product_id FROM ev WHERE rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) SELECT product_id, title, price FROM items WHERE product_id IN (SELECT product_id FROM p)")
def subset_products_semi(spark, sf):
    ids = U.eligible(A.evaluations(spark, sf), 30)
    return U.products_of(I.products(A.metadata(spark, sf)), ids).select("product_id", "title", "price")


@query(f"WITH {EVENTS}, p AS (SELECT product_id FROM ev WHERE rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) SELECT 'subset' AS name, event_id AS id, product_id, CAST(rating AS VARCHAR) AS value FROM ev WHERE rating IS NOT NULL AND product_id IN (SELECT product_id FROM p) UNION ALL SELECT 'condition', event_id, product_id, '[\"' || model || '\",\"' || strategy || '\"]' FROM ev WHERE NOT is_real")
def result_tables_round_trip(spark, sf):
    """A subset and a table with a nested column written, then read again from CSV, value by value."""
    folder = scratch(spark)
    real = A.evaluations(spark, sf).where("NOT real").select("event_id", "product_id", F.array("model", "strategy").alias("condition"))
    W.write_tables({"subset": frozen(spark, sf).select("event_id", "product_id", F.col("_rating").alias("rating")), "conditions": real}, folder)
    W.write_tables({"conditions": real.limit(0)}, folder, overwrite=False)
    read = lambda name, value: spark.read.csv(f"{folder}/{name}.csv", header=True, escape='"').select(F.lit("subset" if name == "subset" else "condition").alias("name"), F.col("event_id").alias("id"), "product_id", F.col(value).alias("value"))
    return read("subset", "rating").unionByName(read("conditions", "condition"))


@query(f"WITH {EVENTS} SELECT event_id FROM ev ORDER BY {bits('7', 'event_id')}, event_id LIMIT 200")
def seeded_row_sample(spark, sf):
    return N.row_sample(A.evaluations(spark, sf).select("event_id"), 200, 7)


@query(f"WITH {EVENTS}, p AS (SELECT product_id FROM ev WHERE rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 25) SELECT least(count(*), 20) AS n, least(count(*), 20) AS n_eligible FROM p")
def seeded_subset_counts(spark, sf):
    can = U.eligible(A.evaluations(spark, sf), 25)
    ids = U.chosen(can, 20, 7)
    return ids.join(can.select("product_id", F.lit(1).alias("one")), "product_id", "left").agg(F.count("*").alias("n"), F.sum("one").alias("n_eligible"))



@query(f"WITH {EVENTS}, p AS (SELECT product_id FROM ev WHERE rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) SELECT '{{\"event_id\": \"' || event_id || '\",  \"product_id\":\"' || product_id || '\"}}' AS line FROM ev WHERE product_id IN (SELECT product_id FROM p)")
def subset_lines_unchanged(spark, sf):
    """Event lines, spaces and all, that a subset keeps: as they were read."""
    path, out = scratch(spark), scratch(spark)
    ev = A.evaluations(spark, sf)
    ev.select(F.format_string('{"event_id": "%s",  "product_id":"%s"}', "event_id", "product_id").alias("value")).write.text(path)
    lines = J.scan(spark, path).withColumn("product_id", P.string(F.col("row"), "product_id"))
    W.write_lines(lines.join(U.eligible(ev, 30).select("product_id"), "product_id", "left_semi"), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@query(f"WITH {EVENTS} SELECT product_id, count(*) AS n, round(avg(rating), 6) + 0.0 AS mean, min(intent) AS least_intent FROM ev WHERE rating >= 4 GROUP BY 1")
def landed_events(spark, sf):
    """Events of both types landed as typed Parquet, then filtered by type and value."""
    folder = scratch(spark)
    both = A.evaluations(spark, sf).unionByName(A.selections(spark, sf).drop("executed", "dropped"), allowMissingColumns=True)
    L.land(both, folder, [RATING, INTENT])
    rows = L.landed(spark, folder).where("event_type = 'evaluation' AND outcome_rating >= 4")
    return rows.groupBy("product_id").agg(F.count("*").alias("n"), r6(F.avg("outcome_rating")).alias("mean"), F.min("outcome_intent").alias("least_intent"))


@query(f"WITH {EVENTS} SELECT count(*) AS n_rows, count(DISTINCT panelist_id) AS panelists, count(DISTINCT product_id) AS products, count(DISTINCT t) AS periods, CAST(7 AS BIGINT) AS seed, 'manual' AS policy, sha256('{{\"a\":[1,2]}}') AS digest FROM ev")
def run_metadata_record(spark, sf):
    """A run's description, written as a line of JSON and read again."""
    path = scratch(spark)
    J.write_jsonl(W.run_metadata(A.evaluations(spark, sf), 7, "manual", {"a": [1, 2]}), path)
    row = F.col("row")
    counts = [P.number(P.field(row, "counts"), c).cast("bigint").alias(n) for c, n in (("rows", "n_rows"), ("panelists", "panelists"), ("products", "products"), ("periods", "periods"))]
    return J.scan(spark, path).select(*counts, P.number(row, "seed").cast("bigint").alias("seed"), P.string(row, "policy").alias("policy"), P.string(row, "config_hash_sha256").alias("digest"))


@query(f"WITH {REVIEWS} SELECT ord AS id, comment AS title, asin AS child, ts AS stamp, CASE WHEN comment IS NULL THEN 'source' ELSE 'review_title,source' END AS keys FROM reviews WHERE user_id IS NOT NULL")
def import_traces(spark, sf):
    """Traces of imported reviews: texts under their names, the source, and no nulls."""
    reviews = A.reviews(spark, sf).withColumn("title", F.concat(F.lit(" "), F.col("comment")))
    ev = I.events(reviews, I.products(A.metadata(spark, sf)), 3)
    source = P.field(F.col("traces"), "source")
    return ev.select(F.col("_ord").alias("id"), P.string(F.col("traces"), "review_title").alias("title"), P.string(source, "child_asin").alias("child"), P.number(source, "timestamp").cast("bigint").alias("stamp"), F.array_join(F.array_sort(P.keys(F.col("traces"))), ",").alias("keys"))
