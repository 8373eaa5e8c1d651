"""The registered queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, bpe, fim, licenses, minhash, onebit, packing, pigeonhole, quality, sortmeans, substring, suffix, urls
from .common import table

try:  # the folder of vocabulary files; pass another path to the operators where there is none
    from public_tokenizers import path as tokenizer_path
except ImportError:

    def tokenizer_path(name: str) -> str:
        return f"/opt/tokenizers/{name}"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer_path("word_bpe_49k.json"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe.same_ranks(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op10_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op13_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OPERATORS = (
    op1_quality, op2_minhash, op3_packing, op4_substring, op5_pigeonhole, op6_licenses, op7_bpe, op8_suffix, op9_urls, op10_onebit, op11_fim, op12_bestfit, op13_sortmeans,
)
QUERIES = {f.__name__: f for f in OPERATORS}

#: Queries whose rows DuckDB can work out by brute force. op1, op3, op7, op12 and the pipeline need a model or a
#: tokenizer; op2 and op6 may miss a pair or a window by chance, and op8 slides over bytes: those are
#: compared with plain Python in tests/llm.
ORACLES: dict[str, str] = {
    "op4_substring": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
    h AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
    r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
    every AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
    kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS text, count(*) AS n FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY 1)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op5_pigeonhole": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    good AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
    SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id""",
    "op10_onebit": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x)) AS score
    FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0) QUALIFY rank <= 10""",
    "op9_urls": urls.ORACLE,
    "op11_fim": fim.ORACLE,
    "op13_sortmeans": sortmeans.oracle(sortmeans.Params()),
}
