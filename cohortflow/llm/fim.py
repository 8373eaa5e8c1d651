"""Fill-in-middle transformation (operator 11): DuckDB within mapInArrow.

Each Arrow batch, a few MB of whole texts at a time, is registered as a table of a DuckDB connection of the
worker, and one SELECT cuts, orders and joins the tokens of all its texts. No row is touched by Python, and
nothing is shuffled: where a text is cut, and its form, follow from its id alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import small_batches

#: Bytes of text that one SELECT works on. A token takes some 20 bytes in each of several lists.
SELECT_BYTES = 1 << 20


@dataclass(frozen=True)
class Params:
    token: str = "[A-Za-z]+|[^A-Za-z]"  # noqa: S105
    #: Marks of prefix, suffix and middle.
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    seed: str = "1:"
    plain: int = 10  # per cent of the texts that stay as they are
    spm: int = 20  # per cent of the others that begin with their suffix

    def __post_init__(self):
        for a in self.marks:
            for b in self.marks:
                if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError("marks that hold or overlap one another cannot be told in an output")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cut_sql(p: Params) -> str:
    """doc_id, n, form, prefix, middle, suffix, text of the rows of `batch` (doc_id, text)."""
    h = [f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT)" for i in range(4)]
    marked = " OR ".join(f"contains(text, {quoted(m)})" for m in p.marks)
    part = lambda a, b: f"CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, {a}, {b}), '') END"
    return f"""SELECT doc_id, n, form, text, {part("1", "lo")} AS prefix, {part("lo + 1", "hi")} AS middle, {part("hi + 1", "n")} AS suffix FROM (
        SELECT *, CAST(least({h[0]} % (n + 1), {h[1]} % (n + 1)) AS BIGINT) AS lo, CAST(greatest({h[0]} % (n + 1), {h[1]} % (n + 1)) AS BIGINT) AS hi,
            CASE WHEN text = '' OR {marked} OR {h[2]} % 100 >= {100 - p.plain} THEN 'plain' WHEN {h[3]} % 100 < {p.spm} THEN 'spm' ELSE 'psm' END AS form
        FROM (SELECT *, CAST(len(tokens) AS BIGINT) AS n FROM (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {quoted(p.token)}) AS tokens, sha256({quoted(p.seed)} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch)))"""


def transform_sql(p: Params) -> str:
    """doc_id, n, form, prefix_chars, middle_chars, output."""
    first, then, last = map(quoted, p.marks)
    return f"""SELECT doc_id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {first} || prefix || {then} || suffix || {last} || middle ELSE {then} || suffix || {first} || prefix || {last} || middle END AS output
        FROM ({cut_sql(p)})"""


def restore_sql(p: Params, rows: str) -> str:
    """All columns of `rows`, and the text rebuilt from its output and form alone."""
    first, then, last = p.marks

    def between(a: str, b: str | None) -> str:
        start = f"instr(output, {quoted(a)}) + {len(a)}"
        return f"substr(output, {start})" if b is None else f"substr(output, {start}, instr(output, {quoted(b)}) - ({start}))"

    psm = f"{between(first, then)} || {between(last, None)} || {between(then, last)}"
    spm = f"{between(first, last)} || {between(last, None)} || {between(then, first)}"
    return f"SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} END AS restored FROM {rows}"


def digest_sql(p: Params) -> str:
    made = restore_sql(p, f"({transform_sql(p)})")
    return f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({made})"


def mapped(rows: DataFrame, sql: str, schema: str, text: int = 1) -> DataFrame:
    """`sql` over each few MB of rows (its table: batch), measured by their column number `text`."""
    small_batches(rows.sparkSession)
    kinds = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for s in flat.slices(batch.column(text), SELECT_BYTES):
                con.register("batch", pa.Table.from_batches([batch.slice(s.lo, s.hi - s.lo)]))
                made = con.sql(sql).to_arrow_table().select(kinds)
                con.unregister("batch")
                strings = [pa.field(f.name, pa.string()) if pa.types.is_large_string(f.type) or pa.types.is_string_view(f.type) else f for f in made.schema]
                yield from made.cast(pa.schema(strings)).to_batches()
        con.close()

    return rows.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), dict(docs.dtypes)[id_col]


def transform(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output: every text once.

    The prefix ends after the smaller of two places drawn from the id, the middle after the larger, each from 0 to n
    tokens. Null and empty texts are plain and stay empty; so do texts that hold a mark, as they are. Repeated ids are cut by
    the same draws, each text at its own length; null ids draw as an empty id. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    p = params or Params()
    rows, kind = texts(docs, id_col, text_col)
    return mapped(rows, transform_sql(p), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(made: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, text: what transform() began with (null texts: empty), from its columns output and form alone."""
    p = params or Params()
    kind = dict(made.dtypes)["doc_id"]
    sql = f"SELECT doc_id, restored AS text FROM ({restore_sql(p, 'batch')})"
    return mapped(made.select("doc_id", "output", "form"), sql, f"doc_id {kind}, text string")


def digests(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """transform() with sha256 of the output, and of the text that is rebuilt from it, in place of the output."""
    p = params or Params()
    rows, kind = texts(docs, id_col, text_col)
    return mapped(rows, digest_sql(p), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


#: The same by lengths and places in the text instead of lists of tokens.
ORACLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS size,
    sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, text, size, len(size) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM u),
f AS (SELECT *, CASE WHEN text = '' OR text SIMILAR TO '(?s).*<[PSM]>.*' OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(list_sum(size[1:least(h[1] % (n + 1), h[2] % (n + 1))]), 0) AS a, coalesce(list_sum(size[1:greatest(h[1] % (n + 1), h[2] % (n + 1))]), 0) AS b FROM d),
o AS (SELECT *, left(text, CAST(a AS BIGINT)) AS p, substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS m, substr(text, CAST(b + 1 AS BIGINT)) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
