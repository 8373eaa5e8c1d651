"""Expressions over open payloads (VARIANT columns): presence, strict types, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _path(name: str) -> str:
    """Paths have no escapes: a name is put between the quotes that it does not hold itself."""
    if "'" in name and '"' in name:
        raise ValueError(f"no path can name a field with both kinds of quotes: {name}")
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def field(payload: Column, name: str) -> Column:
    """The field as VARIANT; SQL null where the key is absent or the payload is no object."""
    return F.try_variant_get(payload, _path(name), "variant")


def kind(payload: Column, name: str) -> Column:
    """Type name of the field: VOID for JSON null, SQL null for an absent key."""
    value = field(payload, name)
    return F.when(value.isNotNull(), F.schema_of_variant(value))


def present(payload: Column, name: str) -> Column:
    """Key there and not null, whatever its type."""
    return F.coalesce(kind(payload, name) != "VOID", F.lit(False))


def number(payload: Column, name: str) -> Column:
    """The field as double if it is a JSON number; booleans and numeric strings give null."""
    return F.when(kind(payload, name).rlike(NUMBER), F.try_variant_get(payload, _path(name), "double"))


def string(payload: Column, name: str) -> Column:
    """The field if it is a JSON string."""
    return F.when(kind(payload, name) == "STRING", F.try_variant_get(payload, _path(name), "string"))


def number_label(x: Column) -> Column:
    """5.0 as "5", other numbers as they print."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def json_label(j: Column) -> Column:
    """A grouping key from a value's JSON text: 1, 1.0 and true share one; strings and containers stay as
    they are shown. Null for JSON null."""
    number = F.when(j.rlike("^-?[0-9]"), number_label(j.try_cast("double")))
    return F.when(j == "true", "1").when(j == "false", "0").when(j != "null", F.coalesce(number, j))


def label(payload: Column, name: str) -> Column:
    """json_label() of the field; the field is fetched once."""
    return F.element_at(F.transform(F.array(F.to_json(field(payload, name))), json_label), 1)


def strings(payload: Column, name: str) -> Column:
    """The field if it is a list of strings (an empty list counts)."""
    return F.when(kind(payload, name).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(payload, _path(name), "array<string>"))


def keys(payload: Column) -> Column:
    """Top-level keys of an object."""
    return F.map_keys(F.try_variant_get(payload, "$", "map<string,variant>"))


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))


def filled(payload: Column) -> Column:
    """A non-empty object."""
    return F.coalesce(is_object(payload) & (F.size(keys(payload)) > 0), F.lit(False))


def lenient_number(text: Column) -> Column:
    """Text as a number the way Python's float() reads it (1_0 is 10, 1d is nothing); blank: null."""
    plain = F.regexp_replace(F.btrim(text), r"(?<=\d)_(?=\d)", "")
    ok = F.lower(plain).rlike(r"^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$")
    return F.when(ok, plain.try_cast("double"))


def lenient_int(text: Column) -> Column:
    """Whole numbers, else truncated decimals; nothing for what is no finite number."""
    x = lenient_number(text)
    return F.coalesce(F.btrim(text).try_cast("bigint"), F.when(F.abs(x) < 9.2e18, x.cast("bigint")))


def clean_text(text: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), F.lit(""))


def clean_list(items: Column) -> Column:
    """Trimmed non-empty items of a list of strings."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), clean_text), lambda x: x.isNotNull())


def joined(items: Column) -> Column:
    """Clean items with a blank line between them; none: null."""
    return F.nullif(F.array_join(clean_list(items), "\n\n"), F.lit(""))


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: the whole text, else from the first { to the last }."""
    parsed = lambda text: F.element_at(F.transform(F.array(F.try_parse_json(text)), lambda x: F.when(is_object(x), x)), 1)  # noqa: E731  parsed once
    return F.coalesce(parsed(F.btrim(reply)), parsed(F.regexp_extract(reply, r"(?s)\{.*\}", 0)))


def excerpt(text: Column, length: int = 800) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("…"))).otherwise(text)
