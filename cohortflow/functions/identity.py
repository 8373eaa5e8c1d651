"""Hashes and identifiers: canonical JSON, stable event ids, deterministic uniform draws."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_digest(raw: pd.Series) -> pd.Series:
    """sha256 of the canonical form of JSON text; null for null or broken text. Python's number format
    cannot be had from to_json()."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json_digest(json.loads(text))
        except ValueError:
            return None

    return raw.map(one, na_action="ignore")


def shown(value: object) -> str:
    """A value as event ids spell it: texts quoted, lists and objects item by item, keys in order."""
    if value is None:
        return "null"
    if isinstance(value, list):
        return f"[{','.join(map(shown, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{shown(value[k])}" for k in sorted(value)) + "}"
    return repr(value)


def spelled_id(namespace: str, parts: dict) -> str:
    """blake2b of 128 bits in hex, of the namespace and the named parts in order of their names."""
    text = "|".join([namespace, *[f"{k}={shown(parts[k])}" for k in sorted(parts)]])
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def event_id(namespace: str, **parts: Column) -> Column:
    """spelled_id() of columns: texts, whole numbers, flags and lists of them. blake2b is no built-in function, and the
    spelling is Python's: batches of JSON go to Python."""

    @F.pandas_udf(StringType())
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda text: spelled_id(namespace, json.loads(text)))

    struct = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return made(F.to_json(struct, {"ignoreNullFields": "false"}))


def evaluation_id(namespace: str, policy: Column, panelist_id: Column, t: Column, product_id: Column, selection_id: Column, schema_version: str = "0.1.0") -> Column:
    return event_id(namespace, schema_version=F.lit(schema_version), event_type=F.lit("evaluation"), policy=policy, panelist_id=panelist_id, t=t, product_id=product_id, selection_id=selection_id)


def selection_id(namespace: str, policy: Column, panelist_id: Column, t: Column, choice_set: Column, selected: Column, schema_version: str = "0.1.0") -> Column:
    return event_id(namespace, schema_version=F.lit(schema_version), event_type=F.lit("selection"), policy=policy, panelist_id=panelist_id, t=t, choice_set=choice_set, selected_product_ids=selected)


def imported_id(**parts: Column) -> Column:
    """evt_ and 16 hex digits of the sha256 of the parts as a JSON object."""
    struct = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.concat(F.lit("evt_"), F.left(F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256), F.lit(16)))


def bits(seed: int, *keys: Column) -> Column:
    """52 random bits that depend on seed and keys alone, not on order or partitioning: of the md5 of their texts, so that
    any engine can repeat the draw."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("bigint")


def draw(seed: int, *keys: Column) -> Column:
    """A uniform number in [0, 1) from bits()."""
    return bits(seed, *keys).cast("double") * F.lit(2.0**-52)
