"""Undeclared features as typed columns: what open payloads hold is found in one pass, and taken out in another."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payload as P


@dataclass(frozen=True)
class Leaf:
    """A scalar field: its keys from the outside in, and its kind: double, string, boolean, or variant where rows differ
    (then it is read as a label), void where it is never anything but null."""

    keys: tuple[str, ...]
    kind: str

    @property
    def name(self) -> str:
        return ".".join(self.keys)

    @property
    def path(self) -> str:
        return "$" + "".join(P._path(k)[1:] for k in self.keys)

    def value(self, payload: Column) -> Column:
        if self.kind in ("variant", "void"):
            field = F.try_variant_get(payload, self.path, "variant")
            scalar = F.when(~F.schema_of_variant(field).rlike("^(ARRAY|OBJECT)"), F.to_json(field))
            return F.element_at(F.transform(F.array(scalar), P.json_label), 1)
        return F.try_variant_get(payload, self.path, self.kind)


def as_type(schema: str) -> T.DataType:
    """A schema as schema_of_variant_agg() shows it."""
    return T.DataType.fromDDL(re.sub(r"`[^`]*`|\bOBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], schema))


def scalars(kind: T.DataType, keys: tuple[str, ...]) -> list[Leaf]:
    """The leaves below a type; lists have none."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in scalars(f.dataType, (*keys, f.name))]
    if isinstance(kind, T.ArrayType):
        return []
    names = {T.StringType: "string", T.BooleanType: "boolean", T.VariantType: "variant", T.NullType: "void"}
    named = next((n for t, n in names.items() if isinstance(kind, t)), None)
    return [Leaf(keys, named or ("double" if isinstance(kind, T.NumericType) else "variant"))]


def leaves(events: DataFrame, *payloads: str) -> list[list[Leaf]]:
    """The scalar fields of each payload, over all rows, in order of name. One aggregation for all payloads; another
    only for fields that are objects in some rows and something else in others."""
    def schemas(*values: Column) -> list[T.DataType | None]:
        row = events.agg(*[F.schema_of_variant_agg(F.when(P.is_object(v), v)) for v in values]).first()
        return [as_type(s) if s and s.startswith("OBJECT") else None for s in row]

    found = [scalars(s, ()) if s else [] for s in schemas(*map(F.col, payloads))]
    open_ = [(i, leaf) for i, group in enumerate(found) for leaf in group if leaf.kind == "variant"]
    while open_:
        inner = schemas(*[F.try_variant_get(F.col(payloads[i]), leaf.path, "variant") for i, leaf in open_])
        deeper = [(i, x) for (i, leaf), s in zip(open_, inner, strict=True) if s for x in scalars(s, leaf.keys)]
        for i, leaf in deeper:
            found[i].append(leaf)
        open_ = [(i, leaf) for i, leaf in deeper if leaf.kind == "variant"]
    return [sorted(set(group), key=lambda leaf: leaf.name) for group in found]


def as_columns(events: DataFrame, sides: Mapping[str, str]) -> DataFrame:
    """Adds a column `side.path` for each scalar field of each payload (sides: side to payload column): numbers as
    double, texts, flags, and labels where rows differ in type. Fields that are always null are left out, and lists."""
    found = leaves(events, *sides.values())
    made = [leaf.value(F.col(payload)).alias(f"{side}.{leaf.name}") for (side, payload), group in zip(sides.items(), found, strict=True) for leaf in group if leaf.kind != "void"]
    return events.select("*", *made)
