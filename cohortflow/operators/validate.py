"""Validation of events: rows against the schema, unique ids, links; payloads against a questionnaire."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P

#: The columns of schema version 0.1.0.
COLUMNS = (
    "schema_version", "event_id", "event_type", "policy", "panelist_id", "t", "selection_id", "choice_set",
    "selected_product_ids", "product_id", "product_display", "panelist_features", "product_features", "outcomes", "traces",
)
POLICIES = ("random", "manual", "self_selection")
VERSIONS = ("0.1.0",)


TEXTS = ("schema_version", "event_id", "event_type", "policy", "panelist_id", "selection_id", "product_id", "product_display")


def period(k: Column, v: Column) -> Column:
    """t as a whole number: numbers without a fraction, their text and booleans are taken."""
    x = F.try_variant_get(v, "$", "double")
    return F.when(k == "BIGINT", F.try_variant_get(v, "$", "bigint")).when((k.rlike(P.NUMBER) & (x == F.floor(x))) | (k == "BOOLEAN"), x.cast("bigint")).when(k == "STRING", F.try_variant_get(v, "$", "string").try_cast("bigint"))


def parts(row: Column) -> list[Column]:
    """What the rules look at: each field's kind (k_), texts (s_), lists (l_), the period, the traces' lists, the keys. Every
    field is fetched here and nowhere else."""
    out = [P.kind(row, n).alias(f"k_{n}") for n in COLUMNS]
    out += [P.string(row, n).alias(f"s_{n}") for n in TEXTS] + [P.strings(row, n).alias(f"l_{n}") for n in ("choice_set", "selected_product_ids")]
    traces = P.field(row, "traces")
    out += [P.kind(traces, n).alias(f"k_{n}") for n in ("executed", "dropped")] + [P.strings(traces, n).alias(f"l_{n}") for n in ("executed", "dropped")]
    return [*out, period(P.kind(row, "t"), P.field(row, "t")).alias("period"), P.keys(row).alias("keys")]


def broken(part: Callable[[str], Column]) -> Column:
    """Codes of all rules that a row breaks, given its parts; an empty array: the row is valid."""
    there = {n: F.coalesce(part(f"k_{n}") != "VOID", F.lit(False)) for n in (*COLUMNS, "executed", "dropped")}
    s, lists = {n: part(f"s_{n}") for n in TEXTS}, {n: part(f"l_{n}") for n in ("choice_set", "selected_product_ids", "executed", "dropped")}
    kind = s["event_type"]
    selection, evaluation = kind == "selection", kind == "evaluation"
    menu, asked, executed, dropped = lists["choice_set"], lists["selected_product_ids"], lists["executed"], lists["dropped"]
    is_object = {n: F.coalesce(part(f"k_{n}").startswith("OBJECT"), F.lit(False)) for n in ("panelist_features", "product_features", "outcomes", "traces")}
    repeats = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    rules: list[tuple[str, Column]] = [(f"type:{n}", there[n] & s[n].isNull()) for n in ("event_id", "event_type", "policy", "panelist_id", "selection_id", "product_id", "product_display")]
    rules += [(f"missing:{n}", ~there[n]) for n in ("event_id", "event_type", "policy", "panelist_id", "t")]
    rules += [(f"type:{n}", there[n] & lists[n].isNull()) for n in ("choice_set", "selected_product_ids")]
    rules += [(f"type:{n}", there[n] & ~is_object[n]) for n in is_object]
    rules += [
        ("unknown_column", F.size(F.array_except(part("keys"), F.array(*[F.lit(c) for c in COLUMNS]))) > 0),
        ("value:event_type", kind.isNotNull() & ~kind.isin("selection", "evaluation")),
        ("value:policy", s["policy"].isNotNull() & ~s["policy"].isin(*POLICIES)),
        ("value:t", there["t"] & (F.coalesce(part("period"), F.lit(-1)) < 0)),
        ("selection:policy", selection & (s["policy"] != "self_selection")),
        ("selection:needs_lists", selection & ~(there["choice_set"] & there["selected_product_ids"])),
        ("selection:forbids_product", selection & (there["product_id"] | there["product_display"] | there["outcomes"])),
        ("selection:repeated_request", selection & repeats(asked)),
        ("selection:trace_lists", selection & ((there["executed"] & executed.isNull()) | (there["dropped"] & dropped.isNull()))),
        ("selection:repeated_trace", selection & (F.coalesce(repeats(executed), F.lit(False)) | F.coalesce(repeats(dropped), F.lit(False)))),
        ("selection:executed_off_menu", selection & (F.size(F.array_except(executed, menu)) > 0)),
        ("selection:executed_and_dropped", selection & F.arrays_overlap(executed, dropped)),
        ("evaluation:needs_product", evaluation & ~(there["product_id"] & there["product_display"])),
        ("evaluation:forbids_lists", evaluation & (there["choice_set"] | there["selected_product_ids"])),
        ("evaluation:needs_selection_id", evaluation & (s["policy"] == "self_selection") & ~there["selection_id"]),
    ]
    unknown = ~F.coalesce(s["schema_version"].isin(*VERSIONS), F.lit(False))
    found = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))
    return F.when(unknown, F.array(F.lit("schema_version"))).otherwise(found)


def problems(row: Column) -> Column:
    """broken() of a row (VARIANT object), as one expression; checked() is the faster way for whole tables."""
    return F.element_at(F.transform(F.array(F.struct(*parts(row))), lambda x: broken(lambda n: x[n])), 1)


def checked(rows: DataFrame) -> DataFrame:
    """rows: _ord, row. _ord, codes."""
    return rows.select("_ord", *parts(F.col("row"))).select("_ord", broken(F.col).alias("codes"))


def violations(rows: DataFrame) -> DataFrame:
    """rows: _ord, row. One output row (_ord, code) per broken rule; valid rows give none. The list of codes is exploded
    where it is made: a filter on it would be pushed below the parts, and each rule would fetch its fields anew."""
    return rows.select("_ord", *parts(F.col("row"))).select("_ord", F.explode(broken(F.col)).alias("code"))


def report(rows: DataFrame, max_errors: int = 50) -> tuple[int, int, list[tuple[int, str]]]:
    """Rows, invalid rows, and the first max_errors (_ord, code): a bounded report."""
    n, bad = checked(rows).agg(F.count("*"), F.count_if(F.size("codes") > 0)).first()
    first = violations(rows).orderBy("_ord", "code").limit(max_errors)
    return n, bad, [tuple(r) for r in first.collect()]


def repeated_ids(events: DataFrame) -> DataFrame:
    """event_id, n, second (the _ord of its second row) of ids that come twice or more; null is an id.
    All that is kept of an id is its count and two smallest places."""
    small = events.groupBy("event_id", "_ord").agg(F.count("*").alias("n"))
    first = small.groupBy("event_id").agg(F.sum("n").alias("n"), F.min("_ord").alias("first")).where("n > 1")
    rest = small.select(F.col("event_id").alias("_id"), "_ord", F.col("n").alias("here")).join(first, F.col("_id").eqNullSafe(F.col("event_id")))
    later = rest.where("_ord > first OR here > 1")
    return later.groupBy("event_id", "n").agg(F.min("_ord").alias("second"))


def link_problems(events: DataFrame) -> DataFrame:
    """_ord, code of events whose links are wrong: events has event_id, event_type, policy, panelist_id, t,
    selection_id. Codes: several selections of a panelist and period, missing, dangling or mismatched
    selection_id."""
    selections = events.where("event_type = 'selection'")
    ways = selections.groupBy("panelist_id", "t").agg(F.count("*").alias("n"), F.min("_ord").alias("first")).where("n > 1")
    same = selections["panelist_id"].eqNullSafe(ways["panelist_id"]) & selections["t"].eqNullSafe(ways["t"])
    several = selections.join(ways, same).where(F.col("_ord") > F.col("first")).select("_ord", F.lit("several_selections").alias("code"))
    target = selections.groupBy(F.col("event_id").alias("selection_id")).agg(F.min_by(F.struct(F.col("panelist_id").alias("p"), F.col("t").alias("t")), "_ord").alias("to"))
    mine = events.where("event_type = 'evaluation' AND policy = 'self_selection'").join(target, "selection_id", "left")
    code = F.when(F.col("selection_id").isNull(), "missing_selection_id").when(F.col("to").isNull(), "dangling_selection_id").when(~(F.col("to.p").eqNullSafe(F.col("panelist_id")) & F.col("to.t").eqNullSafe(F.col("t"))), "mismatched_selection")
    return several.unionByName(mine.select("_ord", code.alias("code")).where("code IS NOT NULL"))


@dataclass(frozen=True)
class Field:
    """A declared field of a questionnaire."""

    name: str
    type: str  # int, float, categorical, bool, text, json
    required: bool = True
    choices: tuple = ()
    low: float | None = None
    high: float | None = None
    analysis: str | None = None  # continuous, binary, nominal, ordinal
    choice_order: tuple = ()

    def __post_init__(self) -> None:
        if self.type not in ("int", "float", "categorical", "bool", "text", "json"):
            raise ValueError(f"{self.name}: unknown type {self.type}")
        if self.type == "categorical" and not self.choices:
            raise ValueError(f"{self.name}: categorical fields need choices")
        if self.analysis == "binary" and self.type == "categorical" and len(self.choices) != 2:
            raise ValueError(f"{self.name}: binary fields need two choices")
        if self.choice_order and (self.analysis != "ordinal" or set(self.choice_order) != set(self.choices)):
            raise ValueError(f"{self.name}: choice_order is for ordinal fields and must name their choices")

    def error(self, payload: Column) -> Column:
        """A message, or null for a good value."""
        k, v = P.kind(payload, self.name), P.field(payload, self.name)
        here = P.present(payload, self.name)
        types = {"int": k.isin("BIGINT", "BOOLEAN"), "float": k.rlike(P.NUMBER), "categorical": k == "STRING", "bool": k == "BOOLEAN", "text": k == "STRING", "json": F.lit(True)}
        wrong = ~F.coalesce(types[self.type], F.lit(False))
        x = F.try_variant_get(v, "$", "double")
        out = F.when(~here, F.lit(f"{self.name}: required") if self.required else F.lit(None).cast("string")).when(wrong, f"{self.name}: not {self.type}")
        if self.type in ("int", "float"):
            outside = F.lit(False)
            outside = outside | (x < self.low) if self.low is not None else outside
            outside = outside | (x > self.high) if self.high is not None else outside
            out = out.when(outside, f"{self.name}: out of range")
        if self.choices:
            listed = x.isin(*[float(c) for c in self.choices]) if self.type in ("int", "float") else P.string(payload, self.name).isin(*self.choices)
            out = out.when(~listed, f"{self.name}: no choice")
        return out


def parse_fields(raw: list[dict]) -> list[Field]:
    """Fields from configuration dicts (name, type, required, choices, min, max, analysis_type, choice_order)."""
    return [Field(r["name"], r["type"], bool(r.get("required", True)), tuple(r.get("choices", ())), r.get("min"), r.get("max"), r.get("analysis_type"), tuple(r.get("choice_order", ()))) for r in raw]


def check_payload(payload: Column, outcomes: list[Field], traces: list[Field] = ()) -> tuple[Column, Column]:
    """Errors and warnings (arrays of messages) of a payload; an error means outcomes and traces count as
    null, a warning is a key that nobody declared."""
    errors = F.array_compact(F.array(*[f.error(payload) for f in (*outcomes, *traces)]))
    errors = F.when(P.is_object(payload), errors).otherwise(F.array(F.lit("no object")))
    declared = F.array(*[F.lit(f.name) for f in (*outcomes, *traces)])
    extra = F.coalesce(F.array_except(P.keys(payload), declared), F.array().cast("array<string>"))
    return errors, F.transform(F.array_sort(extra), lambda x: F.concat(F.lit("[warn] extra key "), x))
