"""Runs: from a configuration to canonical events - decide who sees what, select, evaluate, validate."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import payload as P
from . import exposure as X
from . import generate as G
from .selection import execute
from .validate import Field, parse_fields

POLICIES = ("random", "manual", "self_selection")


@dataclass(frozen=True)
class Policy:
    """How products are shown. random: per_period products, balanced, uniform or (weighted) by weight; manual:
    by a schedule; self_selection: a menu of menu_size products (None: all), of which cap may be taken."""

    name: str
    periods: int = 1
    per_period: int = 1
    assignment: str = "balanced"  # uniform, weighted
    menu_size: int | None = None
    cap: int | None = None
    allow_empty: bool = True
    seed: int = 0

    def __post_init__(self) -> None:
        if self.name not in POLICIES:
            raise ValueError(f"unknown policy {self.name!r}")
        if self.assignment not in ("balanced", "uniform", "weighted"):
            raise ValueError(f"unknown assignment {self.assignment!r}")


def decide(policy: Policy, panelists: DataFrame, products: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """panelist_id, t, slot, product_id for random and manual policies; panelist_id, t, choice_set for
    self-selection. A balanced draw of as many products as there are shows them all."""
    p = policy
    if p.name == "self_selection":
        return X.choice_sets(panelists, products, p.periods, p.menu_size, p.seed)
    if p.name == "manual":
        if schedule is None:
            raise ValueError("the manual policy needs a schedule")
        lists = X.manual(panelists, schedule, p.periods)
        return lists.select("panelist_id", "t", F.posexplode("product_ids").alias("slot", "product_id")).withColumn("slot", F.col("slot").cast("bigint"))
    if p.assignment == "balanced":
        return X.balanced(panelists, products, p.periods, p.per_period, p.seed)
    draw = X.uniform if p.assignment == "uniform" else X.weighted
    return draw(panelists, products, p.per_period, p.periods, p.seed)


def shown(rows: DataFrame, products: DataFrame, display: str = "product_display") -> DataFrame:
    """Decisions with the products that they name: the catalog's other columns, and product_display (without one, the
    id). A product that the catalog does not have fails."""
    known = products.withColumn("_known", F.lit(True))
    joined = rows.join(known, "product_id", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown product "), F.col("product_id"))).cast("string")
    text = F.coalesce(F.col(display), F.col("product_id")) if display in products.columns else F.col("product_id")
    return joined.withColumn("product_display", F.when(F.col("_known"), text).otherwise(unknown)).drop("_known")


def selection_events(rows: DataFrame, policy: Policy, namespace: str = "events") -> DataFrame:
    """Canonical selection events from panelist_id, t, choice_set, selected_product_ids; executed and
    dropped products are always recorded in traces."""
    executed, dropped = execute(F.col("selected_product_ids"), F.col("choice_set"), policy.cap, not policy.allow_empty)
    ids = identity.selection_id(namespace, F.lit(policy.name), F.col("panelist_id"), F.col("t"), F.col("choice_set"), F.col("selected_product_ids"))
    done = rows.withColumn("executed", executed).withColumn("dropped", dropped)
    return done.select(
        F.lit("0.1.0").alias("schema_version"), ids.alias("event_id"), F.lit("selection").alias("event_type"), F.lit(policy.name).alias("policy"), "panelist_id", "t", "choice_set", "selected_product_ids",
        F.to_variant_object(F.struct("executed", "dropped")).alias("traces"), "executed",
    )


def choose_first(menus: DataFrame, n: int) -> DataFrame:
    """A selection model without a backend: the first n of the menu in an order by panelist and period."""
    ranked = F.transform("choice_set", lambda x: F.struct(F.xxhash64("panelist_id", "t", x).alias("h"), x.alias("x")))
    return menus.withColumn("selected_product_ids", F.transform(F.slice(F.array_sort(ranked), 1, n), lambda r: r["x"]))


def build(config: dict, panelists: DataFrame, products: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """All canonical events of a run with the deterministic outcome model. config: policy (fields of Policy),
    questionnaire ({"outcomes": [fields]}), select (products a panelist asks for under self-selection)."""
    missing = [k for k in ("policy", "questionnaire") if k not in config]
    if missing:
        raise ValueError(f"missing sections {missing}")
    policy, fields = Policy(**config["policy"]), parse_fields(config["questionnaire"]["outcomes"])
    rows = decide(policy, panelists, products, schedule)
    if policy.name != "self_selection":
        return G.evaluation_events(G.deterministic(rows, fields), fields, policy.name).withColumn("selection_id", F.lit(None).cast("string"))
    chosen = selection_events(choose_first(rows, config.get("select", 1)), policy)
    taken = chosen.select("panelist_id", "t", F.col("event_id").alias("selection_id"), F.explode("executed").alias("product_id"))
    made = G.deterministic(taken, fields)
    evaluations = G.evaluation_events(made, fields, policy.name, "selection_id")
    return chosen.drop("executed").unionByName(evaluations, allowMissingColumns=True)


def nonce(kind: str, seed: int, batch: int) -> str:
    """Twelve hex digits that differ from batch to batch, for prompts."""
    return identity.json_digest({"kind": kind, "seed": seed, "batch_idx": batch})[:12]


def message_digest(messages: list[dict]) -> str:
    """A 64-bit hash of a chat's roles and trimmed contents."""
    clean = [{"role": str(m.get("role", "user")), "content": str(m.get("content", "")).strip()} for m in messages]
    return hashlib.blake2b(identity.canonical_json(clean).encode(), digest_size=8).hexdigest()


def row_sample(rows: DataFrame, n: int, seed: int = 0, key: str = "event_id") -> DataFrame:
    """n rows, the same in every run: those with the smallest seeded hash of their key (ties: the key)."""
    return rows.orderBy(identity.bits(seed, F.col(key)), key).limit(n)


def find_questionnaire(config: object) -> dict | None:
    """The first object, depth first, that has lists of outcomes or traces with named fields."""
    if isinstance(config, dict):
        lists = [config.get(k) for k in ("outcomes", "traces")]
        if any(isinstance(x, list) and x and all(isinstance(f, dict) and "name" in f and "type" in f for f in x) for x in lists):
            return config
    inner = config.values() if isinstance(config, dict) else config if isinstance(config, list) else ()
    return next((found for x in inner if (found := find_questionnaire(x)) is not None), None)


def declared_fields(metadata: dict) -> tuple[list[Field], list[Field]]:
    """Outcome and trace fields that a run's metadata declare anywhere; none: empty lists."""
    found = find_questionnaire(metadata) or {}
    return parse_fields(found.get("outcomes") or []), parse_fields(found.get("traces") or [])


def example_value(field: Field) -> object:
    """A value that the field accepts, for prompts."""
    if field.choices:
        return field.choices[0]
    low = field.low if field.low is not None else 0
    return {"int": int(low), "float": float(low), "bool": True, "text": "text", "json": {}}[field.type]


def observed_fields(events: DataFrame, payload: str) -> DataFrame:
    """name, n: the keys of a payload over all events, with the number of events that have each."""
    keys = events.where(P.is_object(F.col(payload))).select(F.explode(P.keys(F.col(payload))).alias("name"))
    return keys.groupBy("name").agg(F.count("*").alias("n"))


def unscheduled_products(schedule: DataFrame, products: DataFrame) -> DataFrame:
    """Product ids of a schedule that the catalog does not have."""
    return schedule.select("product_id").distinct().join(products.select("product_id"), "product_id", "left_anti")
