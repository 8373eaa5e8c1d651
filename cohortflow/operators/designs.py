"""Regression designs over flattened evaluations, and what a declared outcome field allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import regression as R
from .validate import Field

#: Designs, with their fixed effects and the sides whose features they take.
DESIGNS = {
    "panelist_features": ((), ("panelist.",)),
    "product_features": ((), ("product.",)),
    "panelist_plus_product_features": ((), ("panelist.", "product.")),
    "panelist_id_fe": (("panelist_id",), ()),
    "product_id_fe": (("product_id",), ()),
    "two_way_fe": (("panelist_id", "product_id"), ()),
    "features_plus_two_way_fe": (("panelist_id", "product_id"), ("panelist.", "product.")),
}


def build(rows: DataFrame, design: str, outcome: str) -> R.Design:
    """A design over rows with panelist_id, product_id, the outcome and columns `panelist.x`, `product.x`.

    Numbers and flags come first, as they are, in order of name: rank reduction keeps the earlier columns, so a
    feature that is constant within an id stays and a dummy of that id goes. Then follow the one-hot columns,
    without their first level: fixed effects, then texts in order of name.
    """
    if design not in DESIGNS:
        raise ValueError(f"unknown design {design!r}: {sorted(DESIGNS)}")
    if outcome not in rows.columns:
        raise ValueError(f"no outcome {outcome!r}")
    effects, sides = DESIGNS[design]
    features = [c for side in sides for c in sorted(rows.columns) if c.startswith(side)]
    missing = [c for c in effects if c not in rows.columns]
    if missing or not (effects or features):
        raise ValueError(f"{design}: missing columns {missing}" if missing else f"{design}: no feature columns")
    kinds, plain = dict(rows.dtypes), {c: f"x{i}" for i, c in enumerate(rows.columns)}
    out = rows.select(*[F.col(f"`{c}`").alias(plain[c]) for c in rows.columns])
    columns, names = [], []
    coded = [*effects, *[c for c in features if kinds[c] == "string"]]
    for c in (*[c for c in features if c not in coded], *coded):
        if c in coded:
            out, made = R.one_hot(out, plain[c])
            columns += made
            names += [c + m[len(plain[c]) :] for m in made]
        else:
            columns.append(plain[c])
            names.append(c)
    again = [F.col(f"`{m}`").alias(f"d{i}") for i, m in enumerate(columns)]
    ids = {k: F.col(plain[k]).cast("string").alias(k) for k in ("panelist_id", "product_id") if k in plain}
    frame = out.select(F.col(plain[outcome]).alias("y"), *again, *ids.values())
    return R.Design(frame, "y", tuple(f"d{i}" for i in range(len(columns))), *[k if k in ids else None for k in ("panelist_id", "product_id")], names=tuple(names))


#: Families that suit each type of analysis.
SUITS = {"continuous": ("ols",), "binary": ("logit", "probit"), "nominal": ("multinomial_logit",), "ordinal": ("ordered_logit", "ordered_probit")}


def analysis_type(field: Field) -> str:
    """The declared type of analysis, else what the field's type says."""
    return field.analysis or {"int": "continuous", "float": "continuous", "bool": "binary", "categorical": "binary" if len(field.choices) == 2 else "nominal"}.get(field.type, "none")


def resolve(fields: list[Field], outcome: str, family: str) -> tuple[Field, list[str]]:
    """The declared field of a regression's outcome and the order of its categories (empty for numbers); a
    field that is not declared, or does not suit the family, is refused."""
    field = next((f for f in fields if f.name == outcome), None)
    if field is None:
        raise ValueError(f"outcome {outcome!r} is not declared")
    kind = analysis_type(field)
    if family not in SUITS.get(kind, ()):
        raise ValueError(f"{outcome} is {kind}: {family} does not suit it")
    order = field.choice_order or field.choices
    return field, [str(c) for c in order] if field.type == "categorical" else []


def target(rows: DataFrame, field: Field, order: list[str]) -> DataFrame:
    """Rows with the outcome as a number: codes of its categories in order, else the number itself."""
    return R.coded(rows, field.name, order) if order else rows.withColumn(field.name, F.col(field.name).cast("double"))


def selected(coefficients: DataFrame, intercept: bool = True, thresholds: bool = True, fixed_effects: bool = True, most_p: float | None = None) -> DataFrame:
    """The coefficient rows asked for: without the intercept, thresholds (a/b), fixed effects, or p above most_p."""
    term = F.col("term")
    name = F.regexp_replace(term, "^[^:]*:", "")
    keep = F.lit(True)
    keep = keep if intercept else keep & (name != "const")
    keep = keep if thresholds else keep & ~term.contains("/")
    keep = keep if fixed_effects else keep & ~name.startswith("panelist_id_") & ~name.startswith("product_id_")
    return coefficients.where(keep if most_p is None else keep & (F.col("p_value") <= most_p))


def top_attributes(coefficients: DataFrame, k: int = 10) -> DataFrame:
    """The k coefficients of largest size, without intercept, thresholds and fixed effects; ties by name."""
    rows = selected(coefficients, False, False, False).where(~F.isnan("estimate"))
    place = F.row_number().over(W.orderBy(F.abs("estimate").desc(), "term"))  # a row per column of the design
    return rows.withColumn("rank", place).where(F.col("rank") <= k)
