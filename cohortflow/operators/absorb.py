"""Least squares with fixed effects of any number of levels.

The outcome and the columns are freed of the effects by group means. For two effects the means of one solve the
equations that are left once the other's are put in; conjugate gradients take some seven rounds where alternating means
take ten, and far fewer on graphs where means travel slowly. Rows are dealt by one effect and counted to cells of equal
levels, which are kept dealt by either effect: a round sends sums by level and task, never the cells. By the theorem of
Frisch and Waugh the slopes, residuals and clustered covariances are those of the design with a dummy for each level,
which is never made. The levels' own estimates follow from the same means, as a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import component_count
from ..plans.storage import dropped, stored
from . import regression as R

#: Numbers in a table of means up to which it is broadcast (8 bytes each); larger ones are joined by shuffle.
BROADCAST_NUMBERS = 1 << 20


@dataclass
class Absorbed:
    result: R.Result
    effects: DataFrame  # effect, level, estimate: against the first level of each effect, as dummies would be
    levels: dict[str, int]
    components: int  # of the graph that joins levels which share a row
    rounds: int
    change: float  # of the last round, in standard deviations


def across(values: list[str], cells: DataFrame, one: str, other: str, means: DataFrame, parts: int) -> DataFrame:
    """Per level of `other` the sum over its rows of what `means` has for their levels of `one`, and the least label
    among those. cells: dealt by `one` to so many parts, which stay where they are; each sends a row for a level of `other`."""
    met = cells.join(means.repartition(parts, one).hint("shuffle_hash"), one)
    return met.groupBy(other).agg(*[F.sum(F.col("n") * F.col(v)).alias(v) for v in values], F.min("label").alias("label"))


def solve(values: list[str], by_p: DataFrame, by_q: DataFrame, sums_p: DataFrame, sums_q: DataFrame, keys: list[str], scale: np.ndarray, parts: int, tolerance: float, max_rounds: int) -> tuple[DataFrame, DataFrame, int, float, int]:
    """Means by level of both effects that leave no mean in any level, rounds, the largest mean that is left (in
    standard deviations), and the number of components of the graph.

    by_p, by_q: cells (levels, n), dealt by either effect. sums_p, sums_q: rows and sums by level. x are the means of the
    first effect, r the sums that they leave in its levels, d the direction of the next step; conjugate gradients
    with the levels' numbers of rows as preconditioner, so r / n is the step of alternating means. Labels (the
    smallest level within reach) go with the rounds.
    """
    p, q = keys
    names = {k: [f"{k}{i}" for i in range(len(values))] for k in "xrdw"}

    def there_and_back(first: DataFrame, less: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Means by level of q of what `first` has by level of p (or, less what it has, of the sums in `less`), and
        their sums by level of p."""
        at_q = across(values, by_p, p, q, first, parts).join(sums_q.select(q, F.col("n").alias("m"), *[F.col(v).alias(f"s_{v}") for v in values]).hint("shuffle_hash"), q)
        means = at_q.select(q, "label", *[((F.col(f"s_{v}") - F.col(v) if less is not None else F.col(v)) / F.col("m")).alias(v) for v in values])
        return means, across(values, by_q, q, p, means, parts)

    zero = sums_p.select(p, F.col(p).alias("label"), *[F.lit(0.0).alias(v) for v in values])
    back = there_and_back(zero, sums_q)[1].select(p, "label", *[F.col(v).alias(f"b_{v}") for v in values])
    state = sums_p.join(back.hint("shuffle_hash"), p)
    left = [(F.col(v) - F.col(f"b_{v}")) for v in values]
    state = stored(state.select(p, "n", "label", (F.col("label") == F.col(p)).alias("same"), *[F.lit(0.0).alias(x) for x in names["x"]], *[z.alias(r) for z, r in zip(left, names["r"], strict=True)], *[(z / F.col("n")).alias(d) for z, d in zip(left, names["d"], strict=True)]))
    rounds = 1

    def remaining(table: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        row = table.agg(F.count_if(~F.col("same")), *[y for r in names["r"] for y in (F.sum(F.col(r) * F.col(r) / F.col("n")), F.max(F.abs(F.col(r)) / F.col("n")))]).first()
        return np.array(row[1::2], float), np.array(row[2::2], float) / scale, row[0]

    size, change, moved = remaining(state)
    while change.max() > tolerance and rounds < max_rounds:
        step = there_and_back(state.select(p, "label", *[F.col(d).alias(v) for d, v in zip(names["d"], values, strict=True)]))[1]
        step = step.select(p, F.col("label").alias("next"), *[F.col(v).alias(w) for v, w in zip(values, names["w"], strict=True)])
        tried = stored(state.join(step.hint("shuffle_hash"), p).select(p, "n", "label", "next", *names["x"], *names["r"], *names["d"], *[(F.col("n") * F.col(d) - F.col(w)).alias(w) for d, w in zip(names["d"], names["w"], strict=True)]))
        along = np.array(tried.agg(*[F.sum(F.col(d) * F.col(w)) for d, w in zip(names["d"], names["w"], strict=True)]).first(), float)
        go = np.where((along > 0) & (change > tolerance), size / np.where(along > 0, along, 1), 0.0).tolist()  # a column that is done stays
        x = [(F.col(x) + g * F.col(d)).alias(x) for g, x, d in zip(go, names["x"], names["d"], strict=True)]
        r = [(F.col(r) - g * F.col(w)).alias(r) for g, r, w in zip(go, names["r"], names["w"], strict=True)]
        new = tried.select(p, "n", F.col("next").alias("label"), (F.col("label") == F.col("next")).alias("same"), *x, *r, *names["d"])
        before = size
        size, change, moved = remaining(new)
        turn = np.where(before > 0, size / np.where(before > 0, before, 1), 0).tolist()
        after = new.select(p, "n", "label", "same", *names["x"], *names["r"], *[(F.col(r) / F.col("n") + t * F.col(d)).alias(d) for r, d, t in zip(names["r"], names["d"], turn, strict=True)])
        old, state = (state, tried), stored(after)
        for table in old:
            dropped(table)
        rounds += 1
    first = state.select(p, "label", *[F.col(x).alias(v) for x, v in zip(names["x"], values, strict=True)])
    second = stored(there_and_back(first, sums_q)[0])
    if moved:  # labels still travel: those of levels that meet are joined
        met = by_p.select(p, q).join(first.select(p, F.col("label").alias("a")).repartition(parts, p).hint("shuffle_hash"), p).join(second.select(q, F.col("label").alias("b")), q)
        components = component_count(met.select("a", "b").distinct())
    else:
        components = first.select("label").distinct().count()
    return first.drop("label"), second.drop("label"), rounds, float(change.max()), components


def nested(rows: DataFrame, effect: str, cluster: str) -> bool:
    """Whether every level of the effect lies in one cluster."""
    spread = rows.groupBy(effect).agg(F.min(cluster).alias("a"), F.max(cluster).alias("b"))
    return spread.where("a <> b").isEmpty()


def fit(
    rows: DataFrame, target: str, columns: Sequence[str], effects: Sequence[str], covariance: str = "nonrobust", panelist: str | None = None, product: str | None = None, names: Sequence[str] = (),
    count_nested: bool = True, tolerance: float = 1e-9, max_rounds: int = 2000,
) -> Absorbed:
    """Least squares of the target on numeric columns and one or two fixed effects.

    Rows with a null in the target, a column or an effect go. Columns that the effects explain (constant within the
    levels, or sums of parts that are) are dropped and listed as absorbed; there is no intercept but the effects'. Degrees
    of freedom count every independent level (levels less components of the graph of levels for two effects). With
    count_nested=False, levels of an effect that is nested in the clusters are left out of the clusters' small-sample
    factor, but for one. r2 is that of the whole model, r2_within that of the columns. An empty table, or a
    target that the effects explain wholly, is refused.
    """
    if len(effects) not in (1, 2):
        raise ValueError("one or two fixed effects")
    if covariance not in R.COVARIANCES:
        raise ValueError(f"unknown {covariance}")
    keys, values = [f"e{i}" for i in range(len(effects))], [f"v{i}" for i in range(len(columns) + 1)]
    clustered = covariance.startswith("cluster")
    ids = [F.col(f"`{c}`").cast("string").alias(n) for c, n in ((panelist, "p"), (product, "q")) if c and clustered]
    numbers = [F.col(f"`{c}`").cast("double").alias(v) for c, v in zip((target, *columns), values, strict=True)]
    levels_of = [F.col(f"`{c}`").cast("string").alias(k) for c, k in zip(effects, keys, strict=True)]
    base = stored(rows.select(*numbers, *levels_of, *ids).na.drop(subset=[*values, *keys]))
    row = base.agg(F.count("*"), *[x for v in values for x in (F.avg(v), F.var_samp(v))], *[F.approx_count_distinct(k) for k in keys]).first()
    n, variance = row[0], np.array([row[2 + 2 * i] or 0.0 for i in range(len(values))])
    if not n or not variance[0] > 0:
        raise ValueError("the target has fewer than two values")
    scale = np.sqrt(np.where(variance > 0, variance, 1))
    kept: list[DataFrame] = []
    try:
        if len(keys) == 1:
            level_sums = base.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
            tables, rounds, change, parts = [stored(level_sums.select(*keys, *[(F.col(v) / F.col("n")).alias(v) for v in values]))], 1, 0.0, None
        else:
            p, q = sorted(keys, key=lambda k: -row[1 + 2 * len(values) + keys.index(k)])  # rows are dealt by the effect of more levels
            deal = base.sparkSession.sparkContext.defaultParallelism
            base = base.repartition(deal, p).persist()
            by_p = base.groupBy(p, q).agg(F.count("*").alias("n")).persist()
            by_q = by_p.repartition(deal, q).persist()
            kept = [base, by_p, by_q]
            sums_p, sums_q = (stored(base.groupBy(k).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])) for k in (p, q))
            *found, rounds, change, parts = solve(values, by_p, by_q, sums_p, sums_q, [p, q], scale, deal, tolerance, max_rounds)
            tables = [dict(zip((p, q), found, strict=True))[k] for k in keys]
            by_p.unpersist(), by_q.unpersist()
        levels = [t.count() for t in tables]
        parts = levels[0] if parts is None else parts
        rank = levels[0] if len(keys) == 1 else sum(levels) - parts
        left = base
        for k, table, count in sorted(zip(keys, tables, levels, strict=True), key=lambda x: -x[2]):
            means = table.withColumnsRenamed({v: f"m_{v}" for v in values})
            means = F.broadcast(means) if count * len(values) <= BROADCAST_NUMBERS else means.repartition(deal, k).hint("shuffle_hash") if len(keys) == 2 and k == p else means
            left = left.join(means, k).select(*[(F.col(v) - F.col(f"m_{v}")).alias(v) for v in values], *keys, *[c for c in "pq" if c in base.columns])
        counted = rank
        if not count_nested and clustered:
            clusters = {"cluster_panelist": "p", "cluster_product": "q"}.get(covariance)
            for k, count in zip(keys, levels, strict=True):
                if clusters and nested(base, k, clusters):
                    counted = max(1, counted - count + 1)
        left = stored(left.drop(*keys))
    finally:
        for table in kept:
            table.unpersist()
    sums = left.agg(*[F.sum(F.col(v) * F.col(v)) for v in values]).first()
    within = np.array([float(x) for x in sums]) / max(n - 1, 1)
    bare = within <= (100 * tolerance) ** 2 * np.maximum(variance, 1e-300)
    if bare[0]:
        raise ValueError("the effects explain the target wholly")
    used = [i for i in range(1, len(values)) if not bare[i]]
    shown = dict(zip(values[1:], names or columns, strict=True))
    design = R.Design(left, "v0", tuple(values[i] for i in used), "p" if panelist and clustered else None, "q" if product and clustered else None, tuple(shown[values[i]] for i in used), counted)
    if not used:
        raise ValueError("the effects explain all columns")
    result = R.fit(design, "ols", covariance)
    if counted != rank and covariance == "nonrobust":
        raise AssertionError("nested levels only matter to clusters")
    fits = dict(result.fit, r2_within=result.fit["r2"], r2=1 - result.fit["ssr"] / (variance[0] * (n - 1)))
    fits["adj_r2"] = 1 - (1 - fits["r2"]) * (n - 1) / (n - rank - len(result.terms))
    result = replace(result, fit=fits, dropped=[(shown[values[i]], "absorbed") for i in range(1, len(values)) if bare[i]] + result.dropped)
    slope = dict(zip(result.terms, result.estimate.tolist(), strict=True))
    estimates = [t.select(F.lit(c).alias("effect"), F.col(k).alias("level"), (F.col("v0") - sum((F.lit(slope[shown[v]]) * F.col(v) for v in values[1:] if shown[v] in slope), F.lit(0.0))).alias("estimate")) for c, k, t in zip(effects, keys, tables, strict=True)]
    against = []
    for t in estimates:
        first = t.orderBy("level").limit(1).select(F.col("estimate").alias("_first"))
        against.append(t.join(F.broadcast(first)).select("effect", "level", (F.col("estimate") - F.col("_first")).alias("estimate")))
    table = against[0] if len(against) == 1 else against[0].unionByName(against[1])
    return Absorbed(result, table, dict(zip(effects, levels, strict=True)), parts, rounds, change)
