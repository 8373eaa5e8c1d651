"""Regressions on panel frames: OLS, logit, probit, multinomial and ordered models, robust covariance.

The rows stay in Spark. Rank and least squares come from a QR factorization in a tree of tasks (triangular
factors alone travel), so that the condition of the design is never squared. Other passes sum small arrays
(moments, gradient, Hessian, per-cluster scores) in Arrow batches; the driver solves systems of the number of
columns. Likelihoods are maximised by Newton steps, one pass each. Fixed effects of any number of levels are
absorbed first (absorb.py).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVARIANCES = ("nonrobust", "HC1", "cluster_panelist", "cluster_product", "cluster_two_way")
FAMILIES = {"ols": ("continuous",), "logit": ("binary",), "probit": ("binary",), "multinomial_logit": ("nominal",), "ordered_logit": ("ordinal",), "ordered_probit": ("ordinal",)}


@dataclass
class Result:
    family: str
    terms: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    n: int
    df: float | None  # of the t distribution; None: normal
    fit: dict[str, float]
    dropped: list[tuple[str, str]] = field(default_factory=list)

    def table(self) -> list[tuple[str, float, float, float, float, float, float]]:
        """term, estimate, standard error, statistic, p-value, 95 % interval."""
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        rows = []
        q = normal_quantile(0.975) if self.df is None else t_quantile(0.975, self.df)
        for name, b, s in zip(self.terms, self.estimate.tolist(), se.tolist(), strict=True):
            z = b / s if s > 0 else math.nan
            p = two_sided(z, self.df) if s > 0 else math.nan
            rows.append((name, b, s, z, p, b - q * s, b + q * s))
        return rows

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.table(), "term string, estimate double, std_error double, statistic double, p_value double, low double, high double")


def two_sided(z: float, df: float | None) -> float:
    """The share of the normal or t distribution beyond -|z| and |z|, from its tail, so that no digit is lost."""
    if df is None:
        return math.erfc(abs(z) / math.sqrt(2))
    return beta_fraction(df / 2, 0.5, df / (df + z * z))


def normal_cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x, float) / math.sqrt(2)))


def normal_pdf(x):
    return np.exp(-np.asarray(x, float) ** 2 / 2) / math.sqrt(2 * math.pi)


def bisect(f: Callable[[float], float], p: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < p else (lo, mid)
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    return bisect(lambda x: float(normal_cdf(x)), p)


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, out, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(2000):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (d_ if abs(d_ := 1 + k * d) > tiny else tiny)
        c = c_ if abs(c_ := 1 + k / c) > tiny else tiny
        out *= c * d
        if abs(c * d - 1) < 1e-14 and i:
            break
    return front * (out - 1)


def t_cdf(x: float, df: float) -> float:
    tail = beta_fraction(df / 2, 0.5, df / (df + x * x)) / 2
    return 1 - tail if x > 0 else tail


def t_quantile(p: float, df: float) -> float:
    return bisect(lambda x: t_cdf(x, df), p)


@dataclass(frozen=True)
class Design:
    """A frame with y, the numeric columns of x (in order; the intercept is added) and cluster ids."""

    rows: DataFrame
    target: str
    columns: tuple[str, ...]
    panelist: str | None = None
    product: str | None = None
    names: tuple[str, ...] = ()  # what results call the columns; none: as they are
    #: Degrees of freedom of effects that y and the columns are free of already; then there is no intercept.
    absorbed: int = 0


def one_hot(rows: DataFrame, column: str, max_levels: int = 2000) -> tuple[DataFrame, list[str]]:
    """Dummies of all levels but the first in order. They make the design dense, so that more levels are refused: absorb.fit() takes any number."""
    levels = [r[0] for r in rows.select(F.col(column).cast("string").alias("c")).where("c IS NOT NULL").distinct().orderBy("c").limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{column}: more than {max_levels} levels")
    names = [f"{column}_{v}" for v in levels[1:]]
    return rows.select("*", *[(F.col(column).cast("string") == v).cast("double").alias(n) for v, n in zip(levels[1:], names, strict=True)]), names


def coded(rows: DataFrame, target: str, order: list[str]) -> DataFrame:
    """The target's category as its place in `order`; a category that is not declared fails."""
    label = F.col(target).cast("string")
    places = F.array_position(F.array(*[F.lit(c) for c in order]), label)
    bad = F.raise_error(F.concat(F.lit(f"{target}: undeclared category "), label)).cast("double")
    return rows.withColumn(target, F.when(label.isNull(), None).when(places > 0, (places - 1).cast("double")).otherwise(bad))


def complete(design: Design, clustered: bool = True) -> DataFrame:
    """Rows without missing values, as y, x (array), p, q; ids are carried for clusters only."""
    x = F.array(*[F.col(c).cast("double") for c in design.columns])
    ids = [F.col(c).cast("string").alias(n) if c and clustered else F.lit(None).cast("string").alias(n) for c, n in ((design.panelist, "p"), (design.product, "q"))]
    rows = design.rows.select(F.col(design.target).cast("double").alias("y"), x.alias("x"), *ids)
    return rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column(0).to_numpy(zero_copy_only=False)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return y, flat.reshape(len(y), -1) if len(y) else flat.reshape(0, 1)


def summed(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of f(y, x), a flat array of `size` numbers, over all rows: one vector a task, added up in
    a tree of Spark aggregations by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(*matrices(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    parts = rows.select("y", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # size rows
    out = np.zeros(size)
    for r in parts:
        out[r.i] = r.v
    return out


def with_const(x: np.ndarray, keep: list[int], shift: np.ndarray, scale: np.ndarray, const: bool) -> np.ndarray:
    z = (x[:, keep] - shift) / scale
    return np.column_stack([np.ones(len(z)), z]) if const else z


def extremes(rows: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(m, np.inf), np.full(m, -np.inf)
        for batch in batches:
            if batch.num_rows and m:
                x = matrices(batch)[1]
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    low, high = np.full(m, np.inf), np.full(m, -np.inf)
    for r in rows.select("y", "x").mapInArrow(run, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # m rows
        low[r.i], high[r.i] = r.low, r.high
    return low, high


def checksum(x: np.ndarray) -> np.ndarray:
    """A randomly weighted sum of each column."""
    return (x * np.random.default_rng(len(x)).random(len(x))[:, None]).sum(0)


def duplicates(rows: DataFrame, columns: list[int], sums: np.ndarray) -> list[int]:
    """Those of `columns` that equal an earlier one in every row. Equal columns have equal checksum()s (sums), to the
    last bit; only such are compared, each with the first."""
    groups: dict[float, list[int]] = {}
    for j in columns:
        groups.setdefault(float(sums[j]), []).append(j)
    out: list[int] = []
    alike = [g for g in groups.values() if len(g) > 1]
    while alike:
        left, right = np.array([(g[0], j) for g in alike for j in g[1:]]).T
        differ = summed(rows, lambda y, x: (x[:, left] != x[:, right]).sum(0).astype(float), len(left))  # noqa: B023
        others = {j for j, n in zip(right.tolist(), differ.tolist(), strict=True) if n}
        out += [j for j in right.tolist() if j not in others]
        alike = [g for g in ([j for j in g[1:] if j in others] for g in alike) if len(g) > 1]
    return sorted(out)


def triangle(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """R of the QR factorization of f(y, x) over all rows: each task factors its batches below what it has,
    tasks' factors are factored together in some tasks, and theirs on the driver. A factor has width * width numbers."""
    fan = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def below(r: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate([r, a]), mode="r")

    def factor(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = below(r, read(batch))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def stacked(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.frombuffer(x).reshape(-1, width) for x in batch.column(0).to_pylist()])

    tasks = rows.select("y", "x").mapInArrow(lambda it: factor(it, lambda b: f(*matrices(b))), "r binary")
    few = tasks.repartition(fan).mapInArrow(lambda it: factor(it, stacked), "r binary").collect()  # `fan` rows
    r = np.zeros((0, width))
    for row in few:
        r = below(r, np.frombuffer(row.r).reshape(-1, width))
    return np.concatenate([r, np.zeros((max(0, width - len(r)), width))])


def independent(r: np.ndarray, n: int) -> list[int]:
    """The columns of a triangle that are no combinations of those before them: what is left of them exceeds rounding."""
    size = np.linalg.norm(r, axis=0)
    least = min(np.finfo(float).eps * max(n, len(size)), 1e-10)
    return [j for j in range(len(size)) if abs(r[j, j]) > least * size[j]]


def scores_sum(rows: DataFrame, score: Callable, k: int, key: str | None) -> tuple[np.ndarray, int]:
    """Sum over clusters of s sᵀ, s the cluster's summed scores, and the number of clusters. key: p, q, both,
    or None (every row a cluster). Clusters are added up by Spark."""
    if key is None:
        return summed(rows, lambda y, x: ((s := score(y, x)).T @ s).reshape(-1), k * k).reshape(k, k), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:  # one row a cluster and batch
                group = batch.column(2).dictionary_encode()
                code = group.indices.fill_null(len(group.dictionary)).to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                head = np.flatnonzero(np.diff(code[order], prepend=-1))
                s = np.add.reduceat(score(*matrices(batch))[order], head)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(order[head])), pa.FixedSizeListArray.from_arrays(pa.array(s.reshape(-1)), k).cast(pa.list_(pa.float64()))], ["g", "s"])

    g = F.concat_ws("\x1f", "p", "q") if key == "both" else F.col(key)
    each = rows.select("y", "x", g.alias("g")).mapInArrow(run, "g string, s array<double>")
    clusters = each.groupBy("g").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            s = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += s.T @ s
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + 1)), pa.array(np.append(total.reshape(-1), n))], ["i", "v"])

    sums = clusters.drop("g").mapInArrow(outer, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * k + 1)
    for r in sums:
        out[r.i] = r.v
    return out[:-1].reshape(k, k), int(out[-1])


def sandwich(rows: DataFrame, bread: np.ndarray, score: Callable, n: int, kind: str, discrete: bool, absorbed: int = 0) -> tuple[np.ndarray, float | None]:
    """Covariance and degrees of freedom (None: normal)."""
    k, parameters = len(bread), len(bread) + absorbed
    if kind == "HC1":
        meat, _ = scores_sum(rows, score, k, None)
        return bread @ meat @ bread * n / (n - parameters), None if discrete else n - parameters
    out, least = np.zeros((k, k)), math.inf
    parts = {"cluster_panelist": [("p", 1)], "cluster_product": [("q", 1)], "cluster_two_way": [("p", 1), ("q", 1), ("both", -1)]}[kind]
    for key, sign in parts:
        meat, g = scores_sum(rows, score, k, key)
        out += sign * (g / (g - 1)) * ((n - 1) / (n - parameters)) * (bread @ meat @ bread)
        least = min(least, g) if sign > 0 else least
    return out, None if discrete else least - 1


def fit(design: Design, family: str = "ols", covariance: str = "nonrobust", standardize: bool = False, classes: int = 2, max_steps: int = 200) -> Result:
    """Fit a family. Columns that are constant, equal to an earlier one, or combinations of earlier ones are
    dropped (and listed as constant, duplicate, rank_deficient); a target of one value or none is refused. Discrete families with cluster_two_way use
    cluster_panelist. Binary targets are 0 and 1; nominal and ordinal ones are codes 0 .. classes - 1."""
    if family not in FAMILIES or covariance not in COVARIANCES:
        raise ValueError(f"unknown {family} or {covariance}")
    discrete = family != "ols"
    if discrete and covariance == "cluster_two_way":
        covariance = "cluster_panelist"
    rows = complete(design, covariance.startswith("cluster")).persist()
    try:
        return _fit(rows, design, family, covariance, standardize, classes, max_steps, discrete)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, design: Design, family: str, covariance: str, standardize: bool, classes: int, max_steps: int, discrete: bool) -> Result:
    names, m = list(design.names or design.columns), len(design.columns)
    n, low, high = rows.agg(F.count("*"), F.min("y"), F.max("y")).first()
    if not n or low == high:
        raise ValueError("the target has fewer than two values")
    ordered = family.startswith("ordered")
    const = not ordered and not design.absorbed
    least, greatest = extremes(rows, m)
    total = summed(rows, lambda y, x: np.append(x.sum(0), y.sum()), m + 1)
    mean = np.zeros(m) if design.absorbed else total[:m] / n
    second = summed(rows, lambda y, x: np.concatenate([((x - mean) ** 2).sum(0), checksum(x)]), 2 * m)
    deviation = np.sqrt(second[:m] / max(n - 1, 1))
    varied = [j for j in range(m) if least[j] < greatest[j] and deviation[j] > 0]
    again = duplicates(rows, varied, second[m:])
    fine = [j for j in varied if j not in again]
    level = float(total[m] / n) if const else 0.0
    # centred, scaled columns and the target, free of the intercept
    whole = triangle(rows, lambda y, x: np.column_stack([(x[:, fine] - mean[fine]) / deviation[fine], y - level]), len(fine) + 1)
    kept = independent(whole[: len(fine), : len(fine)], n)
    keep = [fine[j] for j in kept]
    dropped = [(names[j], "constant") for j in range(m) if j not in varied] + [(names[j], "duplicate") for j in again] + [(names[j], "rank_deficient") for j in fine if j not in keep]
    terms = (["const"] if const else []) + [names[j] for j in keep]
    k = len(terms)
    if family == "ols":
        r = np.linalg.qr(whole[:, [*kept, len(fine)]], mode="r")
        return _ols(rows, r, keep, mean[keep], deviation[keep], level, const, standardize, terms, n, covariance, dropped, design.absorbed)
    shift = mean[keep] if standardize else np.zeros(len(keep))
    scale = deviation[keep] if standardize else np.ones(len(keep))

    def z(x: np.ndarray) -> np.ndarray:
        return with_const(x, keep, shift, scale, const)

    if family in ("logit", "probit"):
        model, size, names_ = _binary(family), k, terms
    elif family == "multinomial_logit":
        model, size, names_ = _multinomial(classes, k), (classes - 1) * k, [f"{c}:{t}" for c in range(1, classes) for t in terms]
    else:
        model, size, names_ = _ordered(family, classes, k), k + classes - 1, terms + [f"{c}/{c + 1}" for c in range(classes - 1)]
    theta = model.start(size)
    value, grad, hess = _pass(rows, z, model, theta, size)
    for _ in range(max_steps):
        step = np.linalg.solve(hess, grad)
        rate, steepest = 1.0, np.abs(grad).max()
        for _ in range(30):  # halve steps that do not help
            there = _pass(rows, z, model, theta + rate * step, size)  # also the next step's start
            if there[0] >= value - 1e-12:
                break
            rate /= 2
        else:  # no step along this direction helps: as far as numbers go
            break
        theta = theta + rate * step
        value, grad, hess = there
        if steepest < 1e-8 * max(1.0, n) and np.abs(step).max() < 1e-8:
            break
    bread = np.linalg.inv(hess)
    cov, df = (bread, None) if covariance == "nonrobust" else sandwich(rows, bread, lambda y, x: model.parts(y, z(x), theta)[1], n, covariance, True)
    out = {"n": n, "llf": value, "aic": -2 * value + 2 * size, "bic": -2 * value + size * math.log(n), "gradient": float(np.abs(grad).max()), "converged": float(np.abs(grad).max() < 1e-6 * max(1.0, n))}
    if not ordered:
        counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # one row a class
        null = sum(c * math.log(c / n) for c in counts.values())
        out["pseudo_r2"] = 1 - value / null
    if family in ("logit", "probit"):
        out["accuracy"] = float(summed(rows, lambda y, x: np.array([((model.mean(z(x) @ theta) >= 0.5) == (y == 1)).sum()], float), 1)[0] / n)
    if ordered:
        theta, cov = model.thresholds(theta, cov)
    return Result(family, names_, theta, cov, n, df, out, dropped)


def _pass(rows: DataFrame, z: Callable, model, theta: np.ndarray, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    def f(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        ll, score, hess = model.parts(y, z(x), theta)
        return np.concatenate([[ll], score.sum(0), hess.reshape(-1)])

    v = summed(rows, f, 1 + size + size * size)
    return v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)


def _ols(
    rows: DataFrame, r: np.ndarray, keep: list[int], mean: np.ndarray, scale: np.ndarray, level: float, const: bool, standardize: bool, terms: list[str], n: int, covariance: str, dropped: list, absorbed: int
) -> Result:
    """From the triangle r of the centred, scaled columns and the target. Everything is worked out for those columns
    (theta, bread), and turned into the columns as they are at the end."""
    m = len(keep)
    inverse = np.linalg.inv(r[:m, :m]) if m else np.zeros((0, 0))
    theta, bread = inverse @ r[:m, m], inverse @ inverse.T
    if const:
        theta, bread = np.append(level, theta), np.block([[np.full((1, 1), 1 / n), np.zeros((1, m))], [np.zeros((m, 1)), bread]])
    k = len(theta) + absorbed

    def z(x: np.ndarray) -> np.ndarray:
        return with_const(x, keep, mean, scale, const)

    def residual(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return y - z(x) @ theta

    sums = summed(rows, lambda y, x: np.array([(e := residual(y, x)) @ e, np.abs(e).sum(), ((y - level) ** 2).sum()]), 3)
    ssr, tss = sums[0], sums[2]
    if covariance == "nonrobust":
        cov, df = bread * ssr / (n - k), float(n - k)
    else:
        cov, df = sandwich(rows, bread, lambda y, x: z(x) * residual(y, x)[:, None], n, covariance, False, absorbed)
    if not standardize:
        turn = np.diag(1 / scale)
        if const:
            turn = np.block([[np.ones((1, 1)), -(mean / scale)[None]], [np.zeros((m, 1)), turn]])
        theta, cov = turn @ theta, turn @ cov @ turn.T
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1)
    out = {"n": n, "r2": 1 - ssr / tss, "adj_r2": 1 - ssr / (n - k) / (tss / (n - 1)), "llf": llf, "aic": -2 * llf + 2 * k, "bic": -2 * llf + k * math.log(n), "rmse": math.sqrt(ssr / n), "mae": sums[1] / n, "ssr": ssr}
    return Result("ols", terms, theta, cov, n, df, out, dropped)


class _binary:
    """Logit and probit. parts(): log-likelihood, scores by row, negative Hessian."""

    def __init__(self, family: str):
        self.logit = family == "logit"

    def start(self, size: int) -> np.ndarray:
        return np.zeros(size)

    def mean(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500))) if self.logit else normal_cdf(eta)

    def parts(self, y: np.ndarray, x: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = x @ theta
        if self.logit:
            p = self.mean(eta)
            ll = float(-np.logaddexp(0, np.where(y == 1, -eta, eta)).sum())
            return ll, x * (y - p)[:, None], (x * (p * (1 - p))[:, None]).T @ x
        q = 2 * y - 1
        p = np.maximum(normal_cdf(q * eta), 1e-300)
        mills = q * normal_pdf(eta) / p
        return float(np.log(p).sum()), x * mills[:, None], (x * (mills * (mills + eta))[:, None]).T @ x


class _multinomial:
    """Multinomial logit; class 0 is the base."""

    def __init__(self, classes: int, k: int):
        self.classes, self.k = classes, k

    def start(self, size: int) -> np.ndarray:
        return np.zeros(size)

    def parts(self, y: np.ndarray, x: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = np.column_stack([np.zeros(len(x)), x @ theta.reshape(self.classes - 1, self.k).T])
        top = eta.max(1, keepdims=True)
        p = np.exp(eta - top)
        total = p.sum(1, keepdims=True)
        p /= total
        code = y.astype(int)
        ll = float((eta[np.arange(len(y)), code] - top[:, 0] - np.log(total[:, 0])).sum())
        hit = (code[:, None] == np.arange(1, self.classes)).astype(float)
        diff, p = hit - p[:, 1:], p[:, 1:]
        score = (diff[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        j = self.classes - 1
        hess = np.zeros((j * self.k, j * self.k))
        for a in range(j):
            for b in range(j):
                w = p[:, a] * ((a == b) - p[:, b])
                hess[a * self.k : (a + 1) * self.k, b * self.k : (b + 1) * self.k] = (x * w[:, None]).T @ x
        return ll, score, hess


class _ordered:
    """Ordered models; the first threshold, then logs of the steps between thresholds. The negative
    Hessian is the sum of outer products of scores (it stays positive definite) until thresholds()."""

    def __init__(self, family: str, classes: int, k: int):
        self.logit, self.classes, self.k = family == "ordered_logit", classes, k

    def start(self, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[self.k] = -(self.classes - 2) / 2
        return out

    def cdf(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -500, 500))) if self.logit else normal_cdf(x)

    def pdf(self, x: np.ndarray) -> np.ndarray:
        if not self.logit:
            return normal_pdf(x)
        p = self.cdf(x)
        return p * (1 - p)

    def cuts(self, theta: np.ndarray) -> np.ndarray:
        return theta[self.k] + np.concatenate([[0], np.cumsum(np.exp(theta[self.k + 1 :]))])

    def slope(self, x: np.ndarray) -> np.ndarray:
        return self.pdf(x) * (1 - 2 * self.cdf(x)) if self.logit else -x * normal_pdf(x)

    def parts(self, y: np.ndarray, x: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cuts, eta, code = self.cuts(theta), x @ theta[: self.k], y.astype(int)
        last = self.classes - 1
        up = np.where(code < last, cuts[np.minimum(code, last - 1)] - eta, 40.0)
        lo = np.where(code > 0, cuts[np.maximum(code - 1, 0)] - eta, -40.0)
        p = np.maximum(self.cdf(up) - self.cdf(lo), 1e-300)
        fu, fl = np.where(code < last, self.pdf(up), 0), np.where(code > 0, self.pdf(lo), 0)
        gu, gl = np.where(code < last, self.slope(up), 0), np.where(code > 0, self.slope(lo), 0)
        # derivatives of the two cut points in each parameter: -x for the slopes, steps for thresholds
        n, size = len(y), len(theta)
        du, dl = np.zeros((n, size)), np.zeros((n, size))
        du[:, : self.k] = dl[:, : self.k] = -x
        for c in range(last):
            step = 1.0 if c == 0 else math.exp(theta[self.k + c])
            du[:, self.k + c] = np.where((code < last) & (code >= c), step, 0)
            dl[:, self.k + c] = np.where(code - 1 >= c, step, 0)
        score = (fu[:, None] * du - fl[:, None] * dl) / p[:, None]
        hess = score.T @ score - (du * (gu / p)[:, None]).T @ du + (dl * (gl / p)[:, None]).T @ dl
        for c in range(1, last):  # thresholds are exponentials of their parameters
            hess[self.k + c, self.k + c] -= score[:, self.k + c].sum()
        return float(np.log(p).sum()), score, hess

    def thresholds(self, theta: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cut points themselves, their covariance by the delta method."""
        j = np.eye(len(theta))
        for a in range(self.classes - 1):
            for c in range(self.classes - 1):
                j[self.k + a, self.k + c] = 0 if c > a else 1.0 if c == 0 else math.exp(theta[self.k + c])
        return np.concatenate([theta[: self.k], self.cuts(theta)]), j @ cov @ j.T
