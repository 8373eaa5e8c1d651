"""Aggregate expressions with the null rules of panel metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variance(x: Column) -> Column:
    """Population variance; null for fewer than two values."""
    return F.when(F.count(x) >= 2, F.var_pop(x))


def rate(condition: Column) -> Column:
    """Share of rows that meet the condition; 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null unless b is positive."""
    return F.when(b > 0, a / b)


def entropy(n: Column) -> Column:
    """Entropy in bits of counts that are aggregated; null without counts."""
    total = F.sum(n)
    return F.when(total > 0, F.greatest(F.log2(total) - F.sum(n * F.log2(n)) / total, F.lit(0.0)))


def normalized(bits: Column, support: Column) -> Column:
    """Entropy over that of a uniform distribution; null for a support of one or none."""
    return F.when(support > 1, bits / F.log2(support))


def plogp(p: Column, q: Column) -> Column:
    """A term of the Kullback-Leibler divergence in bits."""
    return F.when(p > 0, p * F.log2(p / q)).otherwise(0.0)
