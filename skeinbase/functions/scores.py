"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import FACET_WEIGHTS

K1, B = 1.2, 0.4


def idf(df: Column, documents: Column) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def norm(tf: Column, length: Column, average: Column) -> Column:
    """What a term that stands ``tf`` times counts in a node of this length."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average))


def bm25(tf: Column, df: Column, length: Column, documents: Column, average: Column) -> Column:
    return idf(df, documents) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average))


def facet_weight(facets: Column) -> Column:
    """The greatest weight of a node's facets, 1 at least for those without one."""
    weights = F.create_map(*(F.lit(x) for kv in FACET_WEIGHTS.items() for x in kv))
    return F.coalesce(F.array_max(F.transform(facets, lambda f: F.coalesce(F.try_element_at(weights, f), F.lit(1.0)))), F.lit(1.0))


def impact(co_change: Column, hop: Column, importance: Column, test: Column, depth: int = 2) -> Column:
    """hop: null or 0 if no dependency leads there."""
    near = F.when(F.coalesce(hop, F.lit(0)) > 0, depth - hop + 1).otherwise(0)
    return (2 * F.coalesce(co_change, F.lit(0)) + near) * (1 + F.coalesce(importance, F.lit(0.0)) / 25) * F.when(test, 0.5).otherwise(1.0)


def contested(churn: Column, degree: Column) -> Column:
    return churn * (1 + F.coalesce(degree, F.lit(0)) / 4)


def feedback(importance: Column, useful: Column, missed: Column) -> Column:
    """Up or down by a fifth at five net votes, 100 at most."""
    net = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (useful - missed).cast("double")))
    return F.least(F.lit(100.0), importance * (1 + 0.2 * net / 5))


def experience(access: Column, access_max: Column, importance: Column, importance_max: Column, net: Column) -> Column:
    part = lambda x, top: F.when(top > 0, x / top).otherwise(0.0)
    return 0.45 * part(access, access_max) + 0.4 * part(importance, importance_max) + 0.15 * F.greatest(net, F.lit(0.0))
