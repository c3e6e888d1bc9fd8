"""Distances and rank scores as column expressions. Sums run left to right from zero, so
equal inputs give equal doubles on every form of a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(terms: Column, zero: Column) -> Column:
    return F.aggregate(terms, zero, lambda a, x: a + x)


def squared_l2(u: Column | str, v: Column | str) -> Column:
    """Sum of squared differences; enough wherever only the order counts."""
    return _fold(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0))


def l2(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(squared_l2(u, v))


def l1(u: Column | str, v: Column | str) -> Column:
    return _fold(F.zip_with(u, v, lambda x, y: F.abs(x - y)), F.lit(0.0))


def l2_single(u: Column | str, v: Column | str) -> Column:
    """Euclidean distance of integer vectors in single precision: the sum is kept as a float
    (exact below 2^24), and so is its root; distances that only doubles tell apart tie."""
    terms = F.zip_with(u, v, lambda x, y: ((x - y) * (x - y)).cast("float"))
    total = F.aggregate(terms, F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))
    return F.sqrt(total).cast("float")


METRICS = {"l2": l2, "l1": l1, "l2_single": l2_single}


def footrule(u: Column | str, v: Column | str) -> Column:
    """Spearman footrule of two position arrays: the sum of rank displacements."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
