"""Permutation views: the order in which a vector sees the pivots, by (distance, ref_id),
and its inverse, the position of every pivot. The long form is a window over (row, pivot)
pairs and shuffles by row; the array form stays inside the row and does not shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pivotlake.functions import distances
from pivotlake.operators.vectors import BROADCAST_NUMBERS, VectorSet, pairwise

#: Part of a set -> its id and vector.
KEYS = {"objects": ("obj_id", "v"), "queries": ("q_id", "qv")}


def rank_long(vectors: VectorSet, of: str = "objects") -> DataFrame:
    """``(key, ref_id, pos)``, positions from 0, of the set's objects or queries."""
    key, vector = KEYS[of]
    order = Window.partitionBy(key).orderBy("d2", "ref_id")
    found = pairwise(getattr(vectors, of).select(key, vector), vectors.pivots, vectors.measures["pivots_numbers"], vector)
    return found.select(key, "ref_id", (F.row_number().over(order) - 1).cast("long").alias("pos"))


def pivot_table(pivots: DataFrame) -> DataFrame:
    """All pivots in one row, in id order."""
    return pivots.groupBy().agg(F.array_sort(F.collect_list(F.struct("ref_id", "rv"))).alias("pivots"))


def rank_arrays(vectors: VectorSet, of: str = "objects") -> DataFrame:
    """``(key, perm, pos)``: ``perm`` holds pivots by rank, ``pos`` ranks by pivot. Pivots too
    large to be held in every task (measured) are met in the long form, which shuffles."""
    key, vector = KEYS[of]
    if vectors.measures["pivots_numbers"] > BROADCAST_NUMBERS:
        ranked = rank_long(vectors, of).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ref_id"))).alias("o"))
    else:
        seen = getattr(vectors, of).select(key, vector).crossJoin(F.broadcast(pivot_table(vectors.pivots)))
        order = F.array_sort(F.transform("pivots", lambda p: F.struct(distances.squared_l2(F.col(vector), p["rv"]).alias("d2"), p["ref_id"].alias("ref_id"))))
        ranked = seen.select(key, order.alias("o"))
    return ranked.select(key, F.transform("o", lambda z: z["ref_id"].cast("int")).alias("perm")).select(key, "perm", inverse("perm").alias("pos"))


def inverse(perm: str) -> F.Column:
    """rank -> pivot to pivot -> rank (and back): a sort by the stored value."""
    return F.transform(F.array_sort(F.transform(perm, lambda r, i: F.struct(r.alias("r"), i.alias("i")))), lambda z: z["i"])


def array_to_long(arrays: DataFrame, key: str = "obj_id") -> DataFrame:
    """``(key, ref_id, pos)`` from position arrays."""
    return arrays.select(key, F.posexplode("pos").alias("ref_id", "pos")).select(key, F.col("ref_id").cast("long").alias("ref_id"), F.col("pos").cast("long").alias("pos"))


def member_position(values: str, wanted: F.Column) -> F.Column:
    """Place of a value in an array from 0, -1 if absent."""
    return F.array_position(values, wanted) - 1
