"""Stored indexes: position and permutation arrays as Parquet, one row per object, and a
one-row table of their measures."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions import codes
from pivotlake.operators.permutations import rank_arrays
from pivotlake.operators.vectors import VectorSet


def build_index(vectors: VectorSet) -> DataFrame:
    """``(obj_id, perm, pos)``; one scan of the objects, no shuffle."""
    return rank_arrays(vectors)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def write_measured(index: DataFrame, path: str) -> dict[str, int]:
    """Writes the index and, beside it, what is observed of its rows while they are written: how
    many, their cells, the bits of their position codes, and the milliseconds it took. No second
    job reads the rows."""
    spark = index.sparkSession
    bits = F.aggregate("pos", F.lit(0).cast("long"), lambda a, x: a + codes.delta_length(x + 1))
    seen, began = Observation(), time.perf_counter()
    index.observe(seen, F.count("*").alias("objects"), F.coalesce(F.sum(F.size("pos").cast("long")), F.lit(0)).alias("cells"), F.coalesce(F.sum(bits), F.lit(0)).alias("delta_pos_bits")).write.mode("overwrite").parquet(path)
    found = {**seen.get, "build_ms": round(1000 * (time.perf_counter() - began))}
    spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found)).coalesce(1).write.mode("overwrite").parquet(f"{path}-measures")
    return found


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """``(objects, cells, delta_pos_bits, build_ms)`` of a measured index."""
    return spark.read.parquet(f"{path}-measures")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parameters(vectors: VectorSet) -> DataFrame:
    """``(n, nn, dim, num_q)``: pivots, objects, dimensions, queries."""
    n = vectors.pivots.agg(F.count("*").alias("n"), F.max(F.size("rv")).cast("long").alias("dim"))
    return n.crossJoin(vectors.objects.agg(F.count("*").alias("nn"))).crossJoin(vectors.queries.agg(F.count("*").alias("num_q"))).select("n", "nn", "dim", "num_q")


def size_report(vectors: VectorSet, bits: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(coding, bytes, mib)``: uncompressed sizes by formula, and that of a permutation
    table with as many bits a symbol as the largest needs; ``bits`` adds codings by their
    measured bits, ``(bits)`` in one row."""
    sizes = parameters(vectors).select((F.col("n") * F.col("nn")).alias("cells"), F.length(F.bin(F.col("n") - 1)).alias("width"))
    forms = {"plain_32": 4 * F.col("cells"), "plain_64": 8 * F.col("cells"), "permutation": F.col("cells") * F.col("width") / 8.0}
    out = [sizes.select(F.lit(name).alias("coding"), size.cast("double").alias("bytes")) for name, size in forms.items()]
    out += [total.select(F.lit(name).alias("coding"), (F.col("bits") / 8.0).alias("bytes")) for name, total in (bits or {}).items()]
    return reduce(DataFrame.union, out).withColumn("mib", F.col("bytes") / 1048576.0)
