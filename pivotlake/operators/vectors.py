"""Vector tables: objects ``(obj_id, v)``, pivots ``(ref_id, rv)``, queries ``(q_id, qv)``.

Pivots and queries meet every object, so they are the sides to hold: they are broadcast while
their measured size allows; beyond it both sides go into a grid of cells. They are measured once
for a set.

A row takes part if its vector is not null, is as long as the set's vectors are (as that of the
first pivot that is not null) and holds finite numbers only; ``VectorSet.of`` leaves the others
out, of all three parts, so that no form of a search meets them. Object ids may have holes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions import distances
from pivotlake.operators import grid

#: Numbers in a broadcast side at most (8 bytes each).
BROADCAST_NUMBERS = 8_000_000


@dataclass(frozen=True)
class VectorSet:
    objects: DataFrame
    pivots: DataFrame
    queries: DataFrame

    @staticmethod
    def of(objects: DataFrame, pivots: DataFrame, queries: DataFrame) -> VectorSet:
        """A set of the rows that can take part."""
        first = pivots.where("rv is not null").orderBy("ref_id").select(F.size("rv").alias("n")).first()
        n = first["n"] if first else 0
        return VectorSet(usable(objects, "v", n), usable(pivots, "rv", n), usable(queries, "qv", n))

    @cached_property
    def objects_numbers(self) -> int:
        """The numbers in the objects' vectors, all as long as the queries' or pivots'."""
        m = self.measures
        return self.objects.count() * max(m[f"{k}_numbers"] // max(m[k], 1) for k in ("queries", "pivots"))

    @cached_property
    def measures(self) -> dict[str, int]:
        """Rows of pivots and queries, and the numbers in their vectors, by one job."""
        size = lambda d, kind, v: d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum(F.size(v)), F.lit(0)).alias("numbers"))
        rows = size(self.pivots, "pivots", "rv").union(size(self.queries, "queries", "qv")).collect()
        return {r["kind"]: r["n"] for r in rows} | {f"{r['kind']}_numbers": r["numbers"] for r in rows}


def split_embeddings(spark: SparkSession, sf_dir: str, n_pivots: int = 16, every: int = 100) -> VectorSet:
    """The embeddings table: all rows are objects, those of an id divisible by ``every`` are
    the queries, the first ``n_pivots`` the pivots. The bounds reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("embedding").cast("array<double>")
    part = lambda rows, key, name: rows.select(F.col("vec_id").alias(key), v.alias(name))
    return VectorSet.of(spread(part(e, "obj_id", "v")), part(e.where(F.col("vec_id") < n_pivots), "ref_id", "rv"), part(e.where(F.col("vec_id") % every == 0), "q_id", "qv"))


def usable(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """The rows whose vector has ``n`` numbers."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == n) & ~F.exists(vector, lambda x: ~F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores if their scan has fewer tasks than that: a small file is one
    task, and scoring costs far more than moving it. Large scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(cores) if tasks < cores else rows


def select_prefix(rows: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """The first ``n`` by id; more than there are (``total``, if known) is refused."""
    if n < 0 or (total is not None and n > total):
        raise ValueError(f"{n} of {total} rows selected by {key}")
    return rows.where(F.col(key) < n)


def quantise(v: str) -> F.Column:
    """Coordinates in [-1, 1] to 0..255, for integer distances."""
    return F.transform(v, lambda x: F.floor((x + 1.0) * 127.5).cast("int"))


def held(side: DataFrame, numbers: int) -> DataFrame:
    """``side`` with a broadcast hint if its measured size is in bounds, else as it is."""
    return F.broadcast(side) if numbers <= BROADCAST_NUMBERS else side


def pairwise(rows: DataFrame, pivots: DataFrame, numbers: int, vector: str = "v", pivot: str = "rv", metric: str | None = None, name: str = "d2") -> DataFrame:
    """Every row ``(key, vector)`` with every pivot ``(key, vector)`` and their distance: squared
    Euclidean, or a named metric. ``numbers`` tells how many the pivots' vectors hold."""
    if numbers > BROADCAST_NUMBERS:
        (key,), (other,) = ([c for c in d.columns if c != v] for d, v in ((rows, vector), (pivots, pivot)))
        many = rows.agg(F.sum(F.size(vector).cast("long"))).first()[0] or 0
        found = grid.all_pairs(rows.select(F.col(key).alias("id"), F.col(vector).alias("x")), pivots.select(F.col(other).alias("id"), F.col(pivot).alias("y")), grid.blocks(many), grid.blocks(numbers), metric or "squared_l2", "float" if metric == "l2_single" else "double")
        return found.toDF(key, other, name)
    d = distances.METRICS[metric](vector, pivot) if metric else distances.squared_l2(vector, pivot)
    return rows.crossJoin(held(pivots, numbers)).withColumn(name, d).drop(vector, pivot)
