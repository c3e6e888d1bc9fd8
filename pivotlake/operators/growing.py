"""A stored delta index that grows by batches of objects.

``path/buckets/batch=k`` holds the coded rows of a batch, ``path/state/batch=k`` the last cell of
every pivot's chain once it is stored. A batch's chains go on where the state before it ends, so
after any number of batches the codes are those of one build. A batch counts once its state is
complete; what a failed append has left is written over by the next one.

Ids of a batch must be above all stored ones; else the append is refused. An empty batch
leaves the state as it is. Appends to one index come one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions.shared import matching
from pivotlake.operators import codecs


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches."""
    return sorted(int(p.split("batch=")[1].split("/")[0]) for p in matching(spark, f"{path}/state/batch=*/_SUCCESS"))


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """``(ref_id, cell)`` behind the last batch; none of an empty index."""
    known = batches(spark, path)
    return spark.read.parquet(f"{path}/state/batch={known[-1]}") if known else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The coded rows of all complete batches."""
    known = batches(spark, path)
    if not known:
        raise ValueError(f"{path} holds no index")
    return spark.read.option("basePath", f"{path}/buckets").parquet(*[f"{path}/buckets/batch={k}" for k in known])


def append(positions: DataFrame, path: str, n: int, form: str = "gap", segment: int = codecs.SEGMENT) -> int:
    """Codes ``(ref_id, obj_id, pos)`` behind what is stored; the number of the batch."""
    spark = positions.sparkSession
    known, before = batches(spark, path), state(spark, path)
    k = known[-1] + 1 if known else 0
    if before is not None:
        # all chains hold the same objects, so their last cells are of one object
        last, first = before.agg(F.max(F.expr(f"cell div {n}"))).first()[0], positions.agg(F.min("obj_id")).first()[0]
        if last is not None and first is not None and first <= last:
            raise ValueError(f"object {first} comes after {last} is stored")
    where = f"{path}/buckets/batch={k}"
    codecs.delta_encode(positions, n, form, segment, before).write.mode("overwrite").parquet(where)
    rows = spark.read.parquet(where)
    ends = rows.select("ref_id", F.col("end").alias("cell"))
    ends = ends if before is None else ends.union(before.select("ref_id", "cell"))
    ends.groupBy("ref_id").agg(F.max("cell").alias("cell")).write.mode("overwrite").parquet(f"{path}/state/batch={k}")
    return k
