"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions.shared import fresh_path

#: A word is a run without space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written by this process and not deleted yet.
_written: list[DataFrame] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends
    here and a lost executor costs no recomputation. ``discard`` deletes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pivotlake_path = path
    _written.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_pivotlake_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if all(x is not df for df in frames)]


def written() -> list[DataFrame]:
    """What ``materialize`` has written and nobody has deleted: what a caller finds new here
    after a call belongs to that call's result, and can go when the result is stored."""
    return list(_written)


class Scratch:
    """Writes tables like ``materialize`` and deletes all of them at the end of a ``with``:
    only what was written apart from it stays."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        discard(*self.frames)

    def drop(self, *frames: DataFrame) -> None:
        """Delete some of the tables at once."""
        discard(*frames)
        self.frames = [x for x in self.frames if all(x is not df for df in frames)]

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.frames.append(materialize(df, name))
        return self.frames[-1]


def wrap(rows: DataFrame, carry: list[str] | None = None, /, **own: Column) -> DataFrame:
    """Each input row whole, or its columns in ``carry``, as struct ``row``, beside the columns that an operator works
    with; so no name of the input can clash with a helper's. ``unwrap`` undoes it."""
    return rows.select(F.struct(*[rows[f"`{c}`"] for c in (rows.columns if carry is None else carry)]).alias("row"), *[c.alias(name) for name, c in own.items()])


def unwrap(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; at its end the worker gives freed memory back to the
    system. Spark keeps idle workers for later tasks, several an executor, and what their
    allocators hold adds up over the stages of a job."""

    @wraps(run)
    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return own
