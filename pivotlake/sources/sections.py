"""Sectioned text: a header of four integers, then three sections of vectors, all separated
by white space; line breaks mean nothing.

Layout ``refs_first``: ``dim, refs, objects, queries``, sections in that order.
Layout ``objects_first``: ``dim, objects, refs, queries``, sections in that order.

Tokens are numbered without gathering the file: every block of a file counts its tokens,
and a token's number is the sum of the blocks before, of the lines before in its block, and
its place in the line. So blocks are read in parallel, from any store that Spark reads. A
folder's files are read in the order of their names. Lines end where ``separator`` says; a file
without line breaks is read with a space there, so that no line holds all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.operators.vectors import VectorSet

#: Layout -> the two first sections (fixed values); queries come last.
LAYOUTS = {"refs_first": ("refs", "objects"), "objects_first": ("objects", "refs")}


def _blocks(spark: SparkSession, path: str, separator: str) -> tuple[DataFrame, DataFrame]:
    """``(file, block, line, tokens)``, and ``(file, block, n)`` with the tokens of each block."""
    found = spark.read.option("lineSep", separator).text(path)
    lines = found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.withColumn("tokens", F.array_remove(F.split("value", r"\s+", -1), "")).where(F.size("tokens") > 0).drop("value")
    return lines, lines.groupBy("file", "block").agg(F.sum(F.size("tokens")).alias("n"))


def read_tokens(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``(t, x)``: number and text of every token."""
    lines, counts = _blocks(spark, path, separator)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("at", F.coalesce(F.sum(F.size("tokens")).over(inside), F.lit(0))).join(starts, ["file", "block"])
    return numbered.select("start", "at", F.posexplode("tokens").alias("k", "x")).select((F.col("start") + F.col("at") + F.col("k")).alias("t"), "x")


def read_sections(spark: SparkSession, path: str, layout: str, n_objects: int | None = None, n_refs: int | None = None, n_queries: int | None = None, integers: bool = False, strict_sections: bool = True, separator: str = "\n") -> VectorSet:
    """The three vector tables of a file. Selections take prefixes of sections and must not
    exceed them. ``strict_sections=False`` reads as programs do that let a selection move the
    following sections: each starts where the selected vectors before it end.
    ``integers``: coordinates must be whole numbers. A missing path is Spark's own error; a
    file that holds fewer tokens than its header says is refused."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout: {layout}; known: {', '.join(LAYOUTS)}")
    tokens = read_tokens(spark, path, separator)
    head = [r["x"] for r in tokens.where("t < 4").orderBy("t").collect()]
    if len(head) < 4:
        raise ValueError(f"{path}: no header of four integers")
    dim, *sizes, there = map(int, head)
    order = [*LAYOUTS[layout], "queries"]
    total = dict(zip(order, [*sizes, there], strict=True))
    wanted = {"objects": n_objects, "refs": n_refs, "queries": n_queries}
    chosen = {k: total[k] if wanted[k] is None else wanted[k] for k in order}
    for k in order:
        if not 0 <= chosen[k] <= total[k]:
            raise ValueError(f"{chosen[k]} of {total[k]} {k} selected")
    there = _blocks(spark, path, separator)[1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if there < 4 + dim * sum(total.values()):
        raise ValueError(f"{path}: {there} tokens, {4 + dim * sum(total.values())} by the header")
    kind, start, out = "int" if integers else "double", 0, {}
    cells = tokens.where("t >= 4").select(F.expr(f"(t - 4) div {max(dim, 1)}").alias("n"), F.expr(f"(t - 4) % {max(dim, 1)}").alias("j"), F.col("x").cast(kind).alias("x"))
    for k, key, name in ((order[0], *_names(order[0])), (order[1], *_names(order[1])), ("queries", "q_id", "qv")):
        own = cells.where((F.col("n") >= start) & (F.col("n") < start + chosen[k]))
        out[k] = own.groupBy((F.col("n") - start).alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda z: z["x"]).alias(name))
        start += total[k] if strict_sections else chosen[k]
    return VectorSet(out["objects"], out["refs"], out["queries"])


def _names(section: str) -> tuple[str, str]:
    return {"objects": ("obj_id", "v"), "refs": ("ref_id", "rv")}[section]
