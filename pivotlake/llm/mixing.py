"""Mixing sources to target weights.

Sizes are summed per source (partial sums before the shuffle), targets are shared out by
weight with a ceiling, and every document is emitted ``floor(rate)`` times plus once more
with probability ``rate - floor(rate)``, decided by a hash of its id, its size and a seed;
so reruns and retried tasks agree.

Defined results: a null text has size 0; null sources form one source, the last in order;
rows that repeat an id and a size draw alike; a source of size 0 has target and rate 0;
an empty table gives empty tables. ``mix_sources`` keeps all input columns, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.llm.common import materialize, table, unwrap, word_count, wrap

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"
#: Rows of the per-source table up to which it is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000


def number_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_n``, the place of the source in code-point order, null last. Sources
    are dealt by ranges and numbered inside each; only the ranges' counts, one row a range,
    come to the driver. So no task orders all sources, which may be hosts."""
    ranges = materialize(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    first = {k: sum(n for j, n in counts if j < k) for k, _ in counts}
    before = sizes.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "_range int, _first long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    return ranges.join(F.broadcast(before), "_range").withColumn("_n", F.col("_first") + inside - 1).drop("_range", "_first")


def common_level(sources: DataFrame) -> float:
    """The level at which the lesser of weight x level and ceiling, over all sources, uses up
    all sizes. Each turn takes the sources that reach their ceiling under the last level as
    full, and finds the level of the others from sums; levels only rise, towards the one
    sought (Newton's steps on a concave function), so few turns are needed."""
    own = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    total, weights, level = own["t"], own["w"], own["t"] / max(own["w"], 1)
    while True:
        full = sources.where(F.col("_top").cast("double") / F.col("_w").cast("double") <= F.lit(level)).agg(F.coalesce(F.sum("_top"), F.lit(0)).alias("t"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
        if full["w"] == weights:
            return level
        new = (total - full["t"]) / (weights - full["w"])
        if new <= level:
            return level
        level = new


def source_rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(source, source_size, target, rate)``. Sources in code-point order, null last, get
    the weights in turn; their targets are the lesser of weight x level and ceiling x size,
    at the level that uses up all sizes."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("_size")).groupBy("source").agg(F.sum("_size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("long")
    sources = materialize(number_sources(sizes).withColumn("_w", w).withColumn("_top", (ceiling * F.col("source_size")).cast("long")), "mix-sources")
    target = F.least(F.col("_top").cast("double"), F.col("_w").cast("double") * F.lit(common_level(sources)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(*parts: Column, seed: str = SEED) -> Column:
    """A double in [0, 1) from 52 bits of an md5 over the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``(row, size, source_size, target, copies)`` per input row, the row itself as a
    struct. The rates (one row per source) come from a stored table and are broadcast only if
    they are few; else the join shuffles and splits skewed partitions."""
    rates = source_rates(docs, weights, ceiling, text_col, source_col).withColumnRenamed("source", "own")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = wrap(docs, id=F.col(id_col), source=F.col(source_col), size=word_count(F.col(text_col)))
    out = rows.join(rates, F.col("source").eqNullSafe(F.col("own")), "left")
    whole = F.floor("rate")
    extra = (draw(F.col("id"), F.col("size"), seed=seed) < F.col("rate") - whole).cast("long")
    return out.select("row", "size", "source_size", "target", (whole + extra).alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every input row as often as the plan says."""
    plan = mixing_plan(docs, **options)
    return unwrap(plan.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size from documents),
s as (select source, sum(size)::BIGINT as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::BIGINT]::BIGINT as w, 3 * source_size as top from s),
l as (select *, ((sum(source_size) over ()) - coalesce(sum(top) over p, 0))::DOUBLE / ((sum(w) over ()) - coalesce(sum(w) over p, 0))::DOUBLE as level
  from w window p as (order by top::DOUBLE / w::DOUBLE, source asc nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(top::DOUBLE, w::DOUBLE * max(level) over ()) as target from l),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t)
select doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':{SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::BIGINT))::BIGINT as taken
from d join r on d.source is not distinct from r.source
"""
