"""Every query of the engine over the driver tables, with the same rows as DuckDB SQL.

Arrays are returned as joined strings, distances rounded to nine digits. All embeddings are
objects; the queries are those of an id divisible by 100, the pivots, a parameter of every
index, the first 16.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.functions import codes
from pivotlake.functions.shared import fresh_path
from pivotlake.operators import codecs, growing, index, permutations, search, vectors, wavelet
from pivotlake.operators.vectors import VectorSet, split_embeddings
from pivotlake.sources import formats, sections

N_PIVOTS, EVERY, K, K_EXACT = 16, 100, 10, 100


def _set(spark: SparkSession, sf_dir: str) -> VectorSet:
    return split_embeddings(spark, sf_dir, N_PIVOTS, EVERY)


def _integers(spark: SparkSession, sf_dir: str) -> VectorSet:
    s = _set(spark, sf_dir)
    return VectorSet(s.objects.withColumn("v", vectors.quantise("v")), s.pivots.withColumn("rv", vectors.quantise("rv")), s.queries.withColumn("qv", vectors.quantise("qv")))


def _points(spark: SparkSession, sf_dir: str) -> VectorSet:
    """Orders as integer points with many ties; ids are dense order keys."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = F.array(F.floor(F.col("o_totalprice") / 1000), F.dayofyear("o_orderdate"), F.col("o_custkey") % 256).cast("array<double>")
    part = lambda rows, key, name: rows.select(F.col("o_orderkey").alias(key), v.alias(name))
    return VectorSet.of(vectors.spread(part(o, "obj_id", "v")), part(o.where(F.col("o_orderkey") < N_PIVOTS), "ref_id", "rv"), part(o.where(F.col("o_orderkey") % EVERY == 0), "q_id", "qv"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _set(spark, sf_dir)
    return permutations.array_to_long(index.build_index(s))


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


def _rounded(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.round(column, 9))


def vec_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _set(spark, sf_dir)
    parts = ((s.queries, "query", "q_id", "qv"), (s.pivots, "pivot", "ref_id", "rv"), (s.objects, "object", "obj_id", "v"))
    out = [d.select(F.lit(kind).alias("part"), F.col(key).alias("id"), F.size(name).cast("long").alias("dim"), F.col(name)[0].alias("x0")) for d, kind, key, name in parts]
    return out[0].union(out[1]).union(out[2])


def pairwise_sqdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _set(spark, sf_dir)
    return _rounded(vectors.pairwise(s.objects, s.pivots, s.measures["pivots_numbers"]), "d2")


def ref_rank_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutations.rank_long(_set(spark, sf_dir))


def ref_order_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_set(spark, sf_dir)).select("obj_id", _joined("perm").alias("perm"))


def ref_position_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_set(spark, sf_dir)).select("obj_id", _joined("pos").alias("pos"))


def pivot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.build_index(_set(spark, sf_dir))
    return found.select("obj_id", permutations.member_position("perm", F.lit(3)).cast("long").alias("rank_of_3"), permutations.member_position("perm", F.lit(99)).cast("long").alias("rank_of_99"))


def index_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("ref_id", "obj_id", codes.pack_cell(F.col("obj_id"), F.col("pos"), N_PIVOTS).alias("cell"))


def cell_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("cell")
    return index_cell(spark, sf_dir).select("ref_id", "cell", codes.cell_object(cell, N_PIVOTS).alias("obj_id"), codes.cell_position(cell, N_PIVOTS).alias("pos"))


def footrule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.footrule_scores(_set(spark, sf_dir))


def footrule_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.footrule_topk(_set(spark, sf_dir), K)


def footrule_topk_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.footrule_topk_array(_set(spark, sf_dir), K)


def footrule_topk_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.footrule_topk_bulk(_set(spark, sf_dir), K)


def footrule_topk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.footrule_topk_bulk(_points(spark, sf_dir), K)


def footrule_topk_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _set(spark, sf_dir)
    return search.index_topk(index.build_index(s), *search.ranked_queries(s), K, late=True)


def footrule_topk_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merged_topk(search.array_scores(_set(spark, sf_dir)), K)


def footrule_topk_merged_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merged_topk(search.array_scores(_set(spark, sf_dir)), K, late=True)


def footrule_topk_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _set(spark, sf_dir)
    return search.padded(search.footrule_topk_array(s, K), s.queries, K).select("q_id", "rk", "obj_id")


def perm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.permutation_topk(_set(spark, sf_dir), K)


def exact_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.exact_topk(_set(spark, sf_dir), K_EXACT, "l2"), "dist")


def exact_topk_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.exact_topk(_set(spark, sf_dir), K_EXACT, "l1"), "dist")


def exact_topk_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_topk(_integers(spark, sf_dir), K_EXACT, "l2_single")


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.answer_lines(footrule_topk_array(spark, sf_dir))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall_at_k(footrule_topk_array(spark, sf_dir), search.exact_topk(_set(spark, sf_dir), K_EXACT, "l2"), K)


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exact answers, stored in the shared folder as they are read several times, and per query a
    distance that is among them and one that is not."""
    path = fresh_path(spark, "answers")
    exact_topk_int(spark, sf_dir).write.parquet(path)
    found = spark.read.parquet(path)
    return found, found.where("rk = 5").select("q_id", "dist").union(found.where("rk = 1").select("q_id", F.lit(-1.0).cast("float")))


def answer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup_distance(*_answers(spark, sf_dir))


def answer_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.remove_distance(*_answers(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, written to the shared folder and read again."""
    path = fresh_path(spark, "index")
    index.write_index(index.build_index(_set(spark, sf_dir)), path)
    return index.read_index(spark, path)


def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_topk(_stored(spark, sf_dir), *search.ranked_queries(_set(spark, sf_dir)), K)


def stored_perm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.perm_topk(_stored(spark, sf_dir), *search.ranked_queries(_set(spark, sf_dir)), K)


def _stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_positions`` of the stored index, for coders: they read them several times, and ranking
    costs far more than reading."""
    return permutations.array_to_long(_stored(spark, sf_dir))


def perm_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random access to the stored permutations: the pivots of rank 0 and of the last rank."""
    return _stored(spark, sf_dir).select("obj_id", F.element_at("perm", 1).cast("long").alias("first"), F.element_at("perm", -1).cast("long").alias("last"))


def wavelet_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a wavelet matrix, read by counting."""
    built = index.build_index(_set(spark, sf_dir))
    ends = built.select("obj_id", F.explode(F.array(F.lit(0), F.lit(N_PIVOTS - 1))).alias("rank"))
    found = wavelet.read_symbols(wavelet.encode(built, N_PIVOTS), ends, N_PIVOTS)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("ref_id")))
    return found.groupBy("obj_id").agg(at(0).alias("first"), at(N_PIVOTS - 1).alias("last"))


def wavelet_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured bytes of the levels and their counts beside the formula's for bare symbols."""
    s = _set(spark, sf_dir)
    bare = index.size_report(s).where("coding = 'permutation'").select(F.col("bytes").alias("formula_bytes"))
    return wavelet.sizes(wavelet.encode(index.build_index(s), N_PIVOTS)).crossJoin(F.broadcast(bare))


def gap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.gap_values(_stored_positions(spark, sf_dir), N_PIVOTS).select("ref_id", "obj_id", "gap", "first")


def gap_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.restore_gaps(codecs.gap_values(_stored_positions(spark, sf_dir), N_PIVOTS), N_PIVOTS, 128)


def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and codes of all different values that the gap form codes."""
    x = F.col("x")
    values = codecs.coded_values(_positions(spark, sf_dir), N_PIVOTS, "gap", True).select(F.col("value").alias("x")).distinct()
    return values.select("x", codes.bit_length(x).alias("bits"), codes.gamma_length(x).alias("gamma"), codes.gamma_bits(x).alias("gamma_code"), codes.delta_length(x).alias("delta"), codes.delta_bits(x).alias("delta_code"))


def _named_total(sizes: DataFrame) -> DataFrame:
    """The total's null id as -1."""
    return sizes.withColumn("ref_id", F.coalesce("ref_id", F.lit(-1)))


def _bucket_size(form: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _named_total(codecs.delta_sizes_of(index.build_index(_set(spark, sf_dir)), N_PIVOTS, form))

    return query


def delta_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = codecs.coded_values(_positions(spark, sf_dir), N_PIVOTS, "pos", True)
    return values.select("ref_id", "obj_id", codes.delta_bits(F.col("value")).alias("code"))


def _roundtrip(coder: str, form: str) -> Callable[[SparkSession, str], DataFrame]:
    encode, decode = (getattr(codecs, f"{coder}_{way}") for way in ("encode", "decode"))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decode(encode(_stored_positions(spark, sf_dir), N_PIVOTS, form, 128), N_PIVOTS, form)

    return query


def _coded_topk(coder: str, form: str) -> Callable[[SparkSession, str], DataFrame]:
    """The search over a decoded index; Simple-9 forms answer under the late tie rule."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _set(spark, sf_dir)
        return search.index_topk(codecs.collect_positions(_roundtrip(coder, form)(spark, sf_dir)), *search.ranked_queries(s), K, late=coder == "s9")

    return query


def _s9_words(form: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _named_total(codecs.s9_words(_stored_positions(spark, sf_dir), N_PIVOTS, form))

    return query


def s9_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every bucket the last position and what is read behind it."""
    buckets = codecs.s9_encode(_stored_positions(spark, sf_dir), N_PIVOTS, "pos")
    value = lambda i: codes.s9_value(F.col("words"), F.col("nvals"), i)
    last = buckets.groupBy("ref_id").agg(F.max_by(F.struct("words", "nvals"), "seg").alias("b")).select("ref_id", "b.*")
    return last.select("ref_id", value(F.col("nvals") - 1).alias("last"), value(F.col("nvals")).alias("behind"))


def _delta_access(form: str) -> Callable[[SparkSession, str], DataFrame]:
    """Look-ups of all queries' own positions in coded rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _set(spark, sf_dir)
        wanted = s.queries.select(F.col("q_id").alias("obj_id")).crossJoin(F.broadcast(s.pivots.select("ref_id")))
        return codecs.delta_access(codecs.delta_encode(_stored_positions(spark, sf_dir), N_PIVOTS, form, 128), wanted, N_PIVOTS, form, 128)

    return query


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of three batches, by thirds of the ids."""
    positions, path = _stored_positions(spark, sf_dir), fresh_path(spark, "growing")
    end = positions.agg(F.max("obj_id")).first()[0] or 0
    for k in range(3):
        growing.append(positions.where((F.col("obj_id") * 3 > end * k if k else F.lit(True)) & (F.col("obj_id") * 3 <= end * (k + 1))), path, N_PIVOTS)
    return growing.read(spark, path)


def delta_append_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir).groupBy("ref_id").agg(F.sum("nbits").alias("bits"), F.sum("nvals").alias("objects"), F.max("end").alias("last_cell"))


def delta_append_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.delta_decode(_grown(spark, sf_dir), N_PIVOTS, "gap")


def index_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = {f"delta_{form}": _bucket_size(form)(spark, sf_dir).where("ref_id = -1").select("bits") for form in ("gap", "pos")}
    total |= {f"s9_{form}": _s9_words(form)(spark, sf_dir).where("ref_id = -1").select((32 * F.col("words")).alias("bits")) for form in ("gap", "pos")}
    return index.size_report(_set(spark, sf_dir), total)


def index_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.parameters(_set(spark, sf_dir))


#: A selection of every section: objects, pivots, queries.
SELECTED = {"n_objects": 100, "n_refs": 8, "n_queries": 2}


def _written_sections(spark: SparkSession, sf_dir: str, layout: str) -> str:
    """The embeddings as sectioned text in the shared folder, in files dealt by ranges and named
    in order; the path."""
    s = _set(spark, sf_dir)
    parts = {"refs": (s.pivots, "ref_id", "rv"), "objects": (s.objects, "obj_id", "v"), "queries": (s.queries, "q_id", "qv")}
    order = [*sections.LAYOUTS[layout], "queries"]
    p = index.parameters(s).first()
    size = {"refs": p["n"], "objects": p["nn"], "queries": p["num_q"]}
    lines = spark.createDataFrame([(-1, 0, " ".join(map(str, [p["dim"], *(size[k] for k in order)])))], "part int, id long, line string")
    for k, name in enumerate(order):
        d, key, v = parts[name]
        lines = lines.union(d.select(F.lit(k), F.col(key), _joined(v)))
    path = fresh_path(spark, f"sections-{layout}")
    lines.orderBy("part", "id").select("line").write.text(path)
    return path


def _totals(part: DataFrame, kind: str, key: str, v: str) -> DataFrame:
    return part.select(F.lit(kind).alias("part"), F.col(key).alias("id"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


def _sections(layout: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """Sectioned text, written and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = sections.read_sections(spark, _written_sections(spark, sf_dir, layout), layout, **options)
        return _totals(back.queries, "query", "q_id", "qv").union(_totals(back.pivots, "pivot", "ref_id", "rv")).union(_totals(back.objects, "object", "obj_id", "v"))

    return query


def _section_source(layout: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """The same through the data source, by ranges of 16 KiB."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _written_sections(spark, sf_dir, layout)
        kinds = {"queries": "query", "refs": "pivot", "objects": "object"}
        parts = formats.read_parts(spark, path, layout, tuple(kinds), block=1 << 14, **options)
        return reduce(DataFrame.union, [_totals(d, kind, "id", "v") for d, kind in zip(parts, kinds.values(), strict=True)])

    return query


def answer_lines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer lines through the sink and back; lines are numbered in the order of the files."""
    path = fresh_path(spark, "lines")
    formats.write_answer_lines(answer_lines(spark, sf_dir), path)
    back = spark.read.format("answer_lines").option("path", path).load()
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = back.groupBy("file").agg(F.count("*").alias("c")).select("file", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    return back.join(before, "file").select((F.col("start") + F.col("n")).alias("line_no"), F.array_join(F.transform("ids", lambda x: F.concat(x.cast("string"), F.lit(" "))), "").alias("line"))


def answer_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cursor(exact_topk_int(spark, sf_dir))


def index_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed while an index was written; times are not compared."""
    path = fresh_path(spark, "measured")
    index.write_measured(index.build_index(_set(spark, sf_dir)), path)
    return index.read_measures(spark, path).drop("build_ms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (vec_split, pairwise_sqdist, ref_rank_long, ref_order_array, ref_position_array, pivot_lookup, index_cell, cell_decode, footrule_scores, footrule_topk, footrule_topk_array, footrule_topk_bulk, footrule_topk_points, footrule_topk_late, footrule_topk_padded, perm_search, exact_topk_l2, exact_topk_l1, exact_topk_int, answer_lines, recall_at_k, answer_lookup, answer_remove, stored_index_topk, stored_perm_topk, perm_access, gap_values, gap_restore, code_lengths, delta_bits, s9_past_end, index_size_report, index_parameters, delta_append_size, delta_append_positions, answer_lines_written, answer_cursor, index_measures, footrule_topk_merged, footrule_topk_merged_late, wavelet_access, wavelet_size)
    out = {f.__name__: f for f in plain}
    for form in ("gap", "pos"):
        out[f"delta_{form}_size"] = _bucket_size(form)
        out[f"s9_words_{form}"] = _s9_words(form)
        out[f"delta_access_{form}"] = _delta_access(form)
        for coder in ("delta", "s9"):
            out[f"{coder}_roundtrip_{form}"] = _roundtrip(coder, form)
            out[f"{coder}_topk_{form}"] = _coded_topk(coder, form)
    return out | {
        "read_sections_refs_first": _sections("refs_first"),
        "read_sections_objects_first": _sections("objects_first"),
        "section_source_refs_first": _section_source("refs_first"),
        "section_source_objects_first": _section_source("objects_first"),
        "section_source_shifted": _section_source("objects_first", strict_sections=False, **SELECTED),
        "read_sections_selected": _sections("objects_first", **SELECTED),
        "read_sections_shifted": _sections("objects_first", strict_sections=False, **SELECTED),
    }


# --- the same in SQL -------------------------------------------------------------------

_BASE = f"""
a as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings where embedding is not null),
e as (select * from a where len(v) = (select len(v) from a where vec_id < {N_PIVOTS} order by vec_id limit 1) and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as q_id, v as qv from e where vec_id % {EVERY} = 0),
r as (select vec_id as ref_id, v as rv from e where vec_id < {N_PIVOTS}),
o as (select vec_id as obj_id, v from e)"""
_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _pos(rows: str, key: str, v: str) -> str:
    return f"select {key}, ref_id, (row_number() over (partition by {key} order by d2, ref_id) - 1)::BIGINT as pos from (select {key}, ref_id, {_D2.format(v, 'rv')} as d2 from {rows}, r)"


_POS = f"{_BASE}, p as ({_pos('o', 'obj_id', 'v')})"
_SCORE = f"{_POS}, qp as ({_pos('q', 'q_id', 'qv')}), sc as (select q_id, obj_id, sum(abs(p.pos - qp.pos))::BIGINT as score from p join qp using (ref_id) group by q_id, obj_id)"
_TOP = f"select q_id, rk, obj_id, score from (select *, row_number() over (partition by q_id order by score, obj_id)::BIGINT as rk from sc) where rk <= {K}"
_LATE = f"""
s as (select *, row_number() over (partition by q_id order by score, obj_id) as rk0 from sc),
t as (select q_id, max(score) as dstar from s where rk0 <= {K} group by q_id),
l as (select sc.*, t.dstar, row_number() over (partition by sc.q_id order by sc.obj_id) as rn, sum(case when sc.score < t.dstar then 1 else 0 end) over (partition by sc.q_id) as nlow
  from sc join t on sc.q_id = t.q_id where sc.score <= t.dstar),
f as (select *, row_number() over (partition by q_id, (score = dstar) order by obj_id desc) as rl from l where rn <= {K} or score < dstar)
select q_id, row_number() over (partition by q_id order by score, obj_id)::BIGINT as rk, obj_id, score from f where score < dstar or rl <= {K} - nlow"""
_EXACT = "select q_id, rk, obj_id, {out} as dist from (select *, row_number() over (partition by q_id order by dist, obj_id)::BIGINT as rk from (select q_id, obj_id, {dist} as dist from o, q)) where rk <= {k}"
_GAPS = f"{_POS}, c as (select ref_id, obj_id, obj_id * {N_PIVOTS} + pos as cell from p), g as (select ref_id, obj_id, (cell - coalesce(lag(cell) over w, 0))::BIGINT as gap, lag(cell) over w is null as first from c window w as (partition by ref_id order by obj_id))"
_BITS = "length(bin({0}))"
_DELTA = "(2 * length(bin(length(bin({0})))) - 1 + length(bin({0})) - 1)"
_DELTA_CODE = "repeat('0', length(bin(length(bin({0})))) - 1) || bin(length(bin({0}))) || substring(bin({0}), 2)"
_POINTS = f"""
e as (select o_orderkey as k, [floor(o_totalprice / 1000)::DOUBLE, dayofyear(o_orderdate)::DOUBLE, (o_custkey % 256)::DOUBLE] as v from orders),
q as (select k as q_id, v as qv from e where k % {EVERY} = 0), r as (select k as ref_id, v as rv from e where k < {N_PIVOTS}),
o as (select k as obj_id, v from e)"""
_INTEGERS = _BASE.replace("list_transform(embedding, lambda x: x::DOUBLE)", "list_transform(embedding, lambda x: floor((x::DOUBLE + 1.0) * 127.5)::INTEGER)")
_INT_TOP = f"with {_INTEGERS}, t as ({_EXACT.format(out='dist', dist=f'sqrt({_D2.format('v', 'qv')})::FLOAT', k=K_EXACT)})"
_ASKED = "w as (select q_id, dist from t where rk = 5 union all select q_id, (-1)::FLOAT from t where rk = 1), f as (select w.q_id, w.dist, arg_min(t.obj_id, t.rk) as obj_id from w left join t on t.q_id = w.q_id and t.dist = w.dist group by w.q_id, w.dist)"
#: How many of the next values each word takes: the most that are all narrow enough.
_S9_STEP = "case " + " ".join(f"when list_max(v[place:place + {n - 1}]) < {1 << bits} then {n}" for n, bits in zip(codes.S9_COUNTS, codes.S9_BITS, strict=True)) + " end"


def _s9_sql(form: str) -> str:
    """Words per bucket, by taking one word after the other."""
    values, value = (_GAPS, "gap") if form == "gap" else (_POS, "pos")
    rows = "g" if form == "gap" else "p"
    return f"{values}, l as (select ref_id, list({value} order by obj_id) as v from {rows} group by ref_id), s9(ref_id, place, words) as (select ref_id, 1::BIGINT, 0::BIGINT from l union all select s9.ref_id, place + {_S9_STEP}, words + 1 from s9 join l using (ref_id) where place <= len(v)), n as (select ref_id, max(words) as words from s9 group by ref_id)"


def oracle_sql() -> dict[str, str]:
    positions = f"with {_POS} select ref_id, obj_id, pos from p"
    top, late = f"with {_SCORE} {_TOP}", f"with {_SCORE}, {_LATE}"
    sizes = {
        "gap": f"{_GAPS}, b as (select ref_id, {_DELTA.format('(gap + first::BIGINT)')} as bits from g)",
        "pos": f"{_POS}, b as (select ref_id, {_DELTA.format('(pos + 1)')} as bits from p)",
    }
    size = {form: f"with {sql} select coalesce(ref_id, -1) as ref_id, sum(bits)::BIGINT as bits from b group by rollup(ref_id)" for form, sql in sizes.items()}
    total = lambda form: f"(select sum({_DELTA.format('(gap + first::BIGINT)' if form == 'gap' else '(pos + 1)')})::DOUBLE / 8 from {'g' if form == 'gap' else 'p'})"
    s9 = lambda form: f"(select 4.0::DOUBLE * sum(words) from (with recursive {_s9_sql(form)} select words from n))"
    dim = "len(v)::BIGINT"
    sums = "round(list_sum({0}), 9)"
    sections_sql = f"with {_BASE} select 'query' as part, q_id // {EVERY} as id, {sums.format('qv')} as total from q union all select 'pivot', ref_id, {sums.format('rv')} from r union all select 'object', obj_id, {sums.format('v')} from o"
    n, m, k = SELECTED.values()
    shifted = f"with {_BASE} select case when vec_id < {n} then 'object' when vec_id < {n + m} then 'pivot' else 'query' end as part, vec_id - case when vec_id < {n} then 0 when vec_id < {n + m} then {n} else {n + m} end as id, {sums.format('v')} as total from e where vec_id < {n + m + k}"
    out = {
        "vec_split": f"with {_BASE} select 'query' as part, q_id as id, len(qv)::BIGINT as dim, qv[1] as x0 from q union all select 'pivot', ref_id, len(rv)::BIGINT, rv[1] from r union all select 'object', obj_id, {dim}, v[1] from o",
        "pairwise_sqdist": f"with {_BASE} select obj_id, ref_id, round({_D2.format('v', 'rv')}, 9) as d2 from o, r",
        "ref_rank_long": f"with {_POS} select obj_id, ref_id, pos from p",
        "ref_order_array": f"with {_POS} select obj_id, string_agg(ref_id::VARCHAR, ' ' order by pos) as perm from p group by obj_id",
        "ref_position_array": f"with {_POS} select obj_id, string_agg(pos::VARCHAR, ' ' order by ref_id) as pos from p group by obj_id",
        "pivot_lookup": f"with {_POS} select obj_id, pos as rank_of_3, (-1)::BIGINT as rank_of_99 from p where ref_id = 3",
        "index_cell": f"with {_POS} select ref_id, obj_id, obj_id * {N_PIVOTS} + pos as cell from p",
        "cell_decode": f"with {_POS} select ref_id, obj_id * {N_PIVOTS} + pos as cell, obj_id, pos from p",
        "footrule_scores": f"with {_SCORE} select q_id, obj_id, score from sc",
        "footrule_topk_points": f"with {_SCORE.replace(_BASE, _POINTS)} {_TOP}",
        "footrule_topk_late": late,
        "footrule_topk_padded": f"with {_SCORE}, a as (select q_id, obj_id, score, row_number() over (partition by q_id order by score, obj_id)::BIGINT as rk from sc) select q.q_id, k.rk, coalesce(a.obj_id, 0) as obj_id from q cross join (select unnest(range(1, {K} + 1))::BIGINT as rk) k left join a on a.q_id = q.q_id and a.rk = k.rk",
        "exact_topk_l2": f"with {_BASE} " + _EXACT.format(out="round(dist, 9)", dist=f"sqrt({_D2.format('v', 'qv')})", k=K_EXACT),
        "exact_topk_l1": f"with {_BASE} " + _EXACT.format(out="round(dist, 9)", dist="list_sum(list_transform(list_zip(v, qv), lambda z: abs(z[1] - z[2])))", k=K_EXACT),
        "exact_topk_int": f"{_INT_TOP} select * from t",
        "answer_lookup": f"{_INT_TOP}, {_ASKED} select q_id, dist, coalesce(obj_id, -1)::BIGINT as obj_id from f",
        "answer_remove": f"{_INT_TOP}, {_ASKED} select t.q_id, row_number() over (partition by t.q_id order by t.rk)::BIGINT as rk, t.obj_id, t.dist from t left join f on f.q_id = t.q_id and f.obj_id = t.obj_id where f.obj_id is null",
        "footrule_topk_merged": top,
        "footrule_topk_merged_late": late,
        "wavelet_access": f"with {_POS} select obj_id, arg_min(ref_id, pos) as first, arg_max(ref_id, pos) as last from p group by obj_id",
        "wavelet_size": f"with {_POS}, s as (select obj_id // {wavelet.segment_of(N_PIVOTS)} as seg, count(*) as m from p group by seg), w as (select length(bin({N_PIVOTS} - 1)) as w) select coalesce(sum(w * ((m + 7) // 8)), 0)::BIGINT as bit_bytes, coalesce(sum(w * 4 * ((m + {wavelet.BLOCK - 1}) // {wavelet.BLOCK})), 0)::BIGINT as count_bytes, coalesce(sum(m * w), 0) / 8.0::DOUBLE as formula_bytes from s, w",
        "perm_access": f"with {_POS} select obj_id, arg_min(ref_id, pos) as first, arg_max(ref_id, pos) as last from p group by obj_id",
        "answer_lines": f"with {_SCORE}, t as ({_TOP}) select q_id, string_agg(obj_id::VARCHAR || ' ', '' order by rk) as line from t group by q_id",
        "recall_at_k": f"with {_SCORE}, t as ({_TOP}), x as ({_EXACT.format(out='dist', dist='sqrt(' + _D2.format('v', 'qv') + ')', k=K)}) select q_id, count(x.obj_id)::BIGINT as hits, count(x.obj_id) / {K}.0::DOUBLE as recall from t left join x using (q_id, obj_id) group by q_id",
        "gap_values": f"with {_GAPS} select ref_id, obj_id, gap, first from g",
        "gap_restore": positions,
        "code_lengths": f"with {_GAPS}, x as (select distinct (gap + first::BIGINT)::BIGINT as x from g) select x, {_BITS.format('x')}::BIGINT as bits, (2 * {_BITS.format('x')} - 1)::BIGINT as gamma, repeat('0', {_BITS.format('x')} - 1) || bin(x) as gamma_code, {_DELTA.format('x')}::BIGINT as delta, {_DELTA_CODE.format('x')} as delta_code from x",
        "delta_bits": f"with {_POS} select ref_id, obj_id, {_DELTA_CODE.format('(pos + 1)')} as code from p",
        "s9_past_end": f"with {_POS} select ref_id, arg_max(pos, obj_id) as last, (-1)::BIGINT as behind from p group by ref_id",
        "delta_gap_size": size["gap"],
        "delta_append_size": f"with {_GAPS} select ref_id, sum({_DELTA.format('(gap + first::BIGINT)')})::BIGINT as bits, count(*)::BIGINT as objects, max(cell)::BIGINT as last_cell from g join c using (ref_id, obj_id) group by ref_id",
        "delta_append_positions": positions,
        "delta_access_gap": f"{positions} where obj_id % {EVERY} = 0",
        "delta_access_pos": f"{positions} where obj_id % {EVERY} = 0",
        "delta_pos_size": size["pos"],
        "index_size_report": f"with {_GAPS}, s(coding, bytes) as (select 'plain_32', (4 * count(*))::DOUBLE from p union all select 'plain_64', (8 * count(*))::DOUBLE from p union all select 'permutation', count(*) * length(bin({N_PIVOTS} - 1)) / 8.0::DOUBLE from p union all select 's9_gap', {s9('gap')} union all select 's9_pos', {s9('pos')} union all select 'delta_gap', {total('gap')} union all select 'delta_pos', {total('pos')}) select coding, bytes, bytes / 1048576.0::DOUBLE as mib from s",
        "index_parameters": f"with {_BASE} select (select count(*) from r)::BIGINT as n, (select count(*) from o)::BIGINT as nn, (select max(len(rv)) from r)::BIGINT as dim, (select count(*) from q)::BIGINT as num_q",
        "answer_lines_written": f"with {_SCORE}, t as ({_TOP}), b as (select q_id, string_agg(obj_id::VARCHAR || ' ', '' order by rk) as line from t group by q_id) select row_number() over (order by q_id) - 1 as line_no, line from b",
        "answer_cursor": f"{_INT_TOP} select q_id, rk, obj_id, lag(obj_id) over w as prior, lead(obj_id) over w as next, first_value(obj_id) over x as first, last_value(obj_id) over x as last, count(*) over x as count from t window w as (partition by q_id order by rk), x as (partition by q_id order by rk rows between unbounded preceding and unbounded following)",
        "index_measures": f"with {_POS} select count(distinct obj_id) as objects, count(*) as cells, coalesce(sum({_DELTA.format('(pos + 1)')}), 0)::BIGINT as delta_pos_bits from p",
        "section_source_refs_first": sections_sql,
        "section_source_objects_first": sections_sql,
        "section_source_shifted": shifted,
        "read_sections_refs_first": sections_sql,
        "read_sections_objects_first": sections_sql,
        "read_sections_selected": f"select * from ({sections_sql}) where id < case part when 'object' then {n} when 'pivot' then {m} else {k} end",
        "read_sections_shifted": shifted,
    }
    out |= dict.fromkeys(("footrule_topk", "footrule_topk_array", "footrule_topk_bulk", "perm_search", "stored_index_topk", "stored_perm_topk", "delta_topk_gap", "delta_topk_pos"), top)
    out |= {f"s9_words_{form}": f"with recursive {_s9_sql(form)} select coalesce(ref_id, -1) as ref_id, sum(words)::BIGINT as words from n group by rollup(ref_id)" for form in ("gap", "pos")}
    out |= dict.fromkeys(("s9_topk_gap", "s9_topk_pos"), late)
    return out | dict.fromkeys(("delta_roundtrip_gap", "delta_roundtrip_pos", "s9_roundtrip_gap", "s9_roundtrip_pos"), positions)
