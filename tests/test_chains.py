"""Codes over unbroken chains, ids with holes, growing indexes, look-ups, forms of a search."""

import random

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from pivotlake.functions import codes
from pivotlake.operators import codecs, grid, growing, permutations, search, vectors, wavelet
from pivotlake.plans import registry

LONG = "ref_id long, obj_id long, pos long"


def chain(ids, pos, n, form):
    """A bucket's values, its first cell counted from its object's first, wide gaps closed."""
    if form == "pos":
        return pos
    cell = ids * n + pos
    gap = np.diff(np.r_[ids[0] * n, cell])
    return np.where(gap >= codes.S9_LIMIT, n + pos - np.r_[0, pos[:-1]], gap)


def positions(spark, ids, refs, n, seed=1):
    """Positions by pivot, and as rows; not permutations, which codes do not ask for."""
    own = {r: np.random.default_rng(seed + r).integers(0, n, len(ids)) for r in range(refs)}
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids.tolist())], "k long, obj_id long")
    table = spark.createDataFrame([(r, x.tolist()) for r, x in own.items()], "r long, p array<long>")
    return own, rows.crossJoin(F.broadcast(table)).select(F.col("r").alias("ref_id"), "obj_id", F.element_at("p", (F.col("k") + 1).cast("int")).alias("pos"))


@pytest.mark.parametrize("form", ["pos", "gap"])
@pytest.mark.parametrize("segment", [1, 5, 64])
def test_simple9_in_segments(spark, form, segment, monkeypatch):
    """Segments of few values or none: words are those of the whole chain, values come back."""
    monkeypatch.setattr(codecs, "S9_BLOCK", 3)
    rng = random.Random(segment)
    ids = np.array(sorted(rng.sample(range(700), 300)))
    own, d = positions(spark, ids, 3, 6)
    coded = codecs.s9_encode(d, 6, form, segment)
    words = {}
    for r in sorted(coded.collect(), key=lambda r: (r["ref_id"], r["seg"])):
        words.setdefault(r["ref_id"], []).extend(r["words"])
    assert words == {r: codecs.s9_pack(chain(ids, x, 6, form)) for r, x in own.items()}
    assert sorted(codecs.s9_decode(coded, 6, form).collect()) == sorted(d.collect())


@pytest.mark.parametrize("form", ["pos", "gap"])
def test_simple9_words_of_70000_objects(spark, form):
    """More than a segment holds; brute force over the whole chain, and the recursive SQL."""
    import duckdb

    ids = np.arange(70_000)
    own, d = positions(spark, ids, 2, 16)
    got = {r["ref_id"]: r["words"] for r in codecs.s9_sizes(codecs.s9_encode(d, 16, form)).collect()}
    want = {r: len(codecs.s9_pack(chain(ids, x, 16, form))) for r, x in own.items()}
    assert got == want | {None: sum(want.values())}
    assert {r["ref_id"]: r["words"] for r in codecs.s9_words(d, 16, form).collect()} == got
    con = duckdb.connect()
    values = ", ".join(f"({r}, {chain(ids, x, 16, form).tolist()})" for r, x in own.items())
    con.execute(f"create table l as select * from (values {values}) t(ref_id, v)")
    # the part of the registered SQL that takes one word after the other
    sql = registry.oracle_sql()[f"s9_words_{form}"]
    walk = sql[sql.index("s9(ref_id, place, words)") :]
    assert dict(con.execute(f"with recursive {walk}").fetchall()) == {-1 if r is None else r: n for r, n in got.items()}


@pytest.mark.parametrize("form", ["pos", "gap"])
def test_ids_with_holes_and_past_20_million(spark, form):
    for ids, segment in ((np.r_[0:5, 40, 41, 20_000_003, 20_000_004], 64), (np.arange(17_800_000, 17_800_300), codecs.SEGMENT), (np.r_[3_100_000:3_100_020, 90_000_000:90_000_300], 64)):
        own, d = positions(spark, ids, 2, 128)
        want = sorted(d.collect())
        assert sorted(codecs.s9_decode(codecs.s9_encode(d, 128, form, segment), 128, form).collect()) == want
        assert sorted(codecs.delta_decode(codecs.delta_encode(d, 128, form, segment), 128, form).collect()) == want


def test_searches_over_codes_with_a_missing_id(spark):
    s = vectors.split_embeddings(spark, DATA)
    s = vectors.VectorSet(s.objects.where("obj_id <> 33"), s.pivots, s.queries)
    plain, long = search.footrule_topk_array(s), permutations.array_to_long(permutations.rank_arrays(s))
    for coder in ("delta", "s9"):
        for form in ("pos", "gap"):
            encode, decode = getattr(codecs, f"{coder}_encode"), getattr(codecs, f"{coder}_decode")
            back = codecs.collect_positions(decode(encode(long, 16, form, 128), 16, form))
            assert sorted(search.index_topk(back, *search.ranked_queries(s)).collect()) == sorted(plain.collect())


def test_empty_tables_are_coded(spark):
    none = spark.createDataFrame([], LONG)
    for coder in ("delta", "s9"):
        for form in ("pos", "gap"):
            assert getattr(codecs, f"{coder}_encode")(none, 4, form).count() == 0
    assert [tuple(r) for r in codecs.s9_words(none, 4, "gap").collect()] == [(None, None)]
    assert codecs.delta_sizes_of(spark.createDataFrame([], "obj_id long, pos array<int>"), 4, "gap").count() == 1  # the total


@pytest.mark.parametrize("form", ["pos", "gap"])
def test_look_ups_read_one_block(spark, form):
    ids = np.array(sorted(random.Random(4).sample(range(3000), 1000)))
    own, d = positions(spark, ids, 2, 9)
    coded = codecs.delta_encode(d, 9, form, 512)
    wanted = spark.createDataFrame([(r, i) for r in range(2) for i in range(-1, 3001, 7)], "ref_id long, obj_id long")
    there = set(ids.tolist())
    got = codecs.delta_access(coded, wanted, 9, form, 512)
    place = {i: k for k, i in enumerate(ids.tolist())}
    assert sorted(map(tuple, got.collect())) == sorted((r, i, int(own[r][place[i]])) for r in range(2) for i in range(-1, 3001, 7) if i in there)
    dense = codecs.delta_encode(positions(spark, np.arange(300), 1, 9)[1], 9, form)
    assert codecs.delta_access(dense, spark.createDataFrame([(0, 0), (0, 63), (0, 64), (0, 299), (0, 300)], "ref_id long, obj_id long"), 9, form).count() == 4


def test_three_batches_are_one_build(spark, tmp_path):
    ids = np.array(sorted(random.Random(5).sample(range(900), 400)))
    own, d = positions(spark, ids, 3, 7)
    for form in ("gap", "pos"):
        path = str(tmp_path / form)
        for k, (low, high) in enumerate(((0, 300), (300, 301), (301, 900))):
            assert growing.append(d.where((F.col("obj_id") >= low) & (F.col("obj_id") < high)), path, 7, form, 128) == k
        one, rows = codecs.delta_encode(d, 7, form, 128), growing.read(spark, path)
        bits = lambda x: sorted(x.groupBy("ref_id").agg(F.sum("nbits"), F.sum("nvals"), F.max("end")).collect())
        assert bits(rows) == bits(one)
        assert sorted(codecs.delta_decode(rows, 7, form).collect()) == sorted(d.collect())
        code = {}  # bit by bit
        for which, x in (("rows", rows), ("one", one)):
            for r in sorted(x.collect(), key=lambda r: (r["ref_id"], r["first"])):
                code.setdefault((which, r["ref_id"]), []).extend(np.unpackbits(np.frombuffer(r["code"], "u1"), bitorder="little")[: r["nbits"]].tolist())
        assert all(code["rows", r] == code["one", r] for r in range(3))
        with pytest.raises(ValueError, match="is stored"):
            growing.append(d.where("obj_id < 10"), path, 7, form, 128)
        assert growing.batches(spark, path) == [0, 1, 2]
        # what a failed append left does not count, and is written over
        assert growing.read(spark, path).count() == rows.count()
        more = spark.createDataFrame([(r, 5000, 3) for r in range(3)], LONG)
        assert growing.append(more, path, 7, form, 128) == 3 and growing.read(spark, path).agg(F.sum("nvals")).first()[0] == 3 * 401


# --- forms of a search ------------------------------------------------------------------


@pytest.fixture
def odd_set(spark):
    """Ties, a null vector, vectors of other lengths, null and infinite components, in all parts."""
    rng = np.random.default_rng(8)
    good = rng.integers(0, 4, (300, 4)).astype(float).tolist()
    bad = [None, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], []]
    rows = [(3 * k, v) for k, v in enumerate(good)] + [(3 * k + 1, v) for k, v in enumerate(bad)]
    part = lambda own, key, v: spark.createDataFrame(own, f"{key} long, {v} array<double>")
    return vectors.VectorSet.of(part(rows, "obj_id", "v").repartition(3), part([(1, None), (2, [])][:1] + [(k + 5, good[k]) for k in range(5)] + [(99, bad[1])], "ref_id", "rv"), part([(k, good[k]) for k in range(0, 300, 15)] + [(1000 + k, v) for k, v in enumerate(bad)], "q_id", "qv"))


def test_forms_agree_on_odd_vectors(odd_set):
    s = vectors.VectorSet(odd_set.objects, odd_set.pivots.select((F.col("ref_id") - 5).alias("ref_id"), "rv"), odd_set.queries)
    want = sorted(search.footrule_topk(s, 6).collect())
    assert len(want) == 6 * 20 and all(r["obj_id"] % 3 == 0 and r["q_id"] < 1000 for r in want)
    for form in (search.footrule_topk_array, search.footrule_topk_bulk, search.permutation_topk):
        assert sorted(form(s, 6).collect()) == want
    exact = search.exact_topk(s, 6)
    assert exact.where("dist is null or isnan(dist) or obj_id % 3 <> 0").count() == 0 and exact.count() == 120


@pytest.mark.parametrize("cell", [40, 10_000])
def test_searches_beyond_a_broadcast(odd_set, monkeypatch, cell):
    """The same rows from a grid of cells, and no Cartesian product in any plan."""
    s = vectors.VectorSet(odd_set.objects, odd_set.pivots.select((F.col("ref_id") - 5).alias("ref_id"), "rv"), odd_set.queries)
    whole = vectors.VectorSet(s.objects.withColumn("v", F.col("v").cast("array<int>")), s.pivots, s.queries.withColumn("qv", F.col("qv").cast("array<int>")))
    forms = {"long": lambda: search.footrule_topk(s, 6), "array": lambda: search.footrule_topk_array(s, 6), "bulk": lambda: search.footrule_topk_bulk(s, 6), "permutations": lambda: search.permutation_topk(s, 6), "l2": lambda: search.exact_topk(s, 6), "l1": lambda: search.exact_topk(s, 6, "l1"), "single": lambda: search.exact_topk(whole, 6, "l2_single")}
    want = {k: sorted(f().collect()) for k, f in forms.items()}
    for module, name in ((permutations, "BROADCAST_NUMBERS"), (vectors, "BROADCAST_NUMBERS"), (search, "BROADCAST_NUMBERS"), (search, "BULK_NUMBERS")):
        monkeypatch.setattr(module, name, 1)
    monkeypatch.setattr(grid, "CELL_NUMBERS", cell)
    monkeypatch.setattr(grid, "STEP", 16)
    for k, f in forms.items():
        found = f()
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString(), k
        assert sorted(found.collect()) == want[k], k


def test_merged_answers(spark, monkeypatch):
    """Summaries of parts, also given away early, hold what both tie rules need."""
    monkeypatch.setattr(search, "HELD", 50)
    rng = random.Random(6)
    rows = [(q, i, rng.randrange(5)) for q in range(40) for i in rng.sample(range(3000), 2500)]
    d = spark.createDataFrame(rows, "q_id long, obj_id long, score long").repartition(5)
    for k in (1, 7):
        assert sorted(search.merged_topk(d, k).collect()) == sorted(search.smallest(d, k).collect())
        assert sorted(search.merged_topk(d, k, late=True).collect()) == sorted(search.topk_late_ties(d, k).collect())
    plan = search.merged_topk(d, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.rindex("MapInArrow") :]
    assert search.merged_topk(d.where("false"), 7).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 16, 100):
        symbols = rng.integers(0, n, 3000)
        levels = wavelet.build_levels(symbols, max(1, (n - 1).bit_length()))
        assert (wavelet.access(levels, np.arange(3000)) == symbols).all()


def test_wavelet_look_ups(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SYMBOLS", 60)
    rng = np.random.default_rng(5)
    perm = {int(i): rng.permutation(6).tolist() for i in rng.choice(200, 70, replace=False)}
    d = spark.createDataFrame(list(perm.items()), "obj_id long, perm array<int>")
    wanted = spark.createDataFrame([(i, r) for i in range(-1, 201) for r in (-1, 0, 3, 5, 6)], "obj_id long, rank long")
    for salts in (1, 3):
        got = wavelet.read_symbols(wavelet.encode(d, 6), wanted, 6, salts)
        assert sorted(map(tuple, got.collect())) == sorted((i, r, p[r]) for i, p in perm.items() for r in (0, 3, 5))
