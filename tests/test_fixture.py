"""A small example whose every value is known: dimension 2, 3 pivots, 7 objects, 3 queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pivotlake.functions import codes
from pivotlake.operators import codecs, index, permutations, search, vectors
from pivotlake.sources import sections

REFS_FIRST = "2 3 7 3\n0 0  10 0  0 10\n1 1  9 2  2 9  6 6  1 1  8 0  0 5\n2 1  5 5  7 9\n"
OBJECTS_FIRST = "2 7 3 3\n1 1  9 2  2 9  6 6  1 1  8 0  0 5\n0 0  10 0  0 10\n2 1  5 5  7 9\n"
POS = [[0, 1, 2], [1, 0, 2], [1, 2, 0], [2, 0, 1], [0, 1, 2], [1, 0, 2], [0, 2, 1]]
PERM = [[0, 1, 2], [1, 0, 2], [2, 0, 1], [1, 2, 0], [0, 1, 2], [1, 0, 2], [0, 2, 1]]


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("text") / "a.txt"
    path.write_text(REFS_FIRST)
    return sections.read_sections(spark, str(path), "refs_first")


def ids(answers):
    out = {}
    for r in answers.orderBy("q_id", "rk").collect():
        out.setdefault(r["q_id"], []).append(r["obj_id"])
    return out


def test_layouts_agree(spark, tiny, tmp_path):
    (tmp_path / "b.txt").write_text(OBJECTS_FIRST.replace("\n", " \n "))
    other = sections.read_sections(spark, str(tmp_path / "b.txt"), "objects_first")
    for a, b, key in ((tiny.objects, other.objects, "obj_id"), (tiny.pivots, other.pivots, "ref_id"), (tiny.queries, other.queries, "q_id")):
        assert a.orderBy(key).collect() == b.orderBy(key).collect()


def test_tokens_across_blocks(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"{i} {i + 1}\n" for i in range(0, 4000, 2)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = sections.read_tokens(spark, str(path))
        assert found.where(F.col("t") != F.col("x").cast("long")).count() == 0 and found.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_selections(spark, tmp_path):
    path = tmp_path / "b.txt"
    path.write_text(OBJECTS_FIRST)
    strict = sections.read_sections(spark, str(path), "objects_first", n_objects=2, n_refs=2, n_queries=1)
    assert [r["v"] for r in strict.objects.orderBy("obj_id").collect()] == [[1, 1], [9, 2]]
    assert [r["rv"] for r in strict.pivots.orderBy("ref_id").collect()] == [[0, 0], [10, 0]]
    moved = sections.read_sections(spark, str(path), "objects_first", n_objects=2, n_refs=2, n_queries=1, strict_sections=False)
    assert [r["rv"] for r in moved.pivots.orderBy("ref_id").collect()] == [[2, 9], [6, 6]]
    assert [r["qv"] for r in moved.queries.collect()] == [[1, 1]]
    with pytest.raises(ValueError):
        sections.read_sections(spark, str(path), "objects_first", n_objects=8)
    with pytest.raises(ValueError):
        sections.read_sections(spark, str(path), "sideways")
    with pytest.raises(ValueError):
        vectors.select_prefix(strict.objects, "obj_id", 9, 7)


def test_permutations(tiny):
    rows = index.build_index(tiny).orderBy("obj_id").collect()
    assert [r["perm"] for r in rows] == PERM and [r["pos"] for r in rows] == POS
    long = permutations.rank_long(tiny).orderBy("obj_id", "ref_id").collect()
    assert [r["pos"] for r in long] == sum(POS, [])


@pytest.mark.parametrize("form", [search.footrule_topk, search.footrule_topk_array, search.footrule_topk_bulk, search.permutation_topk])
def test_footrule(tiny, form):
    assert ids(form(tiny, 3)) == {0: [0, 4, 1], 1: [0, 4, 1], 2: [2, 3, 0]}


def test_late_ties_and_padding(tiny):
    scored = search.array_scores(tiny)
    assert ids(search.topk_late_ties(scored, 3))[2] == [2, 3, 1]
    full = search.padded(search.smallest(scored, 10), tiny.queries, 10)
    assert ids(full) == {0: [0, 4, 1, 5, 6, 2, 3, 0, 0, 0], 1: [0, 4, 1, 5, 6, 2, 3, 0, 0, 0], 2: [2, 3, 0, 1, 4, 5, 6, 0, 0, 0]}
    lines = {r["q_id"]: r["line"] for r in search.answer_lines(search.smallest(scored, 3)).collect()}
    assert lines[0] == "0 4 1 "


def test_exact(tiny):
    assert ids(search.exact_topk(tiny, 3, "l2")) == {0: [0, 4, 6], 1: [3, 1, 2], 2: [3, 2, 1]}
    l1 = search.exact_topk(tiny, 7, "l1").where("q_id = 2").orderBy("obj_id").collect()
    assert [r["dist"] for r in l1] == [14, 9, 5, 4, 14, 10, 11]


def test_single_precision_ties(spark):
    n = 4_197_200
    d = spark.createDataFrame([(0, [0, 0], [2020, 342]), (1, [0], [1])], "i int, u array<int>, v array<int>")
    from pivotlake.functions.distances import l2_single

    assert [r[0] for r in d.orderBy("i").select(l2_single("u", "v")).collect()][1] == 1.0
    r = spark.sql(f"select cast(sqrt(cast({n} as float)) as float) = cast(sqrt(cast({n + 1} as float)) as float)").first()[0]
    assert r


@pytest.mark.parametrize(("scores", "plain", "late"), [([2, 2, 1, 2, 0], [4, 2, 0], [4, 2, 1]), ([5, 5, 5, 1], [3, 0, 1], [3, 1, 2])])
def test_tie_rules(spark, scores, plain, late):
    d = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)], "q_id long, obj_id long, score long")
    assert ids(search.smallest(d, 3))[0] == plain and ids(search.topk_late_ties(d, 3))[0] == late


def test_late_ties_against_a_heap(spark):
    rng = random.Random(5)
    cases = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    d = spark.createDataFrame([(q, i, s) for q, c in enumerate(cases) for i, s in enumerate(c)], "q_id long, obj_id long, score long")
    got = ids(search.topk_late_ties(d, 5))
    for q, c in enumerate(cases):
        kept = []
        for i, s in enumerate(c):
            if len(kept) < 5:
                kept.append((s, i))
            elif s < max(kept)[0]:
                worst = max(x[0] for x in kept)
                kept.remove(min(x for x in kept if x[0] == worst))
                kept.append((s, i))
        assert got[q] == [i for _, i in sorted(kept)]


POS_BITS = {0: (19, "45b404"), 1: (19, "524b05"), 2: (25, "aa455500")}
GAP_BITS = {0: (25, "8d9a4600"), 1: (28, "22b6110b"), 2: (27, "aa8d5101")}
POS_WORDS, GAP_WORDS = {0: 0x11610000, 1: 0x14848000, 2: 0x1A1A4000}, {0: 0x211C3100, 1: 0x22A98A80, 2: 0x24CC8D00}


@pytest.mark.parametrize(("form", "bits", "words"), [("pos", POS_BITS, POS_WORDS), ("gap", GAP_BITS, GAP_WORDS)])
def test_buckets(tiny, form, bits, words):
    long = permutations.array_to_long(index.build_index(tiny))
    coded = {r["ref_id"]: (r["nbits"], r["code"].hex()) for r in codecs.delta_encode(long, 3, form).collect()}
    assert coded == bits
    assert {r["ref_id"]: r["words"] for r in codecs.s9_encode(long, 3, form).collect()} == {k: [w] for k, w in words.items()}
    sizes = {r["ref_id"]: r["bits"] for r in codecs.delta_sizes(long, 3, form).collect()}
    assert sizes == {k: n for k, (n, _) in bits.items()} | {None: sum(n for n, _ in bits.values())}
    for segment in (2, 1 << 16):
        back = codecs.delta_decode(codecs.delta_encode(long, 3, form, segment), 3, form)
        assert sorted(back.collect()) == sorted(long.select("ref_id", "obj_id", "pos").collect())
        back = codecs.s9_decode(codecs.s9_encode(long, 3, form, segment), 3, form)
        assert sorted(back.collect()) == sorted(long.select("ref_id", "obj_id", "pos").collect())


def test_code_values(spark):
    x = [1, 2, 3, 4, 7, 8, 16, 100, 128, 255, 256]
    d = spark.createDataFrame([(v,) for v in x], "x long")
    assert [r[0] for r in d.select(codes.delta_length(F.col("x"))).collect()] == [1, 4, 4, 5, 5, 8, 9, 11, 14, 14, 15]
    assert [r[0] for r in d.limit(4).select(codes.delta_bits(F.col("x"))).collect()] == ["1", "0100", "0101", "01100"]
    assert codecs.s9_pack(list(range(10))) == [0x30123456, 0x37890000]
    assert codecs.s9_pack([5, 130, 2**27]) == [0x70014082, 0x88000000 - 2**32]
    with pytest.raises(ValueError):
        codecs.s9_pack([2**28])
    with pytest.raises(ValueError):
        codecs.delta_pack(np.array([0]))
    big = [1, 2**31, 2**40 + 3, 5]
    assert codecs.delta_unpack(codecs.delta_pack(np.array(big))[1], 4).tolist() == big


def test_codes_against_strings_and_words_one_by_one():
    rng = random.Random(1)
    for _ in range(150):
        v = [rng.randrange(1, 2 ** rng.randrange(1, 62)) for _ in range(rng.randrange(0, 80))]
        n, code = codecs.delta_pack(np.array(v, "i8"))
        size = [bin(x.bit_length())[2:] for x in v]
        text = "".join("0" * (len(s) - 1) + s + bin(x)[3:] for s, x in zip(size, v, strict=True))
        assert n == len(text) and np.unpackbits(np.frombuffer(code, "u1"), bitorder="little")[:n].tolist() == list(map(int, text))
        assert codecs.delta_unpack(code, len(v)).tolist() == v
        v, at, words = [rng.randrange(2 ** rng.choice([1, 1, 2, 3, 5, 9, 28])) for _ in range(rng.randrange(0, 90))], 0, []
        while at < len(v):
            mode = next(k for k, (c, w) in enumerate(zip(codes.S9_COUNTS, codes.S9_BITS, strict=True)) if max(v[at : at + c]) < 1 << w)
            count, width = codes.S9_COUNTS[mode], codes.S9_BITS[mode]
            words.append(mode << 28 | sum(x << (28 - width * (k + 1)) for k, x in enumerate(v[at : at + count])))
            at += count
        assert [w % 2**32 for w in codecs.s9_pack(v)] == words
    with pytest.raises(ValueError):
        codecs.delta_unpack(codecs.delta_pack(np.array([5, 6]))[1], 9)


def test_gamma_codes_and_reading_past_the_end(spark):
    d = spark.createDataFrame([(v,) for v in (1, 2, 5, 8)], "x long")
    assert [r[0] for r in d.orderBy("x").select(codes.gamma_bits(F.col("x"))).collect()] == ["1", "010", "00101", "0001000"]
    d = spark.createDataFrame([(codecs.s9_pack([3, 1, 4]), 3)], "words array<int>, n long")
    assert list(d.select(*[codes.s9_value(F.col("words"), F.col("n"), F.lit(i)).alias(f"v{i}") for i in range(5)]).first()) == [3, 1, 4, -1, -1]


def test_gaps_across_runs(spark, monkeypatch):
    """Unbroken chains over several runs, one of them without objects."""
    monkeypatch.setattr(codecs, "SEGMENT", 4)
    rng, objects = random.Random(3), [*range(10), *range(17, 25)]
    rows = [(ref, i, rng.randrange(5)) for ref in range(3) for i in objects]
    d = spark.createDataFrame(rows, "ref_id long, obj_id long, pos long")
    gaps = codecs.gap_values(d, 5)
    want, last = {}, {}
    for ref, i, pos in rows:
        want[ref, i] = (i * 5 + pos - last.get(ref, 0), ref not in last)
        last[ref] = i * 5 + pos
    assert {(r["ref_id"], r["obj_id"]): (r["gap"], r["first"]) for r in gaps.collect()} == want
    assert sorted(map(tuple, codecs.restore_gaps(gaps, 5, 4).collect())) == sorted(rows)


def test_sections_of_several_files_and_of_one_line(spark, tmp_path):
    """Files of a folder follow each other by name, whatever their sizes; several blocks each."""
    folder = tmp_path / "many"
    folder.mkdir()
    numbers, names = list(range(9000)), ["part-0", "part-1", "part-2"]
    for name, (low, high) in zip(names, ((0, 500), (500, 6500), (6500, 9000)), strict=True):
        (folder / name).write_text("".join(f"{x} {x + 1}\n" for x in numbers[low:high:2]))
    (tmp_path / "line.txt").write_text(" ".join(map(str, numbers)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for path, separator in ((folder, "\n"), (tmp_path / "line.txt", " ")):
            found = sections.read_tokens(spark, str(path), separator)
            assert found.where(F.col("t") != F.col("x").cast("long")).count() == 0 and found.count() == 9000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_and_short_files(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        sections.read_sections(spark, str(tmp_path / "none.txt"), "refs_first")
    for text, what in (("2 3", "no header"), (REFS_FIRST[:-4], "tokens")):
        (tmp_path / "short.txt").write_text(text)
        with pytest.raises(ValueError, match=what):
            sections.read_sections(spark, str(tmp_path / "short.txt"), "refs_first")


def test_answers_by_distance(tiny, spark):
    found = search.exact_topk(tiny, 7, "l1")
    asked = spark.createDataFrame([(0, 8.0), (0, 3.5), (2, 14.0)], "q_id long, dist double")
    assert {(r["q_id"], r["dist"]): r["obj_id"] for r in search.lookup_distance(found, asked).collect()} == {(0, 8.0): 1, (0, 3.5): -1, (2, 14.0): 0}
    left = search.remove_distance(found, asked)
    assert ids(left)[2] == [3, 2, 1, 5, 6, 4] and ids(left)[0] == [0, 4, 6, 5, 2, 3]


def test_large_sides_are_not_broadcast(tiny, monkeypatch):
    want = ids(search.footrule_topk(tiny, 3))
    for module, name in ((permutations, "BROADCAST_NUMBERS"), (vectors, "BROADCAST_NUMBERS"), (search, "BULK_NUMBERS")):
        monkeypatch.setattr(module, name, 1)
    for form in (search.footrule_topk, search.footrule_topk_array, search.footrule_topk_bulk, search.permutation_topk):
        found = form(tiny, 3)
        assert ids(found) == want


def test_bulk_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (900, 3)).astype(float).tolist()
    d = lambda rows, key, v: spark.createDataFrame(rows, f"{key} long, {v} array<double>")
    s = vectors.VectorSet(d(list(enumerate(x)), "obj_id", "v").repartition(3), d(list(enumerate(x[:6])), "ref_id", "rv"), d([(k, x[k]) for k in range(0, 900, 20)], "q_id", "qv"))
    want = ids(search.footrule_topk_array(s, 7))
    assert ids(search.footrule_topk_bulk(s, 7)) == want
    monkeypatch.setattr(search, "BULK_NUMBERS", 60)
    assert ids(search.footrule_topk_bulk(s, 7)) == want


def test_past_32_bits(spark):
    d = spark.createDataFrame([(0, 429_497 + k, 3) for k in range(3)], "ref_id long, obj_id long, pos long")
    gaps = codecs.gap_values(d, 5000)
    assert {r["pos"] for r in codecs.restore_gaps(gaps, 5000).collect()} == {3}


def test_index_round_trip(spark, tiny, tmp_path):
    built = index.build_index(tiny)
    index.write_index(built, str(tmp_path / "ix"))
    assert sorted(index.read_index(spark, str(tmp_path / "ix")).collect()) == sorted(built.collect())
    assert tuple(index.parameters(tiny).first()) == (3, 7, 2, 3)


def test_plans_push_down_and_limit(spark):
    s = vectors.split_embeddings(spark, "/root/testdata/sf0.001")
    plan = search.footrule_topk_array(s)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(vec_id" in plan and "WindowGroupLimit" in plan and "label" not in plan
