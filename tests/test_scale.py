"""Work and memory that grow as they should: what is compared, held and read, and how often."""

import numpy as np
import pytest

from pivotlake.operators import codecs, grid, search, vectors
from pivotlake.plans import registry
from pivotlake.sources import formats

SF = "/root/testdata/sf0.001"


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_equal_positions_are_compared_once(spark, monkeypatch):
    """of rows that see the pivots in one order the k smallest ids, of such queries one."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (3000, 2)).astype(float)
    d = lambda keys, key, v: spark.createDataFrame([(int(i), x[i].tolist()) for i in keys], f"{key} long, {v} array<double>")
    s = vectors.VectorSet(d(rng.permutation(3000), "obj_id", "v").repartition(5), d(range(4), "ref_id", "rv"), d(range(0, 3000, 10), "q_id", "qv"))
    met, scanned = [], grid.scanned
    monkeypatch.setattr(grid, "scanned", lambda o, q, *more: met.append((o.count(), q.count())) or scanned(o, q, *more))
    got = sorted(map(tuple, search.footrule_topk_bulk(s, 5).collect()))
    pos = search.positions(x, x[:4])
    kinds = len(np.unique(pos, axis=0))
    assert met[0][0] <= 5 * kinds and met[0][1] <= kinds
    want = []
    for q in range(0, 3000, 10):
        score = np.abs(pos - pos[q]).sum(1)
        want += [(q, rk + 1, int(i), int(score[i])) for rk, i in enumerate(np.lexsort((np.arange(3000), score))[:5])]
    assert got == want
    monkeypatch.setattr(search, "HELD", 200)  # tasks give away early, and queries are dealt
    assert sorted(map(tuple, search.footrule_topk_bulk(s, 5).collect())) == want


def test_neighbouring_ranges_share_a_task(spark, tmp_path, monkeypatch):
    """small ranges make no task each, and tokens are counted once for all sections."""
    rows = np.random.default_rng(3).random((900, 4))
    path = tmp_path / "text"
    path.mkdir()
    lines = ["4 800 60 40", *(" ".join(map(repr, map(float, r))) for r in rows)]
    for k in range(3):
        (path / f"part-{k}").write_text("\n".join(lines[k * 400 : (k + 1) * 400]) + "\n")
    parts = formats.read_parts(spark, str(path), "objects_first", ("objects", "refs", "queries"), block=64)
    assert sum(d.rdd.getNumPartitions() for d in parts) <= 3 * 3
    for d, low, high in zip(parts, (0, 800, 860), (800, 860, 900), strict=True):
        assert [list(r["v"]) for r in d.orderBy("id").collect()] == rows[low:high].tolist()
    monkeypatch.setattr(formats, "TASK", 256)  # several tasks a file go on from where the last one ends
    reader = formats.SectionReader({"path": str(path), "layout": "objects_first", "block": "64"})
    tasks = reader.partitions()
    assert len(tasks) > 100 and all(x.end - x.start <= 256 for x in tasks)
    got = [v for t in tasks for b in reader.read(t) for v in b.column("v").to_pylist()]
    assert got == rows[:800].tolist()


def test_pairs_are_not_sorted(spark):
    """F7 to F11, F13 to F19, F21: what a task sorts or holds before the shuffle is k rows a query."""
    s = vectors.split_embeddings(spark, SF)
    answers = [search.footrule_topk(s), search.footrule_topk_array(s), search.permutation_topk(s), search.exact_topk(s, 20), search.index_topk(search.rank_arrays(s), *search.ranked_queries(s), late=True)]
    for d in answers:
        plan = plan_of(d)
        assert "MapInArrow" in plan and "Sort" in plan[: plan.index("MapInArrow")]
        assert "array<bigint>" not in plan and "qpos" not in plan and "qv" not in plan  # no pair is a row
    plan = plan_of(search.footrule_scores(s))
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("metric", ["l2", "l1", "l2_single"])
def test_kernels_equal_column_folds(spark, monkeypatch, metric):
    """Tiles and single floats change no bit of a distance; queries with many answers are dealt."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 4000, (400, 5)).tolist() if metric == "l2_single" else rng.normal(size=(400, 5)).tolist()
    kind = "int" if metric == "l2_single" else "double"
    d = lambda keys, key, v: spark.createDataFrame([(k, x[k]) for k in keys], f"{key} long, {v} array<{kind}>")
    s = vectors.VectorSet(d(range(400), "obj_id", "v"), d(range(4), "ref_id", "rv"), d(range(0, 400, 8), "q_id", "qv"))
    want = sorted(map(tuple, search.smallest(vectors.pairwise(s.objects, s.queries, 250, "v", "qv", metric, "dist"), 9, "dist").collect()))
    assert sorted(map(tuple, search.exact_topk(s, 9, metric).collect())) == want
    monkeypatch.setattr(search, "HELD", 100)
    monkeypatch.setattr(grid, "TILE", 300)
    assert sorted(map(tuple, search.exact_topk(s, 9, metric).collect())) == want


def test_answers_are_made_once(spark, monkeypatch):
    """what reads the exact answers several times reads stored ones."""
    calls, own = [], search.exact_topk
    monkeypatch.setattr(search, "exact_topk", lambda *a: calls.append(a) or own(*a))
    for query in (registry.answer_lookup, registry.answer_remove):
        plan = plan_of(query(spark, SF))
        assert "embedding" not in plan and "answers-" in plan
    assert len(calls) == 2


@pytest.mark.parametrize("kind,kernel,name", [("f8", "l2", "double"), ("f4", "l2_single", "integers"), ("f8", "l2", "far"), ("f8", "l2", "huge")])
def test_few_euclidean_scores_are_made(monkeypatch, kind, kernel, name):
    """F2 to F6, F9: of the pairs only those that may be answers are scored, and no bit changes; with
    many ties, and where rounding leaves the matrix product without use."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 256, (6000, 24)) if name == "integers" else rng.normal(size=(6000, 24)) * (1e160 if name == "huge" else 1) + (1e9 if name == "far" else 0)
    x[3000:4000] = x[:1000]
    y, ids = x[::100], rng.permutation(6000)
    score = grid.KERNELS[kernel](x, y)
    want = [(q, score[i, q], ids[i]) for q in range(len(y)) for i in np.lexsort((ids, score[:, q]))[:7]]
    made, own = [], grid.KERNELS[kernel]
    monkeypatch.setitem(grid.KERNELS, kernel, lambda a, b: made.append(len(a) * len(b)) or own(a, b))
    best = grid.Best(len(y), 7, kind)
    for at in range(0, 6000, 1500):
        best.scan(ids[at : at + 1500], x[at : at + 1500], y, kernel)
    best.settle()
    assert list(zip(best.q.tolist(), best.s, best.i, strict=True)) == want
    if name in ("double", "integers"):
        assert sum(made) < 6000 * len(y) / 4


def test_first_block_keeps_k_rows_a_query():
    """F2 to F6, F9, F10: what the first rows bring is cut to k a query before it is sorted."""
    scores = np.random.default_rng(5).random((512, 300))
    best = grid.Best(300, 10, "f8")
    best.add(np.arange(512), scores)
    assert best.n + len(best.q) <= 300 * 10
    best.settle()
    assert best.i.reshape(300, 10).tolist() == np.argsort(scores, 0)[:10].T.tolist()


def chain(spark):
    """Positions of two pivots, a table that Spark takes for small."""
    return spark.range(600).selectExpr("id % 2 as ref_id", "id div 2 as obj_id", "(id div 2 + id) % 2 as pos")


def test_gaps_stay_dealt_by_runs(spark):
    """rows of a chain are not broadcast to where its runs' last cells lie, a whole chain in a task."""
    gaps = codecs.gap_values(chain(spark), 2)
    for d in (gaps, codecs.restore_gaps(gaps, 2, 128)):
        plan = plan_of(d)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_coders_rank_once(spark):
    """coders read positions several times, from a stored index and not by ranking again."""
    for name in ("delta_topk_gap", "s9_topk_gap", "delta_roundtrip_pos", "s9_words_gap"):
        plan = plan_of(registry.queries()[name](spark, SF))
        assert "embedding" not in plan and "index-" in plan


def test_segments_stay_dealt(spark):
    """nor are segments broadcast to where their neighbours' ends, maps or entries were made."""
    plan = plan_of(codecs.s9_encode(chain(spark), 2, "gap", 16))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
