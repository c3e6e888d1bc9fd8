"""Near duplicates, language ID, classifier, nearest neighbours, packing, pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from pivotlake.llm import annforest, langid, neardup, packing, ranker
from pivotlake.llm.common import Scratch


def brute_components(rows):
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((i, set(zip(w, w[1:], strict=False)) or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    number = {g: k for k, g in enumerate({g for _, own in sets for g in own})}
    table = np.zeros((len(sets), len(number)), "f4")
    for k, (_, own) in enumerate(sets):
        table[k, [number[g] for g in own]] = 1
    both, size = table @ table.T, table.sum(1)
    alike = (both > 0) & (100 * both >= 80 * (size[:, None] + size - both))
    for i, j in np.argwhere(np.triu(alike, 1)):
        x, y = sorted((find(sets[i][0]), find(sets[j][0])))
        root[y] = x
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def copies(rng, n, group, length=60):
    """Chains of near copies: each differs in a few words from an earlier one of its group."""
    out = []
    while len(out) < n:
        own = [[f"w{rng.randrange(10**6)}" for _ in range(length)]]
        for _ in range(group - 1):
            t = list(rng.choice(own))
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            own.append(t)
        out += [" ".join(t) for t in own]
    return out[:n]


@pytest.mark.parametrize(("n", "group"), [(120, 6), (260, 260)])
def test_near_duplicates_against_all_pairs(spark, n, group):
    rows = list(enumerate(copies(random.Random(n), n, group)))
    want, sizes = brute_components(rows)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd, size=2).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[2]["component_id"] == 1 and by[7]["component_id"] == 6
    assert by[3]["n_shingles"] == 0 and by[3]["kept"] and by[8]["n_shingles"] == 1
    assert by[5]["component_id"] == 5 and by[4]["component_id"] == 4  # empty texts link with nothing
    left = neardup.drop_near_duplicates(odd)
    # of the repeated row 1 one stays; of rows without an id that with a text and that without
    assert left.columns == odd.columns and sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in left.collect()) == [(0, ""), (0, "der"), (1, "the"), (3, ""), (4, ""), (5, " \n\t"), (6, "one"), (8, "wor"), (9, "tok")]
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_components_of_any_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for local in (0, 10_000):  # by rounds of joins, and in one task
        with Scratch() as keep:
            got = {r["child"]: r["root"] for r in neardup.contract(spark.createDataFrame(edges, "a long, b long"), keep, local).collect()}
        assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


def test_shingle_sets_are_exact():
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join(rng.choice(["a", "b", "ab", "\x00", "\x00\x00", "é", "A"]) for _ in range(rng.randrange(0, 30)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t.replace("A", "a"))
        want = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} - {()}
        assert len(neardup.shingle_set(t)) == len(want)


TEXTS = {
    "en": "the house of the king is in a valley and it was on the hill",
    "de": "das Haus des Königs ist nicht auf dem Berg und die Tür ist zu",
    "fr": "la maison du roi est dans une vallée et elle est sur la colline",
    "es": "la casa del rey está en el valle y los niños no se van por la colina",
}


def test_language(spark, odd, none):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(TEXTS.items())]
    d = spark.createDataFrame(rows, "doc_id long, text string, want string")
    assert all(r["language"] == r["want"] and r["kept"] for r in langid.identify(d, F.col("text")).select("row.want", "language", "kept").collect())
    found = langid.identify(odd, F.col("text"), declared=F.col("lang"), host=F.col("source")).select("row.doc_id", "row.text", "language", "kept")
    assert found.count() == odd.count() and not any(r["kept"] for r in found.where("text is null or trim(text) = ''").collect())
    kept = langid.keep_identified(odd, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == odd.columns and langid.keep_identified(none, F.col("text")).count() == 0


def test_language_evidence_adds_up(spark):
    """A text that says little goes with its declared language, else its host; one that says
    much goes with itself."""
    plain = [(k, TEXTS["de"], None, "h.example.org") for k in range(40)] + [(50 + k, TEXTS["fr"], None, "f.example.net") for k in range(40)]
    rows = [*plain, (100, "xqz", "fr", "q"), (101, "vwx la", None, "h.example.org"), (102, "vwx la", None, "f.example.net"), (103, "xqz", None, "q"), (104, TEXTS["de"], "fr", "f.example.net"), (105, "xqzw qxxj kwqz " * 40, "fr", "f.example.net"), (106, "жили были дед и баба " * 5, "en", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    got = {r["doc_id"]: r for r in langid.identify(d, F.col("text"), declared=F.col("lang"), host=F.col("host")).select("row.doc_id", "language", "posterior", "kept").collect()}
    assert got[100]["language"] == "fr" and got[103]["language"] == "und" and got[104]["language"] == "de"
    assert got[102]["language"] == "fr" and (got[101]["language"] != "fr" or got[101]["posterior"] < got[102]["posterior"])
    assert not got[105]["kept"] and not got[106]["kept"]


def test_fusion_against_plain_arithmetic(spark):
    """Posteriors by loops over rows, from the same trigram table."""
    rng = random.Random(12)
    bits = [w for t in TEXTS.values() for w in t.split()] + ["qx", "zzt", "1"]
    hosts = ["a.one.com", "b.one.com", "c.two.org", "plain", None]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) or None, rng.choice(["en", "de-AT", "FR", "xx", None]), rng.choice(hosts)) for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = langid.learn_trigrams(d, F.col("text"))
    names, n = langid.CLASSES, len(langid.CLASSES)
    softmax = lambda x: np.exp(x - np.max(x)) / np.exp(x - np.max(x)).sum()
    seen, fused, named = {}, {}, {}
    for i, t, lang, _ in rows:
        *logs, grams = langid.text_evidence(t, model)
        lang = (lang or "")[:2].lower()
        seen[i], x = (logs, grams), np.array(logs)
        if lang in langid.LANGUAGES:
            x += np.log([0.85 if c == lang else 0.25 if c == "und" else 0.05 for c in names])
        fused[i], named[i] = x, lang in langid.LANGUAGES and any(c.isalpha() for c in t or "")
    hosts, domains, corpus = {}, {}, np.zeros(n)
    parent = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
    for i, _, _, h in rows:
        if seen[i][1] > 0:
            p = softmax(fused[i])
            hosts[h] = hosts.get(h, 0) + p
            if parent(h):
                domains[parent(h)] = domains.get(parent(h), 0) + p
            corpus += p
    corpus = (corpus + langid.CORPUS_WEIGHT / n) / (corpus.sum() + langid.CORPUS_WEIGHT)
    for r in langid.identify(d, F.col("text"), declared=F.col("lang"), host=F.col("host")).select("row.doc_id", "row.host", "language", "posterior", "kept").collect():
        i, h, prior = r["doc_id"], r["host"], corpus
        if parent(h) in domains:
            prior = (domains[parent(h)] + langid.DOMAIN_WEIGHT * corpus) / (domains[parent(h)].sum() + langid.DOMAIN_WEIGHT)
        if h in hosts:
            prior = (hosts[h] + langid.HOST_WEIGHT * prior) / (hosts[h].sum() + langid.HOST_WEIGHT)
        else:
            prior = corpus
        post = softmax(fused[i] + np.log(prior))
        name = names[int(np.argmax(post))] if max(seen[i][0][:-1]) > 0 or named[i] else "und"
        assert (r["language"], r["kept"]) == (name, name != "und" and post.max() >= 0.5) and r["posterior"] == pytest.approx(post.max(), abs=1e-6)


def test_language_of_documents_without_a_declared_one(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null")
    rows = langid.identify(d, F.col("text"), ["lang"]).select("row.lang", "language", "kept").collect()
    assert sum(r["lang"] == r["language"] and r["kept"] for r in rows) / len(rows) > 0.98


def test_language_of_long_and_odd_pages(spark):
    page = lambda t: f'<html lang="de"><script>the of and to {"the " * 50}</script><body>{t}</body></html>'
    rows = [(0, "http://a.example.de/x", page(TEXTS["de"] * 3)), (1, None, page("la maison du roi est dans la vallée " * 20_000)), (2, "http://a.example.de/x", None), (3, "", ""), (None, "no address", "<p>the house of the king is in a valley</p>")]
    got = {r["page_id"]: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), carry=["page_id"]).select("row.page_id", "language", "kept").collect()}
    assert {k: (r["language"], r["kept"]) for k, r in got.items()} == {0: ("de", True), 1: ("fr", True), 2: ("und", False), 3: ("und", False), None: ("en", True)}


def test_language_of_pages(spark):
    p = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = langid.identify_pages(p).select("row.url", "language").collect()
    told = [(m[1], r["language"]) for r in rows if (m := re.search(r"/(en|de|fr|es)/", r["url"]))]
    assert sum(a == b for a, b in told) / len(told) > 0.95


def test_ranker_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = ranker.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_ranker_features_by_hand():
    text = "The cat the cat\n\nthe Cat É! a|b 12\r\n the cat"
    w = text.split()
    f = ranker.text_features(text)
    pairs = list(zip(w, w[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    assert len(f) == ranker.N_BASE and len(ranker.text_features("  ")) == ranker.N_BASE
    assert f[0] == pytest.approx(math.log1p(len(w))) and f[1] == pytest.approx(sum(map(len, w)) / len(w) / 10)
    assert f[4] == pytest.approx(sum(pairs.count(p) > 1 for p in pairs) / len(w))
    assert f[7] == pytest.approx(sum(x[0].isupper() for x in w) / len(w)) and f[8] == pytest.approx(2 / len(text))
    assert f[11] == pytest.approx(sum(map(len, lines)) / len(text)) and f[12] == pytest.approx(1 / len(w))
    assert ranker.text_features("ab " * 400_000)[4] == pytest.approx(1, abs=1e-5)


def test_ranker_fit_is_the_least_loss():
    """Pairs join a good and a bad row, every row takes part, and the gradient of the
    logistic loss on feature differences, by finite steps, is zero at the weights."""
    rng = np.random.default_rng(2)
    y = (rng.random(120) < 0.4).astype(int)
    x = np.abs(rng.standard_normal((120, 3)) + 0.8 * y[:, None])
    model = ranker.fit_pairs(x, y)
    good, bad = ranker.preference_pairs(y)
    assert set(y[good]) == {1} and set(y[bad]) == {0} and set(good) | set(bad) == set(range(120))
    z = (ranker.expand(x) - model["mean"]) / model["scale"]
    diff = z[good] - z[bad]
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + ranker.RIDGE / 2 * w @ w
    for k in range(len(model["w"])):
        step = np.eye(len(model["w"]))[k] * 1e-4
        assert abs(loss(model["w"] + step) - loss(model["w"] - step)) / 2e-4 < 1e-6
    scores = z @ model["w"]
    assert (scores < model["cut"]).sum() == (y == 0).sum()


def test_ranker_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (9, 1), (77, 1), (None, 1), (2, None), (2, 1), (6, 0)], "doc_id long, quality int")
    model = ranker.train(odd, labels)
    rows = ranker.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert ranker.train(none, labels) is None and ranker.train(odd, labels.where("false")) is None
    assert {r["score"] for r in ranker.score_documents(odd, None).collect()} == {0.5}
    assert ranker.score_documents(none, model).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 1200)] + 0.3 * rng.standard_normal((1200, 24))).astype("f4")
    x[700:1100] = x[700]  # a third of the rows share one vector
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    odd_rows = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [float("inf")] * 24), (5004, [None] * 24), (5005, [1.0]), (None, [1.0] * 24), (3, rows[3][1])]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows + odd_rows], "vec_id long, embedding array<float>, score int, rank int")
    got = {}
    for r in annforest.nearest(d, d.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1200, 50):
        cos = u @ u[q]
        cos[q] = -9
        best = sorted(range(1200), key=lambda i: (-round(cos[i], 12), i))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len(set(best) & {v for v, _ in got[q].values()})
        assert all(s == pytest.approx(cos[v], abs=1e-12) for v, s in got[q].values())
    assert hits / (5 * 24) >= 0.9 and [got[750][k][0] for k in range(1, 6)] == [700, 701, 702, 703, 704]
    assert set(got) == set(range(0, 1200, 50))


def test_neighbours_of_scaled_vectors(spark):
    """Vectors of one direction tie, whatever their lengths; the smaller ids come first."""
    rng = np.random.default_rng(5)
    one, rest = rng.standard_normal(8), rng.standard_normal((300, 8))
    rows = [(k, (one * 2.0 ** (k % 40 - 20)).tolist()) for k in range(60)] + [(100 + k, v.tolist()) for k, v in enumerate(rest)] + [(900, (one * 2.0**990).tolist()), (950, (one * 2.0**-990).tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in annforest.nearest(d, d.where("vec_id in (0, 50, 950)")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert got[0] == [(k, 1.0) for k in range(1, 6)] and got[50] == [(k, 1.0) for k in range(5)]


def clustered(rng, n, dim=32):
    centres = rng.standard_normal((max(20, n // 100), dim))
    return centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("n", [2_000, 51_282, 200_000])
def test_forest_recall_and_share_compared(n):
    """At least 0.9 of the neighbours in the leaves of the queue, at a measured share, and a
    part of the rows that falls as clustered tables grow."""
    x = annforest._unit(clustered(np.random.default_rng(n), n))
    sample = x[np.random.default_rng(1).permutation(n)[: annforest.SAMPLE]]
    forest = annforest.Forest(sample, n)
    share, own = forest.share(sample, 5), forest.leaves(x)
    hits, part = 0, []
    for q in range(0, n, n // 60):
        seen = np.isin(own, forest.search(x[q], share)).any(1)
        cos = x @ x[q]
        cos[q] = -2
        hits += seen[np.argsort(-cos)[:5]].sum()
        part.append(seen.mean())
    assert hits / (5 * len(part)) >= 0.9
    assert np.mean(part) < {2_000: 0.7, 51_282: 0.1, 200_000: 0.05}[n]


def test_queue_order_is_that_of_the_margins():
    x = annforest._unit(np.random.default_rng(3).standard_normal((3000, 16)))
    forest = annforest.Forest(x, 3000)
    for q in x[:20]:
        far = forest.distances(q)
        found = forest.search(q, 100.0)
        assert sorted(found) == list(range(len(far))) and np.all(np.diff(far[found]) >= -1e-12)
    # a leaf holds about as many rows as asked for, and every row is in one leaf of each tree
    own = forest.leaves(x)
    assert all(np.bincount(own[:, t] - t * (forest.inner + 1)).max() <= 2 * annforest.LEAF for t in range(forest.trees))


def test_neighbours_few(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = annforest.nearest(d, d.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 50), (0, 7), (50, 0), (50, 7)]
    none = d.where("false")
    assert annforest.nearest(none, none).count() == 0


@pytest.fixture(scope="module")
def chunks():
    return packing.ChunkIds(packing._tokenizer_path(packing.TOKENIZER))


def test_tokens(chunks, duck):
    texts = [r[0] for r in duck.execute("select text from documents").fetchall()]
    texts += ["it's don't we'LL café CAFÉ ß ſ İstanbul 日本 é a\x1cb ² x3 <|endoftext|>x foo<|startoftext|> ___ x\u0085z Σας", "", " \n", "\x00\x01 a\x00b", "\U0001F642 …", "z" * 5000]
    for t in texts:
        assert np.frombuffer(chunks.encode(t), "<u4").tolist() == chunks.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokens_of_another_tokenizer(chunks):
    other = packing.ChunkIds(packing._tokenizer_path("byte_bpe_50k.json"))
    assert chunks.by_rank and not other.by_rank
    for t in ("Hello  the World's é\n x", "", "a b"):
        assert np.frombuffer(other.encode(t), "<u4").tolist() == other.tokenizer.encode(t, add_special_tokens=False).ids


def test_fullest_against_all_subsets():
    rng = random.Random(6)
    for _ in range(100):
        items = sorted(rng.randrange(1, 30) for _ in range(9))
        counts = [items.count(x) for x in range(41)]
        found = packing.fullest(counts, items[-1], 40)
        rest = items[:-1]
        best = max(sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if items[-1] + sum(c) <= 40)
        assert sum(k * n for k, n in found.items()) == items[-1] + best and all(counts[k] >= n for k, n in found.items())


def test_idle_workers_keep_no_chunks(spark):
    """The pipeline failed by what several idle workers an executor held of the tokenizer's cache."""

    def held(batches):
        import pyarrow as pa

        from pivotlake.llm import packing

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.chunk_ids(packing._tokenizer_path(packing.TOKENIZER)))])], ["n"])

    d = spark.createDataFrame([(k, f"some text number{k} of words{k % 7}") for k in range(64)], "doc_id long, text string").repartition(16)
    assert packing.cut_pieces(d).count() == 64
    assert {r["n"] for r in d.mapInArrow(held, "n long").collect()} == {0}


def test_packing(spark, odd, none, chunks):
    rows = packing.pack_documents(odd).collect()
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    for i, t in texts.items():
        ids = chunks.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = {(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
        assert docs[i] == want
    assert len(seqs) == -(-sum(r["length"] for r in rows) // 4096) and packing.pack_documents(none).count() == 0


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), DATA).count() == 0
    sequences = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_pipeline_against_its_stages_by_hand(spark, chunks):
    """Rows in, rows out and tokens kept, stage by stage, by plain Python."""
    import corpus_pipeline

    rng = random.Random(13)
    base = [" ".join(rng.choice(TEXTS["de" if k % 2 else "en"].split()) + str(k) * (j % 3 == 0) for j in range(60)) for k in range(30)]
    rows = [(k, t, "de" if k % 2 else "en", f"s{k % 4}") for k, t in enumerate(base)]
    rows += [(100 + k, t, r[2], r[3]) for k, (t, r) in enumerate(zip(base[:10], rows, strict=False))]  # exact copies
    rows += [(200 + k, t + " tail", r[2], r[3]) for k, (t, r) in enumerate(zip(base[10:15], rows[10:], strict=False))]  # near copies
    rows += [(300, "12 34 -- 56", "en", "s0"), (301, "", "en", "s1"), (302, None, None, None), (303, "the key of the house is token = abcdefgh12345678 and that is it for the day", "en", "s2")]
    docs = spark.createDataFrame([(i, t, la, so, len(t or "")) for i, t, la, so in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = spark.createDataFrame(stage[0](spark, docs, DATA).collect(), docs.schema)
    assert {r["doc_id"] for r in one.collect()} == {i for i, *_ in rows} - {300, 301, 302}
    two = spark.createDataFrame(stage[1](spark, one, DATA).collect(), docs.schema)
    assert {r["doc_id"] for r in two.collect()} == set(range(30)) | {303}
    three = spark.createDataFrame(stage[2](spark, two, DATA).collect(), docs.schema)
    text = {r["doc_id"]: r["text"] for r in three.collect()}
    assert text == {k: t for k, t in enumerate(base)} | {303: "the key of the house is [secret] and that is it for the day"}
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())
    four = stage[3](spark, three, DATA).collect()
    copies = Counter(r["doc_id"] for r in four)
    size = Counter()
    for r in three.collect():
        size[r["source"]] += len(r["text"].split())
    # weights 5, 2, 1, 5 over sizes; each source's words come near its target, in whole copies
    level, weight, full = None, dict(zip(sorted(size), (5, 2, 1, 5), strict=True)), set()
    while level is None or any(weight[s] * level > 3 * size[s] for s in size if s not in full):
        full |= {s for s in size if level is not None and weight[s] * level >= 3 * size[s]}
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
    for r in three.collect():
        rate = min(3, weight[r["source"]] * level / size[r["source"]])
        assert copies[r["doc_id"]] in (math.floor(rate), math.floor(rate) + (rate % 1 > 0))
    five = stage[4](spark, spark.createDataFrame(four, docs.schema), DATA).collect()
    want = Counter()
    for r in four:
        want[r["doc_id"]] += len(chunks.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got = Counter()
    for r in five:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_pipeline_stage_compares_five_words(spark):
    """The near-dedup stage against all pairs, on exact sets of five-word shingles."""
    import corpus_pipeline

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rng = random.Random(9)
    for k in range(40):  # few words changed: alike in pairs of words, not in runs of five
        t = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        u = list(t)
        for at in rng.sample(range(60), k % 5):
            u[at] = f"y{rng.randrange(10**6)}"
        rows += [(10**6 + 2 * k, " ".join(t)), (10**6 + 2 * k + 1, " ".join(u))]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    out = corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in sets if find(i) == i)


def test_language_query_covers_pages_and_documents(spark):
    found = langid.op3_language_id(spark, DATA).collect()
    docs, pages = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "pages"))
    assert sorted(r["doc_id"] for r in found if r["page_id"] is None) == sorted(r["doc_id"] for r in docs.collect())
    own = {r["page_id"]: r["language"] for r in found if r["page_id"] is not None}
    addresses = {r["page_id"]: r["url"] for r in pages.collect()}
    assert own.keys() == addresses.keys()
    told = [(m[1], own[i]) for i, u in addresses.items() if (m := re.search(r"/(en|de|fr|es)/", u))]
    assert sum(a == b for a, b in told) / len(told) > 0.95


def test_signature_filter_misses_less_than_the_trees():
    """Binomial chances, for a pair of similarity 0.8, to agree in fewer tokens than asked."""
    n = neardup.TREES * neardup.COORDINATES
    agreed = [math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(neardup.LEAST)]
    assert sum(agreed) < (1 - 0.9375) ** neardup.TREES / 10


def test_signature_tokens_agree_as_the_sets_do():
    rng, a = np.random.default_rng(3), neardup._multipliers()
    agree = []
    for _ in range(200):
        x = rng.integers(0, 2**64, 900, "u8")
        agree.append((neardup.signature(np.unique(x[:850]), a) == neardup.signature(np.unique(np.r_[x[:800], x[850:]]), a)).mean())
    assert abs(np.mean(agree) - 800 / 900) < 0.01 and abs(np.std(agree) - (8 / 81 / len(a)) ** 0.5) < 0.006


def check_all_pairs(spark, rows):
    want, _ = brute_components(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    return want


def test_unlike_documents_that_share_a_passage(spark, monkeypatch):
    """A passage in 300 documents makes nodes larger than a leaf, without a single link. With
    leaves and blocks this small, nodes branch and are compared in several blocks as well."""
    monkeypatch.setattr(neardup, "LEAF", 40)
    monkeypatch.setattr(neardup, "BLOCK", 30)
    monkeypatch.setattr(neardup, "DEPTH", 3)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40 + k % 50))) for k in range(300)]
    want = check_all_pairs(spark, rows + [(1000 + k, t + " more") for k, t in rows[:20]])
    assert sum(k != c for k, c in want.items()) == 20


@pytest.mark.parametrize("leaf", [None, 50])
def test_near_copies_around_and_beside_one_core(spark, monkeypatch, leaf):
    """2,000 near copies of one text: most are close to it, many not to each other; some only
    to another copy, so that links run through documents outside the core's reach."""
    if leaf:
        monkeypatch.setattr(neardup, "LEAF", leaf)
        monkeypatch.setattr(neardup, "BLOCK", 40)
        monkeypatch.setattr(neardup, "DEPTH", 3)
        monkeypatch.setattr(neardup, "LOCAL_LINKS", 0)
    rng = random.Random(8)
    core = [f"c{k}" for k in range(60)]
    rows, last = [], core
    for k in range(600 if leaf else 2000):
        t = list(core if k % 10 else last)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        last = t
        rows.append((k, " ".join(t)))
    rng.shuffle(rows)
    want = check_all_pairs(spark, rows)
    assert 1 < len(set(want.values())) < len(rows) * 3 / 4


def test_near_copies_of_very_different_lengths(spark):
    rng = random.Random(11)
    rows = []
    for n in (1, 2, 3, 5, 9, 30, 400, 9000):
        for _ in range(6):
            own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for _ in range(4):
                t = list(own)
                t[rng.randrange(n)] = f"y{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(t[: rng.randrange(max(1, n - n // 12), n + 1)])))
    check_all_pairs(spark, rows)


def test_links_of_a_cell_are_a_forest():
    """However many documents of a cell are alike, links are fewer than documents, and none
    joins what is joined already."""
    import pyarrow as pa

    a = neardup._multipliers()
    sets = [neardup.shingle_set(t) for t in copies(random.Random(4), 150, 50)]
    n = len(sets)
    rows = pa.RecordBatch.from_pydict({"node": [1] * n, "asked_block": [0] * n, "block": [0] * n, "id": list(range(n)), "asks": [True] * n, "brief": [neardup.signature(x, a).astype("u1").tobytes() for x in sets], "comp": list(range(n)), "set": [x.tobytes() for x in sets]})
    links = [(x.as_py(), y.as_py()) for b in neardup._links(iter([rows])) for x, y in zip(b["a"], b["b"], strict=True)]
    root = list(range(n))
    for x, y in links:
        p, q = x, y
        while root[p] != p:
            p = root[p]
        while root[q] != q:
            q = root[q]
        assert p != q and neardup.similar(sets[x], sets[y])
        root[max(p, q)] = min(p, q)
    pairs = sum(neardup.similar(sets[i], sets[j]) for i, j in itertools.combinations(range(n), 2))
    assert len(links) < n < pairs


def test_rows_of_one_id_and_of_none(spark):
    """An id with two texts joins what is like either; rows without an id link as well, but
    name nothing, and one of a component of such rows stays."""
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(5)]
    rows = [(1, text[0]), (2, text[1]), (5, text[0] + " x"), (5, text[1] + " y"), (7, text[2]), (None, text[2] + " z"), (None, text[3]), (None, text[3] + " u"), (None, text[3]), (9, text[4]), (9, text[4])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(d).collect())
    assert got == [(0, 0, True)] * 3 + [(0, 7, False), (1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (9, 9, True), (9, 9, True)]
    left = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(d).collect()]
    assert sorted(i or 0 for i, _ in left) == [0, 1, 7, 9] and next(t for i, t in left if i is None).startswith(text[3])
