"""Personal data, fill-in-middle, collocations: against brute force, and on odd rows."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from pivotlake.llm import chat, collocations, fim, pii

# --- fill in the middle -----------------------------------------------------------------


def brute_cut(text, h):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    one, two = sorted(x % (len(units) + 1) for x in h)
    return len(units), any(m in text for m in fim.MARKS), len("".join(units[:one])), len("".join(units[:two]))


def test_automaton_on_random_texts():
    rng, automaton = random.Random(5), fim.Automaton()
    for _ in range(400):
        text = "".join(rng.choice("<PSM>\n\nab\U0001F600") for _ in range(rng.randrange(0, 60)))
        h = (rng.randrange(2**32), rng.randrange(2**32))
        for chunk in (1, 3, 7, 100):
            assert fim.cut_text(automaton, text, h, chunk) == brute_cut(text, h), (text, h, chunk)


def test_functions_compose_associatively():
    rng, automaton = random.Random(2), fim.Automaton(("<PRE>", "PRE<", "EE"))
    parts = ["".join(rng.choice("<PRE>\nx") for _ in range(rng.randrange(0, 9))) for _ in range(30)]
    scanned = [automaton.scan(p) for p in parts]
    for a, b, c in zip(scanned, scanned[1:], scanned[2:], strict=False):
        left, right = fim.compose(fim.compose(a, b), c), fim.compose(a, fim.compose(b, c))
        assert all(np.array_equal(x, y) for x, y in zip(left, right, strict=True))
    whole = automaton.scan("".join(parts))
    state, count = fim.entries(*map(np.stack, zip(*scanned, strict=True)))
    assert (state[-1], count[-1]) == (whole[0][0], whole[1][0])
    for _ in range(300):
        text = "".join(rng.choice("<PRE>\nx") for _ in range(rng.randrange(0, 30)))
        assert (automaton.scan(text)[0][0] >= automaton.found) == any(m in text for m in ("<PRE>", "PRE<", "EE")), text


def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n, marked, a, b = brute_cut(text, h[:2])
    if not text or marked or h[2] % 100 >= rate:
        return n, "plain", text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("giant", [fim.GIANT, 20])
def test_fill_in_middle(spark, odd, none, giant):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b\n", "\n", "é\U0001F600 ", "<P", "x<S>" if k % 9 == 0 else "<"]) for _ in range(rng.randrange(0, 200))) for k in range(60)]
    d = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    made = fim.fill_in_middle(d, giant=giant, chunk=16, rate=80).select("id", "text", "n", "form", "output", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(made) == d.count()
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    for r in made:
        assert (r["n"], r["form"], r["output"]) == brute_fim(r["id"], r["text"], rate=80)
        assert r["back"] == r["text"]
    assert fim.fill_in_middle(none, giant=giant).count() == 0
    assert fim.fill_in_middle(odd, giant=giant).select("row.*").columns == [c for c in odd.columns if c != "text"]


def test_giant_text(spark):
    text = "".join(f"line {k} {'x' * (k % 50)}\n" for k in range(120_000)) + "end"
    d = spark.createDataFrame([(1, text), (1, text), (2, text[:-1])], "doc_id long, text string")
    for r in fim.fill_in_middle(d).select("id", "text", "n", "form", "output").collect():
        assert (r["n"], r["form"], r["output"]) == brute_fim(r["id"], r["text"])


# --- collocations -----------------------------------------------------------------------


def brute_collocations(rows, depth=3, least=10, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


@pytest.mark.parametrize(("depth", "block"), [(3, 1 << 20), (3, 40), (2, 64), (4, 200)])
def test_collocations(spark, odd, none, depth, block):
    rng = random.Random(depth + block)
    vocabulary = ["a", "B", "New", "york", "city", "é", "a\x01", "x-y", "\U0001F600", "the"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randrange(0, 60))) for _ in range(90)]
    rows = [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("fr", ""), ("en", "new york city " * 15)]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(d, depth, 10, block=block).collect()}
    assert got == brute_collocations(rows, depth)
    assert len(got) > 5
    if depth == 3 and block > 1000:
        assert {r["phrase"] for r in collocations.top_collocations(collocations.collocations(odd)).collect()} == {p for _, p in brute_collocations([(r["lang"], r["text"]) for r in odd.collect()])}
        assert collocations.top_collocations(collocations.collocations(none)).count() == 0


def test_phrases_that_do_not_pass_are_not_made(monkeypatch):
    """Of a filtered level only the nodes that pass are sorted and named; tokens are those of the pattern."""
    made, own = [], collocations.pc.binary_join_element_wise
    monkeypatch.setattr(collocations.pc, "binary_join_element_wise", lambda a, b, s: made.append(len(a)) or own(a, b, s))
    few = np.zeros(collocations.FILTER_BITS // 64, "u8")
    for path in ("new york", "york city"):
        slot = collocations._path_slot("en", path)
        few[slot >> 6] |= np.uint64(1 << (slot & 63))
    shard = collocations.Shard(3, frequent=collocations.Filter(few))
    text = "New York city. new york\tcity, york city hall\x0b" + " ".join(f"w{k % 97}" for k in range(5000))
    rows = [r for b in [*shard.add("en", text), *shard.trie()] for r in b.to_pylist()]
    assert rows == [{"lang": "en", "phrase": "new york city", "words": 3, "f": 2}]
    assert sum(made) <= 2
    texts = [b"a b\n", b"\n", b" .x\x0b\ty,, z!\xc3\xa9\n"]
    tokens, size = collocations._tokens(texts)
    assert tokens.to_pylist() == [w for x in texts for w in collocations._TOKEN.findall(x)]
    assert size.tolist() == [len(collocations._TOKEN.findall(x)) for x in texts]


def test_full_filter_changes_nothing(spark, monkeypatch):
    rows = [("en", "of the house of the dog " * 20), ("en", "in the house, of the cat in the house " * 12)]
    d = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "frequent_paths", lambda trie: collocations.Filter(np.full(collocations.FILTER_BITS // 64, 2**64 - 1, "u8")))
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(d).collect()}
    assert got == brute_collocations(rows)


def test_ties_rank_by_bytes(spark):
    d = spark.createDataFrame([("en", "b\x01 c. b c. é z. z z. " * 10)], "lang string, text string")
    got = [r["phrase"] for r in collocations.top_collocations(collocations.collocations(d)).orderBy("rank").collect()]
    brute = brute_collocations([("en", "b\x01 c. b c. é z. z z. " * 10)])
    assert got == [p for _, p in sorted(brute, key=lambda x: (-brute[x][4], -brute[x][0], x[1].encode()))]


# --- personal data ----------------------------------------------------------------------


def luhn(digits):
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * c, 10)) for c in own[1::2])) % 10 == 0


def brute_base(t):
    only = lambda m: re.sub("[^0-9]", "", m)
    found = [(m.start(), 0, m.end()) for m in re.finditer(pii.EMAIL, t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(pii.IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(pii.CARD, t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(pii.PHONE, t) if 9 <= len(only(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in sorted(found))


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


TRICKY = [
    "a@b.c_x@d.e a@b@c.d x@y a@b. a..b@-.-", "1.2.3.4.5 001.002.003.255 1.2.3.256 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111111111111", "+1 (132) 555-1352 999.999.99.99 +1 () 2 +123456789 +12-34", "+49 151 23456789",
    "\U0001F600é 4111111111111111 joe@x.com", "", "5" * 30, "1 2 3 4 5 6 7 8 9 0 1 2", "++1 22 333 4444", "0" * 16,
]


def test_certain_spans(spark, model):
    rng = random.Random(1)
    bits = ["joe", "@", "x.com", ".", " ", "4111111111111111", "+1", "555-1352", "(132)", "12.34", "256", "-", "7", "é", "\n", "a%b_c"]
    texts = TRICKY + ["".join(rng.choice(bits) for _ in range(30)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.scan_private(d, model=model).select("doc_id", pii.span_list("base").alias("b"), pii.span_list("spans").alias("s")).collect()}
    for k, t in enumerate(texts):
        assert rows[k]["b"] == brute_base(t), t
        assert set(filter(None, rows[k]["b"].split(","))) <= set(rows[k]["s"].split(","))


def test_added_spans_by_plain_arithmetic(spark, model):
    """Generators by Python's patterns, trees walked one by one, containment by all pairs."""
    texts = [r["text"] for r in pii.training_texts(spark, 400).collect()] + ["write to jane.roe [at] example [dot] com or call (132) 555-1352. " * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = pii.scan_parts(d).select("doc_id", F.explode("candidates").alias("c"))
    x = c.select("doc_id", "c.start", "c.end", F.col("c.kind").alias("k"), *[v.alias(k) for k, v in pii.features(F.col("c")).items()]).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["k"]) for r in x} == {(k, m.start(), m.end(), j) for k, t in enumerate(texts) for j in range(pii.N_BASE, len(pii.KINDS)) for m in re.finditer(pii.GENERATORS[j - pii.N_BASE], t)}

    def walk(tree, row):
        while tree.feature:
            tree = tree.low if row[tree.feature] <= tree.at else tree.high
        return tree.value

    want = {k: set() for k in range(len(texts))}
    for r in x:
        score = model.bias + sum(walk(t, r) for t in model.trees)
        base = [tuple(map(int, s.split(":")[1:])) for s in brute_base(texts[r["doc_id"]]).split(",") if s]
        if score >= model.thresholds.get(r["k"], np.inf) and not any(a <= r["start"] and r["end"] <= b for a, b in base):
            want[r["doc_id"]].add(f"{pii.KINDS[r['k']]}:{r['start']}:{r['end']}")
    for r in pii.scan_private(d, model=model).select("doc_id", pii.span_list("base").alias("b"), pii.span_list("spans").alias("s")).collect():
        assert set(r["s"].split(",")) - set(r["b"].split(",")) - {""} == want[r["doc_id"]] - {""}


def test_trees_on_sentences_not_seen(spark, model):
    """Other ids, so other digits and words: precision and recall of the selection."""
    found = pii.judged(pii.training_texts(spark, 40_000).where("id >= 24000"))
    x = pii.features(F.col("c"))
    got = found.select((F.col("personal") == 1).alias("y"), model.selected(F.col("c.kind"), model.score(x)).alias("p")).groupBy("y", "p").count().collect()
    n = {(r["y"], r["p"]): r["count"] for r in got}
    assert n[True, True] / (n[True, True] + n.get((False, True), 0)) > 0.95
    assert n[True, True] / (n[True, True] + n.get((True, False), 0)) > 0.85
    assert set(model.thresholds) >= {4, 5, 6, 7, 8}


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(3)
    x = {"a": rng.integers(0, 5, 600), "b": rng.integers(0, 3, 600)}
    y = ((x["a"] > 2) ^ (x["b"] == 1)).astype("f8")
    bias, trees = pii.boost(x, y, np.ones(600))
    score = bias + sum(t.of(x) for t in trees)
    assert ((score > 0) == (y > 0)).mean() == 1.0
    s, p = pii.calibrated(score, y, np.ones(600))
    assert (np.diff(p) >= 0).all() and len(s) == len(p)


def test_telling_and_misleading_contexts(spark, model):
    yes = ["You can call me on 555-123-4567 after six", "write to jane.roe [at] example [dot] com today", "his ssn 123-45-6789 was on file", "iban DE89 3704 0044 0532 0130 00 please", "logged in from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 today"]
    no = ["order 5551234567 shipped", "the meeting at 12:30:45 was long", "on 2021-03-14 10 people", "we met at home.Then we left", "isbn 978-3-16-148410-0 of the book", "about 4999999 votes", "it took 1234567 years"]
    d = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.scan_private(d, model=model).select("doc_id", pii.span_list("spans").alias("s")).collect()}
    assert all(got[k] for k in range(len(yes))), got
    assert not any(got[k] for k in range(len(yes), len(yes) + len(no))), got


def test_redaction_and_odd_rows(spark, odd, none, model):
    clean = pii.redact_private(odd, model=model)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert pii.scan_private(odd, model=model).count() == odd.count() and pii.scan_private(none, model=model).count() == 0
    d = spark.createDataFrame([(1, "x joe@a.com y +1 (132) 555-1352 z"), (1, "joe@a.com"), (1, "joe@a.com"), (None, "10.0.0.1"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["text"] for r in pii.redact_private(d, model=model).collect()), key=str)
    assert got == sorted(["x [private] y [private] z", "[private]", "[private]", "[private]", None, ""], key=str)


def test_personal_data_is_linear_in_a_text(spark, model):
    for text in ("joe@a.com 10.0.0.1 " * 60_000, "a" * 1_500_000, "1" * 1_500_000, "a@" + "b." * 500_000, "+1" + " " * 1_000_000, "call (132) 555-1352 " * 40_000):
        began = time.perf_counter()
        r = pii.scan_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model).select(F.size("spans").alias("n")).first()
        assert time.perf_counter() - began < 60, text[:20]
        assert r["n"] == {"j": 120_000, "c": 40_000}.get(text[0], r["n"])


def test_personal_data_plan_is_native(spark, model):
    plan = pii.scan_private(spark.read.parquet(f"{DATA}/documents.parquet"), model=model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- long conversations -----------------------------------------------------------------


def test_examples_in_blocks(spark):
    """Ten thousand turns: the examples lie in many tasks, and say what one block says."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <x>\\") for k in range(10_000)] + [(2, 0, "user", "a"), (None, 0, "assistant", "b"), (3, 0, "assistant", None)]
    d = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    written = chat.written_examples(d, 1 << 24).withColumn("part", F.spark_partition_id())
    spread = {r["conv_id"]: (r["parts"], r["n"]) for r in written.groupBy("conv_id").agg(F.countDistinct("part").alias("parts"), F.count("reply").alias("n")).collect()}
    assert spread[1][0] > 2 and {k: n for k, (_, n) in spread.items()} == {1: 5000, 2: 0, 3: 1, None: 1}
    r = {r["conv_id"]: r for r in chat.read_back(d).collect()}[1]
    assert (r["n_turns"], r["n_examples"]) == (10_000, 5_000)
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for c, _, role, text in rows if c == 1).encode()).hexdigest()
    small = chat.transcripts(spark.createDataFrame(rows[:60] + rows[-3:], "conv_id long, turn long, role string, text string"))
    one, many = (sorted(map(repr, chat.written_examples(small, n).collect())) for n in (1 << 26, 300))
    assert one == many
