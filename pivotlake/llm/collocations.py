"""Phrase collocations by depth-limited count tries.

Every task builds tries of its texts, one a block of words: under a root for each language, a
node for every word that follows, to the depth of the longest phrase, with the number of times
that the path from the root occurs. A trie is an array of nodes a level, found level by level
by sorting (parent, word). Tries are serialised as rows, one a node, and stored. The stored runs
are dealt into ranges of (language, phrase) and sorted; so a range holds the same part of all
tries side by side, and a walk along it adds up equal nodes and, in passing, knows the counts
of the nodes above, which are the left parts of a phrase. Ranges are cut anywhere in a subtree,
so a frequent first word is spread like any other; what stands above the first nodes of a range
is looked up instead. The right parts are the nodes that suffix links lead to, found by a join.

A trie grows by levels: the first pass over the texts counts to two words. Each pass after it
adds one level, and of that level only the paths whose two parts one word shorter may be
frequent: a filter of fixed size, made from the merged trie, is broadcast. So rare phrases,
most of all, are never written.

Words: A-Z in lower case, runs without space and tab, in pieces between ``.,;:!?`` and line
ends; phrases stay inside pieces. Only nodes with ``least`` occurrences are kept once merged:
all parts of such a phrase occur as often. Products of counts are decimals of 38 digits.

Bounds: a task holds a block of ``BLOCK`` bytes of text and its trie. Longer texts are cut into
slices between words; a slice repeats the last words of the one before, which count only as the
beginning of phrases that end in the slice. The walk holds one batch of rows.

Defined results: a null text is empty; a null language is ``und``; null ids do not matter;
repeated rows count each; a language without phrases has no row; an empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import discard, lean, materialize, table

#: Bytes of text whose words go into one trie.
BLOCK = 16 << 20
#: Bits of a filter of paths (16 MiB), a power of two.
FILTER_BITS = 1 << 27
#: Bits of it that one task makes.
FILTER_PART = 1 << 20
#: Nodes in a row batch of a serialised trie.
BATCH = 1 << 16
_TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]")
_BREAK = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_ENDS = [bytes([c]) for c in (*b".,;:!?", *range(0x0A, 0x0E))]
#: Of each byte: 0 between tokens, 1 a token of its own, 2 of a word.
_KIND = np.full(256, 2, "u1")
_KIND[[0x20, 0x09]] = 0
_KIND[[c[0] for c in _ENDS]] = 1
_NODE = "lang string, phrase string, words int, f long"


def slices(text: str, size: int) -> Iterator[bytes]:
    """The text in lower case, cut between words into parts of about ``size`` bytes."""
    data, at = text.encode("utf-8", "surrogatepass").lower(), 0  # of bytes, lower() takes A-Z only
    while len(data) - at > size:
        cut = _BREAK.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of paths one word longer (unsigned, wrapping)."""
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _name_hash(names: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in names], "u8")


class Filter:
    """Which paths of a length may be frequent: a bit for every hash. It never says no wrongly,
    and its size is fixed, so that with more paths than bits it only says yes more often."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(FILTER_BITS - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


class Shard:
    """Texts of a task until they make a block, then its trie down to ``depth``. With a filter
    only the lowest level is given, and of it the nodes whose path passes without its last and
    without its first word."""

    def __init__(self, depth: int, block: int = BLOCK, frequent: Filter | None = None):
        self.depth, self.block, self.frequent = depth, block, frequent
        self.clear()

    def clear(self) -> None:
        self.bytes, self.parts = 0, []

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        known: list[bytes] = []
        for data in slices(text, self.block):
            # language, what the slice before has counted and the slice, and how many tokens that is
            self.parts.append((lang, b" ".join([*known, data]) + b"\n", len(known)))
            self.bytes += len(data)
            if len(data) >= self.block:  # there may be another slice
                own = known + _TOKEN.findall(data)
                known = own[len(own) - min(len(own), self.depth - 1) :]
            if self.bytes >= self.block:
                yield from self.trie()

    def trie(self) -> Iterator[pa.RecordBatch]:
        """The block's trie, level by level, each sorted by parent and word."""
        if not self.parts:
            return
        langs, texts, known = zip(*self.parts, strict=True)
        self.clear()
        coded, size = _tokens(texts)
        del texts
        coded = coded.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        names, rank = coded.dictionary.take(order), np.empty(len(order), "i8")
        rank[order.to_numpy()] = np.arange(len(order))
        rank[pc.is_in(coded.dictionary, pa.array(_ENDS, pa.binary())).to_numpy(zero_copy_only=False)] = -1
        word = rank[coded.indices.to_numpy(zero_copy_only=False)]
        del coded
        roots = pa.array(langs, pa.string()).dictionary_encode()
        known = np.array(known)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        fresh = place >= np.repeat(known, size)
        node = np.repeat(roots.indices.to_numpy(zero_copy_only=False).astype("i8"), size)
        lang = np.arange(len(roots.dictionary))
        if not self.frequent:
            start = np.arange(len(word))
            yield from _rows(roots.dictionary, None, 0, np.bincount(node, fresh & (word >= 0), len(lang)).astype("i8"))
        else:
            start = self._passed(word, node, names, roots.dictionary)
            node = node[start]
        phrase, n_words = None, max(len(names), 1)
        for depth in range(1, self.depth + 1):
            end = start + depth - 1
            ok = end < len(word)
            ok[ok] = word[end[ok]] >= 0
            if depth == self.depth:
                ok[ok] = fresh[end[ok]]  # others would count nothing
            start, end, node = start[ok], end[ok], node[ok]
            key, node, f = _nodes(node * n_words + word[end], fresh[end], len(lang) * n_words, depth == self.depth)
            above, last = key // n_words, key % n_words
            own = names.take(pa.array(last)).cast(pa.string())
            phrase = own if phrase is None else pc.binary_join_element_wise(phrase.take(pa.array(above)), own, " ")
            lang = lang[above]
            if not self.frequent or depth == self.depth:
                yield from _rows(roots.dictionary.take(pa.array(lang)), phrase, depth, f)

    def _passed(self, word: np.ndarray, root: np.ndarray, names: pa.Array, langs: pa.Array) -> np.ndarray:
        """Where paths of full depth begin whose two parts one word shorter pass the filter. Only
        these are sorted into nodes, and only of them phrases are made."""
        word_hash, h = _name_hash(names.to_pylist()), _name_hash([x.encode() for x in langs.to_pylist()])[root]
        n = max(0, len(word) - self.depth + 2)
        passed, h = np.ones(n, bool), h[:n]
        for k in range(self.depth - 1):
            w = word[k : k + n]
            passed &= w >= 0
            h = _mix(h, word_hash[w])
        passed[passed] = self.frequent(h[passed])
        return np.flatnonzero(passed[:-1] & passed[1:])


def _tokens(texts: Iterable[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of ``_TOKEN`` in texts that end in a line end, and how many every text has."""
    data = np.frombuffer(b"".join(texts), "u1")
    kind = _KIND[data]
    first = kind == 1
    first[1:] |= (kind[1:] == 2) & (kind[:-1] != 2)
    first[:1] |= kind[:1] == 2
    ends = np.cumsum([len(x) for x in texts])
    size = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    own = kind > 0
    data, at = data[own], np.flatnonzero(first[own])
    offsets = np.append(at, len(data)).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), size


def _nodes(key: np.ndarray, fresh: np.ndarray, space: int, last: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Different keys below ``space`` in order, which of them each is (but for the last level, where
    all are fresh), and how many fresh ones each has."""
    if last:
        found, f = np.unique(key, return_counts=True)
        return found, None, f.astype("i8")
    if space <= 4 * len(key):
        seen = np.zeros(space, bool)
        seen[key] = True
        found, node = np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]
    else:
        found, node = np.unique(key, return_inverse=True)
    return found, node, np.bincount(node, fresh, len(found)).astype("i8")


def _rows(lang: pa.Array, phrase: pa.Array | None, words: int, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes that occur, as rows. The root's phrase is empty."""
    own = pa.array(np.flatnonzero(f))
    phrase = pa.array([""] * len(f), pa.string()) if phrase is None else phrase
    t = pa.table({"lang": lang.take(own), "phrase": phrase.take(own), "words": pa.array(np.full(len(own), words, "i4")), "f": pa.array(f[own.to_numpy()])})
    yield from t.to_batches(max_chunksize=BATCH)


def count_tries(docs: DataFrame, depth: int = 2, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, frequent: Filter | None = None) -> DataFrame:
    """``(lang, phrase, words, f)``: the nodes of all tasks' tries (of their lowest level, with a
    filter). A phrase stands once a trie; its root has no words and counts all."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(depth, block, shared.value)
        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from shard.add(lang, text)
        yield from shard.trie()

    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(lean(run), _NODE)


def _path_slot(lang: str, phrase: str) -> int:
    """The bit of a path in a filter."""
    h = _name_hash([lang.encode()])
    for w in _name_hash(phrase.encode().split(b" ")):
        h = _mix(h, w)
    return int(h[0] & np.uint64(FILTER_BITS - 1))


def walk(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sorted nodes of many tries to merged ones ``(lang, phrase, words, f, left, slot)``:
    ``left`` has the counts of the nodes above from the first word on, null where they are not
    in sight, ``slot`` the bit of a path of full depth."""
    above: list[tuple[str, str, int]] = []  # the last node seen of each depth

    def merged() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches of first rows of equal nodes with their sums; the last node waits for more."""
        held, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                same = [pc.equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) for c in b.columns[:2]]
                new[1:] = ~(same[0] & same[1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(b.column(3).to_numpy(), first)
            if held is not None:
                if all(held.column(k)[0] == b.column(k)[0] for k in (0, 1)):
                    total[0] += n
                else:
                    yield held, np.array([n])
            yield b.take(pa.array(first[:-1])), total[:-1]
            held, n = b.slice(first[-1], 1), int(total[-1])
        if held is not None:
            yield held, np.array([n])

    for b, f in merged():
        keep = np.flatnonzero((f >= least) | (b.column(2).to_numpy() == 0))
        own, out, slot = b.take(pa.array(keep)), [], []
        for lang, phrase, words, n in zip(*(own.column(k).to_pylist() for k in range(3)), f[keep].tolist(), strict=True):
            del above[max(words - 1, 0) :]
            above += [("", "", -1)] * (max(words - 1, 0) - len(above))
            out.append([a[2] if a[2] >= 0 and a[0] == lang and phrase.startswith(a[1] + " ") else None for a in above])
            slot.append(_path_slot(lang, phrase) if words == depth else None)
            if words:
                above.append((lang, phrase, n))
        yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(f[keep]), pa.array(out, pa.list_(pa.int64())), pa.array(slot, pa.int64())], ["lang", "phrase", "words", "f", "left", "slot"])


def merge_tries(nodes: DataFrame, depth: int = 2, least: int = 10) -> DataFrame:
    """``(lang, phrase, words, f, left, slot)`` from serialised tries, by ranges of phrases."""
    runs = nodes.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    return runs.mapInArrow(lean(lambda batches: walk(batches, depth, least)), f"{_NODE}, left array<long>, slot long")


def frequent_paths(trie: DataFrame) -> Filter:
    """The filter of the merged trie's lowest level, made in parts; ``FILTER_BITS / 8`` bytes come
    to the driver at most."""

    def part(t: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_PART, "u1")
        bits[t["slot"].to_numpy() % FILTER_PART] = 1
        return pa.table({"part": [t["slot"][0].as_py() // FILTER_PART], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = trie.where("slot is not null").select("slot").distinct()
    rows = slots.groupBy(F.shiftright("slot", FILTER_PART.bit_length() - 1)).applyInArrow(part, "part long, bits binary")
    words = np.zeros((FILTER_BITS // FILTER_PART, FILTER_PART // 64), "<u8")
    for r in rows.toLocalIterator():
        words[r["part"]] = np.frombuffer(r["bits"], "<u8")
    return Filter(words.ravel())


def _first(phrase: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(1), k), " ")


def _rest(phrase: Column, k: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), k + 1, n - k), " ")


def score_cuts(trie: DataFrame) -> DataFrame:
    """``(lang, phrase, words, a, l, r, score)``: phrases with their lowest-scoring cut. Left
    parts that the walk did not see, few a range, and all right parts are looked up."""
    cuts = trie.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.posexplode("left").alias("i", "l")).withColumn("k", F.col("i") + 1)
    part = trie.where("words >= 1").select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias("_f"))
    cuts = cuts.withColumn("first", _first(F.col("phrase"), F.col("k"))).withColumn("rest", _rest(F.col("phrase"), F.col("k"), F.col("words")))
    seen = cuts.where(F.col("l").isNotNull())
    look = cuts.where(F.col("l").isNull()).join(part, (F.col("lang") == F.col("_l")) & (F.col("first") == F.col("_p"))).withColumn("l", F.col("_f")).select(*cuts.columns)
    both = seen.unionByName(look).join(part, (F.col("lang") == F.col("_l")) & (F.col("rest") == F.col("_p")))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", (wide("a") * wide("a") * F.lit(1_000_000)).cast("decimal(38,0)"), (wide("l") * wide("_f")).cast("decimal(38,0)"))
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", F.col("_f").alias("r")))
    return both.groupBy("lang", "phrase", "words", "a").agg(best.alias("b")).select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def drop_covered(scored: DataFrame, depth: int = 3, share: int = 50) -> DataFrame:
    """Without the phrases of which a longer one has ``share`` in 100 of the occurrences."""
    n, word = F.col("words"), F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), n - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda s: F.array_join(F.slice(word, s, m), " "))))
    longer = scored.where("words >= 3").select(F.col("lang").alias("_l"), F.explode(F.array_distinct(inner)).alias("_p"), F.col("a").alias("_a"))
    cover = longer.groupBy("_l", "_p").agg(F.max("_a").alias("_a"))
    wide = lambda c, x: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)") * x
    return scored.join(cover, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left").where(F.col("_a").isNull() | (wide("_a", 100) < wide("a", share))).drop("_l", "_p", "_a")


def collocations(docs: DataFrame, depth: int = 3, least: int = 10, share: int = 50, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score)`` of all phrases that stay. The tries and the
    merged one are written to the shared folder; the merged one stays for the returned frame."""
    grow = lambda d, frequent=None: materialize(count_tries(docs, d, text_col, lang_col, block, frequent), f"trie-nodes-{d}")
    nodes = grow(2)
    trie = materialize(merge_tries(nodes, 2, least), "trie-2")
    discard(nodes)
    for d in range(3, depth + 1):
        nodes, above = grow(d, frequent_paths(trie)), trie
        trie = materialize(merge_tries(nodes.unionByName(above.select(*nodes.columns)), d, least), f"trie-{d}")
        discard(nodes, above)
    total = trie.where("words = 0").select(F.col("lang").alias("_l"), F.col("f").alias("n"))
    return drop_covered(score_cuts(trie), depth, share).join(total, F.col("lang") == F.col("_l")).drop("_l")


def top_collocations(found: DataFrame, k: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``k`` of every language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(collocations(table(spark, sf_dir, "documents")))


ORACLE = r"""
with recursive d as (select row_number() over () as id, coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') as w from d),
g as (select lang, m, unnest(list_transform(range(1, (len(w) - m + 2)::BIGINT), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from p, (values (1), (2), (3)) t(m) where len(w) >= m),
f as materialized (select lang, m, phrase, count(*) as f from g group by lang, m, phrase having count(*) >= 10),
n as (select lang, sum(len(w))::BIGINT as n from p group by lang),
c as (select lang, m, phrase, f as a, unnest(range(1, m)) as k from f where m >= 2),
s as (select c.lang, c.m, c.phrase, c.a, k, x.f as l, y.f as r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT as score from c
  join f x on x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as nth from s) where nth = 1),
o as (select lang, phrase, max(f) as most from (select lang, f, array_to_string(string_split(phrase, ' ')[1:2], ' ') as phrase from f where m = 3 union all select lang, f, array_to_string(string_split(phrase, ' ')[2:3], ' ') from f where m = 3) group by lang, phrase),
t as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank from b left join o on o.lang = b.lang and o.phrase = b.phrase where o.most is null or 100 * o.most::HUGEINT < 50 * a::HUGEINT)
select t.lang, rank::BIGINT as rank, phrase, a::BIGINT as a, l::BIGINT as l, r::BIGINT as r, n.n, score from t join n on n.lang = t.lang where rank <= 2000
"""
