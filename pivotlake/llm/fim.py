"""Fill-in-middle transformation by a parallel automaton scan.

A text is cut into units (lines), and two of the places between units become the ends of its
prefix and its middle. One automaton reads the text: it counts where units start and notices
the reserved marks. Its state at a chunk's beginning depends on all that stands before, so a
chunk is scanned without knowing it: it gives, for every state it may be entered in, the state
that it is left in and the number of units that start. These functions compose associatively;
composed in order they tell the state and the count at every chunk's beginning, and the cut
behind unit k is then sought in the one chunk where unit k + 1 starts.

Texts of up to ``GIANT`` code points are scanned where they lie. Chunks of longer ones are
dealt over all tasks; only their functions (some hundred bytes each) come together, at most
as many as a row's length allows, and only the chunks that hold a cut are looked at again.
Texts themselves are shuffled only if the cuts of giant texts are too many to broadcast.

Defined results: a null text is empty, and an empty text has no unit and stays plain; a null id
counts as an empty string in the seed; repeated rows get the same result each; an empty table
gives an empty table. Other columns are carried by ``fill_in_middle``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import materialize, table, wrap

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Code points of a chunk, and of the longest text that one task scans alone.
CHUNK, GIANT = 1 << 14, 1 << 16
#: Giant texts in all up to which their cuts are broadcast (some 100 bytes each).
BROADCAST_CUTS = 200_000


class Automaton:
    """Two things read at once: whether a unit is open, and how much of a reserved mark has
    been seen (found is for good). State ``2 * m + open``; ``after[state, class]``."""

    def __init__(self, marks: tuple[str, ...] = MARKS):
        seen = sorted({m[:k] for m in marks for k in range(len(m))})  # proper prefixes, "" first
        found = len(seen)
        letters = sorted({"\n", *"".join(marks)})
        self.alphabet = np.array([ord(c) for c in letters], "u4")

        def read(prefix: str, c: str) -> int:
            ends = [(prefix + c)[k:] for k in range(len(prefix) + 2)]
            longest = next(x for x in ends if x in marks or x in seen)
            return found if longest in marks else seen.index(longest)

        # classes: the letters in order, then everything else
        step = np.array([[*(read(p, c) for c in letters), 0] for p in seen] + [[found] * (len(letters) + 1)])
        is_open = np.array([[c != "\n" for c in letters] + [True]] * 2)
        self.n_states = 2 * (found + 1)
        state = np.arange(self.n_states)
        self.after = (2 * step[state // 2] + is_open[state % 2]).astype("i8")
        self.starts = (state % 2 == 0).astype("i8")  # any character starts a unit where none is open
        self.found = 2 * found

    def classes(self, chunk: str) -> np.ndarray:
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet))

    def scan(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """What the chunk does to every entry state: exit states and units started. A run of
        other characters does what one does."""
        c = self.classes(chunk)
        other = c == len(self.alphabet)
        c = c[~(other & np.r_[False, other[:-1]])] if len(c) else c
        f = self.after.T[c]
        n = np.broadcast_to(self.starts, f.shape)
        while len(f) > 1:  # neighbours compose, all pairs at once
            odd = (f[-1:], n[-1:]) if len(f) % 2 else (f[:0], n[:0])
            f, n = compose((f[: len(f) & ~1 : 2], n[: len(f) & ~1 : 2]), (f[1::2], n[1::2]))
            f, n = np.concatenate([f, odd[0]]), np.concatenate([n, odd[1]])
        return (f[0], n[0]) if len(f) else (np.arange(self.n_states), np.zeros(self.n_states, "i8"))

    def unit_start(self, chunk: str, entry: int, nth: int) -> int:
        """Place in the chunk where its ``nth`` unit (from 0) starts."""
        ends = np.flatnonzero(self.classes(chunk) == int(np.searchsorted(self.alphabet, ord("\n")))) + 1
        starts = np.r_[[0] if entry % 2 == 0 else [], ends[ends < len(chunk)]]
        return int(starts[nth])


def compose(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First ``one``, then ``two``; associative. Works on stacks of functions."""
    f, n = one
    return np.take_along_axis(two[0], f, -1), n + np.take_along_axis(two[1], f, -1)


def entries(f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive functions, the state and count at the beginning of each and at the end,
    starting from state 0: all prefixes are composed in logarithmically many passes."""
    f, n, width = f.copy(), n.copy(), 1
    while width < len(f):
        f[width:], n[width:] = compose((f[:-width].copy(), n[:-width].copy()), (f[width:], n[width:]))
        width *= 2
    return np.r_[0, f[:, 0]], np.r_[0, n[:, 0]]


def places(automaton: Automaton, f: np.ndarray, n: np.ndarray, h: tuple[int, int]) -> tuple[int, bool, list[tuple[int, int, int]]]:
    """Units, whether a mark was found, and for both cuts the chunk, its entry state and which of
    its units starts there; chunk -1 is the text's end. The cut behind all units is there."""
    state, before = entries(f, n)
    total = int(before[-1])
    cuts = []
    for k in sorted(x % (total + 1) for x in h):
        # the last chunk with at most k units before it holds the start of unit k
        at = int(np.searchsorted(before[:-1], k, side="right")) - 1
        cuts.append((at, int(state[at]), k - int(before[at])) if k < total else (-1, 0, 0))
    return total, bool(state[-1] >= automaton.found), cuts


def cut_text(automaton: Automaton, text: str, h: tuple[int, int], chunk: int = CHUNK) -> tuple[int, bool, int, int]:
    """Units, whether a mark was found, and both cuts as code points, of a text in one place."""
    parts = [text[k : k + chunk] for k in range(0, len(text), chunk)] or [""]
    f, n = map(np.stack, zip(*map(automaton.scan, parts), strict=True))
    total, found, cuts = places(automaton, f, n, h)
    a, b = (len(text) if at < 0 else at * chunk + automaton.unit_start(parts[at], state, nth) for at, state, nth in cuts)
    return total, found, a, b


_CUTS = "n long, marked boolean, a long, b long"
_PLACES = "n long, marked boolean, c1 long, e1 long, u1 long, c2 long, e2 long, u2 long"


def _cut_here(rows: DataFrame, marks: tuple[str, ...], chunk: int) -> DataFrame:
    @F.pandas_udf(_CUTS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(marks)
        for text, h1, h2 in batches:
            yield pd.DataFrame([cut_text(automaton, *x[:1], x[1:], chunk) for x in zip(text, h1, h2, strict=True)], columns=["n", "marked", "a", "b"])

    return rows.withColumn("_c", cut("text", F.col("h")[0], F.col("h")[1])).select(*rows.columns, "_c.*")


def _cut_giants(rows: DataFrame, marks: tuple[str, ...], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Chunks over all tasks, their functions by text, the cuts back to the texts. Also returns
    the stored table of places."""
    cut_up = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))

    @F.pandas_udf("f array<int>, u array<long>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(marks)
        for s in batches:
            yield pd.DataFrame([automaton.scan(x) for x in s], columns=["f", "u"])

    def resolve(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        f, u = (np.array(t[c].to_pylist(), "i8") for c in ("f", "u"))
        total, found, (one, two) = places(Automaton(marks), f, u, tuple(t["h"][0].as_py()[:2]))
        names = _PLACES.replace(",", "").split()[::2]
        return pa.table({"id": t["id"][:1], "key": t["key"][:1], **{name: [x] for name, x in zip(names, (total, found, *one, *two), strict=True)}})

    parts = rows.select("id", "key", "h", F.posexplode(cut_up).alias("k", "part"))
    seen = parts.repartition(F.col("key"), F.col("k")).withColumn("_s", scan("part")).select("id", "key", "h", "k", "_s.*")
    seen = seen.dropDuplicates(["id", "key", "k"])  # of repeated rows
    kind = rows.schema["id"].dataType.simpleString()
    found = materialize(seen.groupBy("id", "key").applyInArrow(resolve, f"id {kind}, key long, {_PLACES}"), "fim-places")
    few = F.broadcast(found) if found.count() <= BROADCAST_CUTS else found
    x, y = rows.alias("x"), few.alias("y")
    own = x.join(y, F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.key") == F.col("y.key"))).select("x.*", *[f"y.{c}" for c in _PLACES.replace(",", "").split()[::2]])

    @F.pandas_udf("long")
    def at(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = Automaton(marks)
        for s in batches:
            yield pd.Series([automaton.unit_start(*x) for x in zip(*s, strict=True)], dtype="int64")

    def place(k: int) -> Column:
        c, e, u = (F.col(f"{name}{k}") for name in "ceu")
        # the end of a text needs no look; any unit of an empty chunk entered closed is at 0
        inside = F.when(c >= 0, F.substring("text", (c * chunk + 1).cast("int"), F.lit(chunk))).otherwise(F.lit("-"))
        return F.when(c >= 0, c * chunk + at(inside, e, u)).otherwise(F.length("text")).cast("long")

    return own.select(*rows.columns, "n", "marked", place(1).alias("a"), place(2).alias("b")), found


def transform(rows: DataFrame, rate: int = 100, spm: int = 50, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """Form, parts and output from ``(text, h, n, marked, a, b)``."""
    p, s, m = (F.lit(x) for x in marks)
    form = F.when((F.length("text") == 0) | F.col("marked") | (F.col("h")[2] % 100 >= rate), "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    cut = lambda start, size: F.substring("text", (start + 1).cast("int"), size.cast("int"))
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("form", form).withColumn("prefix", cut(F.lit(0), a)).withColumn("middle", cut(a, b - a)).withColumn("suffix", cut(b, F.length("text") - b))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.concat(p, "prefix", s, "suffix", m, "middle"))
    return rows.withColumn("output", output)


def restore(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output was made from. Texts that hold a mark stay plain, so the first
    of each mark is the one that was set."""
    p, s, m = marks
    between = lambda one, two: F.substring(output, F.instr(output, one) + len(one), (F.instr(output, two) if two else F.length(output) + 1) - F.instr(output, one) - len(one))
    return F.when(form == "plain", output).when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(F.concat(between(p, s), between(m, None), between(s, m)))


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, ...] = MARKS, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """``(row, id, text, h, n, marked, a, b, form, prefix, middle, suffix, output)`` per input
    row; ``row`` holds the input's columns. ``rate`` in 100 documents are transformed, ``spm`` in
    100 of these with their suffix first."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    rows = wrap(docs, [c for c in docs.columns if c != text_col], id=F.col(id_col), text=text, h=h)
    small = _cut_here(rows.where(F.length("text") <= giant), marks, chunk)
    large = rows.where(F.length("text") > giant).withColumn("key", F.xxhash64("text"))
    cut, _ = _cut_giants(large, marks, chunk)
    return transform(small.unionByName(cut.drop("key")), rate, spm, marks)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns none. Outputs are texts of ``fill_in_middle``; here they
    are told by digests."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.when(F.col("form") != "plain", F.length(c)).cast("long")
    return made.select(F.col("id").alias("doc_id"), "n", "form", size("prefix").alias("prefix_chars"), size("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) as x from documents),
h as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as u, ('0x' || x[1:8])::BIGINT as h1, ('0x' || x[9:16])::BIGINT as h2, ('0x' || x[17:24])::BIGINT as h3, ('0x' || x[25:32])::BIGINT as h4 from d),
n as (select *, len(u)::BIGINT as n from h),
k as (select *, least(h1 % (n + 1), h2 % (n + 1)) as k1, greatest(h1 % (n + 1), h2 % (n + 1)) as k2,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(u[1:k1], '') as p, array_to_string(u[k1 + 1:k2], '') as m, array_to_string(u[k2 + 1:], '') as s from k)
select doc_id, n, form, case when form <> 'plain' then length(p) end::BIGINT as prefix_chars, case when form <> 'plain' then length(m) end::BIGINT as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(p || m || s) as restored_sha256 from p
"""
