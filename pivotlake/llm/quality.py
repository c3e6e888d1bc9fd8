"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule is a row ``(name, measure, low, high)``; ``compile_rules`` turns the table into
one boolean expression, so that adding a rule changes data, not code. No user function,
no shuffle: each text is judged alone, in the scan.

Defined results: a null or empty text has no words, all counts 0, fails the base rule and
is not kept; null ``doc_id`` passes through; repeated rows give repeated results; an empty
table gives an empty table. Columns of the input other than ``id_col`` and ``text_col``
are neither read nor returned, so their names cannot clash.
Windows of three words are compared by 64-bit hashes inside one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.llm.common import table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Function words of the supported languages (fixed values).
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "with", "as", "was", "on", "be", "by", "are", "this",
    # German
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "sich", "auf", "für", "dem",
    # French
    "le", "la", "les", "et", "de", "des", "un", "une", "que", "qui", "en", "du", "dans", "pour", "est", "sur", "par",
    # Spanish
    "el", "los", "las", "y", "una", "por", "con", "no", "para", "se", "su", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    """Keep when ``low <= measure <= high``; None: open end."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are expressions over the counted columns; all of them are ratios or counts.
DEFAULT_RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("mean_word_length", "try_divide(word_chars, n_words)", low=2.0, high=14.0),
    Rule("symbols_per_word", "try_divide(n_symbols, n_words)", high=0.25),
    Rule("stop_word_ratio", "try_divide(n_stop, n_words)", low=0.04),
    Rule("duplicate_line_ratio", "try_divide(n_dup_lines, n_lines)", high=0.5),
    Rule("shouted_ratio", "try_divide(n_upper, greatest(n_letters, 1))", high=0.5),
    Rule("bang_ratio", "try_divide(n_bang, n_words)", high=0.3),
    Rule("repeated_word_ratio", "try_divide(n_repeat_words, n_words)", high=0.5),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column; a measure that is null (nothing to measure) fails its rule."""
    verdict = F.lit(True)
    for r in rules:
        value = F.expr(r.measure)
        if r.low is not None:
            verdict = verdict & F.coalesce(value >= F.lit(r.low), F.lit(False))
        if r.high is not None:
            verdict = verdict & F.coalesce(value <= F.lit(r.high), F.lit(False))
    return verdict


def _count_chars(text: str, chars: str) -> Column:
    kept = F.translate(F.col(text), chars, "")
    return (F.length(text) - F.length(kept)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however the optimizer moves the
    expression: a filter on a result would otherwise repeat it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(own: Column) -> Column:
    """Word positions inside windows that occur at least twice: windows are hashed and
    sorted with their places, equal neighbours are kept, and their places are covered."""

    def windows(h: Column) -> Column:
        heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.array_sort(F.transform(heads, lambda x, i: F.struct(F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        like = lambda g, other: F.coalesce(g["h"] == other["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda g, i: like(g, F.get(s, i - 1)) | like(g, F.get(s, i + 1))), lambda g: g["i"]))

    def covered(r: Column) -> Column:
        steps = F.transform(r, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(r, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(F.transform(own, lambda x: F.xxhash64(x)), lambda h: _let(windows(h), lambda s: _let(starts(s), covered)))


def measure_quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The counted columns, one row per input row. ``n_repeat_words`` counts the word
    positions inside three-word windows that occur at least twice in the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            _count_chars("_t", SYMBOLS).alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_w")).alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.expr(f"size(filter(_w, w -> lower(w) in ({stop})))").cast("long").alias("n_stop"),
            _count_chars("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            _count_chars("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").alias("n_letters"),
            _count_chars("_t", "!").alias("n_bang"),
        )
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Measures, the base verdict and ``kept``. Base: fewer than 50 words, or more than
    half of the words lie in repeated windows."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measure_quality(docs, text_col, id_col)
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as k from documents),
w as (select k, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) as i from d),
wc as (select k, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (lower(w) in ({_STOP_SQL})) as n_stop from w group by k),
g as (select k, i, w || ' ' || lead(w) over p || ' ' || lead(w, 2) over p as g from w window p as (partition by k order by i)),
rep as (select k, i from (select k, i, count(*) over (partition by k, g) as c from g where g is not null) where c > 1),
cov as (select k, count(distinct j) as n_repeat from (select k, unnest([i, i + 1, i + 2]) as j from rep) group by k),
l as (select k, unnest(string_split(t, chr(10))) as l from d),
lc as (select k, count(*) as n_lines, count(*) - count(distinct l) as n_dup from l where regexp_matches(l, '[^\x20\x09-\x0D]') group by k),
m as (select doc_id, coalesce(n_words, 0)::BIGINT as n_words, coalesce(word_chars, 0)::BIGINT as word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT as n_symbols, coalesce(n_dup, 0)::BIGINT as n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT as n_repeat_words, coalesce(n_lines, 0)::BIGINT as n_lines, coalesce(n_stop, 0)::BIGINT as n_stop,
  (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT as n_upper,
  (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')))::BIGINT as n_letters,
  (length(t) - length(translate(t, '!', '')))::BIGINT as n_bang
  from d left join wc using (k) left join cov using (k) left join lc using (k)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select *, (not base_failed and n_words >= 50
  and word_chars / n_words between 2.0 and 14.0 and n_symbols / n_words <= 0.25 and n_stop / n_words >= 0.04
  and n_dup_lines / n_lines <= 0.5 and n_upper / greatest(n_letters, 1) <= 0.5 and n_bang / n_words <= 0.3
  and n_repeat_words / n_words <= 0.5) as kept
from b
"""
