"""Language ID by fusing evidence in the manner of Bayes.

log P(L | row) is, up to a constant, the sum of
- the text likelihood: byte trigrams of the letters under each language, against a class of
  its own for what is none of them, under which all trigrams are alike,
- the declared markup language, right with a stated reliability,
- the address suffix, where a country suffix speaks for a language,
- the host prior, P(L | host), smoothed towards its parent domain and that towards the whole
  corpus; all three levels are counted by grouped aggregation over all rows.

The trigrams are learned from the corpus: in a sample of ``TRAIN_ROWS`` rows (a documented
bound; the rest is scored only) function words tell the language, where one is far ahead, and
the trigrams of those rows are counted. Function words themselves are counted as well, so every
language has a model on any table. Counts, a table of bounded size, come to the driver.

Rows are rejected when the best class is none of the languages or its posterior is under the
threshold, or when neither the text nor a known declared language says anything. For tables
without addresses, any grouping column (such as a source) can stand for the host.

Defined results: a text without a letter (null, empty) is rejected (language ``und``);
null declared language, host or address: no evidence of that kind, null hosts share one
prior; unknown declared languages are ignored; repeated rows count as often as they stand;
an empty table gives an empty table; a very long text counts whole. Languages of other letters
than those four are ``und``; others with the same letters are taken for the likest of the four.
Columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import lean, materialize, table, unwrap, wrap

#: Function words (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to a in is it that for with as was on be by are this from or an have not but they you which at were his her".split(),
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für dem im es auch als an werden aus er hat dass sie nach bei wird".split(),
    "es": "de la que el en y a los las del un una por con no para se su al es lo como más pero sus le ya o este sí esta entre muy sin".split(),
    "fr": "le la les et de des un une que qui en du dans pour est sur par au pas plus ne avec ce il sont aux ou cette être son".split(),
}
#: Country suffixes (fixed values).
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}

LANGUAGES = tuple(sorted(FUNCTION_WORDS))
#: The class of everything else comes last.
NONE = "und"
CLASSES = (*LANGUAGES, NONE)
DECLARED_RIGHT, SUFFIX_RIGHT = 0.85, 0.7
#: Pseudo-counts with which a level leans on the one above.
HOST_WEIGHT, DOMAIN_WEIGHT, CORPUS_WEIGHT = 20.0, 50.0, 5.0
MIN_POSTERIOR = 0.5
BROADCAST_HOSTS = 50_000
#: Numbers of trigrams (by a hash); the share of a language's chances that all trigrams have
#: alike; how often function words are counted; each letter is in so many trigrams.
GRAMS, ALIKE, SEEDED, OVERLAP = 1 << 16, 0.3, 20, 3
#: Rows that the trigrams are learned from, about; function words that a language must be
#: ahead by.
TRAIN_ROWS, AHEAD = 50_000, 3

_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORDS = {w.encode(): [LANGUAGES.index(lang) for lang in LANGUAGES if w in FUNCTION_WORDS[lang]] for lang in LANGUAGES for w in FUNCTION_WORDS[lang]}


def letters(text: str | None) -> bytes:
    """The text's words of letters, lower-case as far as ASCII goes, with single spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def trigrams(plain: bytes) -> np.ndarray:
    """Numbers of the trigrams of ``letters``."""
    x = np.frombuffer(plain, "u1").astype("u4")
    return ((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def seed_language(plain: bytes) -> int:
    """The language whose function words are ahead by ``AHEAD``, else -1."""
    counts, hits = Counter(plain.split()), [0] * len(LANGUAGES)
    for w in _WORDS.keys() & counts.keys():
        for lang in _WORDS[w]:
            hits[lang] += counts[w]
    best = max(range(len(hits)), key=hits.__getitem__)
    return best if hits[best] >= AHEAD + max(h for k, h in enumerate(hits) if k != best) else -1


def learn_trigrams(rows: DataFrame, text: Column, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Trigram and language to how much likelier the trigram is in the language than in the
    class of everything else (a logarithm). The sample is told by a hash of the whole row."""
    ship(rows.sparkSession)
    share = min(1.0, train_rows / max(rows.count(), 1))
    low = F.pmod(F.xxhash64(*[rows[f"`{c}`"] for c in rows.columns]), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES), GRAMS), "i8")
        for b in batches:
            for t in b.column(0):
                plain = letters(t.as_py())
                lang = seed_language(plain) if plain else -1
                if lang >= 0:
                    np.add.at(total[lang], trigrams(plain), 1)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang * GRAMS + gram), pa.array(total[lang, gram])], ["cell", "n"])

    found = rows.where(low).select(text.alias("t")).mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(LANGUAGES) * GRAMS)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    total = total.reshape(len(LANGUAGES), GRAMS)
    for k, lang in enumerate(LANGUAGES):
        np.add.at(total[k], trigrams(letters(" ".join(FUNCTION_WORDS[lang]))), SEEDED)
    chance = (1 - ALIKE) * total / total.sum(1, keepdims=True) + ALIKE / GRAMS
    return np.log(chance * GRAMS).T.astype("f4")


def text_evidence(text: str | None, model: np.ndarray) -> list[float]:
    """Log likelihood of the text per class, that of the last being 0; then the trigrams."""
    codes, total = trigrams(letters(text)), np.zeros(len(LANGUAGES))
    for k in range(0, len(codes), 1 << 16):
        total += model[codes[k : k + (1 << 16)]].sum(0, dtype="f8")
    return [*(total / OVERLAP).tolist(), 0.0, float(len(codes))]


def _text_evidence(rows: DataFrame, text: Column) -> Column:
    shared = rows.sparkSession.sparkContext.broadcast(learn_trigrams(rows, text))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        return pa.array([text_evidence(t.as_py(), model) for t in texts], pa.list_(pa.float64()))

    return score(text)


def _categorical(value: Column, right: float) -> Column:
    """Log likelihoods per class of a named language that is right so often; null and
    unknown names say nothing, and under no language all names are alike."""
    wrong = (1 - right) / (len(LANGUAGES) - 1)
    own = [F.when(value == lang, math.log(right)).otherwise(math.log(wrong)) for lang in LANGUAGES]
    return F.when(value.isin(*LANGUAGES), F.array(*own, F.lit(-math.log(len(LANGUAGES))))).otherwise(F.array(*[F.lit(0.0)] * len(CLASSES)))


def _add(*terms: Column) -> Column:
    return F.array(*[sum((t[k] for t in terms[1:]), terms[0][k]) for k in range(len(CLASSES))])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def evidence(rows: DataFrame, text: Column, declared: Column | None = None, host: Column | None = None, url: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Per input row: ``row`` (a struct, of the columns in ``carry`` or of all), ``seen``
    (likelihoods and trigrams of the text), ``fused`` (the evidence of the row alone),
    ``named`` (a known language is declared for letters), ``host`` and ``domain``."""
    none = F.lit(None).cast("string")
    if url is not None:
        host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:@]+)", 1))
    host = none if host is None else host.cast("string")
    # of www.example.com the domain is the last two labels; other names have no parent
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.regexp_extract(host, r"\.([a-z]+)$", 1)] if url is not None else none
    declared = none if declared is None else F.lower(F.substring(declared, 1, 2))
    named = F.coalesce(declared.isin(*LANGUAGES) & text.rlike(r"\p{L}"), F.lit(False))
    own = wrap(rows, carry, seen=_text_evidence(rows, text), host=host, domain=F.when(domain != "", domain), declared=declared, suffix=suffix, named=named)
    fused = _add(F.col("seen"), _categorical(F.col("declared"), DECLARED_RIGHT), _categorical(F.col("suffix"), SUFFIX_RIGHT))
    return own.withColumn("fused", fused).drop("declared", "suffix")


def host_priors(found: DataFrame) -> tuple[DataFrame, list[float]]:
    """``(h, prior)``, one row per host: log P(L | host); and P(L) over the corpus. Rows with
    text evidence add their posterior to their host (partial sums before the shuffle);
    domains and the corpus are summed from the hosts."""
    shares = found.where(F.col("seen")[len(CLASSES)] > 0).select("host", "domain", _softmax(F.col("fused")).alias("p"))
    n = [f"n{k}" for k in range(len(CLASSES))]
    hosts = materialize(shares.groupBy("host", "domain").agg(*[F.sum(F.col("p")[k]).alias(c) for k, c in enumerate(n)]), "lang-hosts")
    total = hosts.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in n]).first()
    mass = sum(total)
    corpus = [(c + CORPUS_WEIGHT / len(n)) / (mass + CORPUS_WEIGHT) for c in total]
    sums = lambda t: sum((F.col(f"{t}.{c}") for c in n[1:]), F.col(f"{t}.{n[0]}"))
    domains = hosts.groupBy("domain").agg(*[F.sum(c).alias(c) for c in n]).alias("d")
    smooth = domains.select("domain", *[((F.col(f"d.{c}") + DOMAIN_WEIGHT * corpus[k]) / (sums("d") + DOMAIN_WEIGHT)).alias(f"p{k}") for k, c in enumerate(n)])
    h, d = hosts.alias("h"), smooth.alias("d")
    parent = [F.when(F.col("d.domain").isNull(), F.lit(corpus[k])).otherwise(F.col(f"d.p{k}")) for k in range(len(n))]
    prior = [F.log((F.col(f"h.{c}") + HOST_WEIGHT * parent[k]) / (sums("h") + HOST_WEIGHT)) for k, c in enumerate(n)]
    return h.join(d, F.col("h.domain") == F.col("d.domain"), "left").select(F.col("h.host").alias("h"), F.array(*prior).alias("prior")), corpus


def identify(rows: DataFrame, text: Column, carry: list[str] | None = None, **columns: Column) -> DataFrame:
    """``(row, language, posterior, kept)`` per input row, the row as a struct; ``und`` where
    nothing is known. The priors are written first and broadcast only if hosts are few. Rows
    of few columns (``carry``) are written with their evidence, so that texts are scored once;
    whole rows are scored again, which costs less than to write them."""
    found = evidence(rows, text, carry=carry, **columns)
    if carry is not None:
        found = materialize(found, "lang-evidence")
    priors, corpus = host_priors(found)
    priors = materialize(priors, "lang-priors")
    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    flat = F.array(*[F.lit(math.log(p)) for p in corpus])
    out = found.join(priors, F.col("host").eqNullSafe(F.col("h")), "left")
    out = out.withColumn("post", _softmax(_add(F.col("fused"), F.coalesce("prior", flat))))
    best = F.array_max("post")
    enough = F.exists(F.slice("seen", 1, len(LANGUAGES)), lambda x: x > 0) | F.col("named")
    name = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("post", best).cast("int"))
    name = F.when(enough, name).otherwise(NONE)
    return out.select("row", name.alias("language"), best.alias("posterior"), ((name != NONE) & (best >= MIN_POSTERIOR)).alias("kept"))


def keep_identified(rows: DataFrame, text: Column, **columns: Column) -> DataFrame:
    """Only rows whose language is identified; the input columns."""
    return unwrap(identify(rows, text, **columns).where("kept"))


def identify_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """Raw pages: the declared language is the ``lang`` of the ``html`` element, host and
    suffix come from the address, the text is what stands outside tags."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract(html_col, r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-zA-Z]{2})""", 1)
    return identify(pages, bare, carry, declared=declared, url=F.col(url_col))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with all kinds of evidence, and all documents, which have neither address nor
    markup: there the source stands for the host, ``lang`` for the declared markup language.
    The tables are judged apart, each with priors of its own; a row has a ``doc_id`` or a
    ``page_id``, the other is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    none = F.lit(None).cast("long")
    of_docs = identify(docs, F.col("text"), ["doc_id"], declared=F.col("lang"), host=F.col("source"))
    of_pages = identify_pages(pages, carry=["page_id"])
    return of_docs.select("row.doc_id", none.alias("page_id"), "language", "posterior", "kept").union(of_pages.select(none.alias("doc_id"), "row.page_id", "language", "posterior", "kept"))
