r"""Personal data: wide generators propose spans, boosted trees judge them, calibrated
thresholds select. Built-in functions only.

Certain spans come from four patterns with their checks (addresses of mail, IPv4, cards by
Luhn's sum, international phone numbers). Five wide patterns propose more, which may overlap
each other and the certain ones: spoken mail addresses, IPv6, grouped digits, national numbers
and IBANs. Whether a candidate is personal is a matter of its form (digits, groups, checksums,
separators) and its context (cue words before, units behind): small integer features, all column
expressions, which gradient-boosted trees of depth three weigh. The trees become one column
expression; a candidate is kept where its score reaches its kind's threshold, and where no
certain span holds it.

No table marks personal data, so the trees learn from sentences made by rule
(``training_texts``): values of many forms in telling, neutral and misleading contexts, run
through the same generators. Training reads the count of every distinct feature vector, at most
``TRAIN_ROWS`` rows. A quarter of the sentences is held out: scores are calibrated on it by
pooling adjacent violators, kind by kind, and a kind's threshold is the lowest score whose
calibrated probability reaches ``PRECISION``; a kind that never does adds nothing.

Positions count code points, ends are exclusive; they come from splitting a text by a pattern,
as in ``secrets``. Patterns need no backtracking over long runs, so the work is linear in a text.
The context of a candidate reaches back ``LEFT`` code points, at most to the candidate of the
same generator before it.

Defined results: null texts count as empty; null ids pass through; rows that repeat id and text
get the same spans each; no spans: counts 0, digest of the empty string, empty list; spans that
overlap or touch are redacted as one; an empty table gives an empty table. Other columns pass
through ``redact_private``, whatever their names, and are not read elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.llm.common import discard, materialize, table, wrap
from pivotlake.llm.secrets import BROADCAST_SPANS, _let, find_spans, masked, merged_spans, running

#: Kinds in the order in which spans of one start are listed: base ones, then the method's.
KINDS = ("email", "ip", "card", "phone", "spoken_email", "ipv6", "number", "national_id", "iban")
N_BASE = 4

#: The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The same matches without retries inside a run: a run that fails from its first character fails
# from all, and a card needs at least 12 digits in a chain.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

_AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20|@)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
#: The wide generators, kind by kind.
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + r"[A-Za-z0-9-]{1,63}+(?:" + _DOT + r"[A-Za-z0-9-]{1,63}+){1,8}",
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z+.,])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
)
LEFT, RIGHT = 40, 12
MASK = "[private]"

#: Cue words before a value, by what they announce, and words that speak against.
CUES = {
    "call": r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|ring|handy|telefon|reach me)\b",
    "mail": r"\b(?:e-?mail|mail|write to|contact|correo|courriel)\b",
    "person": r"\b(?:ssn|social security|national id|passport|tax id|insured)\b",
    "bank": r"\b(?:iban|account|bank|transfer|pay to)\b",
    "net": r"\b(?:ip|ipv6|host|server|client|logged in from|address)\b",
    "other": r"(?:\b(?:order|invoice|isbn|issn|version|build|page|pages|part|sku|model|serial|ref|ticket|case|item|dated?|time|on|since|until|between|figure|section|lot|batch)\b(?:\x20?(?:no|nr|number)\b)?|[#$€£=/_*])[^a-z]{0,8}$",
}
UNITS = r"^\x20?(?:%|kg|km|cm|mm|ms|kb|mb|gb|px|usd|eur|dollars|euros|years|items|pieces|points|votes|copies|bytes|times)"
DATE = r"^(?:(?:19|20)[0-9]{2}[-/.\x20]?[01]?[0-9][-/.\x20]?[0-3]?[0-9]|[0-3]?[0-9][-/.\x20][01]?[0-9][-/.\x20](?:19|20)[0-9]{2})"
GROUPED = r"^(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[-.\x20/])[0-9]{3,4}[-.\x20][0-9]{3,4}$"

TRAIN_ROWS, ROUNDS, DEPTH, RATE = 24_000, 24, 3, 0.4
PRECISION = 0.95


def mod97(code: Column) -> Column:
    """The remainder by 97 of a text of digits and capitals (A: 10 to Z: 35)."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.regexp_extract_all(code, F.lit("."), F.lit(0)), F.lit(0), lambda a, c: F.when(value(c) < 10, a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of certain spans by kind."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    octets = f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
    return {
        "email": find_spans(text, _EMAIL, 0),
        "ip": find_spans(text, _IP, 1, lambda m: m.rlike(octets)),
        "card": find_spans(text, _CARD, 2, lambda m: F.when(F.length(digits(m)) <= 19, F.call_function("luhn_check", digits(m))).otherwise(False)),
        "phone": find_spans(text, PHONE, 3, lambda m: F.length(digits(m)).between(9, 15)),
    }


def find_candidates(text: Column, kind: int) -> Column:
    """A generator's spans, each with its match and what stands before and behind it."""
    pattern = GENERATORS[kind - N_BASE]

    def candidates(matches: Column, gaps: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        return _let(running(sizes, lambda a, x: a + x), lambda ends: F.transform(matches, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), m.alias("m"),
            F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("right"),
        )))

    found = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), lambda x: candidates(x["m"], x["g"]))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:int,m:string,left:string,right:string>>)"))


def features(c: Column) -> dict[str, Column]:
    """Small integers of a candidate ``(kind, m, left, right)``."""
    m, left, right = c["m"], F.lower(c["left"]), F.lower(c["right"])
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    digits = F.array_join(groups, "")
    plain = F.regexp_replace(m, "\x20", "")
    check = (
        F.when(c["kind"] == 8, mod97(F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))) == 1)
        .when(c["kind"] == 7, ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits))
        .otherwise(False)
    )
    style = lambda bracket, bare: F.when(m.rlike(bracket), 1).when(m.rlike(bare), 2).otherwise(0)
    out = {
        "kind": c["kind"] - N_BASE, "digits": F.least(F.length(digits), F.lit(24)), "length": F.least(F.length(m), F.lit(48)), "groups": F.least(F.size(groups), F.lit(12)),
        "longest": F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(20)), "marks": F.least(F.regexp_count(m, F.lit("[^A-Za-z0-9]")), F.lit(16)),
        "check": check.cast("int"), "date": m.rlike(DATE).cast("int"), "grouped": m.rlike(GROUPED).cast("int"), "unit": right.rlike(UNITS).cast("int"),
        "at": style(r"[\[({<]\x20?(?:at|AT|@)", r"\x20(?:at|AT)\x20"), "dot": style(r"[\[({<]\x20?(?:dot|DOT|\.)", r"\x20(?:dot|DOT)\x20"), "domain": F.when(m.rlike(r"[^A-Za-z0-9-][a-z]{2,6}$"), 1).otherwise(0),
        "colons": F.regexp_count(m, F.lit(":")), "hex": m.rlike("[a-fA-F]").cast("int"), "zero": m.rlike(r"^\(?0").cast("int"),
    }
    return out | {f"cue_{name}": left.rlike(cue).cast("int") for name, cue in CUES.items()}


# --- sentences made by rule -------------------------------------------------------------

#: ``#`` digit, ``^`` small letter, ``~`` capital, ``*`` hexadecimal digit; ``IBAN`` a valid number.
_GROUPED = ("###-###-####", "(###) ###-####", "(###)###-####", "### ### ####", "###.###.####")
_LOCAL = ("0### ######", "0## #### ####", "0##########", "##########", "0###/#######", "###-####")
_RUNS = ("#######", "########", "############", "################", "#### ####", "97#-#-###-#####-#", "##.##.##.##.##", "###/####/##", "########-#####")
_DATES = ("20##-0#-1#", "1#/0#/20## 1#", "0#.1#.19##", "201#0#1# 1#", "20## 20## 20##")
_SPOKEN = ("^^^^^.^^^^^ [at] ^^^^^^ [dot] com", "^^^^ (at) ^^^^^^.org", "^^^^##[at]^^^^^.net", "^^^^^ at ^^^^^^ dot com", "^^^ AT ^^^^^ DOT org", "^^^^_^^^(@)^^^^^^.de")
_PROSE = ("^^^^^ at ^^^^^^.~^^", "^^^^ at ^^^.^^^^^^^^^", "^^^^^^ at ^^^^^.~^^^^", "^^^^ at ###.##", "^^ at ^^^^.#")
_V6 = ("2001:*###:*##*:#*#*:**#*:***#:#***:*#**", "fe80::*#**:#***:***#:**#*", "2a0#:*#*#::*#*", "fd##:####:***#::#*:#*#")
_TIMES = ("1#:0#:3#", "0#:1#:5#:#", "2#:##:##:##", "####:##:##", "#:##:##")
_CODES = ("~~## #### #### ####", "~~##########", "~~## ~~~~ #### ~~~~", "~~##~~~~####")
#: What comes before: announcing words of each kind, words that speak against, neither.
_BEFORE = {
    "call": ("call me on ", "phone: ", "tel. ", "my mobile is ", "Fax ", "whatsapp "), "mail": ("email ", "write to ", "contact: ", "mail me: "), "person": ("ssn ", "social security no. ", "passport "),
    "bank": ("iban ", "to my bank account ", "pay to "), "net": ("logged in from ", "client ip ", "server "), "other": ("order ", "invoice no. ", "isbn ", "version ", "page ", "part no. ", "on ", "dated ", "ticket #", "model ", "ref: ", "$", "serial ", "item "), "none": ("of the ", "and then ", "it was ", "we saw ", "in a "),
}
_BEHIND = (" and more.", ".", ", thank you", " in the house", "\n")
_MEASURED = (" kg", " euros", " votes", "%", " points")


def templates() -> list[tuple[str, str, str, int]]:
    """``(before, form, behind, kind)`` for every form in every context; ``kind`` is that of the
    personal value, or -1. Some forms tell enough by themselves, others need a cue."""
    out = []
    every = set(_BEFORE)
    for kind, forms, yes in (
        (6, _GROUPED, every - {"other"}), (6, _LOCAL, {"call"}), (6, _RUNS, set()), (6, _DATES, set()), (4, _SPOKEN, every), (4, _PROSE, set()),
        (5, _V6, every - {"other"}), (5, _TIMES, set()), (8, _CODES, set()), (8, ("IBAN",), every), (7, ("###-##-####",), every - {"other"}),
    ):
        for form, (cue, before) in product(forms, ((c, b) for c, bs in _BEFORE.items() for b in bs)):
            out += [(before, form, behind, kind if cue in yes else -1) for behind in _BEHIND]
            out += [(before, form, behind, -1) for behind in _MEASURED if forms in (_RUNS, _LOCAL)]
    return out


def training_texts(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(id, text, begin, stop, kind)``: sentences with one value each, between ``begin`` and
    ``stop``, and the kind of the personal ones (else -1). Digits and letters come from a hash of the id."""
    all_of = spark.createDataFrame([(k, *t) for k, t in enumerate(templates())], "t long, before string, form string, behind string, kind int")
    n = all_of.count()
    seed = F.sha2(F.concat(F.lit("pii:"), F.col("id").cast("string")), 256)
    pool = {"#": F.translate(seed, "abcdef", "271839"), "^": F.translate(seed, "0123456789abcdef", "retasondilcumpgh"), "~": F.translate(seed, "0123456789abcdef", "DEFGBKLMNPRSTVXZ"), "*": seed}
    fill = lambda form: F.array_join(F.transform(F.split(form, ""), lambda c, i: F.coalesce(*[F.when(c == mark, F.substring(own, i + 3, F.lit(1))) for mark, own in pool.items()], c)), "")
    body = F.substring(pool["#"], 20, 18)
    country = F.element_at(F.array(*map(F.lit, ("DE", "FR", "ES", "GB"))), (F.col("id") % 4 + 1).cast("int"))
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)
    grouped = F.when(F.col("id") % 3 == 0, F.trim(F.regexp_replace(iban, "(.{4})", "$1 "))).otherwise(iban)
    value = F.when(F.col("form") == "IBAN", grouped).otherwise(fill(F.col("form")))
    lead = F.concat(F.substring(pool["^"], 40, 5), F.lit(" "), F.substring(pool["^"], 50, 6), F.lit(" "))
    made = spark.range(rows, numPartitions=8).join(F.broadcast(all_of), (F.col("id") * 7919) % n == F.col("t")).withColumn("value", value).withColumn("head", F.concat(lead, "before"))
    return made.select("id", F.concat("head", "value", "behind").alias("text"), F.length("head").alias("begin"), (F.length("head") + F.length("value")).alias("stop"), "kind")


# --- boosted trees ----------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A leaf if ``feature`` is empty, else ``low`` for values up to ``at`` and ``high`` above."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, x: dict[str, Column]) -> Column:
        if not self.feature:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.at, self.low.column(x)).otherwise(self.high.column(x))

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if not self.feature:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] <= self.at, self.low.of(x), self.high.of(x))


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Tree, ...]
    thresholds: dict[int, float]  # by kind; kinds without one are never kept

    def score(self, x: dict[str, Column]) -> Column:
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + t.column(x)
        return out

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return self.bias + sum(t.of(x) for t in self.trees)

    def selected(self, kind: Column, score: Column) -> Column:
        known = [(kind == k) & (score >= edge) for k, edge in self.thresholds.items()]
        out = F.lit(False)
        for k in known:
            out = out | k
        return out


def grow(x: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float = 4.0, penalty: float = 1.0) -> Tree:
    """A tree for the gradients ``g`` and curvatures ``h``: at each node the cut of highest gain."""
    total_g, total_h = g.sum(), h.sum()
    leaf = Tree(float(RATE * total_g / (total_h + penalty)))
    best = (1e-6, "", 0)
    for name, v in x.items() if depth else ():
        size = int(v.max(initial=0)) + 1
        low_g, low_h = np.cumsum(np.bincount(v, g, size))[:-1], np.cumsum(np.bincount(v, h, size))[:-1]
        gain = low_g**2 / (low_h + penalty) + (total_g - low_g) ** 2 / (total_h - low_h + penalty) - total_g**2 / (total_h + penalty)
        gain[(low_h < least) | (total_h - low_h < least)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), name, int(gain.argmax()))
    if not best[1]:
        return leaf
    low = x[best[1]] <= best[2]
    side = lambda own: grow({k: v[own] for k, v in x.items()}, g[own], h[own], depth - 1, least, penalty)
    return Tree(0.0, best[1], best[2], side(low), side(~low))


def boost(x: dict[str, np.ndarray], y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> tuple[float, tuple[Tree, ...]]:
    """Newton boosting of the logistic loss over weighted feature vectors."""
    share = min(max(float((w * y).sum() / w.sum()), 0.01), 0.99)
    bias, trees = float(np.log(share / (1 - share))), []
    score = np.full(len(y), bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(x, w * (y - p), w * p * (1 - p), depth))
        score += trees[-1].of(x)
    return bias, tuple(trees)


def calibrated(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores with the probabilities of an isotonic fit: adjacent violators pooled."""
    s, at = np.unique(score, return_inverse=True)
    yes, all_of = np.bincount(at, w * y), np.bincount(at, w)
    pools: list[list[float]] = []  # positives, weight, members
    for a, b in zip(yes, all_of, strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a2, b2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, pools[-1][2] + n2]
    return s, np.repeat([a / b for a, b, _ in pools], [n for *_, n in pools])


def judged(texts: DataFrame) -> DataFrame:
    """``(id, c, personal)``: the candidates of training texts; personal are those of the value's
    kind that cover its greater part."""
    c = F.explode(F.concat(*[find_candidates(F.col("text"), k) for k in range(N_BASE, len(KINDS))]))
    shared = F.least("stop", "c.end") - F.greatest("begin", "c.start")
    return texts.withColumn("c", c).select("id", "c", ((F.col("kind") == F.col("c.kind")) & (2 * shared > F.col("stop") - F.col("begin"))).cast("int").alias("personal"))


def labelled(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(features ..., personal, held, n)``: distinct feature vectors of the training texts'
    candidates and how often they occur."""
    x = features(F.col("c"))
    held = (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("held")
    return judged(training_texts(spark, rows)).select(*[v.cast("int").alias(k) for k, v in x.items()], "personal", held).groupBy(*x, "personal", "held").agg(F.count("*").alias("n"))


def train(spark: SparkSession, rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Model:
    """Trees from three quarters of the sentences, thresholds from the rest."""
    counts = labelled(spark, rows)
    names = counts.columns[:-3]
    got = counts.orderBy(*counts.columns).collect()
    cut = lambda part: ({k: np.array([r[k] for r in part], "i8") for k in names}, np.array([r["personal"] for r in part], "f8"), np.array([r["n"] for r in part], "f8"))
    x, y, w = cut([r for r in got if not r["held"]])
    model = Model(*boost(x, y, w), {})
    x, y, w = cut([r for r in got if r["held"]])
    score, edges = model.of(x), {}
    for kind in np.unique(x["kind"]):
        own = x["kind"] == kind
        s, p = calibrated(score[own], y[own], w[own])
        if (p >= precision).any():
            edges[int(kind) + N_BASE] = float(s[p >= precision][0]) - 1e-9
    return Model(model.bias, model.trees, edges)


# --- scan and redaction -----------------------------------------------------------------

_SPANS = "cast(array() as array<struct<start:bigint,end:bigint,kind:int>>)"


def scan_parts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per input row: id, a hash of the text that tells versions of an id apart, certain spans
    by kind, and all candidates."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    for name, spans in base_spans(F.col("_t")).items():
        rows = rows.withColumn(name, spans)
    return rows.withColumn("candidates", F.concat(*[find_candidates(F.col("_t"), k) for k in range(N_BASE, len(KINDS))])).withColumn("_key", F.xxhash64("_t")).drop("_t")


def select_candidates(parts: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, _key, added)``: the selected candidates of the rows that have any. Certain
    spans hold a candidate where, of all that start no later, one ends no earlier."""
    own = parts.where(F.size("candidates") > 0).select("doc_id", "_key", F.concat("email", "ip", "card", "phone").alias("base"), "candidates").dropDuplicates(["doc_id", "_key"])
    c = own.select("doc_id", "_key", F.explode("candidates").alias("c")).select("doc_id", "_key", "c", *[v.cast("int").alias(k) for k, v in features(F.col("c")).items()])
    names = [x for x in c.columns if x not in ("doc_id", "_key", "c")]
    score = model.score({k: F.col(k) for k in names})
    good = c.where(model.selected(F.col("c.kind"), score)).select("doc_id", "_key", "c.start", "c.end", "c.kind")
    base = own.select("doc_id", "_key", F.explode("base").alias("c")).select("doc_id", "_key", "c.start", "c.end", "c.kind")
    before = Window.partitionBy("doc_id", "_key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("kind") < N_BASE, F.col("end"))).over(before)
    new = good.union(base).withColumn("reach", F.coalesce(reach, F.lit(-1))).where((F.col("kind") >= N_BASE) & (F.col("reach") < F.col("end")))
    return new.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))


def _scan(docs: DataFrame, text_col: str, id_col: str, model: Model | None) -> tuple[DataFrame, DataFrame]:
    model = model or train(docs.sparkSession)
    parts = materialize(scan_parts(docs, text_col, id_col), "pii-parts")
    added = select_candidates(parts, model).toDF("_d", "_k", "added")
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    base = F.concat("email", "ip", "card", "phone")
    return parts, parts.join(added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").select(
        "doc_id", "_key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:N_BASE]], order(base).alias("base"), order(F.concat(base, F.coalesce("added", F.expr(_SPANS)))).alias("spans")
    )


def scan_private(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``(doc_id, _key, n_email, n_ip, n_card, n_phone, base, spans)`` per input row: certain
    spans and all spans, sorted by start, then kind. The scan's small result is written once
    and read twice; it stays for the returned frame."""
    return _scan(docs, text_col, id_col, model)[1]


def redact_private(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Model | None = None, mask: str = MASK) -> DataFrame:
    """The input rows with every span replaced by ``mask``. A null text stays null. Spans are
    written and, if few in all, broadcast, so that texts are not shuffled."""
    parts, scanned = _scan(docs, text_col, id_col, model)
    found = materialize(scanned.where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("_key").alias("k"), merged_spans(F.col("spans")).alias("m")).dropDuplicates(["d", "k"]), "pii-spans")
    discard(parts)
    if (found.agg(F.sum(F.size("m"))).first()[0] or 0) <= BROADCAST_SPANS:
        found = F.broadcast(found)
    rows = wrap(docs, id=F.col(id_col), text=F.col(text_col), key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    clean = F.when(F.col("m").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("m"), mask))
    return out.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def span_list(spans: str) -> Column:
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, name), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_private(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))
