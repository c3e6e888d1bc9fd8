"""Secret scans with multipart credential linking, in built-in functions only.

Certain spans come from three patterns (assignments, access identifiers, long hex runs).
Weak candidates (long mixed tokens) prove nothing alone: they are reported only when a
complementary part, an access identifier or an endpoint, stands in the same scope, that is
at most ``SCOPE`` code points away. Parts are laid out as intervals, keyed by document and
position block, and joined on overlapping scopes; of every secret (an assignment or a weak
candidate) the links to its nearest identifier and its nearest endpoint are kept.

Positions come from splitting a text by a pattern: pieces and matches alternate, so their
lengths add up to every start. All positions count code points, ends are exclusive. Running
sums over arrays go in blocks of ``BLOCK`` values, so that the work grows with the matches
and not with their square; so does redaction, which cuts a text into chunks first.

Defined results: null texts count as empty; null ids pass through; rows that repeat id and
text get the same spans each; no spans: counts 0, digest of the empty string, empty list;
touching spans are redacted as one; of parts equally near, the first links; an empty table
gives an empty table. A text may be as long as a row may be and hold any number of matches.
Other columns pass through ``redact_secrets``, whatever their names, and are not read
elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.llm.common import discard, materialize, table, wrap

#: Kinds in the order in which spans of one start are listed: base ones, then the method's.
KINDS = ("assign", "access", "hex", "endpoint", "weak")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns.
ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: A run of 16 or more is found by the longer pattern alone; shorter runs are dropped anyway.
HEX_LONG = "[0-9a-f]{16,}"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
WEAK = r"[A-Za-z0-9+/_-]{32,}"
SCOPE = 200
MASK = "[secret]"

_SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


#: Values of an array that one running sum goes through; code points of a chunk of text.
BLOCK, CHUNK = 512, 256
#: Spans in all up to which the found ones are broadcast to the texts (some 40 bytes each).
BROADCAST_SPANS = 500_000
_EMPTY = f"cast(array() as {_SPAN})"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running results of ``step`` from 0 over an array of longs. An array that grows by
    one value at a time is copied each time, so values go in blocks, of which only the totals
    are run through one after the other."""
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda start, own: F.aggregate(own, start, lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))

    def run(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda b: _let(grow(zero, F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("long"), step))), lambda before: F.flatten(F.transform(b, lambda x, k: F.slice(grow(F.array(F.get(before, k)), x), 2, BLOCK)))))

    return _let(values, run)


def find_spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans. Matches that fail ``keep``
    are dropped but have been consumed. Texts without a match are not split."""

    def spans(matches: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        found = F.zip_with(matches, running(sizes, lambda a, x: a + x), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), (keep(m) if keep else F.lit(True)).alias("ok")))
        return F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.when(F.rlike(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.expr(_EMPTY))


def scan_parts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, a hash of the text that tells versions of an id apart,
    the certain spans, the weak ones and the complementary ones."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
        .withColumn("assign", find_spans(F.col("_t"), ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12))
        .withColumn("access", find_spans(F.col("_t"), ACCESS, 1, lambda m: F.length(m) >= 18))
        .withColumn("hex", find_spans(F.col("_t"), HEX_LONG, 2))
        .withColumn("endpoint", find_spans(F.col("_t"), ENDPOINT, 3))
        .withColumn("weak", find_spans(F.col("_t"), WEAK, 4, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")))
        .withColumn("_key", F.xxhash64("_t"))
        .drop("_t")
    )


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, _key, linked, links)`` for rows with linked parts. A secret's interval,
    widened by the scope, overlaps an access identifier or an endpoint. Both sides are cut
    into position blocks, so that a very long text is spread over many keys. ``linked`` holds
    weak candidates with company and the endpoints that support them; ``links`` holds
    ``(secret, part)``, the nearest identifier and the nearest endpoint of every secret."""
    both = parts.where((F.size("weak") + F.size("assign") > 0) & (F.size("access") + F.size("endpoint") > 0)).select("doc_id", "_key", "access", "endpoint", "weak", "assign").distinct()
    blocks = lambda s, wide: F.explode(F.sequence(F.floor((s["start"] - wide) / scope), F.floor((s["end"] + wide) / scope)))
    secret = both.select("doc_id", "_key", F.explode(F.concat("weak", "assign")).alias("s")).select("*", blocks(F.col("s"), scope).alias("block")).alias("x")
    part = both.select("doc_id", "_key", F.explode(F.concat("access", "endpoint")).alias("s")).select("*", blocks(F.col("s"), 0).alias("block")).alias("y")
    gap = F.greatest(F.col("y.s.start") - F.col("x.s.end"), F.col("x.s.start") - F.col("y.s.end"), F.lit(0))
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x._key") == F.col("y._key")) & (F.col("x.block") == F.col("y.block"))
    near = secret.join(part, same & (gap <= scope)).select("x.doc_id", "x._key", F.col("x.s").alias("s"), F.struct(gap.alias("gap"), F.col("y.s.start").alias("start"), F.col("y.s.end").alias("end"), F.col("y.s.kind").alias("kind")).alias("p"))
    nearest = lambda kind: F.min(F.when(F.col("p.kind") == kind, F.col("p")))
    plain = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"))
    links = F.transform(F.array_compact(F.array("one", "two")), lambda p: F.struct(F.col("s").alias("secret"), plain(p).alias("part")))
    secrets = near.groupBy("doc_id", "_key", "s").agg(nearest(1).alias("one"), nearest(3).alias("two")).select("doc_id", "_key", "s", links.alias("links"))
    ends = near.where((F.col("s.kind") == 4) & (F.col("p.kind") == 3)).select("doc_id", "_key", plain(F.col("p")).alias("s")).distinct()
    found = secrets.union(ends.withColumn("links", F.lit(None).cast(secrets.schema["links"].dataType)))
    return found.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_list(F.when(F.col("s.kind") >= 3, F.col("s")))).alias("linked"), F.array_sort(F.flatten(F.collect_list("links"))).alias("links"))


def _scan(docs: DataFrame, text_col: str, id_col: str, scope: int) -> tuple[DataFrame, DataFrame]:
    """The stored parts, and the result from them."""
    parts = materialize(scan_parts(docs, text_col, id_col), "secret-parts")
    linked = link_parts(parts, scope).toDF("_d", "_k", "linked", "links")
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    base = F.concat("assign", "access", "hex")
    return parts, parts.join(linked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").select(
        "doc_id", "_key", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        order(base).alias("base"), order(F.concat(base, F.coalesce("linked", F.expr(_EMPTY)))).alias("spans"), F.coalesce("links", F.expr(f"cast(array() as array<struct<secret:{_SPAN[6:-1]},part:{_SPAN[6:-1]}>>)")).alias("links"),
    )


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``(doc_id, _key, n_assign, n_access, n_hex, base, spans, links)`` per input row:
    certain spans and all spans, sorted by start, then kind. The scan's small result is
    written once and read twice; it stays for the returned frame."""
    return _scan(docs, text_col, id_col, scope)[1]


def merged_spans(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined, as ``(start, end)``."""

    def join(v: Column) -> Column:
        reach = running(F.transform(v, lambda s: s["end"]), lambda a, x: F.greatest(a, x))

        def cut(r: Column) -> Column:
            heads = F.filter(F.transform(v, lambda s, i: F.when((i == 0) | (s["start"] > F.get(r, i - 1)), i)), lambda i: i.isNotNull())
            return _let(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(v, i)["start"].alias("start"), F.get(r, F.coalesce(F.get(h, k + 1), F.size(v)) - 1).alias("end"))))

        return _let(reach, cut)

    return _let(spans, join)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with merged ``spans`` replaced. A piece between two spans is taken from the
    chunks that it lies in, not from the text's first character on."""

    def pieces(c: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            first = F.floor(low / CHUNK).cast("int")
            own = F.array_join(F.slice(c, first + 1, F.floor(high / CHUNK).cast("int") - first + 1), "")
            return F.substring(own, (low % CHUNK + 1).cast("int"), (high - low).cast("int"))

        return _let(spans, lambda m: F.concat(
            F.array_join(F.transform(m, lambda s, i: F.concat(between(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), s["start"]), F.lit(mask))), ""),
            between(F.element_at(m, -1)["end"], F.length(text).cast("long")),
        ))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), pieces)


def redact_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """The input rows with every reported span replaced by ``mask``; overlapping spans are
    joined first. A null text stays null. Rows are matched by id and text, so repeated rows
    stay as many as they are. The found spans are written and, if few in all, broadcast, so
    that texts are not shuffled."""
    parts, scanned = _scan(docs, text_col, id_col, scope)
    found = materialize(scanned.where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("_key").alias("k"), merged_spans(F.col("spans")).alias("m")).dropDuplicates(["d", "k"]), "secret-spans")
    discard(parts)
    if (found.agg(F.sum(F.size("m"))).first()[0] or 0) <= BROADCAST_SPANS:
        found = F.broadcast(found)
    rows = wrap(docs, id=F.col(id_col), text=F.col(text_col), key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    clean = F.when(F.col("m").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("m"), mask))
    return out.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def _name(s: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))


def span_list(spans: str) -> Column:
    return F.array_join(F.transform(spans, _name), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns ``links``: secret and part of each link, joined by >."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(">", _name(x["secret"]), _name(x["part"]))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), links.alias("links"))


def _oracle() -> str:
    """The same rows in DuckDB: spans from running sums over pieces and matches, links from a
    join of all parts of a text, without blocks."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    assign, endpoint = ASSIGN, ENDPOINT.replace(r"\s", r" \t\n\x0B\f\r")
    keep = {0: f"length(regexp_extract(m, {q(assign)}, 2)) >= 12", 1: "length(m) >= 18", 2: "length(m) >= 16", 3: "true", 4: "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"}
    kinds = [
        f"select k, {n} as kind, e - length(m) as s, e from (select k, m, sum(length(g) + coalesce(length(m), 0)) over (partition by k order by i) as e from (select k, generate_subscripts(string_split_regex(t, {q(p)}), 1) as i, unnest(string_split_regex(t, {q(p)})) as g, unnest(regexp_extract_all(t, {q(p)})) as m from d)) where m is not null and {keep[n]}"
        for n, p in enumerate((assign, ACCESS, HEX, endpoint, WEAK))
    ]
    names = "[" + ", ".join(f"'{x}'" for x in KINDS) + "]"
    name = lambda t: f"{names}[{t}.kind + 1] || ':' || {t}.s || ':' || {t}.e"
    gap = "greatest(p.s - w.e, w.s - p.e, 0)"
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
a as materialized ({" union all ".join(kinds)}),
n as (select w.k, w.kind, w.s, w.e, p.kind as pk, p.s as ps, p.e as pe, {gap} as gap from a w join a p on w.k = p.k where w.kind in (0, 4) and p.kind in (1, 3) and {gap} <= {SCOPE}),
r as (select k, kind, s, e from a where kind < 3 union select k, kind, s, e from n where kind = 4 union select k, pk, ps, pe from n where kind = 4 and pk = 3),
l as (select * from (select *, row_number() over (partition by k, kind, s, e, pk order by gap, ps, pe) as nth from n) where nth = 1),
b as (select k, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, string_agg({name("a")}, ',' order by s, kind, e) as base from a where kind < 3 group by k),
x as (select k, string_agg({name("r")}, ',' order by s, kind, e) as spans from r group by k),
y as (select k, string_agg({name("l")} || '>' || {names}[pk + 1] || ':' || ps || ':' || pe, ',' order by s, e, kind, ps, pe, pk) as links from l group by k)
select doc_id, coalesce(n0, 0)::BIGINT as n_assign, coalesce(n1, 0)::BIGINT as n_access, coalesce(n2, 0)::BIGINT as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(links, '') as links
from d left join b using (k) left join x using (k) left join y using (k)
"""


ORACLE = _oracle()
