r"""Chat formatting: every assistant turn becomes an example of its own, whose context is
all preceding turns and whose only trainable text is that reply.

The examples of one conversation are prefixes of one transcript, so the transcript is formed
once, as formatted segments (one per turn), and an example is a range over it:
``[0, context_end)`` is context and ``[loss_start, loss_end)`` the reply under the mask.
``written_examples`` writes every context out, which is quadratic in the turns of a
conversation; the query does so, too, and takes its digests from these examples.

Template: ``<turn role=R>\n`` text ``\n</turn>\n``. Inside a text ``\`` becomes ``\b`` and
``<`` becomes ``\l``, in a role also ``>`` becomes ``\g`` and a line feed ``\n``; so no text
can hold a control string, and reading back is exact.

Defined results: null texts and roles are empty strings; rows are ordered by turn (null
last), then role, then text; repeated rows are turns of their own; null ``conv_id`` is one
conversation; conversations without an assistant have a transcript and no example; an empty
table gives an empty table. A text may be as long as a row may be, and so may a transcript.
Long conversations are gathered in blocks of turns before they are joined, and their examples
are written by many tasks. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.llm.common import table

BLOCK = 64
#: Code points of contexts that one task writes out of one conversation, give or take one.
CONTEXT_CHARS = 1 << 26
END = "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def format_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, segment)``: each turn with its formatted segment."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<turn role="), escape_role(role), F.lit(">\n"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("segment", F.concat(head, escape(F.col("text")), F.lit("\n</turn>\n")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """``(conv_id, transcript)``: the formatted turns of a conversation, in order. Blocks of
    turns are sorted and joined first, spread over all tasks; then blocks are joined."""
    # all other null, negative or sparse turns still order rightly: blocks are ranges of turn
    block = F.floor(F.col("turn") / BLOCK)
    parts = (
        format_turns(conversations)
        .groupBy("conv_id", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(2**63 - 1)).alias("turn"), "role", "text", "segment"))).alias("t"))
        .select("conv_id", F.coalesce("block", F.lit(2**63 - 1)).alias("block"), F.array_join(F.col("t.segment"), "").alias("part"))
    )
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("block", "part")))["part"], "")
    return parts.groupBy("conv_id").agg(whole.alias("transcript"))


def segments(transcript: Column) -> Column:
    """The transcript cut after every end mark; escaped texts cannot hold one."""
    return F.array_remove(F.split(transcript, "(?<=\n</turn>\n)", -1), "")


def masked_segments(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n, segment, start, loss_start, loss_end)``: the transcript's segments with
    their place and, for the assistant's, the trainable range (else null), all in code
    points of the transcript. Transcripts are dealt by conversation already, so neither the
    running sum nor a later grouping by conversation shuffles again."""
    cut = formatted.select("conv_id", F.posexplode(segments(F.col("transcript"))).alias("n", "segment"))
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.withColumn("start", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    own = F.col("segment").startswith("<turn role=assistant>\n")
    first = F.col("start") + F.length(F.substring_index("segment", "\n", 1)) + 1
    last = F.col("start") + F.length("segment") - F.length(F.lit("\n</turn>\n"))
    return spans.withColumn("loss_start", F.when(own, first)).withColumn("loss_end", F.when(own, last))


def prefix_examples(formatted: DataFrame) -> DataFrame:
    """``(conv_id, example, context_end, loss_start, loss_end)`` in code points of the
    transcript, one row per assistant turn: everything before ``context_end`` is context,
    and only ``[loss_start, loss_end)`` is trainable."""
    own = masked_segments(formatted).where(F.col("loss_start").isNotNull())
    return own.select("conv_id", F.col("n").alias("example"), F.col("loss_start").alias("context_end"), "loss_start", "loss_end")


def render_examples(formatted: DataFrame) -> DataFrame:
    """``(conv_id, example, context, reply)``: prefixes written out as texts."""
    e = prefix_examples(formatted).withColumnRenamed("conv_id", "_c")
    cut = F.expr("substring(transcript, 1, cast(context_end as int))"), F.expr("substring(transcript, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")
    return formatted.join(e, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "example", cut[0].alias("context"), cut[1].alias("reply"))


def written_examples(formatted: DataFrame, block_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``(conv_id, example, context, known, reply)``, one row per assistant turn: its context
    written out, of which the example before holds the first ``known`` code points, and its
    reply. Turns after the last reply are no example's; they follow as a row whose reply is
    null, with the whole transcript as context. Examples whose contexts together pass
    ``block_chars`` are dealt in blocks over the tasks, each with a copy of the transcript."""
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        masked_segments(formatted)
        .withColumn("known", F.coalesce(F.max("loss_end").over(before) + F.length(F.lit(END)), F.lit(0)))
        .withColumn("last", F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull())
        .where(F.col("loss_start").isNotNull() | F.col("last"))
        .withColumn("context_end", F.coalesce("loss_start", F.col("start") + F.length("segment")))
        .withColumn("block", F.floor(F.coalesce(F.sum("context_end").over(before), F.lit(0)) / block_chars))
        .withColumn("blocks", F.max("block").over(Window.partitionBy("conv_id")))
        .select(F.col("conv_id").alias("_c"), "block", "blocks", F.struct(F.col("n").alias("example"), "context_end", "loss_start", "loss_end", "known").alias("e"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    few = formatted.join(marked.where("blocks = 0"), same).select("conv_id", "transcript", "e.*")
    parts = marked.where("blocks > 0").groupBy("_c", "block").agg(F.collect_list("e").alias("e"))
    tasks = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = formatted.join(parts, same).repartition(tasks, "conv_id", "block").select("conv_id", "transcript", F.explode("e").alias("e")).select("conv_id", "transcript", "e.*")
    cut = F.expr("substring(transcript, 1, cast(context_end as int))"), F.expr("substring(transcript, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")
    return few.union(many).select("conv_id", "example", cut[0].alias("context"), "known", cut[1].alias("reply"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makes every example, its context written out, and reads everything back from them:
    turns by parsing contexts and replies, the trainable text from the replies."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    formatted = transcripts(given.unionByName(own))
    return read_back(formatted)


def _turn(segment: Column) -> Column:
    """Role and text of a formatted turn, a line feed after each."""
    role = unescape_role(F.regexp_extract(segment, r"^<turn role=([^>]*)>", 1))
    text = unescape(F.substr(segment, F.instr(segment, "\n") + 1, F.length(segment) - F.instr(segment, "\n") - F.length(F.lit(END))))
    return F.concat(role, F.lit("\n"), text, F.lit("\n"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from its written examples. Each gives the turns of its
    context that the one before does not hold, and its reply; so each turn counts once.
    ``n_examples`` and ``context_chars`` count the examples and all of their contexts."""
    fresh = F.concat(F.expr("substring(context, cast(known + 1 as int))"), F.coalesce(F.concat("reply", F.lit(END)), F.lit("")))
    joined = lambda parts: F.array_join(F.array_sort(parts)["x"], "")
    return (
        written_examples(formatted)
        .select("conv_id", "example", "reply", F.when(F.col("reply").isNotNull(), F.length("context").cast("long")).alias("_context"), fresh.alias("_f"))
        .select("conv_id", "example", "reply", "_context", F.length("_f").alias("_chars"), segments(F.col("_f")).alias("_s"))
        .select("conv_id", "_context", "_chars", F.size("_s").cast("long").alias("_n"), F.struct("example", F.array_join(F.transform("_s", _turn), "").alias("x")).alias("_t"), F.when(F.col("reply").isNotNull(), F.struct("example", unescape(F.col("reply")).alias("x"))).alias("_m"))
        .groupBy("conv_id")
        .agg(F.sum("_n").alias("n_turns"), F.collect_list("_t").alias("_t"), F.collect_list("_m").alias("_m"), F.sum("_chars").alias("formatted_chars"), F.count("_context").alias("n_examples"), F.coalesce(F.sum("_context"), F.lit(0)).alias("context_chars"))
        .withColumn("_loss", joined(F.col("_m")))
        .select("conv_id", "n_turns", F.sha2(joined(F.col("_t")), 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")
    )


_ESC = r"replace(replace({0}, '\', '\b'), '<', '\l')"
_ROLE = "replace(replace(" + _ESC.format("role") + r", '>', '\g'), chr(10), '\n')"
ORACLE = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, length('<turn role=' || {_ROLE} || '>' || chr(10) || {_ESC.format("text")} || chr(10) || '</turn>' || chr(10)) as n from c),
p as (select *, coalesce(sum(n) over (partition by conv_id order by turn nulls last, role, text rows between unbounded preceding and 1 preceding), 0) as past from f)
select conv_id, count(*)::BIGINT as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::BIGINT as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::BIGINT as formatted_chars, count(*) filter (role = 'assistant')::BIGINT as n_examples,
  coalesce(sum(past + length('<turn role=assistant>') + 1) filter (role = 'assistant'), 0)::BIGINT as context_chars
from p group by conv_id
"""
