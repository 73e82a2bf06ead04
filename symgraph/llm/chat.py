"""Chat formatting by event-sourced reconstruction (native).

Log events are partitioned by conversation and sorted by sequence; streamed deltas, edits and
regenerations fold into final messages, which are rendered with a reversible template.

Events: ``conv_id, seq, op, msg, role, text``.

* ``message``, ``edit`` and ``regenerate`` set message ``msg`` to ``text``; ``delta`` appends to it.
* ``regenerate`` also drops the messages after ``msg`` that the log had by then.
* A message's role is that of its last event that names one.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Control strings inside texts get a
backslash after their first character (one more, if they have some), which reading takes off again.

Defined cases: null text or role is empty; null ``op`` is ``message``; null ``seq`` or ``msg`` sorts
first; events with equal ``seq`` apply in the order of op, role and text; repeated events each apply;
a conversation with null id is one conversation; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of other common ones, without their first character.
CONTROL = r"([<\[])(\\*(?:\|[A-Za-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>|/?(?:SYSTEM|USER|ASSISTANT)\]))"
ESCAPED = r"([<\[])\\(\\*(?:\|[A-Za-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>|/?(?:SYSTEM|USER|ASSISTANT)\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: ``conv_id, msg, role, text``. One shuffle, on conv_id."""
    e = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    sets = F.col("op") != "delta"
    e = e.withColumn("ord", F.row_number().over(conv.orderBy("seq", "op", "role", "text")))
    # Messages before this one, regenerated later: what the log had by then is gone.
    e = e.withColumn("place", F.dense_rank().over(conv.orderBy("msg")).cast("long"))
    cut = F.max(F.when(F.col("op") == "regenerate", F.col("ord"))).over(conv.orderBy("place").rangeBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("cut", F.coalesce(cut, F.lit(0))).where("ord > cut")
    e = e.withColumn("reset", F.coalesce(F.max(F.when(sets, F.col("ord"))).over(Window.partitionBy("conv_id", "place")), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.when(F.col("ord") >= F.col("reset"), F.struct("ord", "text"))))
    return e.groupBy("conv_id", "place").agg(
        F.first("msg").alias("msg"),
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("ord"))), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` (start from 0 and length, in code points of ``formatted``)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "place", (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("start", (before + F.length("head")).cast("long"))
    m = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "loss", "start", "head", "body"))).alias("all"))
    spans = F.transform(F.filter("all", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), F.length(x["body"]).cast("long").alias("length")))
    text = F.array_join(F.transform("all", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return m.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold and render: one row per conversation that has a message left."""
    return render(fold(events), loss_role)


def read_back(formatted: Column) -> Column:
    """The turns (array of role, text) of a formatted conversation."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        tail = len(END) + 1
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return let(F.split(formatted, r"<\|im_start\|>"), lambda parts: F.transform(F.filter(parts, lambda p, i: i > 0), turn))


def events_of_rows(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: each row is a ``message`` event of its own."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", place.cast("long").alias("seq"), F.lit("message").alias("op"), place.cast("long").alias("msg"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, read back from ``formatted`` and its loss spans."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        formatted.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("under", F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length(F.array_join("under", "")).cast("long").alias("loss_chars"),
            F.sha2(F.array_join("under", ""), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(events_of_rows(rows.unionByName(extra))))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, 12 + length(role) + 1 + 11
    + length(regexp_replace(text, '([<\[])(\\*(?:\|[A-Za-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>|/?(?:SYSTEM|USER|ASSISTANT)\]))', '\1\\\2', 'g')) AS size
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
