"""Event-sourced reconstruction of conversations, and their rendering as chat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm.common import table

#: What opens and closes a message, and stands between its role and its text.
CHATML = ("<|im_start|>", "\n", "<|im_end|>\n")
PLAIN = ("", ": ", "\n\n")
KINDS = ("start", "delta", "edit", "regenerate")


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message_id", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """The final messages (conv, message, role, text, n_events) of an event log.

    Events of a conversation apply in the order of seq:
      start       the message begins, with a role and perhaps a first text;
      delta       text is appended;
      edit        text replaces all of the message so far;
      regenerate  all of the message so far and all messages with a higher id go; deltas that follow write it anew.
    A message is there if an event other than regenerate is left for it. Its role is the last one that any of its events gives,
    also one before a regenerate, else "unknown".

    Events without conversation, seq or message, or of another kind, are left out. Null text is empty. Equal events (a log that
    delivers twice) apply once; different events of one seq apply by kind in the order above, then by text, then by role. An empty log
    gives no messages; other columns are ignored.

    One shuffle, by conversation: the windows, and the aggregations after them, keep that partitioning. Nothing is done in Python.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("__kind"))
    own = events.select(
        F.col(conv).alias("__conv"), F.col(seq).alias("__seq"), F.col(message).alias("__msg"), F.col(kind).alias("__kind"), F.col(role).alias("__role"), F.coalesce(F.col(text), F.lit("")).alias("__text")
    )
    own = own.where(F.col("__conv").isNotNull() & F.col("__seq").isNotNull() & F.col("__msg").isNotNull() & F.col("__kind").isin(*KINDS)).repartition("__conv")
    # a place of its own for each event; equal events have one place and the copies go
    by = ["__seq", order, "__text", "__role", "__msg"]
    place = F.dense_rank().over(W.partitionBy("__conv").orderBy(*by))
    copy = F.row_number().over(W.partitionBy("__conv").orderBy(*by)) - F.rank().over(W.partitionBy("__conv").orderBy(*by))
    placed = own.withColumn("__at", place).withColumn("__copy", copy).where("__copy = 0")
    later = W.partitionBy("__conv").orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -1)
    gone = F.min(F.when(F.col("__kind") == "regenerate", F.col("__msg"))).over(later)
    mine = W.partitionBy("__conv", "__msg")
    reset = F.max(F.when(F.col("__kind").isin("edit", "regenerate"), F.col("__at"))).over(mine)
    last_role = F.max(F.when(F.col("__role").isNotNull(), F.struct("__at", "__role"))).over(mine)
    marked = placed.select("*", gone.alias("__gone"), reset.alias("__reset"), last_role["__role"].alias("__last_role"))
    live = marked.where((F.col("__kind") != "regenerate") & (F.col("__gone").isNull() | (F.col("__gone") > F.col("__msg")) | ((F.col("__gone") == F.col("__msg")) & (F.col("__reset") < F.col("__at")))))
    live = live.where(F.col("__gone").isNull() | (F.col("__gone") >= F.col("__msg")))
    kept = F.when(F.coalesce(F.col("__at") >= F.col("__reset"), F.lit(True)), F.struct("__at", "__text"))
    grouped = live.groupBy("__conv", "__msg").agg(F.array_sort(F.collect_list(kept)).alias("__parts"), F.max("__last_role").alias("__role"), F.count("*").alias("n_events"))
    return grouped.select(
        F.col("__conv").alias(conv), F.col("__msg").alias(message), F.coalesce("__role", F.lit("unknown")).alias("role"), F.array_join(F.transform("__parts", lambda p: p["__text"]), "").alias("text"), "n_events"
    )


def _escaped(text: Column, style: tuple[str, str, str]) -> Column:
    """Text in which no marker of the style can be read: <| becomes < |."""
    return F.replace(text, F.lit("<|"), F.lit("< |")) if any("<|" in s for s in style) else text


def render(messages: DataFrame, conv: str = "conv_id", message: str = "message_id", style: tuple[str, str, str] = CHATML) -> DataFrame:
    """(conv, n_messages, rendered): each conversation's messages in the order of their ids, in the given style.

    Markers that a text or role contains are made harmless. Messages of one id go by role, then by text; equal ones each count. A null role is
    "unknown", a null text empty, so every message is rendered; a null message id comes first, and messages without a conversation are one of their own.
    An empty table gives no rows; other columns are ignored.
    """
    opened, between, closed = style
    one = F.struct(F.col(message).alias("m"), F.coalesce("role", F.lit("unknown")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(F.lit(opened), _escaped(x["r"], style), F.lit(between), _escaped(x["t"], style), F.lit(closed)))
    return messages.groupBy(conv).agg(F.count("*").alias("n_messages"), F.array_join(parts, "").alias("rendered"))


def events_of(conversations: DataFrame) -> DataFrame:
    """An event log of the table conversations: each turn starts and is streamed in three deltas. Every fifth turn first streams a
    draft, with a message after it, that a regenerate then discards; every seventh is edited at the end. One event in eleven comes twice.
    """
    c, n, t = F.col("turn"), F.length("text"), F.coalesce("text", F.lit(""))
    third = F.floor(F.coalesce(n, F.lit(0)) / 3).cast("int")
    h = F.col("conv_id") + F.col("turn")
    e = lambda k, kind, text, m=c, role=F.lit(None): F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), m.cast("bigint").alias("message_id"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    none = F.lit(None)
    draft = F.array(e(1, "delta", F.reverse(t)), e(2, "start", none, c + 1, F.lit("assistant")), e(3, "delta", F.lit("discarded"), c + 1), e(4, "regenerate", none))
    always = F.array(e(5, "delta", F.substring(t, 1, third)), e(6, "delta", t.substr(third + 1, third)), e(7, "delta", t.substr(2 * third + 1, F.length(t))))
    edit = F.array(e(8, "edit", F.concat(F.lit("[edited] "), t)))
    empty = F.slice(edit, 1, 0)
    listed = F.concat(F.array(e(0, "start", none, c, F.col("role"))), F.when(h % 5 == 0, draft).otherwise(empty), always, F.when(h % 7 == 0, edit).otherwise(empty))
    log = conversations.select("conv_id", "turn", F.explode(listed).alias("e")).select("conv_id", (F.col("turn") * 10 + F.col("e.k")).alias("seq"), "e.message_id", "e.kind", "e.role", "e.text")
    twice = F.when((F.col("conv_id") + F.col("seq")) % 11 == 0, 2).otherwise(1)
    return log.select("*", F.explode(F.sequence(F.lit(1), twice)).alias("__c")).drop("__c")


def query(spark, sf_dir):
    return render(fold(events_of(table(spark, sf_dir, "conversations"))))


SQL = """
WITH m AS (SELECT conv_id, turn, arg_max(coalesce(role, 'unknown'), coalesce(role, '')) AS role, coalesce(arg_max(text, text), '') AS text, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
f AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 7 = 0 THEN '[edited] ' ELSE '' END || text AS text FROM m)
SELECT conv_id, count(*) AS n_messages,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM f GROUP BY conv_id
"""
