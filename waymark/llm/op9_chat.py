"""Operator 9, chat formatting; DataFrame functions only.

Turn structs of a conversation are collected and sorted, neighbours of one role
are merged into one block, and everything is concatenated:

    ### role:
    text<turn/>text of the next turn of the same role</turn>

Inside roles and texts a backslash, ``<`` and ``#`` (in roles ``:`` too) are
written as ``\\b``, ``\\l``, ``\\h`` and ``\\c``, so no control string can occur
there and the output can be read back exactly.

Defined results: a null text or role is empty; turns are ordered by (turn, role,
text), null turns first, so ties and repeated rows have one order and each row
counts as a turn; null ids form one conversation; an empty table gives an empty
result; other columns are ignored.  A conversation is collected in runs of
``CHUNK`` turn numbers first, so that a very long one is sorted in pieces; its
formatted text is one row, as the result asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

CHUNK = 512
HEAD, MIDDLE, JOIN, END = "### ", ":\n", "<turn/>", "</turn>\n"
LOSS_ROLE = "assistant"
PROBE = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, ``formatted`` and ``segments``: its pieces in order, each with its loss mask."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
        F.floor(F.col("turn") / CHUNK).alias("chunk"),
    )
    runs = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ts"))).alias("runs"))

    def pieces(ts: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            joined = F.coalesce(F.get(ts, i - 1)["role"] == t["role"], F.lit(False)) & (i > 0)
            last = ~F.coalesce(F.get(ts, i + 1)["role"] == t["role"], F.lit(False))
            piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
            return F.array(
                piece(F.when(joined, F.lit(JOIN)).otherwise(F.concat(F.lit(HEAD), _role(t["role"]), F.lit(MIDDLE))), F.lit(False)),
                piece(escape(t["text"]), t["role"] == loss_role),
                piece(F.when(last, F.lit(END)).otherwise(F.lit("")), F.lit(False)),
            )

        return F.filter(F.flatten(F.transform(ts, of)), lambda p: p["text"] != "")

    out = whole.select("conv_id", let(F.flatten(F.transform("runs", lambda r: r["ts"])), pieces).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda p: p["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted conversation was made of."""

    def of(block: Column) -> Column:
        def body(head: Column) -> Column:
            texts = F.split(F.substring(block, F.length(head) + len(MIDDLE) + 1, F.length(block)), JOIN)
            role = unescape(F.replace(F.substring(head, F.lit(len(HEAD) + 1), F.length(head)), F.lit("\\c"), F.lit(":")))
            return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

        return let(F.substring_index(block, MIDDLE, 1), body)

    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    return F.flatten(F.transform(blocks, of))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text"))
    out = format_conversations(given.unionByName(probe))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda p: p["loss"]), lambda p: p["text"]), ""))
    digest = let(
        read_turns(F.col("formatted")),
        lambda ts: F.struct(
            F.size(ts).cast("long").alias("n"),
            F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        ),
    )
    under = let(loss, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    read = out.select("conv_id", digest.alias("d"), under.alias("u"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", F.col("d.n").alias("n_turns"), F.col("d.sha").alias("turns_sha256"), F.col("u.n").alias("loss_chars"), F.col("u.sha").alias("loss_sha256"), "formatted_chars")


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), t AS (
  SELECT *, lag(role) OVER o IS NOT DISTINCT FROM role AS joined, lead(role) OVER o IS DISTINCT FROM role AS last,
         length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS text_chars,
         length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS role_chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN joined THEN {len(JOIN)} ELSE {len(HEAD) + len(MIDDLE)} + role_chars END + CASE WHEN last THEN {len(END)} ELSE 0 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
