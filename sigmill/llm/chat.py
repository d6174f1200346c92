"""Relational chat formatting, in Spark expressions only.

A conversation is one string. Each run of adjacent turns of one role becomes

    <turn:ROLE>text<next>text</turn>

Texts and roles are escaped so that no `<` or `>` of theirs is left: backslash
is written `\\b`, `<` is `\\l`, `>` is `\\g`. Each escape begins with a
backslash and no other backslash remains, so undoing `\\l`, `\\g` and then
`\\b` restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, NEXT, END = "<turn:", ">", "<next>", "</turn>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted.

    Turns are ordered by turn number, then role, then text, nulls first, so ties
    and repeated rows have one order; every row is kept. Null roles and texts
    are empty; turns with a null id are one conversation with a null id; no rows
    give no rows; other columns are not read. A conversation is one string in
    the end and so is put together by one task; nothing larger is.
    """
    t = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(t)).alias("t"))
    at = lambda i: F.get("t", i)["role"]
    piece = F.transform(
        "t",
        lambda x, i: F.concat(
            F.when(x["role"].eqNullSafe(at(i - 1)), NEXT).otherwise(F.concat(F.lit(OPEN), escape(x["role"]), F.lit(SHUT))),
            escape(x["text"]),
            F.when(x["role"].eqNullSafe(at(i + 1)), "").otherwise(END),
        ),
    )
    return grouped.select(id_col, F.array_join(piece, "").alias("formatted"))


def read_chats(formatted: DataFrame, formatted_col: str = "formatted") -> DataFrame:
    """Adds `turns`, array of (role, text), read back from the formatted string alone."""
    runs = F.split(F.col(formatted_col), END)
    runs = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))

    def turns(run):
        head = F.substring_index(run, SHUT, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(run, F.char_length(head) + 2)
        return F.transform(F.split(body, NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(runs, turns)))


def loss_text(turns: str | Column = "turns", role: str = "assistant") -> Column:
    """The texts that the loss mask covers, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def op5_chat_formatting(spark, sf_dir):
    from .common import table

    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    read = read_chats(format_chats(rows.union(extra)))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length(loss_text()).cast("long").alias("loss_chars"),
        F.sha2(loss_text(), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS e,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS er
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(e) + CASE WHEN role IS NOT DISTINCT FROM before THEN 6 ELSE 7 + length(er) END
                + CASE WHEN role IS NOT DISTINCT FROM after THEN 0 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
