r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn, adjacent turns of one role are merged, and the blocks
are concatenated::

    ### assistant: first text</part>second text</turn>\n

Control strings are ``### ``, ``</part>`` and ``</turn>``. In texts and roles a backslash is doubled and a control string
gets a backslash inside it (a colon too, in roles), so no control string occurs in escaped text and dropping one backslash
before each character restores it. ``loss`` holds the code point ranges of the assistant's escaped texts, markers excluded.

Defined cases: null text or role: empty. Null turn: sorts first. Equal turn numbers: by role, then text. Repeated rows stay.
Rows of null conversation ids form one conversation. Empty table: no rows. A conversation is one value, so it must fit in a
task; that is the method asked for, and a conversation is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

PART, TURN, HEAD = "</part>", "</turn>\n", "### "
TRAP = r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in (("</turn>", "<\\/turn>"), ("</part>", "<\\/part>"), ("### ", "#\\## ")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def merged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with ``blocks``: array of (role, parts), adjacent turns of a role in one block."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    c = conversations.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("t"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a block begins where the role differs from the turn before; its parts run up to the next beginning
    turns = turns.withColumn("heads", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[i - 1].role)"))
    return turns.select(
        "conv_id",
        F.expr("""transform(heads, (h, k) -> struct(turns[h].role as role,
                  transform(slice(turns, h + 1, if(k + 1 < size(heads), heads[k + 1], size(turns)) - h), t -> t.text) as parts))""").alias("blocks"),
    )


def formatted(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_id, formatted text, and ``loss``: array of (start, length) in code points, from 0."""
    blocks = merged(conversations, key, turn, role, text)
    safe = blocks.withColumn(
        "blocks",
        F.transform("blocks", lambda b: F.struct((b.role == trained).alias("trained"), F.concat(F.lit(HEAD), F.replace(escape(b.role), F.lit(":"), F.lit("\\:")), F.lit(": ")).alias("head"), F.transform(b.parts, escape).alias("parts"))),
    )
    # pieces: heads, parts and marks in order of writing, each with whether the loss covers it
    piece = lambda on, s: F.struct(on.alias("on"), s.alias("s"))
    off = F.lit(False)
    pieces = safe.select(
        "conv_id",
        F.flatten(F.transform("blocks", lambda b: F.flatten(F.transform(b.parts, lambda p, i: F.array(
            piece(off, F.when(i == 0, b["head"]).otherwise("")), piece(b.trained, p), piece(off, F.when(i == F.size(b.parts) - 1, F.lit(TURN)).otherwise(F.lit(PART)))
        ))))).alias("pieces"),
    )
    sized = pieces.withColumn("sizes", F.transform("pieces", lambda p: F.char_length(p.s)))
    ends = F.aggregate("sizes", F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    return sized.withColumn("ends", ends).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p.s), "").alias("formatted"),
        F.expr("transform(filter(sequence(0, size(pieces) - 1), i -> pieces[i].on), i -> struct(ends[i] as start, sizes[i] as length))").alias("loss"),
    )


def parsed(out: DataFrame) -> DataFrame:
    """conv_id, turns as array of (role, text), and the text under the loss mask, all from the formatted text alone."""
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    role = lambda b: unescape(F.regexp_extract(b, r"(?s)^### ((?:[^\\:]|\\.)*+): ", 1))
    body = lambda b: F.regexp_replace(b, r"(?s)^### (?:[^\\:]|\\.)*+: ", "")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), PART), lambda p: F.struct(role(b).alias("role"), unescape(p).alias("text")))))
    cut = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length)))
    return out.select("conv_id", "formatted", turns.alias("turns"), F.array_join(cut, "").alias("loss_text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.sql("select -7L as conv_id, 0L as turn, 'user' as role, :t as text union all select -7L, 1L, 'assistant', :t", {"t": TRAP})
    all_turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    path = scratch(spark, "chat")
    formatted(all_turns).write.parquet(path)
    back = parsed(spark.read.parquet(path))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after,
        replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '</part>', '<\/part>'), '### ', '#\## ') AS x,
        replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '</part>', '<\/part>'), '### ', '#\## '), ':', '\:') AS r
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN before IS DISTINCT FROM role THEN length(r) + 6 ELSE 0 END
    + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
