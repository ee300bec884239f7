"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

Native. An example holds all preceding turns as context and one reply, and only that reply is trainable. The template is

    ### role: text</turn>

with a newline after each turn. Inside texts a backslash, ``<`` and ``#`` become two-letter escapes, so no control string
can occur in an escaped text; roles escape ``:`` and newlines too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslake.llm.common import text_of

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TARGET = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, example (from 1), is_last, text, loss_start and loss_length (code points from 0) per assistant turn.

    A conversation that does not end with an assistant turn gets a last example without a trainable part, so that every
    turn is in the output. Turns are ordered by turn (null first), then role and text; repeated rows are turns of their
    own. A null text or role counts as empty, a null conv_id is a conversation. Other columns are not read; no rows give
    no rows. A conversation's turns meet in one row, as an example is one text; nothing larger is gathered.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE)))
    turns = turns.withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    placed = turns.select(
        "conv_id", "head", "body", (F.col("role") == TARGET).alias("target"), F.row_number().over(by).alias("place"),
        F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "place", "end", "target", F.length("body").alias("length"), F.concat("head", "body", F.lit(CLOSE)).alias("part")))).alias("turns"))
    whole = whole.select("conv_id", F.array_join(F.col("turns.part"), "").alias("whole"), F.filter(
        F.transform("turns", lambda t: F.struct(t["place"], t["end"], t["target"], t["length"])),
        lambda t: t["target"] | (t["place"] == F.size("turns"))).alias("ends"), F.size("turns").alias("n"))
    each = whole.select("conv_id", "whole", "n", F.posexplode("ends").alias("at", "e"))
    return each.select(
        "conv_id", (F.col("at") + 1).alias("example"), (F.col("e.place") == F.col("n")).alias("is_last"),
        F.substring("whole", F.lit(1), F.col("e.end")).alias("text"),
        F.when(F.col("e.target"), F.col("e.end") - len(CLOSE) - F.col("e.length")).otherwise(F.col("e.end")).alias("loss_start"),
        F.when(F.col("e.target"), F.col("e.length")).otherwise(F.lit(0)).alias("loss_length"))


def turns_of(text: Column) -> Column:
    """Read a formatted text back: an array of (role, text)."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, MIDDLE, 1), len(OPEN) + 1, 1 << 30), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(p, F.instr(p, MIDDLE) + len(MIDDLE), F.length(p))).alias("text")))


def loss_of(text: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(text, start + 1, length))


def report(conversations: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the examples."""
    read = examples(conversations).select(
        "conv_id", "example", F.length("text").cast("bigint").alias("chars"),
        F.when(F.col("is_last"), turns_of(F.col("text"))).alias("turns"),
        loss_of(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    read = read.select(
        "conv_id", "example", "chars", "loss", F.size("turns").cast("bigint").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("sha"))
    done = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.sort_array(F.collect_list(F.struct("example", "loss")))["loss"], "").alias("loss"))
    return done.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_control_strings(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations plus one whose texts hold the template's control strings."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(extra)


def sql() -> str:
    return r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(6 + length(role) + length(regexp_replace(role, '[^\\<#:\n]', '', 'g')) + length(text)
        + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 8) OVER w AS e
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR place = n THEN e ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
