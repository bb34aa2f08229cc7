"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, its text is the
only trainable span. Where a conversation doesn't end with an assistant turn, one more example with no
trainable span carries the whole conversation, so that nothing is lost.

Defined cases: a null text or role is the empty string; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have one order and all stay; null conv_id is a conversation like
others; an empty table gives no rows; columns beyond the four are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import table


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and control strings of other templates that texts may not hold verbatim either."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.close, *self.others)

    def pattern(self) -> str:
        """Matches the first character of a control string that stands before its rest."""
        return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)

    def escape(self, text: Column) -> Column:
        """Doubles backslashes, then puts one after the first character of each control string."""
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({self.pattern()})", "$1\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame, template: Template = Template(), target_role: str = "assistant") -> DataFrame:
    """conv_id, example (0..), n_turns, trainable, text, loss_start, loss_length (code points of text)."""
    t = template
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select(
        "conv_id",
        F.struct("turn", "role", "text").alias("key"),
        (F.col("role") == target_role).alias("target"),
        F.concat(F.lit(t.open), t.escape(F.col("role")), F.lit(t.sep)).alias("head"),
        t.escape(F.col("text")).alias("body"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("key", "target", "head", "body"))).alias("t"))
    turns = turns.select(
        "conv_id",
        F.size("t").alias("n"),
        F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(t.close))).alias("whole"),
        F.transform("t", lambda x: F.struct(x["target"].alias("target"), F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"))).alias("part"),
    )
    at = turns.select("conv_id", "n", "whole", F.posexplode("part").alias("i", "p")).where("p.target or i = n - 1")
    prefix = F.array_join(F.slice("whole", F.lit(1), F.col("i")), "")
    return at.select(
        "conv_id",
        F.col("i").alias("example"),
        (F.col("i") + 1).alias("n_turns"),
        F.col("p.target").alias("trainable"),
        F.concat(prefix, F.element_at("whole", F.col("i") + 1)).alias("text"),
        F.when(F.col("p.target"), F.length(prefix) + F.col("p.head")).alias("loss_start"),
        F.when(F.col("p.target"), F.col("p.body")).otherwise(0).alias("loss_length"),
    )


def parse(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted example."""
    t = template
    pieces = F.slice(F.split(text, re.escape(t.close)), F.lit(1), F.size(F.split(text, re.escape(t.close))) - 1)

    def turn(piece: Column) -> Column:
        halves = F.split(F.substring(piece, F.lit(len(t.open) + 1), F.length(piece)), re.escape(t.sep), 2)
        return F.struct(t.unescape(halves[0]).alias("role"), t.unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def digest(examples: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what the formatted examples hold when read back."""
    masked = examples.select(
        "*", F.when(F.col("trainable"), template.unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))).alias("loss")
    )
    per = masked.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    read = per.select("conv_id", parse(F.col("longest"), template).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    return digest(expand(conversations.unionByName(extra)))


QUERIES = {"op8_chat_prefix_targets": op8_chat_prefix_targets}

ORACLES = {
    "op8_chat_prefix_targets": """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 32 + length(role) + length(text)
    + length(text) - length(replace(text, chr(92), ''))
    + len(regexp_extract_all(text, '<[|]im_start[|]>|<[|]im_sep[|]>|<[|]im_end[|]>|<s>|</s>|[[]INST[]]|[[]/INST[]]|<<SYS>>|<</SYS>>')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
}
