"""Preference formatting of chosen and rejected conversations.

The longest common prefix of the two lists of turns is rendered once, as the prompt; what follows in each is rendered
as its completion, with a mask of the characters that are learnt: the assistant's texts and the marker that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def _plain(c: Column) -> Column:
    """A text can't hold the markers: a space comes into them."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(STOP + "\n"))), "")


def _mask(turns: Column) -> Column:
    """[start, end) of each learnt stretch, in characters of the rendered turns."""
    head, tail = len(START) + 1, len(STOP) + 1

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.lit(head) + F.length(t["role"])
        end = begin + F.length(t["text"]) + F.lit(len(STOP))
        span = F.struct(begin.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == LEARNT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.lit(head + tail) + F.length(t["role"]) + F.length(t["text"])).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair: str = "pair_id", chosen: str = "chosen", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) for each pair of conversations.

    turns: a row for each turn, with the pair it belongs to and whether it is of the chosen conversation (boolean).
    Turns go by number; turns of one number by role and text, and rows equal in all of these are one turn. Null roles and
    texts are empty; a null turn comes first. A side without turns has an empty completion. Rows without a pair or a side
    (null) belong to no pair and give nothing. If both sides are the same, all is prompt. An empty table gives no rows;
    other columns are ignored.
    """
    rows = turns.select(
        F.col(pair).alias("__pair"), F.col(chosen).alias("__side"), F.col(turn).alias("turn"), _plain(F.col(role)).alias("role"), _plain(F.col(text)).alias("text")
    ).filter("__pair IS NOT NULL AND __side IS NOT NULL")
    # equal rows are one in each task before they are moved, and a group holds a pair's different turns only
    sides = rows.groupBy("__pair").agg(
        F.array_sort(F.collect_set(F.when(F.col("__side"), F.struct("turn", "role", "text")))).alias("c"),
        F.array_sort(F.collect_set(F.when(~F.col("__side"), F.struct("turn", "role", "text")))).alias("r"),
    )

    def bare(c: Column) -> Column:
        return F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    sides = sides.select("__pair", bare(F.col("c")).alias("c"), bare(F.col("r")).alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    differs = F.array_position(F.zip_with(F.slice("c", F.lit(1), both), F.slice("r", F.lit(1), both), lambda x, y: x == y), False)
    cut = sides.withColumn("n", F.when(differs == 0, both).otherwise((differs - 1).cast("int")))
    rest = cut.select("__pair", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return rest.select(
        F.col("__pair").alias(pair), F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations 2k and 2k + 1 as a pair k, the even one chosen: (pair_id, chosen, turn, role, text)."""
    return conversations.select(F.shiftright(conv, 1).alias("pair_id"), (F.col(conv).bitwiseAND(1) == 0).alias("chosen"), "turn", "role", "text")


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";")


ORACLE = r"""
WITH t AS (
  SELECT DISTINCT conv_id >> 1 AS pair_id, conv_id & 1 AS s, turn, replace(coalesce(role, ''), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, s ORDER BY turn NULLS FIRST, role, text) AS i FROM t
), e AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i, coalesce(a.role = b.role AND a.text = b.text, FALSE) AS same
  FROM (SELECT * FROM o WHERE s = 0) a FULL JOIN (SELECT * FROM o WHERE s = 1) b ON a.pair_id = b.pair_id AND a.i = b.i
), l AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM e GROUP BY 1
), r AS (
  SELECT o.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x,
         coalesce(sum(CASE WHEN i > n THEN length(role) + length(text) + 24 END) OVER (PARTITION BY pair_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS b
  FROM o JOIN l USING (pair_id)
)
SELECT pair_id, n AS n_prompt_turns,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (s = 0 AND i <= n), '') AS prompt,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (s = 0 AND i > n), '') AS chosen,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (s = 1 AND i > n), '') AS rejected,
       coalesce(string_agg(b || '-' || (b + length(text) + 10), ';' ORDER BY i) FILTER (s = 0 AND i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(b || '-' || (b + length(text) + 10), ';' ORDER BY i) FILTER (s = 1 AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM r GROUP BY pair_id, n
"""
