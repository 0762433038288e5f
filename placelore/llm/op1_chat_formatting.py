"""Preference formatting: the longest common turn prefix of two conversations, once, and both completions with masks.

Only DataFrame functions: one shuffle brings the turns of a pair together, everything else is expressions on arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm.common import fresh, read

#: How a turn is rendered; the completion's loss falls on what an assistant says and on the mark that ends it.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def rendered(turn):
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def text_of(turns):
    return F.array_join(F.transform(turns, rendered), "")


def masks(turns):
    """Spans [begin, end) in characters of the completion which count for the loss, in order."""
    head = lambda t: F.length(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))).cast("long")
    long = lambda t: F.length(rendered(t)).cast("long")
    before = lambda i: F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0).cast("long"), lambda n, t: n + long(t))
    span = lambda t, i: F.when(t["role"] == TRAINED, F.struct((before(i) + head(t)).alias("begin"), (before(i) + long(t) - 1).alias("end")))
    return F.filter(F.transform(turns, span), lambda s: s.isNotNull())


def preference_pairs(turns: DataFrame, pair, chosen, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats pairs of conversations for preference training.

    pair: a column that both conversations of a pair share; chosen: whether a row belongs to the chosen one.
    Returns pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected (rendered completions), chosen_mask,
    rejected_mask (spans of what assistants say in the completions, end mark without its newline included), n_turns.

    Turns are ordered by turn, then role and text, so ties and repeated rows have one order; repeated rows count. A null
    role or text is empty, a null turn comes first. A conversation without a partner keeps its row: its id is on its side,
    the other id is null, there is no prompt and the other completion is empty. Equal conversations are all prompt, with empty
    completions. Rows whose pair is null are one pair per conversation id. An empty table gives an empty result. Other
    columns are not looked at.
    """
    c = lambda n: F.col(f"`{n}`")
    p, s, t = fresh(turns, "pair_", "side_", "turn_")
    entry = F.struct(c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    rows = turns.select(pair.alias(p), F.when(pair.isNull(), c(conversation)).alias("alone"), chosen.alias(s), c(conversation).alias("conv"), entry.alias(t))
    side = lambda yes: F.sort_array(F.collect_list(F.when(F.col(s) if yes else ~F.coalesce(F.col(s), F.lit(False)), F.col(t))))
    both = rows.groupBy(p, "alone").agg(
        side(True).alias("a"),
        side(False).alias("b"),
        F.min(F.when(F.col(s), F.col("conv"))).alias("chosen_id"),
        F.min(F.when(~F.coalesce(F.col(s), F.lit(False)), F.col("conv"))).alias("rejected_id"),
    )
    same = lambda i: (F.get("a", i)["role"] == F.get("b", i)["role"]) & (F.get("a", i)["text"] == F.get("b", i)["text"])
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: F.coalesce(same(i), F.lit(False))), False)
    n = F.when(shorter == 0, F.lit(0)).when(differs == 0, shorter).otherwise(differs.cast("int") - 1)
    cut = both.withColumn("n", n).select("*", *(F.slice(x, F.col("n") + 1, F.size(x)).alias(f"rest_{x}") for x in ("a", "b")))
    return cut.select(
        F.col(p).alias("pair_id"),
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        text_of(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        text_of(F.col("rest_a")).alias("chosen"),
        text_of(F.col("rest_b")).alias("rejected"),
        masks(F.col("rest_a")).alias("chosen_mask"),
        masks(F.col("rest_b")).alias("rejected_mask"),
        (F.size("a") + F.size("b")).cast("long").alias("n_turns"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) are a pair. Masks are given as begin-end texts joined by commas."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    digest = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({"chosen_mask": digest("chosen_mask"), "rejected_mask": digest("rejected_mask")})


SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, conv_id,
         {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS e FROM conversations
), g AS (
  SELECT pair_id, min(conv_id) FILTER (side) AS chosen_id, min(conv_id) FILTER (NOT side) AS rejected_id,
         coalesce(list(e ORDER BY e) FILTER (side), []) AS a, coalesce(list(e ORDER BY e) FILTER (NOT side), []) AS b
  FROM t GROUP BY pair_id
), n AS (
  SELECT *, least(len(a), len(b)) AS m,
         list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text) AS bad FROM g
), c AS (
  SELECT *, CASE WHEN len(bad) = 0 THEN m ELSE bad[1] - 1 END AS k FROM n
), r AS (
  SELECT *, list_transform(a[:k], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS p, a[k + 1:] AS ra, b[k + 1:] AS rb FROM c
), x AS (
  SELECT *, list_transform(ra, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS ta,
         list_transform(rb, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS tb FROM r
)
SELECT pair_id, chosen_id, rejected_id, k::BIGINT AS n_prompt_turns, array_to_string(p, '') AS prompt,
       array_to_string(ta, '') AS chosen, array_to_string(tb, '') AS rejected,
       array_to_string(list_transform(list_filter(range(1, len(ra) + 1), lambda i: ra[i].role = 'assistant'),
         lambda i: (length(array_to_string(ta[:i - 1], '')) + 14)::VARCHAR || '-' || (length(array_to_string(ta[:i], '')) - 1)::VARCHAR), ',') AS chosen_mask,
       array_to_string(list_transform(list_filter(range(1, len(rb) + 1), lambda i: rb[i].role = 'assistant'),
         lambda i: (length(array_to_string(tb[:i - 1], '')) + 14)::VARCHAR || '-' || (length(array_to_string(tb[:i], '')) - 1)::VARCHAR), ',') AS rejected_mask,
       (len(a) + len(b))::BIGINT AS n_turns
FROM x
"""
