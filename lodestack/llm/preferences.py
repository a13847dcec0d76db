"""Preference formatting of paired conversations.

For a chosen and a rejected conversation the longest common prefix of turns is
rendered once, as the prompt; what follows in each is rendered as a completion.
A completion's mask holds one character range for each of its assistant turns
(their content and end mark): the text that a loss counts. A prompt always ends
before both completions: if one conversation is a prefix of the other, its last
common assistant turn is left to the completions.

Only DataFrame functions; turns gather by conversation, so no row meets those of
other pairs. Defined results: a null role is `unknown`, a null text empty; turns
that repeat a number go in order of role and text; turns without conversation or
number take no part; a pair of which one side has no turns gives no row; pairs
with the same turns have empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(f"{END}\n"))), "")


def _mask(turns: Column) -> Column:
    """(start, end) in characters of the assistant turns' text and end mark, within the rendered turns."""
    sized = F.transform(turns, lambda t: F.struct(F.length(_head(t)).cast("long").alias("head"), (F.length(t["text"]) + len(END)).cast("long").alias("body"), (t["role"] == "assistant").alias("counts")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["body"] + 1).alias("at"),
        F.when(t["counts"], F.array_append(acc["out"], F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end")))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(sized, zero, step)["out"]


def conversations_of(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, turns in order)."""
    t = turns.where("conv_id is not null and turn is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return t.groupBy("conv_id").agg(ordered.alias("turns"))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected: conversation ids) -> one row per pair: prompt, both completions and their masks."""
    side = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen").alias("conv_id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected").alias("conv_id"), F.lit(False).alias("is_chosen")))).alias("s")).select("pair_id", "s.*")
    both = conversations_of(turns).join(side, "conv_id").groupBy("pair_id").agg(F.max(F.when(F.col("is_chosen"), F.struct("conv_id", "turns"))).alias("c"), F.max(F.when(~F.col("is_chosen"), F.struct("conv_id", "turns"))).alias("r"))
    return formatted(both.where("c is not null and r is not null").select("pair_id", F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("c.turns").alias("c"), F.col("r.turns").alias("r")))


def formatted(both: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, c, r: arrays of turns) -> the pairs' texts."""
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at("c", i) == F.element_at("r", i))
    first_other = F.array_position(same, F.lit(False))
    common = F.when(first_other > 0, first_other - 1).otherwise(shorter).cast("int")
    ends_one = (common == shorter) & (F.size("c") != F.size("r")) & (F.element_at("c", F.greatest(common, F.lit(1)))["role"] == "assistant")
    n = F.when(ends_one & (common > 0), common - 1).otherwise(common)
    cut = both.withColumn("n", n)
    rest = lambda name: F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
    )


def op3_preference_formatting(spark, sf_dir: str) -> DataFrame:
    """Conversations 2 k (chosen) and 2 k + 1 (rejected) of the whole table as pair k; masks as text start-end;..."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = conversations_of(turns).withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    both = c.groupBy("pair_id").agg(F.max(F.when(even, F.struct("conv_id", "turns"))).alias("c"), F.max(F.when(~even, F.struct("conv_id", "turns"))).alias("r"))
    both = both.where("c is not null and r is not null").select("pair_id", F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("c.turns").alias("c"), F.col("r.turns").alias("r"))
    out = formatted(both)
    mask = lambda name: F.array_join(F.transform(name, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ";").alias(name)
    return out.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", mask("chosen_mask"), "rejected", mask("rejected_mask"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS i,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), ids AS (
  SELECT c.conv_id // 2 AS pair_id, c.conv_id AS chosen_id, r.conv_id AS rejected_id, c.n AS cn, r.n AS rn
  FROM (SELECT DISTINCT conv_id, n FROM t) c JOIN (SELECT DISTINCT conv_id, n FROM t) r ON c.conv_id % 2 = 0 AND r.conv_id = c.conv_id + 1
), other AS (
  SELECT pair_id, min(c.i) AS i FROM ids JOIN t c ON c.conv_id = chosen_id JOIN t r ON r.conv_id = rejected_id AND r.i = c.i
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY pair_id
), common AS (
  SELECT ids.*, coalesce(other.i - 1, least(cn, rn)) AS k FROM ids LEFT JOIN other USING (pair_id)
), cut AS (
  SELECT common.*, CASE WHEN k > 0 AND k = least(cn, rn) AND cn <> rn AND t.role = 'assistant' THEN k - 1 ELSE k END AS p
  FROM common LEFT JOIN t ON t.conv_id = chosen_id AND t.i = k
), parts AS (
  SELECT pair_id, p, t.conv_id = chosen_id AS is_c, i, i <= p AS in_prompt, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body, role
  FROM cut JOIN t ON t.conv_id IN (chosen_id, rejected_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, is_c, in_prompt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM parts
), texts AS (
  SELECT pair_id,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (is_c AND in_prompt), '') AS prompt,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (is_c AND NOT in_prompt), '') AS chosen,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ';' ORDER BY i) FILTER (is_c AND NOT in_prompt AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (NOT is_c AND NOT in_prompt), '') AS rejected,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ';' ORDER BY i) FILTER (NOT is_c AND NOT in_prompt AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY pair_id
)
SELECT pair_id, chosen_id, rejected_id, p::BIGINT AS n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask FROM cut JOIN texts USING (pair_id)
"""
