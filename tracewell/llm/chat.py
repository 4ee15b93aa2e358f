"""Chat formatting: one training example for every assistant turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import need, table

TRAINED = "assistant"


def prefix_examples(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, turn, n_context, prompt, completion, train_start, train_end: an example for each turn of the role ``trained``.

    ``prompt`` holds all preceding turns of the conversation, each as ``<|role|>``, line feed, text, line feed, and the reply's
    own ``<|role|>`` line; ``completion`` is the reply and a line feed. Only the characters train_start to train_end of
    prompt followed by completion are trained on.

    Turns are ordered by turn, then role, then text, nulls first, so repeated rows and ties have one defined order and are
    kept. A null text counts as empty and a null role as "unknown" in prompts; a reply with a null or empty text makes no example. Rows with
    a null conv_id belong to no conversation and a null turn has no place: both are left out. Extra columns are ignored.
    One shuffle, by conversation.
    """
    need(turns, "conv_id", "turn", "role", "text")
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    shown = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.struct("turn", "role", "text", shown.alias("shown")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    each = whole.select("conv_id", "all", F.posexplode("all").alias("at", "reply")).where((F.col("reply.role") == trained) & (F.col("reply.text") != ""))
    context = F.array_join(F.transform(F.slice("all", F.lit(1), F.col("at")), lambda t: t["shown"]), "")
    out = each.select("conv_id", F.col("reply.turn").alias("turn"), F.col("at").alias("n_context"), F.concat(context, F.lit(f"<|{trained}|>\n")).alias("prompt"), F.concat("reply.text", F.lit("\n")).alias("completion"))
    return out.withColumns({"train_start": F.length("prompt"), "train_end": F.length("prompt") + F.length("completion")})


def op7_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn of conversations as an example with its whole context."""
    return prefix_examples(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS shown,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT *, coalesce(string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '<|assistant|>' || chr(10) AS prompt FROM c)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS n_context, prompt, text || chr(10) AS completion,
  CAST(length(prompt) AS INTEGER) AS train_start, CAST(length(prompt) + length(text) + 1 AS INTEGER) AS train_end
FROM p WHERE role = 'assistant' AND text <> ''
"""
