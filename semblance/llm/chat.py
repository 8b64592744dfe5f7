"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its reply is trainable. The turns of a conversation meet in
one grouped aggregation; the examples are slices of the sorted turns, so that
the expansion itself is narrow.

Template: ``<|role|>`` newline, text, ``<|end|>`` newline. A text can't forge a
marker: ``<|`` in it becomes ``< |``. The trainable span covers the reply and
its end marker, as character positions of ``text``, so that
``substr(text, train_start + 1, train_end - train_start)`` is the target.

Defined results: turns are ordered by turn (nulls first), then role, then text,
so ties and repeated rows have one order; a null role counts as ``user``, a
null text as empty; a null ``conv_id`` is a conversation of its own; a
conversation without assistant turns gives no example; an assistant turn that
opens its conversation has an empty context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, position, context_turns, text, train_start, train_end)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.coalesce("role", F.lit("user")))).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said")).alias("t"),
    )
    # array_sort puts null fields of a struct first, as the order above asks
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    own = own.withColumn("parts", F.transform("ts", lambda t: F.concat(F.lit("<|"), F.replace(t.role, F.lit("<|"), F.lit("< |")), F.lit("|>\n"), t.said, F.lit("<|end|>\n"))))
    each = own.select("conv_id", "parts", F.posexplode("ts").alias("position", "t")).where("t.role = 'assistant'")
    context = F.array_join(F.slice("parts", 1, F.col("position")), "")
    start = F.length("context") + F.lit(len("<|assistant|>\n"))
    return each.withColumn("context", context).select(
        "conv_id", F.col("t.turn").alias("turn"), "position", F.col("position").alias("context_turns"),
        F.concat("context", F.element_at("parts", F.col("position") + 1)).alias("text"),
        start.alias("train_start"), (start + F.length("t.said") + F.lit(len("<|end|>\n"))).alias("train_end"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, lower(trim(coalesce(role, 'user'))) AS role, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
p AS (SELECT *, concat('<|', replace(role, '<|', '< |'), '|>', chr(10), said, '<|end|>', chr(10)) AS part,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS position FROM t),
e AS (SELECT a.conv_id, a.turn, a.position, a.said, a.part, coalesce(string_agg(b.part, '' ORDER BY b.position), '') AS context
  FROM p a LEFT JOIN p b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.position < a.position WHERE a.role = 'assistant' GROUP BY ALL)
SELECT conv_id, turn, position::INT AS position, position::INT AS context_turns, concat(context, part) AS text,
  (length(context) + 14)::INT AS train_start, (length(context) + 14 + length(said) + 8)::INT AS train_end FROM e
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(C.table(spark, sf_dir, "conversations"))
