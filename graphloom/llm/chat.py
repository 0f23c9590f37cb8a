"""Chat formatting with Spark expressions only.

``format_chats`` groups turns by conversation, sorts the collected structs,
merges adjacent turns of one role and concatenates one training text.

Defined results
  * null ``role`` -> ``"unknown"``; null ``text`` -> empty text; null ``turn``
    sorts first; null ``conv_id`` is one conversation of its own.
  * turns with equal numbers are ordered by role, then text, so ties and
    repeated rows give one result whatever the input order; repeats are kept.
  * an empty table gives an empty table; an empty text still renders a turn.
  * other columns are ignored, whatever their names.
  * a control marker inside a text or a role (``<|``) is broken to ``< |`` so that
    no turn can forge a boundary.

One shuffle on ``conv_id``; merging is linear in the turns of a conversation
(run starts are filtered, and each run is one ``array_join`` of a slice) where
growing an array in ``aggregate`` would be quadratic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame, merge_with: str = "\n") -> DataFrame:
    """(conv_id, n_turns, n_merged, roles, chat), one row per conversation."""
    t = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.replace(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("<|"), F.lit("< |")).alias("role"),
            F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("t"),
    )
    grouped = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("a"))
    index = F.sequence(F.lit(1), F.size("a"))
    starts = F.filter(index, lambda i: (i == 1) | (F.element_at("a", i)["role"] != F.element_at("a", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = grouped.withColumn("s", starts)
    merged = F.transform(
        "s",
        lambda i, k: F.struct(
            F.element_at("a", i)["role"].alias("role"),
            F.array_join(
                F.transform(
                    F.slice("a", i, F.coalesce(F.get("s", k + 1), F.size("a") + 1) - i),
                    lambda x: x["text"],
                ),
                merge_with,
            ).alias("text"),
        ),
    )
    return runs.withColumn("m", merged).select(
        "conv_id",
        F.size("a").cast("long").alias("n_turns"),
        F.size("m").cast("long").alias("n_merged"),
        F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"),
        F.array_join(
            F.transform("m", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE))), "\n"
        ).alias("chat"),
    )


#: DuckDB: gaps and islands over window functions.
SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
f AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY n) THEN 0 ELSE 1 END AS starts FROM o),
g AS (
  SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY n) AS run FROM f),
m AS (
  SELECT conv_id, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY n) AS text, count(*) AS turns
  FROM g GROUP BY conv_id, run)
SELECT conv_id, CAST(sum(turns) AS BIGINT) AS n_turns, count(*) AS n_merged,
       string_agg(role, '>' ORDER BY run) AS roles,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY run) AS chat
FROM m GROUP BY conv_id
"""
