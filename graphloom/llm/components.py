"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_table, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the least node it is joined to.

    Each round is two shuffles and halves the depth of what is left; its edges
    are written to the shared folder. Null ends and loops are ignored; repeated
    edges count once; an empty table gives an empty table.
    """
    e = materialize(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        spread = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(least.select("a", F.col("m").alias("b")).union(spread).distinct(), "edges")
        drop_table(e)
        e = after
    star = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(e.select(F.col("b"), F.col("b"))).distinct()
