"""Snapshots against each other, and set algebra keyed by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_nodes(base: DataFrame, head: DataFrame, columns=("type", "name", "file", "package", "metadata")) -> DataFrame:
    """(id, change, fields): added, removed and modified ids; fields are those that differ, in order of name."""
    b = base.select("id", F.struct(*columns).alias("b"), F.lit(True).alias("in_b"))
    h = head.select("id", F.struct(*columns).alias("h"), F.lit(True).alias("in_h"))
    both = b.join(h, "id", "full")
    differs = F.array_sort(F.filter(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull()))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_h").isNull(), "removed").when(F.size(differs) > 0, "modified")
    fields = F.when(F.col("in_b") & F.col("in_h"), F.array_join(differs, ",")).otherwise("")
    return both.select("id", change.alias("change"), fields.alias("fields")).where(F.col("change").isNotNull())


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def diff_edges(base: DataFrame, head: DataFrame) -> DataFrame:
    """(type, src, dst, change): an edge is its triple, so it is added or removed, never modified."""
    key = ["type", "src", "dst"]
    both = base.select(*key).distinct().withColumn("in_b", F.lit(True)).join(head.select(*key).distinct().withColumn("in_h", F.lit(True)), key, "full")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_h").isNull(), "removed")
    return both.select(*key, change.alias("change")).where(F.col("change").isNotNull())


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["id"])


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.dropDuplicates(["id"]).join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.dropDuplicates(["id"]).join(b.select("id"), "id", "left_anti")
