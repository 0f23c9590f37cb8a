"""Reports over whole graphs and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import half_up
from graphloom.graph import Graph
from graphloom.operators import measure, structure, walk

#: Nodes beyond which the average path length isn't computed.
PATH_NODES = 250


def average_path_length(graph: Graph) -> float | None:
    """Mean least number of steps, edges taken both ways, over ordered pairs that are joined; None for a larger graph."""
    if graph.nodes.limit(PATH_NODES + 1).count() > PATH_NODES:
        return None
    far = walk.reach(graph, graph.nodes, "both").where("depth > 0").agg(half_up(F.avg("depth"), 4)).first()[0]
    return 0.0 if far is None else float(far)


def full_statistics(graph: Graph) -> DataFrame:
    """One row: the plain statistics, components, the largest of them, the most imported module,
    the most depended-on service, and the average path length of small graphs."""
    sizes = structure.components(graph).groupBy("component").agg(F.count("*").alias("size"))
    parts = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))

    def most(relation: str, nodes: DataFrame, name: str) -> DataFrame:
        hits = graph.by_relation([relation]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).join(nodes.select("id"), "id")
        return hits.agg(F.min_by("id", F.struct((-F.col("n")).alias("m"), "id")).alias(name), F.coalesce(F.max("n"), F.lit(0)).alias(f"{name}_n"))

    imported = most("IMPORTS", graph.of_types("Module"), "most_imported")
    used = most("DEPENDS_ON", graph.nodes.where("type = 'Service' OR name LIKE '%Service'"), "most_depended")
    length = F.lit(average_path_length(graph)).cast("double").alias("average_path_length")
    # each side is one row
    return measure.statistics(graph).crossJoin(parts).crossJoin(imported).crossJoin(used).withColumn("average_path_length", length)


def roll_up(results: DataFrame, category: str) -> DataFrame:
    """(category, questions, passed, partial, failed, precision, recall) of evaluated questions."""
    count = {name: F.sum((F.col("status") == status).cast("long")).alias(name) for name, status in (("passed", "PASS"), ("partial", "PARTIAL"), ("failed", "FAIL"))}
    means = [half_up(F.avg(c), 4).alias(c) for c in ("precision", "recall")]
    return results.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("questions"), *count.values(), *means)


def regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question, was, now, change): how each question's status moved between two evaluations."""
    order = lambda c: F.when(F.col(c) == "PASS", 2).when(F.col(c) == "PARTIAL", 1).when(F.col(c) == "FAIL", 0)
    both = before.select("question", F.col("status").alias("was")).join(after.select("question", F.col("status").alias("now")), "question", "full")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(order("now") > order("was"), "improved")
        .when(order("now") < order("was"), "regressed")
        .otherwise("same")
    )
    return both.withColumn("change", change)
