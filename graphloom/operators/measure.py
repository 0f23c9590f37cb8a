"""Counts, degrees and statistics of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import half_up
from graphloom.graph import Graph
from graphloom.plans.tables import shards, spread


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def degrees(graph: Graph, relations=None) -> DataFrame:
    """(id, type, degree): edge ends at each node; a loop counts twice, an isolated node 0."""
    e = graph.by_relation(relations)
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes.select("id", "type").join(ends, "id", "left").select("id", "type", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def most_connected(graph: Graph, types, k: int) -> DataFrame:
    """The k nodes of most edges among some types; ties by id."""
    kinds = graph.nodes.where(F.col("type").isin(*types))
    return degrees(Graph(kinds, graph.edges)).orderBy(F.desc("degree"), "id").limit(k)


def statistics(graph: Graph) -> DataFrame:
    """One row: nodes, edges, density, average and maximum degree and its node."""
    d = degrees(graph).agg(
        F.count("*").alias("n_nodes"),
        F.sum("degree").alias("ends"),
        F.max("degree").alias("max_degree"),
        F.min_by("id", F.struct((-F.col("degree")).alias("d"), "id")).alias("max_degree_id"),
    )
    e = graph.edges.agg(F.count("*").alias("n_edges"))
    n = F.col("n_nodes").cast("double")
    return d.crossJoin(e).select(
        "n_nodes",
        "n_edges",
        F.when(F.col("n_nodes") > 1, half_up(F.col("n_edges") / (n * (n - 1)), 4)).otherwise(0.0).alias("density"),
        F.when(F.col("n_nodes") > 0, half_up(F.col("ends") / n, 4)).otherwise(0.0).alias("average_degree"),
        "max_degree",
        "max_degree_id",
    )


def most_targeted(graph: Graph, relation: str, k: int = 1) -> DataFrame:
    hits = graph.by_relation([relation]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return hits.join(graph.nodes.select("id", "name"), "id").orderBy(F.desc("n"), "id").limit(k)


def relation_summary(graph: Graph) -> DataFrame:
    """(id, inbound, outbound): edge counts by relation, as ``relation=n`` joined by commas."""

    n = shards(graph.edges)

    def side(end: str, name: str) -> DataFrame:
        # by id alone: the counts, the texts and the join with the nodes need no other shuffle
        ends = spread(graph.edges.select(F.col(end).alias("id"), "type"), n, "id")
        counts = ends.groupBy("id", "type").agg(F.count("*").alias("n"))
        text = F.concat_ws("=", "type", F.col("n").cast("string"))
        return counts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias(name))

    both = graph.nodes.select("id").join(side("dst", "inbound"), "id", "left").join(side("src", "outbound"), "id", "left")
    return both.select("id", F.coalesce("inbound", F.lit("")).alias("inbound"), F.coalesce("outbound", F.lit("")).alias("outbound"))


#: Concerns in the order in which they claim a node: label, types, name pattern.
CONCERNS = (
    ("Routes", ("Route", "Operation"), None),
    ("Controllers", ("Controller",), None),
    ("Services", ("Service", "Provider", "Factory"), None),
    ("Modules", ("Module", "Package", "Workspace", "Application"), None),
    ("Persistence", ("Repository", "DatabaseTable", "Model", "Resource"), "repository|prisma|database"),
    ("Configuration", ("Configuration", "EnvironmentVariable", "BuildTarget"), None),
    ("Authorization", ("Permission", "Guard", "Middleware"), "auth|permission|guard"),
    ("Language", ("Function", "Method", "Class", "Interface", "TypeAlias", "Enum", "Field"), None),
    ("External Boundaries", ("Dependency", "Framework", "Package"), "^@|sdk|api"),
    ("Tests", ("Module", "Function", "Method"), "test|spec"),
)


def concern() -> Column:
    """The first concern whose types a node has, or whose pattern its id, name or file meets."""
    said = F.lower(F.concat_ws(" ", "id", "name", F.coalesce("file", F.lit(""))))
    chain: Column | None = None
    for label, types, pattern in CONCERNS:
        hit = F.col("type").isin(*types)
        if pattern:
            hit = hit | said.rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("Other")


def round_robin(rows: DataFrame, group: str, *order) -> DataFrame:
    """Rows dealt group by group: first of each group, then second of each, and so on, as ``turn``."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def cap_per_node(edges: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` edges of each source, in the order of relation and target."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("type", "dst"))
    return edges.withColumn("rank_", rank).where(F.col("rank_") <= limit).drop("rank_")
