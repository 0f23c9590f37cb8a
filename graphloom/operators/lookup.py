"""Lookups, adjacency and the join patterns that stand on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import normal_text, tokens
from graphloom.graph import Graph
from graphloom.plans.tables import shards, spread


def find(nodes: DataFrame, **where: str) -> DataFrame:
    """Conjunctive lookup by id, type, name, file or package."""
    for column, value in where.items():
        nodes = nodes.where(F.col(column) == value)
    return nodes


def find_text(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes one of whose haystacks holds the normalised phrase, or all its words."""
    said = normal_text(F.lit(query))
    words = tokens(F.lit(query))
    fields = ["id", "name", "type", "file"]
    hay = F.array(*[normal_text(F.coalesce(F.col(c), F.lit(""))) for c in fields], normal_text(F.concat_ws(" ", "name", "type")))
    hit = F.exists(hay, lambda h: (h != "") & (F.contains(h, said) | F.forall(words, lambda w: F.contains(h, w))))
    return nodes.where(hit)


def resolve(nodes: DataFrame, text: str) -> DataFrame:
    """By exact id, else exact name, else text: the best kind of match alone."""
    by_text = find_text(nodes, text).withColumn("match", F.when(F.col("id") == text, 0).when(F.col("name") == text, 1).otherwise(2))
    exact = nodes.where((F.col("id") == text) | (F.col("name") == text)).withColumn("match", F.when(F.col("id") == text, 0).otherwise(1))
    every = exact.unionByName(by_text).dropDuplicates(["id"])
    best = every.agg(F.min("match").alias("best"))
    return every.join(F.broadcast(best), F.col("match") == F.col("best")).drop("match", "best")


def neighbours(graph: Graph, seeds: DataFrame, direction: str = "outbound", relations=None) -> DataFrame:
    """(seed, id, relation): nodes one edge away from each seed; ends without a node drop out."""
    e = graph.links_of(relations)
    ways = []
    if direction in ("outbound", "both"):
        ways.append(e.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.col("type").alias("relation")))
    if direction in ("inbound", "both"):
        ways.append(e.select(F.col("dst").alias("seed"), F.col("src").alias("id"), F.col("type").alias("relation")))
    near = ways[0] if len(ways) == 1 else ways[0].union(ways[1])
    near = near.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi").where(F.col("seed") != F.col("id"))
    near = spread(near, shards(graph.links_of()), "id").join(graph.nodes.select("id"), "id")  # a semi join would be pushed down to all edges
    return near.select("seed", "id", "relation").distinct()


def without_inbound(graph: Graph, types, relations) -> DataFrame:
    """Nodes of some types that no edge of some relations points at."""
    used = graph.links_of(relations).select(F.col("dst").alias("id"))
    return graph.of_types(*types).join(used, "id", "left_anti")


def induced(graph: Graph, keep: Column) -> Graph:
    """The nodes that satisfy ``keep`` and the edges between them."""
    nodes = graph.nodes.where(keep)
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes, edges.select(*graph.edges.columns))


def touching(graph: Graph, ids: DataFrame, relations=None) -> DataFrame:
    """Edges with an end in ``ids``: two semi joins, as a join on OR would be nested loops."""
    e = graph.links_of(relations)
    out = e.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    into = e.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return out.select(*e.columns).union(into.select(*e.columns)).distinct()


def dangling(graph: Graph) -> DataFrame:
    """(type, src, dst, missing): edges whose end is no node."""
    n = shards(graph.edges)
    known = spread(graph.nodes.select("id"), n, "id").distinct()
    lost = []
    for end in ("src", "dst"):
        ends = spread(graph.edges.select("type", "src", "dst"), n, end)
        lost.append(ends.join(known, ends[end] == known["id"], "left").where("id IS NULL").select("type", "src", "dst", F.lit(end).alias("missing")))
    return lost[0].union(lost[1])


def guard_closure(graph: Graph) -> DataFrame:
    """GUARDS(guard, route) where the guard authorises what a route belongs to or handles, unless known."""
    a = graph.links_of(["AUTHORIZES"]).select(F.col("src").alias("guard"), F.col("dst").alias("x"))
    b = graph.links_of(["BELONGS_TO", "HANDLES"]).select(F.col("src").alias("route"), F.col("dst").alias("x"))
    n = shards(graph.links_of())
    pairs = spread(a, n, "x").join(b, "x").select(F.col("guard").alias("src"), F.col("route").alias("dst"))
    new = spread(pairs, 4 * n, "src", "dst").distinct()
    known = graph.by_relation(["GUARDS"]).select("src", "dst")
    return new.join(known, ["src", "dst"], "left_anti").select(F.lit("GUARDS").alias("type"), "src", "dst")


def owner_by_prefix(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): the package whose folder is the longest prefix of the path; by exploding a path's own
    prefixes and an equi join, so that no range join is needed."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path", F.posexplode(prefixes).alias("depth", "folder"))
    joined = each.join(packages, "folder")
    return joined.groupBy("path").agg(F.max_by("package", F.struct("depth", "package")).alias("package"))


def find_one(nodes: DataFrame, text: str) -> DataFrame:
    """The first node, by id, of the best kind of match."""
    return resolve(nodes, text).orderBy("id").limit(1)


def services(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "Service") | F.col("name").endswith("Service"))


def routes(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'Route'")


def models(nodes: DataFrame) -> DataFrame:
    return nodes.where("type IN ('Model', 'Interface')")


def incident(graph: Graph, id_: str, direction: str = "both", relations=None) -> DataFrame:
    """(side, relation, id): the edges into and out of one node, whether their other ends have a node or not."""
    e = graph.by_relation(relations)
    into = e.where(F.col("dst") == id_).select(F.lit("incoming").alias("side"), F.col("type").alias("relation"), F.col("src").alias("id"))
    out = e.where(F.col("src") == id_).select(F.lit("outgoing").alias("side"), F.col("type").alias("relation"), F.col("dst").alias("id"))
    return {"inbound": into, "outbound": out, "both": into.union(out)}[direction]


def inspect_node(graph: Graph, id_: str) -> DataFrame:
    """(side, relation, id): a node's edges, its callers and callees, and what it is related to."""
    edges = incident(graph, id_)
    there = edges.join(graph.nodes.select("id"), "id", "left_semi").where(F.col("id") != id_).select("side", "relation", "id")
    calls = there.where("relation = 'CALLS'").withColumn("side", F.when(F.col("side") == "incoming", "caller").otherwise("callee"))
    near = there.select(F.lit("related").alias("side"), F.lit("").alias("relation"), "id").distinct()
    return edges.union(calls).union(near)


def inspect_file(graph: Graph, file: str) -> DataFrame:
    """(role, id): the nodes of a file, what they import, and what they export."""
    own = graph.nodes.where(F.col("file") == file).select("id")
    sides = [own.select(F.lit("node").alias("role"), "id")]
    for role, relation in (("import", "IMPORTS"), ("export", "EXPORTS")):
        sides.append(graph.by_relation([relation]).join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.lit(role).alias("role"), F.col("dst").alias("id")).distinct())
    return sides[0].union(sides[1]).union(sides[2])
