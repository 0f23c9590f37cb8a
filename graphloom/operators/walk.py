"""Traversals: bounded walks as one lazy plan, unbounded ones as loops over kept tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import DEPENDENCY, Graph
from graphloom.plans.tables import is_small, kept, shards, spread


def steps(graph: Graph, direction: str = "outbound", relations=None) -> DataFrame:
    """(here, there) along the walk's direction, each pair at least once."""
    e = graph.links_of(relations)
    out = [F.col("src").alias("here"), F.col("dst").alias("there")]
    back = [F.col("dst").alias("here"), F.col("src").alias("there")]
    if direction == "both":
        return e.select(F.inline(F.array(F.struct(*out), F.struct(*back))))
    return e.select(*(out if direction == "outbound" else back))


def adjacency(graph: Graph, direction: str = "outbound", relations=None) -> DataFrame:
    """(here, there) along the walk's direction, each pair once."""
    return steps(graph, direction, relations).distinct()


def walk(graph: Graph, seeds: DataFrame, direction="outbound", depth: int = 2, relations=None, keep: Column | None = None, wide: bool = False) -> DataFrame:
    """(seed, id, depth): what each seed reaches in at most ``depth`` steps, by the least number of steps.

    ``keep`` rejects nodes and the ways through them, the seed included. The depth is
    unrolled into one plan without actions; a level starts from the level before. ``wide`` is for
    walks that reach many more pairs than there are edges: these are shuffled once then, at the end.
    """
    every = reached(graph, seeds, direction, depth, relations, keep, wide)
    return spread(every, shards(graph.links_of()), "seed", "id").groupBy("seed", "id").agg(F.min("depth").alias("depth"))


def reached(graph: Graph, seeds: DataFrame, direction="outbound", depth: int = 2, relations=None, keep: Column | None = None, wide: bool = False) -> DataFrame:
    """The rows of ``walk`` before the least depth of each pair is taken: a pair may come more than once."""
    starts = seeds.select(F.col("id").alias("seed"), "id")
    levels = _levels(graph, starts, is_small(seeds), direction, depth, relations, keep, wide)
    every = levels[0].withColumn("depth", F.lit(0))
    for step, level in enumerate(levels[1:], 1):
        every = every.union(level.withColumn("depth", F.lit(step)))
    return every


def around(graph: Graph, seeds: DataFrame, direction="outbound", depth: int = 2, relations=None) -> DataFrame:
    """(id): what any seed reaches in at most ``depth`` steps, the seeds included; a node is kept once, whatever seeds reach it."""
    levels = _levels(graph, seeds.select("id"), is_small(seeds), direction, depth, relations)
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return spread(every, shards(graph.links_of()), "id").distinct()


def _levels(graph: Graph, starts: DataFrame, small: bool, direction, depth: int, relations=None, keep: Column | None = None, wide: bool = False) -> list[DataFrame]:
    """The columns of ``starts`` (id and more) at each level of a walk; a row of the last level may come more than once.

    A level is parted by id once: for the check against the nodes, for what makes
    it distinct, and for the next step. The check is an inner join, as a semi join would be
    pushed down to all edges. Where the starts are few the first step is a scan of the edges.
    ``wide`` checks the edges' ends against the nodes before the walk, and not what is reached.
    """
    nodes = graph.nodes if keep is None else graph.nodes.where(keep)
    ids, adj, n = nodes.select("id"), steps(graph, direction, relations), shards(graph.links_of())
    if wide:
        adj = spread(adj, n, "there").distinct().join(spread(ids, n, "id").distinct(), F.col("there") == F.col("id")).select("here", "there")
    level = starts.join(ids, "id").select(*starts.columns)
    levels = [level]
    for step in range(1, depth + 1):
        before = F.broadcast(level) if small and step == 1 else level
        ahead = adj.join(before, adj["here"] == before["id"]).drop("id", "here").withColumnRenamed("there", "id").select(*starts.columns)
        level = ahead if wide else spread(ahead, n, "id").join(ids, "id").select(*starts.columns)
        level = level.distinct() if step < depth else level
        levels.append(level)
    return levels


def dependencies(graph: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return walk(graph, seeds, "outbound", depth, DEPENDENCY)


def dependents(graph: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return walk(graph, seeds, "inbound", depth, DEPENDENCY)


def reach(graph: Graph, seeds: DataFrame, direction="outbound", relations=None) -> DataFrame:
    """(seed, id, depth) to the fixpoint, by least depth; each round keeps its frontier in a shared table."""
    adj, n = kept(steps(graph, direction, relations)), shards(graph.links_of())
    seen = frontier = kept(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    step = 0
    while not frontier.isEmpty():
        step += 1
        ahead = spread(frontier, n, "id").join(adj, F.col("id") == F.col("here")).select("seed", F.col("there").alias("id"), F.lit(step).alias("depth"))
        least = spread(ahead.unionByName(seen), n, "seed", "id").groupBy("seed", "id").agg(F.min("depth").alias("depth"))
        frontier = kept(least.where(F.col("depth") == step))
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(graph: Graph, seeds: DataFrame, targets: DataFrame, direction="outbound", relations=None) -> DataFrame:
    """(seed, id, hops, path): a path of fewest hops to each target; of equals, the least sequence of ids.

    Every level keeps one path per node: prefixes of a least path are least themselves. A level's paths are
    ranked by sorting it, so that candidates carry the rank of the path before them in place of the path;
    what earlier levels reached ranks before all of them.
    """
    adj, n = kept(steps(graph, direction, relations)), shards(graph.links_of())
    ranked = lambda paths: kept(paths.orderBy("path").withColumn("rank", F.monotonically_increasing_id()))
    seen = paths = ranked(seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("path")).distinct())
    while not paths.isEmpty():
        more = spread(paths.select("seed", "id", "rank"), n, "id").join(adj, F.col("id") == F.col("here")).select("seed", F.col("there").alias("id"), "rank")
        known = seen.select("seed", "id", F.lit(-1).cast("long").alias("rank"))
        least = spread(more.union(known), n, "seed", "id").groupBy("seed", "id").agg(F.min("rank").alias("rank")).where("rank >= 0")
        longer = spread(least, n, "rank").join(paths.select("rank", "path"), "rank")
        paths = ranked(longer.select("seed", "id", F.concat("path", F.array("id")).alias("path")))
        seen = seen.unionByName(paths)
    return seen.join(targets.select("id"), "id", "left_semi").select("seed", "id", (F.size("path") - 1).alias("hops"), F.array_join("path", ">").alias("path"))


def path_tree(graph: Graph, roots: DataFrame, depth: int, relations=None) -> DataFrame:
    """(path, id, depth): every path from the roots, without a node twice in a path."""
    adj = adjacency(graph, "outbound", relations)
    level = roots.select("id", F.array("id").alias("p"))
    every = level
    for _ in range(depth):
        level = level.join(adj, level["id"] == adj["here"]).where(~F.array_contains("p", F.col("there"))).select(F.col("there").alias("id"), F.concat("p", F.array("there")).alias("p"))
        every = every.union(level)
    return every.select(F.array_join("p", ">").alias("path"), "id", (F.size("p") - 1).alias("depth"))


def boundary(graph: Graph, seeds: DataFrame, direction="both", depth: int = 2, relations=None, max_nodes: int = 50, per_node: int = 25) -> DataFrame:
    """(id, depth, truncated): a walk from all seeds under budgets; the first nodes by (depth, id) stay.

    A hub contributes its first ``per_node`` edges, and the walk goes on.
    """
    from pyspark.sql.window import Window

    adj = adjacency(graph, direction, relations)
    rank = F.row_number().over(Window.partitionBy("here").orderBy("there"))
    adj = adj.withColumn("r", rank).where(F.col("r") <= per_node).drop("r")
    level = seeds.select("id").distinct()
    every = level.withColumn("depth", F.lit(0))
    for step in range(1, depth + 1):
        level = level.join(adj, level["id"] == adj["here"]).select(F.col("there").alias("id")).distinct()
        every = every.union(level.withColumn("depth", F.lit(step)))
    found = every.groupBy("id").agg(F.min("depth").alias("depth"))
    top = found.orderBy("depth", "id").limit(max_nodes)
    return top.crossJoin(found.agg((F.count("*") > max_nodes).alias("truncated")))
