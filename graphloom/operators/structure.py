"""Structure of a whole graph: components, cycles, levels, chains. Loops end in O(log n) rounds where they can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.tables import kept, shards, spread


def components(graph: Graph, relations=None) -> DataFrame:
    """(id, component): the least id of each node's undirected component.

    Every round takes the least label around, then follows labels to their own
    labels (pointer jumping), so rounds grow with the logarithm of the diameter.
    """
    e = graph.by_relation(relations).where(F.col("src") != F.col("dst"))
    both = kept(e.select("src", "dst").union(e.select("dst", "src")).distinct())
    ids = graph.nodes.select("id").union(both.select("src")).distinct()
    label = kept(ids.select("id", F.col("id").alias("component")))
    while True:
        around = both.join(label, both["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("least"))
        lower = label.join(around, label["id"] == around["src"], "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = kept(lower.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")))
        moved = after.join(label.withColumnRenamed("component", "was"), "id").where(F.col("component") != F.col("was"))
        label = after
        if moved.isEmpty():
            break
    return label.join(graph.nodes.select("id"), "id", "left_semi")


def communities(graph: Graph, relations=None) -> DataFrame:
    """(component, size, rank): components by size, ties by id."""
    from pyspark.sql.window import Window

    sizes = components(graph, relations).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")).cast("long"))


def cycle_core(graph: Graph, relations=None) -> DataFrame:
    """(id, cycle): nodes that lie on a cycle, with the least node of their strongly connected part.

    Nodes without an edge in or out are peeled until none is left to peel; what
    remains is closed transitively by doubling, and two nodes are together where
    each reaches the other.
    """
    e = kept(graph.by_relation(relations).select("src", "dst").distinct())
    while True:
        inner = kept(e.join(e.select(F.col("dst").alias("src")), "src", "left_semi").join(e.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
        if inner.count() == e.count():
            break
        e = inner
    closure, size = e, e.count()
    while size:
        step = closure.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
        longer = closure.join(step, closure["dst"] == step["mid"]).select("src", F.col("end").alias("dst"))
        closure = kept(closure.union(longer).distinct())
        grown = closure.count()
        if grown == size:
            break
        size = grown
    back = closure.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = closure.join(back, ["src", "dst"])
    return mutual.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("cycle")).select("id", F.least("id", "cycle").alias("cycle"))


def topological_levels(graph: Graph, relations=None) -> DataFrame:
    """(id, level): the longest way to each node from a node without predecessors; a cycle is an error.

    Where no node has two predecessors the graph is a set of chains and trees,
    and pointers are doubled (log n rounds); otherwise levels are peeled.
    """
    n = shards(graph.edges)
    e = kept(spread(graph.by_relation(relations).select("src", "dst"), n, "dst").distinct())
    ids = graph.nodes.select("id")
    most = e.groupBy("dst").count().agg(F.max("count")).first()[0] or 0
    if most <= 1:
        state = kept(spread(ids, n, "id").join(e, F.col("id") == F.col("dst"), "left").select("id", F.col("src").alias("up"), F.when(F.col("src").isNull(), 0).otherwise(1).cast("long").alias("level")))
        total, rounds = state.count(), 0
        # nodes that are done stay out of the join: without a pointer they would all go to one task
        done, going = state.where("up IS NULL"), state.where("up IS NOT NULL")
        while not going.isEmpty():
            if 1 << rounds > max(total, 1):
                raise ValueError("the graph has a cycle")
            up = done.union(going).select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("level").alias("more"))
            state = kept(spread(going, n, "up").join(up, "up", "left").select("id", F.col("further").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
            done, going = done.union(state.where("up IS NULL")), state.where("up IS NOT NULL")
            rounds += 1
        return done.select("id", "level")
    done, rest, level = None, kept(ids), 0
    while not rest.isEmpty():
        blocked = e.join(rest.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        free = kept(rest.join(blocked, "id", "left_anti").select("id", F.lit(level).cast("long").alias("level")))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.union(free)
        rest = kept(rest.join(free, "id", "left_anti"))
        level += 1
    return done if done is not None else ids.select("id", F.lit(0).cast("long").alias("level")).limit(0)


def longest_chain(graph: Graph, relations=None) -> DataFrame:
    """One row: the number of nodes on the longest chain and the least node that ends one."""
    levels = topological_levels(graph, relations)
    return levels.agg((F.max("level") + 1).alias("length"), F.min_by("id", F.struct((-F.col("level")).alias("l"), "id")).alias("last"))
