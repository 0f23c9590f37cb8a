"""Validation rules and coverage metrics of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import half_up
from graphloom.graph import Graph
from graphloom.operators.lookup import dangling
from graphloom.plans.tables import shards, spread


def _issue(rows: DataFrame, code: str, severity: str, subject: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.alias("subject"))


def validate(graph: Graph, node_types=None, relations=None, hooks=()) -> DataFrame:
    """(code, severity, subject): one row per broken rule and place."""
    n, e, links = graph.nodes, graph.edges, graph.links_of()
    whole = spread(e.select("type", "src", "dst"), shards(e), "src")  # the shuffle that dangling() needs too
    edge = F.concat_ws(" ", "src", "type", "dst")
    into = lambda *kinds: links.where(F.col("type").isin(*kinds)).select(F.col("dst").alias("id"))
    out = lambda *kinds: links.where(F.col("type").isin(*kinds)).select(F.col("src").alias("id"))
    rules = [
        _issue(n.groupBy("id").count().where("count > 1"), "duplicate-node", "error", F.col("id")),
        _issue(whole.groupBy("type", "src", "dst").count().where("count > 1"), "duplicate-edge", "error", edge),
        _issue(dangling(graph), "missing-endpoint", "error", edge),
        _issue(e.where((F.col("src") == F.col("dst")) & (F.col("type") != "REFERENCES")), "self-edge", "error", edge),
        _issue(n.where(F.col("id").isNull() | (F.trim("id") == "")), "empty-id", "error", F.coalesce("name", F.lit("?"))),
        _issue(n.where(F.col("name").isNull() | (F.trim("name") == "")), "empty-name", "error", F.col("id")),
        _issue(n.where(F.col("type") == "Route").join(out("HANDLES"), "id", "left_anti"), "route-without-handler", "warning", F.col("id")),
        _issue(n.where(F.col("type") == "Route").join(into("MOUNTS", "CONTAINS"), "id", "left_anti"), "route-without-controller", "warning", F.col("id")),
        _issue(n.where(F.col("type") == "Controller").join(into("CONTAINS", "DECLARES", "REGISTERED_IN"), "id", "left_anti"), "controller-without-module", "warning", F.col("id")),
        _issue(n.where(F.col("type").isin("Provider", "Service")).join(out("PROVIDES", "INJECTS").union(into("INJECTS", "USES")), "id", "left_anti"), "unused-provider", "info", F.col("id")),
        _issue(n.where(F.col("type") == "Route").groupBy("name").agg(F.count("*").alias("c")).where("c > 1"), "duplicate-route", "warning", F.col("name")),
        _issue(n.where(F.col("type") == "Controller").groupBy("name").agg(F.count("*").alias("c")).where("c > 1"), "duplicate-controller", "warning", F.col("name")),
    ]
    if node_types is not None:
        rules.append(_issue(n.where(~F.col("type").isin(*node_types)), "unknown-node-type", "error", F.col("id")))
    if relations is not None:
        rules.append(_issue(e.where(~F.col("type").isin(*relations)), "unknown-relation", "error", edge))
    rules += [hook(graph) for hook in hooks]
    return reduce(DataFrame.unionByName, rules)


def coverage(graph: Graph) -> DataFrame:
    """(metric, total, missing, coverage, confidence, status) of services, controllers, routes and packages."""
    e = graph.links_of()
    used = {
        "services": (("Service",), e.where(F.col("type").isin("PROVIDES", "INJECTS")).select(F.col("src").alias("id"))),
        "controllers": (("Controller",), e.where(F.col("type") == "MOUNTS").select(F.col("src").alias("id"))),
        "routes": (("Route",), e.where(F.col("type") == "HANDLES").select(F.col("src").alias("id"))),
        "packages": (("Package",), e.where(F.col("type") == "CONTAINS").select(F.col("src").alias("id"))),
        "functions": (("Function",), e.where(F.col("type").isin("HANDLES", "PROVIDES", "CALLS")).select(F.col("dst").alias("id"))),
    }
    rows = []
    for metric, (types, ok) in used.items():
        mark = graph.of_types(*types).join(ok.distinct().withColumn("ok", F.lit(1)), "id", "left")
        rows.append(mark.agg(F.count("*").alias("total"), (F.count("*") - F.count("ok")).alias("missing")).select(F.lit(metric).alias("metric"), "total", "missing"))
    r = reduce(DataFrame.unionByName, rows)
    percent = F.when(F.col("total") > 0, F.floor(100.0 * (F.col("total") - F.col("missing")) / F.col("total") + 0.5)).otherwise(0)
    r = r.withColumn("coverage", percent.cast("long"))
    trust = F.greatest(F.lit(0), F.col("coverage") - F.least(F.lit(20), 2 * F.col("missing"))).cast("long")
    status = F.when(F.col("total") == 0, "unknown").when(F.col("coverage") >= 95, "pass").when(F.col("coverage") >= 60, "warn").otherwise("fail")
    return r.withColumn("confidence", trust).withColumn("status", status)


def evaluate(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(question, expected, predicted, hits, precision, recall, status) of (question, item) tables."""
    e = expected.distinct().withColumn("e", F.lit(1))
    p = predicted.distinct().withColumn("p", F.lit(1))
    both = e.join(p, ["question", "item"], "full")
    g = both.groupBy("question").agg(F.count("e").alias("expected"), F.count("p").alias("predicted"), F.sum(F.when(F.col("e").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("hits"))
    precision = F.when(F.col("predicted") > 0, half_up(F.col("hits") / F.col("predicted"), 4)).otherwise(0.0)
    recall = F.when(F.col("expected") > 0, half_up(F.col("hits") / F.col("expected"), 4)).otherwise(1.0)
    status = F.when((F.col("hits") == F.col("expected")) & (F.col("predicted") == F.col("hits")), "PASS").when(F.col("hits") > 0, "PARTIAL").otherwise("FAIL")
    return g.select("question", "expected", "predicted", "hits", precision.alias("precision"), recall.alias("recall"), status.alias("status"))
