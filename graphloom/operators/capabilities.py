"""Canned analyses composed from the other operators, in a registry by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import blast_radius
from graphloom.graph import DEPENDENCY, EXPANSION, OWNERSHIP, USAGE, Graph
from graphloom.operators import lookup, measure, quality, structure, walk
from graphloom.plans.tables import shards, spread

REGISTRY: dict[str, Callable[..., DataFrame]] = {}
IMPACT = {"direct": (1, 20), "local": (2, 50), "feature": (3, 80), "semantic": (4, 120), "blast-radius": (5, 200)}


def capability(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return add


def run(name: str, graph: Graph, **options) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"no capability {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](graph, **options)


@capability("RepositorySummary")
def repository_summary(graph: Graph) -> DataFrame:
    return measure.statistics(graph)


@capability("ArchitectureSummary")
def architecture_summary(graph: Graph) -> DataFrame:
    return measure.count_by(graph.nodes.withColumn("concern", measure.concern()), "concern")


def both_ways(graph: Graph, seeds: DataFrame, mode: str) -> DataFrame:
    """(seed, id, depth, side): what depends on each seed and what it depends on, to the depth of a mode."""
    depth, _ = IMPACT[mode]
    into = walk.dependents(graph, seeds, depth).withColumn("side", F.lit("dependent"))
    out = walk.dependencies(graph, seeds, min(depth, 3)).withColumn("side", F.lit("dependency"))
    return into.union(out).where(F.col("depth") > 0)


@capability("ImpactAnalysis")
def impact(graph: Graph, seeds: DataFrame, mode: str = "local") -> DataFrame:
    """(seed, id, depth, side): what depends on each seed, what it depends on, and its semantic expansion, to the depth of a mode."""
    around = walk.walk(graph, seeds, "both", IMPACT[mode][0], EXPANSION, wide=True).withColumn("side", F.lit("expansion"))
    return both_ways(graph, seeds, mode).union(around.where(F.col("depth") > 0))


@capability("BlastRadius")
def blast(graph: Graph, seeds: DataFrame, mode: str = "local") -> DataFrame:
    """(seed, affected, radius): how many others a seed's impact holds; the label counts the seed too, up to the mode's limit of nodes.

    The pairs of all sides are shuffled once, by seed, and counted there.
    """
    depth = IMPACT[mode][0]
    sides = [("both", depth, EXPANSION, True), ("inbound", depth, DEPENDENCY, False), ("outbound", min(depth, 3), DEPENDENCY, False)]
    pairs = [walk.reached(graph, seeds, way, far, kinds, wide=wide).select("seed", "id").where(F.col("seed") != F.col("id")) for way, far, kinds, wide in sides]
    every = spread(pairs[0].union(pairs[1]).union(pairs[2]), 8 * shards(graph.links_of()), "seed")
    sizes = every.groupBy("seed").agg(F.countDistinct("id").alias("affected"))
    every = seeds.select(F.col("id").alias("seed")).join(sizes, "seed", "left").select("seed", F.coalesce("affected", F.lit(0)).cast("long").alias("affected"))
    return every.withColumn("radius", blast_radius(F.least(F.col("affected") + 1, F.lit(IMPACT[mode][1]))))


@capability("DeadCode")
def dead_code(graph: Graph) -> DataFrame:
    return lookup.without_inbound(graph, ("Function", "Method", "Service", "Provider", "Repository", "Route"), (*USAGE, "REGISTERED_IN"))


@capability("FindUnusedFeature")
def unused_feature(graph: Graph) -> DataFrame:
    return lookup.without_inbound(graph, ("Function", "Method", "Service", "Repository", "Route"), USAGE)


@capability("FindDeadCode")
def uncalled(graph: Graph) -> DataFrame:
    return lookup.without_inbound(graph, ("Function", "Method"), ("CALLS",))


@capability("EntryPoints")
def entry_points(graph: Graph) -> DataFrame:
    return lookup.without_inbound(graph, ("Function", "Method", "Module", "Route", "Application"), ("CALLS", "IMPORTS", "HANDLES", "REGISTERED_IN"))


@capability("FindEntrypoints")
def call_entry_points(graph: Graph) -> DataFrame:
    return lookup.without_inbound(graph, ("Function", "Method", "Module"), ("CALLS", "IMPORTS"))


@capability("OwnershipAnalysis")
def ownership(graph: Graph, seeds: DataFrame) -> DataFrame:
    return lookup.neighbours(graph, seeds, "inbound", OWNERSHIP)


@capability("RequestTrace")
def request_trace(graph: Graph, routes: DataFrame, depth: int = 5) -> DataFrame:
    return walk.walk(graph, routes, "outbound", depth, ("HANDLES", "CALLS"))


@capability("CallHierarchy")
def call_hierarchy(graph: Graph, seeds: DataFrame, depth: int = 4) -> DataFrame:
    up = walk.walk(graph, seeds, "inbound", depth, ("CALLS",)).withColumn("side", F.lit("caller"))
    down = walk.walk(graph, seeds, "outbound", depth, ("CALLS",)).withColumn("side", F.lit("callee"))
    return up.union(down).where(F.col("depth") > 0)


@capability("DependencyAnalysis")
def dependency_analysis(graph: Graph, seeds: DataFrame | None = None) -> DataFrame:
    return both_ways(graph, graph.of_types("Package", "Module") if seeds is None else seeds, "feature")


@capability("DependencyHierarchy")
def dependency_hierarchy(graph: Graph, seeds: DataFrame | None = None) -> DataFrame:
    return dependency_analysis(graph, seeds)


def _kinds_and_edges(types: tuple[str, ...], out: tuple[str, ...] | None, into: tuple[str, ...] | None, pattern: str | None = None, fields=("name",), touching: bool = True):
    """(role, id): nodes of some types or names, and the other ends of their edges ``out`` and ``into`` (None: of all relations).

    Where ``touching`` is off, all edges of the relations count, whatever they join.
    """

    def analyse(graph: Graph) -> DataFrame:
        own = F.col("type").isin(*types)
        if pattern:
            own = own | F.lower(F.concat_ws(" ", *fields)).rlike(pattern)
        if types == ("Framework",) and "framework" in graph.nodes.columns:
            own = own | F.col("framework").isNotNull()
        nodes = graph.nodes.where(own).select("id")
        if touching:
            near = lookup.neighbours(graph, nodes, "outbound", out).union(lookup.neighbours(graph, nodes, "inbound", into)).select("id")
        else:
            e = graph.links_of(out)
            near = e.select(F.col("src").alias("id")).union(e.select("dst")).join(graph.nodes.select("id"), "id", "left_semi")
        near = near.distinct().join(nodes, "id", "left_anti")
        return nodes.select(F.lit("subject").alias("role"), "id").union(near.select(F.lit("related").alias("role"), "id"))

    return analyse


_AUTH, _CONFIG, _STORE = ("AUTHORIZES", "HANDLES", "READS"), ("CONFIGURES", "READS", "WRITES"), ("READS", "WRITES", "USES", "CALLS")
for _name, _args in {
    "AuthenticationFlow": ((), _AUTH, _AUTH, "auth|login|session|jwt|guard|permission", ("id", "name")),
    "AuthorizationFlow": (("Permission", "Guard", "Middleware", "Route", "Controller"), ("AUTHORIZES", "USES"), None, "permission|authorize|guard|role|policy", ("name",), False),
    "ConfigurationUsage": (("Configuration", "EnvironmentVariable", "BuildTarget"), _CONFIG, _CONFIG),
    "EnvironmentUsage": (("EnvironmentVariable",), ("READS", "WRITES"), ("READS", "WRITES")),
    "ProviderGraph": (("Provider", "Service", "Factory", "Module", "Repository"), ("INJECTS", "PROVIDES", "REGISTERED_IN", "DEPENDS_ON"), None, None, ("name",), False),
    "ModuleOverview": (("Module", "Package", "Workspace"), ("CONTAINS", "IMPORTS", "EXPORTS", "PROVIDES"), ("IMPORTS", "REGISTERED_IN")),
    "PackageOverview": (("Package", "Dependency"), ("DEPENDS_ON", "IMPORTS", "EXPORTS"), ("DEPENDS_ON", "IMPORTS", "USES")),
    "FrameworkSummary": (("Framework",), None, None),
    "FindDatabaseAccess": (("DatabaseTable", "Model", "Repository"), _STORE, _STORE, "database|sql|repository"),
}.items():
    REGISTRY[_name] = _kinds_and_edges(*_args)


@capability("ServiceOverview")
def service_overview(graph: Graph, depth: int = 2) -> DataFrame:
    """(role, id): services, providers and what is named a service, and their semantic expansion."""
    own = graph.nodes.where(F.col("type").isin("Service", "Provider") | F.col("name").endswith("Service")).select("id")
    near = walk.around(graph, own, "both", depth, EXPANSION).join(own, "id", "left_anti")
    return own.select(F.lit("subject").alias("role"), "id").union(near.select(F.lit("related").alias("role"), "id"))


@capability("CircularDependencies")
def circular(graph: Graph) -> DataFrame:
    return structure.cycle_core(graph, ("IMPORTS", "DEPENDS_ON"))


@capability("DataFlow")
def data_flow(graph: Graph, seeds: DataFrame) -> DataFrame:
    return lookup.touching(graph, seeds, ("READS", "WRITES", "CALLS"))


@capability("RepositoryHealth")
def health(graph: Graph) -> DataFrame:
    issues = quality.validate(graph).groupBy("code").agg(F.count("*").alias("n"))
    return issues.union(dead_code(graph).agg(F.count("*")).select(F.lit("dead-code"), "count(1)"))


@capability("RiskAnalysis")
def risk(graph: Graph, k: int = 15) -> DataFrame:
    """The best connected modules, packages, services, providers, controllers and routes."""
    return measure.most_connected(graph, ("Module", "Package", "Service", "Provider", "Controller", "Route"), k)


@capability("FeatureTouchpoints")
def touchpoints(graph: Graph, phrase: str, depth: int = 3) -> DataFrame:
    from graphloom.operators.search import entries, search

    return walk.walk(graph, search(entries(graph), phrase), "both", depth)


@capability("EvidencePack")
def evidence_pack(graph: Graph, phrase: str, nodes: int = 20) -> DataFrame:
    """(id, type, score, turn): search hits dealt round-robin over the kinds of nodes, the first ``nodes``."""
    from graphloom.operators.search import entries, search

    hits = search(entries(graph), phrase, 80)
    dealt = measure.round_robin(hits, "type", F.desc("score"), "id")
    return dealt.orderBy("turn", "type").limit(nodes).select("id", "type", "score", F.col("turn").cast("long").alias("turn"))


@capability("ImplementationPlan")
def implementation_plan(graph: Graph, phrase: str) -> DataFrame:
    """(stage, id): targets found by search, their dependents, dependencies and owners."""
    targets = evidence_pack(graph, phrase).select("id")
    near = both_ways(graph, targets, "local").select("side", "id").distinct()
    owners = ownership(graph, targets).select(F.lit("owner").alias("side"), "id").distinct()
    return targets.select(F.lit("target").alias("side"), "id").union(near).union(owners).withColumnRenamed("side", "stage")
