"""Registered queries of the library's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.graph import DEPENDENCY, EXPANSION, OWNERSHIP, USAGE, Graph
from graphloom.operators import capabilities, diff, history, lookup, measure, quality, report, search, structure, walk
from graphloom.sources import graph_files
from graphloom.sources import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
G = f"WITH RECURSIVE {R.NODES_SQL.strip()}, {R.EDGES_SQL.strip()}"
H = f"WITH {R.HISTORY_SQL.strip()}"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def on_graph(sql: str | None = None):
    """Register a function of the star graph."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(R.star_graph(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        query(f"{G} {sql}" if sql else None)(run)
        return f

    return add


def on_history(sql: str | None = None):
    """Register a function of the normalised history."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(history.normalise(*R.history(spark, sf_dir)))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        query(f"{H}, rows AS (SELECT * FROM changes JOIN commits USING (hash)) {sql}" if sql else None)(run)
        return f

    return add


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# counts, degrees, statistics


@on_graph("SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_kind_counts(g: Graph) -> DataFrame:
    return measure.count_by(g.nodes, "type")


@on_graph("SELECT type, count(*) AS n FROM edges GROUP BY type")
def relationship_counts(g: Graph) -> DataFrame:
    return measure.count_by(g.edges, "type")


DEGREE = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"


@on_graph(f", {DEGREE} SELECT n.id, n.type, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id)")
def degree(g: Graph) -> DataFrame:
    return measure.degrees(g)


@on_graph(f", {DEGREE} SELECT n.id, n.type, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) WHERE type = 'Service' ORDER BY degree DESC, id LIMIT 10")
def degree_topk(g: Graph) -> DataFrame:
    return measure.most_connected(g, ("Service",), 10)


@on_graph(f""", {DEGREE}, s AS (SELECT count(*) AS n, (SELECT count(*) FROM edges) AS e FROM nodes),
m AS (SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 1)
SELECT n AS n_nodes, e AS n_edges, floor(e / (CAST(n AS DOUBLE) * (n - 1)) * 10000 + 0.5) / 10000 AS density,
  floor(2 * e / CAST(n AS DOUBLE) * 10000 + 0.5) / 10000 AS average_degree, m.degree AS max_degree, m.id AS max_degree_id FROM s, m""")
def graph_statistics(g: Graph) -> DataFrame:
    return measure.statistics(g)


@on_graph("SELECT dst AS id, any_value(name) AS name, count(*) AS n FROM edges e JOIN nodes ON dst = id WHERE e.type = 'PROVIDES' GROUP BY dst ORDER BY n DESC, id LIMIT 10")
def most_targeted(g: Graph) -> DataFrame:
    return measure.most_targeted(g, "PROVIDES", 10).select("id", "name", "n")


@on_graph(""", i AS (SELECT id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS inbound FROM (SELECT dst AS id, type, count(*) AS n FROM edges GROUP BY ALL) GROUP BY id),
o AS (SELECT id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS outbound FROM (SELECT src AS id, type, count(*) AS n FROM edges GROUP BY ALL) GROUP BY id)
SELECT id, coalesce(inbound, '') AS inbound, coalesce(outbound, '') AS outbound FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def relation_summary(g: Graph) -> DataFrame:
    return measure.relation_summary(g)


@on_graph("""SELECT CASE type WHEN 'Route' THEN 'Routes' WHEN 'Controller' THEN 'Controllers' WHEN 'Service' THEN 'Services'
WHEN 'Package' THEN 'Modules' WHEN 'Workspace' THEN 'Modules' ELSE 'Language' END AS concern, count(*) AS n FROM nodes GROUP BY 1""")
def architecture_summary(g: Graph) -> DataFrame:
    return capabilities.run("ArchitectureSummary", g)


@on_graph("SELECT 'nodes' AS what, string_agg(type || ': ' || n, ', ' ORDER BY type) AS line FROM (SELECT type, count(*) AS n FROM nodes GROUP BY 1) UNION ALL SELECT 'edges', string_agg(type || ': ' || n, ', ' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges GROUP BY 1)")
def text_summary(g: Graph) -> DataFrame:
    return graph_files.summary_line(g)


@on_graph("SELECT type, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY type, dst) AS r FROM edges) WHERE r <= 5")
def capped_edges(g: Graph) -> DataFrame:
    return measure.cap_per_node(g.edges, 5)


# lookups and joins

NORMAL = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def normal(x: str) -> str:
    return NORMAL.replace("{0}", x)


HAY = ", ".join(normal(f"coalesce({c}, '')") for c in ("id", "name", "type", "file")) + ", " + normal("name || ' ' || type")


@on_graph(f"SELECT id, type, name FROM (SELECT *, unnest([{HAY}]) AS h FROM nodes) WHERE h <> '' AND (contains(h, 'small ring') OR (contains(h, 'ring') AND contains(h, 'small'))) GROUP BY ALL")
def find_text(g: Graph) -> DataFrame:
    return lookup.find_text(g.nodes, "SmallRing").select("id", "type", "name")


@on_graph("SELECT id, type, name FROM nodes WHERE name = 'small ring'")
def resolve_name(g: Graph) -> DataFrame:
    return lookup.resolve(g.nodes, "small ring").select("id", "type", "name")


@on_graph("SELECT id, name, package FROM nodes WHERE type = 'Service' AND package = 'nation:3'")
def find_by_options(g: Graph) -> DataFrame:
    return lookup.find(g.nodes, type="Service", package="nation:3").select("id", "name", "package")


@on_graph("SELECT e.dst AS seed, n.id, e.type AS relation FROM edges e JOIN nodes n ON e.src = n.id WHERE e.type = 'HANDLES'")
def callers(g: Graph) -> DataFrame:
    return lookup.neighbours(g, g.of_types("Function"), "inbound", ["HANDLES"])


@on_graph("SELECT e.src AS seed, n.id, e.type AS relation FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.type = 'PROVIDES'")
def callees(g: Graph) -> DataFrame:
    return lookup.neighbours(g, g.of_types("Service"), "outbound", ["PROVIDES"])


@on_graph("SELECT seed, id, relation FROM (SELECT src AS seed, dst AS id, type AS relation FROM edges UNION SELECT dst, src, type FROM edges) WHERE seed LIKE 'nation:%'")
def related(g: Graph) -> DataFrame:
    return lookup.neighbours(g, g.of_types("Package"), "both")


@on_graph("SELECT type, src, dst FROM edges WHERE src LIKE 'nation:%' AND dst LIKE 'supplier:%' OR src LIKE 'supplier:%'AND dst LIKE 'part:%' OR type = 'CONTAINS' AND src LIKE 'region:%'")
def induced_subgraph(g: Graph) -> DataFrame:
    return lookup.induced(g, F.col("type").isin("Workspace", "Package", "Service", "Function")).edges


@on_graph("SELECT type, src, dst FROM edges WHERE type = 'CONTAINS'")
def edges_touching(g: Graph) -> DataFrame:
    return lookup.touching(g, g.of_types("Package"))


def unused_sql(types, relations) -> str:
    return f"SELECT id, type, name FROM nodes n WHERE type IN ({names(types)}) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.type IN ({names(relations)}))"


@on_graph(unused_sql(("Function", "Method", "Service", "Provider", "Repository", "Route"), (*USAGE, "REGISTERED_IN")))
def dead_code(g: Graph) -> DataFrame:
    return capabilities.run("DeadCode", g).select("id", "type", "name")


@on_graph(unused_sql(("Function", "Method", "Service", "Repository", "Route"), USAGE))
def unused_feature(g: Graph) -> DataFrame:
    return capabilities.run("FindUnusedFeature", g).select("id", "type", "name")


@on_graph(unused_sql(("Function", "Method"), ("CALLS",)))
def uncalled(g: Graph) -> DataFrame:
    return capabilities.run("FindDeadCode", g).select("id", "type", "name")


@on_graph(unused_sql(("Function", "Method", "Module", "Route", "Application"), ("CALLS", "IMPORTS", "HANDLES", "REGISTERED_IN")))
def entry_points(g: Graph) -> DataFrame:
    return capabilities.run("EntryPoints", g).select("id", "type", "name")


@on_graph(f"SELECT e.dst AS seed, e.src AS id, e.type AS relation FROM edges e WHERE e.dst LIKE 'orders:%' AND e.type IN ({names(OWNERSHIP)}) OR e.dst LIKE 'part:%' AND e.type IN ({names(OWNERSHIP)})")
def ownership_edges(g: Graph) -> DataFrame:
    return capabilities.run("OwnershipAnalysis", g, seeds=g.of_types("Route", "Function"))


@query("""WITH p AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_name AS path FROM part),
k AS (SELECT DISTINCT p_type AS folder FROM part UNION SELECT DISTINCT p_type || '/' || p_brand FROM part WHERE p_size > 25)
SELECT path, arg_max(folder, length(folder)) AS package FROM p JOIN k ON starts_with(path, folder || '/') GROUP BY path""")
def package_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = R.table(spark, sf_dir, "part")
    paths = part.select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path")).distinct()
    folders = part.select(F.col("p_type").alias("folder")).union(part.where("p_size > 25").select(F.concat_ws("/", "p_type", "p_brand"))).distinct()
    return lookup.owner_by_prefix(paths, folders.withColumn("package", F.col("folder")))


@query("""SELECT DISTINCT 'GUARDS' AS type, 'supplier:' || a.l_suppkey AS src, 'orders:' || b.l_orderkey AS dst
FROM lineitem a JOIN lineitem b USING (l_partkey) WHERE a.l_returnflag = 'R'""")
def guard_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = R.table(spark, sf_dir, "lineitem")
    part = R.key("part", "l_partkey").alias("dst")
    a = line.where("l_returnflag = 'R'").select(F.lit("AUTHORIZES").alias("type"), R.key("supplier", "l_suppkey").alias("src"), part)
    b = line.select(F.lit("HANDLES").alias("type"), R.key("orders", "l_orderkey").alias("src"), part)
    return lookup.guard_closure(Graph(a.select("src"), a.union(b).distinct(), a.union(b)))


# traversals


def walk_sql(seed: str, depth: int, step: str = "src, dst", relations=None) -> str:
    keep = f"WHERE type IN ({names(relations)})" if relations else ""
    here, there = step.split(", ")
    return f""", adj AS (SELECT {here} AS here, {there} AS there FROM edges {keep}),
w AS (SELECT id AS seed, id, 0 AS depth FROM nodes WHERE {seed} UNION SELECT seed, there, depth + 1 FROM w JOIN adj ON w.id = here WHERE depth < {depth})
SELECT seed, id, min(depth) AS depth FROM w GROUP BY seed, id"""


@on_graph(walk_sql("type = 'Workspace'", 3))
def walk_outbound(g: Graph) -> DataFrame:
    return walk.walk(g, g.of_types("Workspace"), "outbound", 3)


@on_graph(walk_sql("type = 'Service'", 3, relations=DEPENDENCY))
def dependencies_d3(g: Graph) -> DataFrame:
    return walk.dependencies(g, g.of_types("Service"), 3)


@on_graph(walk_sql("type = 'Function'", 3, "dst, src", relations=DEPENDENCY))
def dependents_d3(g: Graph) -> DataFrame:
    return walk.dependents(g, g.of_types("Function"), 3)


@on_graph(""", adj AS (SELECT src AS here, dst AS there FROM edges UNION SELECT dst, src FROM edges)
SELECT id AS seed, id, 0 AS depth FROM nodes WHERE type = 'Package' UNION ALL SELECT DISTINCT here, there, 1 FROM adj WHERE here LIKE 'nation:%'""")
def neighborhood_d1(g: Graph) -> DataFrame:
    return walk.walk(g, g.of_types("Package"), "both", 1)


@on_graph(walk_sql("type = 'Controller'", 9))
def descendants(g: Graph) -> DataFrame:
    return walk.reach(g, g.of_types("Controller"))


@on_graph(""", hops3 AS (SELECT n_regionkey AS r, l_partkey AS p, ['region:' || n_regionkey, 'nation:' || n_nationkey, 'supplier:' || s_suppkey, 'part:' || l_partkey] AS a
  FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey),
hops4 AS (SELECT n_regionkey AS r, l_partkey AS p, ['region:' || n_regionkey, 'nation:' || n_nationkey, 'customer:' || c_custkey, 'orders:' || o_orderkey, 'part:' || l_partkey] AS a
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
best AS (SELECT r, p, min(a) AS a FROM hops3 GROUP BY r, p
  UNION ALL SELECT r, p, min(a) FROM hops4 WHERE NOT EXISTS (SELECT 1 FROM hops3 h WHERE h.r = hops4.r AND h.p = hops4.p) GROUP BY r, p)
SELECT 'region:' || r AS seed, 'part:' || p AS id, CAST(len(a) - 1 AS INTEGER) AS hops, array_to_string(a, '>') AS path FROM best""")
def shortest_path(g: Graph) -> DataFrame:
    return walk.shortest_paths(g, g.of_types("Workspace"), g.of_types("Function"))


@query(f"""WITH {R.TURNS_SQL.strip()}, roots AS (SELECT * FROM turn_nodes WHERE n = 1)
SELECT string_agg(b.id, '>' ORDER BY b.n) AS path, max(b.id) AS id, CAST(count(*) - 1 AS INTEGER) AS depth
FROM roots r JOIN turn_nodes b ON b.conv_id = r.conv_id JOIN turn_nodes e ON e.conv_id = r.conv_id AND b.n <= e.n AND e.n <= 4 GROUP BY r.id, e.id""")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.turn_forest(spark, sf_dir)
    return walk.path_tree(g, lookup.without_inbound(g, ("Module",), ("IMPORTS",)), 3)


@on_graph(""", w AS (SELECT 'region:1' AS id, 0 AS depth UNION ALL SELECT dst, 1 FROM edges WHERE src = 'region:1'
  UNION ALL SELECT b.dst, 2 FROM edges a JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) b ON b.src = a.dst WHERE a.src = 'region:1' AND b.r <= 25),
m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT id, depth, (SELECT count(*) FROM m) > 50 AS truncated FROM m ORDER BY depth, id LIMIT 50""")
def boundary_walk(g: Graph) -> DataFrame:
    return walk.boundary(g, lookup.find(g.nodes, id="region:1"), "outbound", 2)


def around_sql(kinds) -> str:
    """``around``: what is at most two steps along the expansion's relations from nodes of some kinds."""
    return f""", seeds AS (SELECT id FROM nodes WHERE type IN ({names(kinds)})),
sides AS (SELECT src AS here, dst AS there FROM edges WHERE type IN ({names(EXPANSION)}) UNION SELECT dst, src FROM edges WHERE type IN ({names(EXPANSION)})),
one AS (SELECT here AS seed, there AS id FROM sides WHERE here IN (SELECT id FROM seeds)),
two AS (SELECT DISTINCT one.seed, there AS id FROM one JOIN sides ON here = one.id),
around AS (SELECT seed, id, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two) WHERE seed <> id GROUP BY seed, id)"""


@on_graph(f"""{around_sql(("Service", "Function"))}, ups AS (SELECT DISTINCT dst AS seed, src AS id, 1 AS depth, 'dependent' AS side FROM edges WHERE type = 'PROVIDES'),
downs AS (SELECT DISTINCT src AS seed, dst AS id, 1 AS depth, 'dependency' AS side FROM edges WHERE type = 'PROVIDES')
SELECT * FROM ups UNION ALL SELECT * FROM downs UNION ALL SELECT seed, id, CAST(depth AS INTEGER), 'expansion' FROM around""")
def impact_local(g: Graph) -> DataFrame:
    return capabilities.run("ImpactAnalysis", g, seeds=g.of_types("Service", "Function"))


@on_graph(f"""{around_sql(("Service",))}, every AS (SELECT seed, id FROM around UNION SELECT src, dst FROM edges WHERE type = 'PROVIDES'),
c AS (SELECT seed, count(*) AS affected FROM every GROUP BY seed)
SELECT id AS seed, coalesce(affected, 0) AS affected, CASE WHEN least(coalesce(affected, 0) + 1, 50) >= 100 THEN 'large' WHEN least(coalesce(affected, 0) + 1, 50) >= 25 THEN 'medium' ELSE 'small' END AS radius
FROM nodes LEFT JOIN c ON id = seed WHERE type = 'Service'""")
def blast_radius(g: Graph) -> DataFrame:
    return capabilities.run("BlastRadius", g, seeds=g.of_types("Service"))


@on_graph(f"""{around_sql(("Service",))} SELECT 'subject' AS role, id FROM seeds UNION ALL SELECT DISTINCT 'related', id FROM around WHERE id NOT IN (SELECT id FROM seeds)""")
def service_overview(g: Graph) -> DataFrame:
    return capabilities.run("ServiceOverview", g)


@on_graph("SELECT 'subject' AS role, id FROM nodes WHERE type IN ('Package', 'Workspace') UNION ALL SELECT DISTINCT 'related', dst FROM edges WHERE src SIMILAR TO '(region|nation):.*' AND dst NOT LIKE 'nation:%'")
def module_overview(g: Graph) -> DataFrame:
    return capabilities.run("ModuleOverview", g)


@on_graph("SELECT 'subject' AS role, id FROM nodes WHERE type IN ('Route', 'Controller') OR regexp_matches(lower(name), 'permission|authorize|guard|role|policy')")
def authorization_flow(g: Graph) -> DataFrame:
    return capabilities.run("AuthorizationFlow", g)


@on_graph("SELECT 'subject' AS role, id FROM nodes WHERE type IN ('Service') UNION ALL SELECT DISTINCT 'related', dst FROM edges WHERE type = 'PROVIDES'")
def provider_graph(g: Graph) -> DataFrame:
    return capabilities.run("ProviderGraph", g)


@on_graph(f", {DEGREE} SELECT n.id, n.type, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) WHERE type IN ('Package', 'Service', 'Controller', 'Route') ORDER BY degree DESC, id LIMIT 15")
def risk_analysis(g: Graph) -> DataFrame:
    return capabilities.run("RiskAnalysis", g)


# structure


@query(f"WITH {R.TURNS_SQL.strip()} SELECT id, min(id) OVER (PARTITION BY conv_id) AS component FROM turn_nodes")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.components(R.turn_forest(spark, sf_dir))


@query(f"""WITH {R.TURNS_SQL.strip()}, c AS (SELECT min(id) AS component, count(*) AS size FROM turn_nodes GROUP BY conv_id)
SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS rank FROM c""")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.communities(R.turn_forest(spark, sf_dir))


@query("""WITH RECURSIVE n AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst FROM n WHERE dst IS NOT NULL),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT a.src AS id, min(a.dst) AS cycle FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def cycle_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.cycle_core(R.event_cycle(spark, sf_dir))


LEVEL = "SELECT 'orders:' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS level FROM orders"


@query(LEVEL)
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.topological_levels(R.order_chain(spark, sf_dir))


@query(f"WITH l AS ({LEVEL}) SELECT max(level) + 1 AS length, min(id) FILTER (level = (SELECT max(level) FROM l)) AS last FROM l")
def longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.longest_chain(R.order_chain(spark, sf_dir))


# snapshots

FIELDS = ("file", "metadata", "name", "package", "type")
DIFF = f"""WITH {R.SNAPSHOTS_SQL.strip()}, f AS (SELECT coalesce(b.id, h.id) AS id, b.id AS bid, h.id AS hid,
 concat_ws(',', {", ".join(f"CASE WHEN b.{c} IS DISTINCT FROM h.{c} THEN '{c}' END" for c in FIELDS)}) AS fields FROM base b FULL JOIN head h ON b.id = h.id),
g AS (SELECT id, CASE WHEN bid IS NULL THEN 'added' WHEN hid IS NULL THEN 'removed' WHEN fields <> '' THEN 'modified' END AS change,
 CASE WHEN bid IS NULL OR hid IS NULL THEN '' ELSE fields END AS fields FROM f)"""


@query(f"{DIFF} SELECT * FROM g WHERE change IS NOT NULL")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_nodes(*R.snapshots(spark, sf_dir))


@query(f"{DIFF} SELECT change, count(*) AS n FROM g WHERE change IS NOT NULL GROUP BY change")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_summary(diff.diff_nodes(*R.snapshots(spark, sf_dir)))


@query("""WITH e AS (SELECT DISTINCT 'PROVIDES' AS type, 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, year(l_shipdate) >= 1998 AS late FROM lineitem)
SELECT type, src, dst, CASE WHEN bool_or(late) THEN 'added' ELSE 'removed' END AS change FROM e GROUP BY ALL HAVING count(*) = 1""".replace("GROUP BY ALL", "GROUP BY type, src, dst"))
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = R.table(spark, sf_dir, "lineitem")
    e = line.select(F.lit("PROVIDES").alias("type"), R.key("supplier", "l_suppkey").alias("src"), R.key("part", "l_partkey").alias("dst"), (F.year("l_shipdate") >= 1998).alias("late"))
    return diff.diff_edges(e.where("NOT late"), e.where("late"))


SETS = f"WITH {R.SNAPSHOTS_SQL.strip()}"


@query(f"{SETS} SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM base UNION SELECT id FROM head) UNION ALL SELECT 'intersection', count(*) FROM (SELECT id FROM base INTERSECT SELECT id FROM head) UNION ALL SELECT 'difference', count(*) FROM (SELECT id FROM base EXCEPT SELECT id FROM head)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = R.snapshots(spark, sf_dir)
    n = F.count("*").alias("n")
    rows = [f(a, b).agg(n).select(F.lit(f.__name__).alias("op"), "n") for f in (diff.union, diff.intersection, diff.difference)]
    return rows[0].union(rows[1]).union(rows[2])


# quality


@on_graph("""SELECT 'route-without-handler' AS code, 'warning' AS severity, id AS subject FROM nodes WHERE type = 'Route' AND id NOT IN (SELECT src FROM edges WHERE type = 'HANDLES')
UNION ALL SELECT 'unused-provider', 'info', id FROM nodes WHERE type = 'Service' AND id NOT IN (SELECT src FROM edges WHERE type = 'PROVIDES')
UNION ALL SELECT 'missing-endpoint', 'error', src || ' ' || type || ' ' || dst FROM edges WHERE src NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'missing-endpoint', 'error', src || ' ' || type || ' ' || dst FROM edges WHERE dst NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'duplicate-controller', 'warning', name FROM nodes WHERE type = 'Controller' GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'duplicate-edge', 'error', src || ' ' || type || ' ' || dst FROM edges GROUP BY type, src, dst HAVING count(*) > 1
UNION ALL SELECT 'route-without-controller', 'warning', id FROM nodes WHERE type = 'Route' AND id NOT IN (SELECT dst FROM edges WHERE type = 'MOUNTS')""")
def validation_issues(g: Graph) -> DataFrame:
    return quality.validate(g)


def _covered(metric: str, kind: str, ends: str) -> str:
    return f"SELECT '{metric}' AS metric, count(*) AS total, count(*) FILTER (id NOT IN ({ends})) AS missing FROM nodes WHERE type = '{kind}'"


@on_graph(f""", m AS ({_covered("services", "Service", "SELECT src FROM edges WHERE type = 'PROVIDES'")} UNION ALL {_covered("controllers", "Controller", "SELECT src FROM edges WHERE type = 'MOUNTS'")}
UNION ALL {_covered("routes", "Route", "SELECT src FROM edges WHERE type = 'HANDLES'")} UNION ALL {_covered("packages", "Package", "SELECT src FROM edges WHERE type = 'CONTAINS'")}
UNION ALL {_covered("functions", "Function", "SELECT dst FROM edges WHERE type IN ('HANDLES', 'PROVIDES')")}),
c AS (SELECT *, CAST(floor(100.0 * (total - missing) / total + 0.5) AS BIGINT) AS coverage FROM m)
SELECT *, CAST(greatest(0, coverage - least(20, 2 * missing)) AS BIGINT) AS confidence, CASE WHEN coverage >= 95 THEN 'pass' WHEN coverage >= 60 THEN 'warn' ELSE 'fail' END AS status FROM c""")
def coverage_metrics(g: Graph) -> DataFrame:
    return quality.coverage(g)


@query("""WITH e AS (SELECT lang AS question, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT lang AS question, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 500),
f AS (SELECT coalesce(e.question, p.question) AS question, e.item AS ei, p.item AS pi FROM e FULL JOIN p ON e.question = p.question AND e.item = p.item),
g AS (SELECT question, count(ei) AS expected, count(pi) AS predicted, count(*) FILTER (ei IS NOT NULL AND pi IS NOT NULL) AS hits FROM f GROUP BY question)
SELECT *, CASE WHEN predicted > 0 THEN floor(hits / predicted * 10000 + 0.5) / 10000 ELSE 0 END AS precision, CASE WHEN expected > 0 THEN floor(hits / expected * 10000 + 0.5) / 10000 ELSE 1 END AS recall,
 CASE WHEN hits = expected AND predicted = hits THEN 'PASS' WHEN hits > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM g""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(R.table(spark, sf_dir, "labels"), "doc_id")
    q = [F.col("lang").alias("question"), F.col("doc_id").alias("item")]
    return quality.evaluate(d.where("quality = 1").select(*q), d.where("n_chars >= 500").select(*q))


# history

FILES = """, p AS (SELECT file, count(*) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(additions + deletions) AS BIGINT) AS churn,
 count(DISTINCT author) AS contributors, arg_min(hash, (authored_at, hash)) AS first_commit, arg_max(hash, (authored_at, hash)) AS last_commit,
 max(epoch(authored_at)) AS last, min(epoch(authored_at)) AS first FROM rows GROUP BY file),
t AS (SELECT greatest(max(commits), 1) AS mc, greatest(max(churn), 1) AS mh, max(last) AS latest, greatest((max(last) - min(first)) / 86400, 1) AS win FROM p),
s AS (SELECT p.*, mh, floor((commits / mc * 45 + churn / mh * 35 + least(contributors, 5) / 5 * 10 + greatest(0, 1 - (latest - last) / 86400 / win) * 10) * 1000 + 0.5) / 1000 AS hotspot FROM p, t)"""
CLASS = "CASE WHEN hotspot >= 70 THEN 'hotspot' WHEN hotspot >= 40 THEN 'watch' ELSE 'stable' END AS class"


@on_history(f"""{FILES} SELECT file, commits, additions, deletions, churn, contributors, first_commit, last_commit, hotspot,
 floor(churn / mh * 100 * 1000 + 0.5) / 1000 AS churn_score, floor(greatest(0, 100 - hotspot) * 1000 + 0.5) / 1000 AS stability, {CLASS} FROM s""")
def file_history(rows: DataFrame) -> DataFrame:
    return history.file_history(rows)


@on_history(f"{FILES} SELECT file, hotspot, commits, {CLASS} FROM s ORDER BY hotspot DESC, commits DESC, file LIMIT 200")
def hotspots(rows: DataFrame) -> DataFrame:
    return history.hotspots(rows)


@on_history(""", e AS (SELECT file, author, count(*) AS n, sum(additions + deletions) AS churn FROM rows GROUP BY file, author),
r AS (SELECT *, row_number() OVER w AS rank, sum(n) OVER (PARTITION BY file ORDER BY n DESC, churn DESC, author ROWS UNBOUNDED PRECEDING) AS so_far, sum(n) OVER (PARTITION BY file) AS total
 FROM e WINDOW w AS (PARTITION BY file ORDER BY n DESC, churn DESC, author))
SELECT file, arg_min(author, rank) AS owner, floor(arg_min(n, rank) / max(total) * 100 * 1000 + 0.5) / 1000 AS confidence, count(*) AS contributors,
 min(CASE WHEN so_far / total >= 0.5 THEN rank END) AS bus_factor FROM r GROUP BY file""")
def ownership(rows: DataFrame) -> DataFrame:
    return history.ownership(rows)


@on_history(""", z AS (SELECT *, count(*) OVER (PARTITION BY hash) AS size FROM rows),
p AS (SELECT a.file AS a, b.file AS b, count(*) AS n, arg_max(a.hash, (a.authored_at, a.hash)) AS last_commit FROM z a JOIN z b ON a.hash = b.hash AND a.file < b.file WHERE a.size <= 80 AND b.size <= 80 GROUP BY 1, 2)
SELECT a, b, n, floor(n / (SELECT max(n) FROM p) * 100 * 1000 + 0.5) / 1000 AS score, last_commit FROM p ORDER BY n DESC, score DESC, a, b LIMIT 5000""")
def cochange_pairs(rows: DataFrame) -> DataFrame:
    return history.co_changes(rows)


@on_history(""", f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY authored_at, hash) = 1 AS fresh FROM rows)
SELECT lower(split_part(file, '/', 1)) AS feature, CAST(year(authored_at) AS INTEGER) AS year, count(DISTINCT hash) AS commits, count(DISTINCT file) AS files_touched,
 CAST(sum(CAST(fresh AS BIGINT)) AS BIGINT) AS files_introduced, CAST(sum(additions + deletions) AS BIGINT) AS churn FROM f GROUP BY 1, 2""")
def drift_timeline(rows: DataFrame) -> DataFrame:
    return history.drift(rows)


@on_history(""", y AS (SELECT lower(split_part(file, '/', 1)) AS feature, year(authored_at) AS y, count(DISTINCT file) AS n FROM rows GROUP BY 1, 2),
f AS (SELECT feature, arg_min(n, y) AS first_files, arg_max(n, y) AS last_files FROM y GROUP BY feature)
SELECT *, CASE WHEN last_files > greatest(first_files, 1) * 1.5 THEN 'increasing' ELSE 'flat' END AS trend FROM f""")
def drift_trends(rows: DataFrame) -> DataFrame:
    return history.trends(rows)


@on_history("SELECT file, 0.0::DOUBLE AS bugfix, 0.0::DOUBLE AS refactor, 0.0::DOUBLE AS feature, 1.0::DOUBLE AS other FROM rows GROUP BY file")
def category_ratios(rows: DataFrame) -> DataFrame:
    return history.category_ratios(rows)


# search and text

@query(f"""WITH t AS (SELECT doc_id, {normal("text")} AS n FROM documents), p AS (SELECT DISTINCT doc_id, unnest(string_split(n, ' ')) AS term FROM t)
SELECT term, count(*) AS frequency FROM p WHERE term <> '' GROUP BY term""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.table(spark, sf_dir, "documents").select("doc_id", C.tokens(F.col("text")).alias("words"))
    return search.vocabulary(search.postings(docs, "doc_id"))


@query(f"""WITH t AS (SELECT doc_id, {normal("text")} AS n FROM documents)
SELECT DISTINCT term, doc_id AS id FROM (SELECT doc_id, unnest(string_split(n, ' ')) AS term FROM t) WHERE term <> ''""")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.table(spark, sf_dir, "documents").select("doc_id", C.tokens(F.col("text")).alias("words"))
    return search.postings(docs, "doc_id")


WEIGHTS = "CASE WHEN type IN ('Workspace') THEN 5 WHEN type IN ('Package', 'Controller', 'Route', 'Service') THEN 4 ELSE 1 END"
LAYER = "CASE WHEN type IN ('Route', 'Controller') THEN 'application-boundary' WHEN type = 'Service' THEN 'application-service' WHEN type IN ('Package', 'Workspace') THEN 'architecture' ELSE 'language' END"
ENTRIES = f""", {DEGREE}, ins AS (SELECT dst AS id, count(*) AS inbound FROM edges GROUP BY dst), e AS (SELECT n.id, n.name, n.type, coalesce(degree, 0) AS usage, {LAYER} AS layer,
 list_sort(list_distinct(string_split({normal("n.name || ' ' || n.type")}, ' '))) AS words,
 floor(({WEIGHTS} + log2(coalesce(degree, 0) + 1) + log2(coalesce(inbound, 0) + 1)) * 1000 + 0.5) / 1000 AS importance FROM nodes n LEFT JOIN d USING (id) LEFT JOIN ins USING (id))"""


@on_graph(f"{ENTRIES} SELECT id, type, layer, array_to_string(words, ' ') AS words, importance, usage FROM e")
def search_entries(g: Graph) -> DataFrame:
    return search.entries(g).select("id", "type", "layer", F.array_join("words", " ").alias("words"), "importance", "usage")


@on_graph(f"""{ENTRIES}, q AS (SELECT ['blue', 'ring'] AS w, 'blue ring' AS said),
m AS (SELECT e.*, {normal("name")} AS n, len(list_intersect(words, w)) AS met, len(list_distinct(list_concat(words, w))) AS uni, said FROM e, q WHERE list_has_any(words, w) OR contains({normal("name")}, said)),
s AS (SELECT id, type, floor(((CASE WHEN n = said THEN 500 ELSE 0 END) + (CASE WHEN met = 2 THEN 260 ELSE 0 END) + (CASE WHEN contains(n, said) THEN 180 ELSE 0 END) + 55.0 * met + 140.0 * met / uni
 + importance + least(60, 10 * log2(usage + 1)) - 120.0 * (2 - met)) * 1000 + 0.5) / 1000 AS score FROM m),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, type, id LIMIT 40)
SELECT id, type, score, row_number() OVER (ORDER BY score DESC, type, id) AS rank FROM t""")
def search_score(g: Graph) -> DataFrame:
    return search.search(search.entries(g), "BlueRing").select("id", "type", "score", "rank")


@on_graph(f"""{ENTRIES}, f AS (SELECT array_to_string(words[1:3], '-') AS feature, importance + usage AS s FROM e)
SELECT feature, count(*) AS members, floor(sum(s) * 10 + 0.5) / 10 AS score FROM f GROUP BY feature ORDER BY members DESC, feature LIMIT 240""")
def feature_buckets(g: Graph) -> DataFrame:
    return search.feature_buckets(search.entries(g))


@query("""WITH t AS (SELECT DISTINCT item_id AS id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM benchmark),
u AS (SELECT * FROM t WHERE term <> '')
SELECT a.id AS a, b.id AS b, count(*) AS shared FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2""")
def related_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = R.table(spark, sf_dir, "benchmark").select("item_id", C.tokens(F.lower("text")).alias("words"))
    return search.related_by_terms(search.postings(items, "item_id"))


@on_graph(f"""{ENTRIES}, i AS (SELECT unnest(words) AS intent FROM e UNION ALL SELECT words[k] || ' ' || words[k + 1] FROM e, unnest(generate_series(1, len(words) - 1)) AS u(k))
SELECT intent, count(*) AS n FROM i GROUP BY intent""")
def intent_vocabulary(g: Graph) -> DataFrame:
    return search.intents(search.entries(g))


@on_graph(f"""{ENTRIES}, i AS (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1)
SELECT id, type, floor((least(60, 4 * coalesce(i, 0) + 3 * coalesce(o, 0)) + importance) * 1000 + 0.5) / 1000 AS score FROM e LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def ownership_scores(g: Graph) -> DataFrame:
    return search.ownership_scores(g)


@on_graph()
def evidence_pack(g: Graph) -> DataFrame:
    return capabilities.run("EvidencePack", g, phrase="green bolt")


@query("SELECT p_partkey, lower(p_name) AS normal, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ',') AS words, 'part:' || p_type || ':' || p_name AS node FROM part")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part")
    return p.select("p_partkey", C.normal_text(F.col("p_name")).alias("normal"), F.array_join(C.tokens(F.col("p_name")), ",").alias("words"), C.node_id(F.lit("part"), F.col("p_name"), F.col("p_type")).alias("node"))


@on_graph("SELECT 'node' AS part, '<node id=\"' || id || '\"/>' AS line FROM nodes UNION ALL SELECT 'edge', '<edge source=\"' || src || '\" target=\"' || dst || '\"/>' FROM edges")
def export_graphml(g: Graph) -> DataFrame:
    return graph_files.drawing(g, "graphml")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.streaming.ingest import windowed_counts

    return windowed_counts(R.table(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


# lookups of one node, forms of text, whole reports


@on_graph("SELECT id, name FROM nodes WHERE type = 'Service' OR name LIKE '%Service'")
def services_found(g: Graph) -> DataFrame:
    return lookup.services(g.nodes).select("id", "name")


@on_graph("SELECT id, type, name FROM nodes WHERE name = 'small ring' ORDER BY id LIMIT 1")
def one_found(g: Graph) -> DataFrame:
    return lookup.find_one(g.nodes, "small ring").select("id", "type", "name")


@on_graph("""SELECT 'incoming' AS side, type AS relation, src AS id FROM edges WHERE dst = 'nation:3' UNION ALL SELECT 'outgoing', type, dst FROM edges WHERE src = 'nation:3'
UNION ALL (SELECT 'related', '', src FROM edges WHERE dst = 'nation:3' UNION SELECT 'related', '', dst FROM edges WHERE src = 'nation:3')""")
def node_inspected(g: Graph) -> DataFrame:
    return lookup.inspect_node(g, "nation:3")


@query(r"""WITH p AS (SELECT p_partkey, p_name, lower(p_type) || '/' || p_name || '.v1.ts' AS path, string_split(p_name, ' ') AS w FROM part),
t AS (SELECT *, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') AS title, w[len(w)] AS last FROM p)
SELECT p_partkey, p_name || '.v1' AS stem, split_part(path, '/', 1) AS folder, title, lower(regexp_replace(replace(title, ' ', ''), '([a-z0-9])([A-Z])', '-', 'g')) AS kebab,
 CASE WHEN last LIKE '%y' AND length(last) > 2 THEN last[:-2] || 'ies' WHEN last LIKE '%s' THEN last ELSE last || 's' END AS many,
 CASE WHEN last LIKE '%ies' AND length(last) > 4 THEN last[:-4] || 'y' WHEN last LIKE '%sses' THEN last[:-3] WHEN last LIKE '%s' AND last NOT LIKE '%ss' AND length(last) > 3 THEN last[:-2] ELSE last END AS one,
 CASE WHEN length(p_name) > 8 THEN p_name[:8] || '...[truncated]' ELSE p_name END AS short,
 array_to_string(list_sort(list_distinct([array_to_string(w, ' '), array_to_string(w, ''), array_to_string(w, '-'), array_to_string(w, '_')])), '|') AS variants FROM t""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").withColumn("path", F.concat(F.lower("p_type"), F.lit("/"), "p_name", F.lit(".v1.ts")))
    name, last, title = F.col("p_name"), F.substring_index("p_name", " ", -1), C.title_case(F.col("p_name"))
    return p.select(
        "p_partkey", C.file_stem(F.col("path")).alias("stem"), C.folder(F.col("path")).alias("folder"), title.alias("title"), C.kebab_case(F.replace(title, F.lit(" "), F.lit(""))).alias("kebab"),
        C.plural(last).alias("many"), C.singular(last).alias("one"), C.shorten(name, 8).alias("short"), F.array_join(C.variants(name), "|").alias("variants"),
    )


@query("SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS folded FROM documents")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", F.md5(C.fold(F.col("text"))).alias("folded"))


@query(f"""WITH {R.TURNS_SQL.strip()}, c AS (SELECT conv_id, count(*) AS size FROM turn_nodes GROUP BY conv_id),
d AS (SELECT t.id, CASE WHEN size = 1 THEN 0 WHEN n = 1 OR n = size THEN 1 ELSE 2 END AS degree FROM turn_nodes t JOIN c USING (conv_id)),
s AS (SELECT count(*) AS n_nodes, count(*) FILTER (n > 1) AS n_edges, min(id) FILTER (n > 1) AS most_imported FROM turn_nodes)
SELECT n_nodes, n_edges, floor(n_edges / (CAST(n_nodes AS DOUBLE) * (n_nodes - 1)) * 10000 + 0.5) / 10000 AS density, floor(2 * n_edges / CAST(n_nodes AS DOUBLE) * 10000 + 0.5) / 10000 AS average_degree,
 (SELECT max(degree) FROM d) AS max_degree, (SELECT min(id) FROM d WHERE degree = (SELECT max(degree) FROM d)) AS max_degree_id,
 (SELECT count(*) FROM c) AS components, (SELECT max(size) FROM c) AS largest_component, most_imported, 1 AS most_imported_n, NULL AS most_depended, 0 AS most_depended_n,
 CASE WHEN n_nodes <= 250 THEN (SELECT floor(sum(size * size * size - size) / 3 / sum(size * size - size) * 10000 + 0.5) / 10000 FROM c) END AS average_path_length FROM s""")
def full_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.full_statistics(R.turn_forest(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(R.table(spark, sf_dir, "labels"), "doc_id")
    q = [F.concat_ws("/", "lang", "source").alias("question"), F.col("doc_id").alias("item")]
    return quality.evaluate(d.where("quality = 1").select(*q), d.where(F.col("n_chars") >= least).select(*q))


def judged_sql(name: str, least: int) -> str:
    return f"""{name}_g AS (SELECT concat_ws('/', lang, source) AS question, count(DISTINCT doc_id) FILTER (quality = 1) AS expected, count(DISTINCT doc_id) FILTER (n_chars >= {least}) AS predicted,
 count(DISTINCT doc_id) FILTER (quality = 1 AND n_chars >= {least}) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING expected + predicted > 0),
{name} AS (SELECT question, CASE WHEN predicted > 0 THEN floor(hits / predicted * 10000 + 0.5) / 10000 ELSE 0 END AS precision, CASE WHEN expected > 0 THEN floor(hits / expected * 10000 + 0.5) / 10000 ELSE 1 END AS recall,
 CASE WHEN hits = expected AND predicted = hits THEN 'PASS' WHEN hits > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM {name}_g)"""


@query(f"""WITH {judged_sql("a", 500)} SELECT split_part(question, '/', 1) AS category, count(*) AS questions, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'PARTIAL') AS partial,
 count(*) FILTER (status = 'FAIL') AS failed, floor(avg(precision) * 10000 + 0.5) / 10000 AS precision, floor(avg(recall) * 10000 + 0.5) / 10000 AS recall FROM a GROUP BY 1""")
def evaluation_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.roll_up(_judged(spark, sf_dir, 500).withColumn("lang", F.substring_index("question", "/", 1)), "lang")


@query(f"""WITH {judged_sql("a", 500)}, {judged_sql("b", 4000)}, r AS (SELECT question, a.status AS was, b.status AS now, CASE a.status WHEN 'PASS' THEN 2 WHEN 'PARTIAL' THEN 1 WHEN 'FAIL' THEN 0 END AS x,
 CASE b.status WHEN 'PASS' THEN 2 WHEN 'PARTIAL' THEN 1 WHEN 'FAIL' THEN 0 END AS y FROM a FULL JOIN b USING (question))
SELECT question, was, now, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN y > x THEN 'improved' WHEN y < x THEN 'regressed' ELSE 'same' END AS change FROM r""")
def evaluation_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.regression(_judged(spark, sf_dir, 500), _judged(spark, sf_dir, 4000))
