"""Plans whose tasks stay small, and the results of the steps behind them on odd graphs."""

import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from graphloom.graph import DEPENDENCY, EXPANSION, Graph
from graphloom.operators import capabilities, history, lookup, measure, quality, search, structure, walk
from graphloom.plans import catalog, tables
from graphloom.sources.relational import star_graph


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_graph(spark, seed):
    """Repeated nodes and edges, loops, and ends without a node."""
    rng = random.Random(seed)
    nodes = [(f"n:{k:02}", rng.choice(("Service", "Function")), f"n{k}", None, None) for k in [*range(18), 3, 3, 7]]
    edges = [(rng.choice(("CALLS", "CONTAINS", "OTHER")), f"n:{rng.randrange(22):02}", f"n:{rng.randrange(22):02}") for _ in range(34)]
    edges += edges[:5]
    g = Graph(spark.createDataFrame(nodes, "id string, type string, name string, file string, package string"), spark.createDataFrame(edges, "type string, src string, dst string"))
    return g, {n[0] for n in nodes}, edges


def brute(known, edges, seeds, direction, depth, relations=None):
    ahead = {}
    for kind, a, b in edges:
        if relations is None or kind in relations:
            if direction != "inbound":
                ahead.setdefault(a, set()).add(b)
            if direction != "outbound":
                ahead.setdefault(b, set()).add(a)
    found = {}
    for seed in seeds & known:
        level = {seed}
        for step in range(depth + 1):
            for i in level:
                found.setdefault((seed, i), step)
            level = {b for a in level for b in ahead.get(a, ()) if b in known and (seed, b) not in found}
    return found


@pytest.mark.parametrize("direction", ["outbound", "inbound", "both"])
def test_walks_of_odd_graphs(spark, direction):
    g, known, edges = odd_graph(spark, 4)
    seeds = spark.createDataFrame([(f"n:{k:02}",) for k in (0, 3, 3, 5, 20)], "id string")
    want = brute(known, edges, {"n:00", "n:03", "n:05", "n:20"}, direction, 3)
    got = walk.walk(g, seeds, direction, 3).collect()
    assert {(r["seed"], r["id"]): r["depth"] for r in got} == want and len(got) == len(want)
    wide = walk.walk(g, seeds, direction, 3, wide=True).collect()
    assert sorted(wide) == sorted(got)
    near = [r["id"] for r in walk.around(g, seeds, direction, 3).collect()]
    assert sorted(near) == sorted({i for _, i in want})


def test_service_overview_forgets_seeds(spark):
    """What is around all services is walked once, not once for each service."""
    g, known, edges = odd_graph(spark, 6)
    own = {r["id"] for r in g.of_types("Service").collect()}
    df = capabilities.run("ServiceOverview", g)
    want = {i for _, i in brute(known, edges, own, "both", 2, EXPANSION)} - own
    assert sorted(r["id"] for r in df.where("role = 'related'").collect()) == sorted(want)
    assert not re.search(r"\bseed#", plan(df))


@pytest.mark.parametrize("name", ["walk_outbound", "dependencies_d3", "dependents_d3", "guard_closure", "callers", "callees", "module_overview", "validation_issues",
                                  "file_history", "drift_timeline", "relation_summary"])
def test_partitions_follow_the_files(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "SHARD_MB", 0.001)
    parts = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan(catalog.QUERIES[name](spark, str(DATA))))]
    assert parts and min(parts) >= 100


def test_a_step_from_few_seeds_is_a_scan(spark):
    """The edges are neither made unique nor shuffled for a step from a few seeds."""
    g = star_graph(spark, str(DATA))
    text = walk.walk(g, g.of_types("Package"), "both", 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[here#", text)
    assert "SortMergeJoin [here#" not in text and "LeftSemi" not in text


def test_reach_and_paths_of_odd_graphs(spark):
    g, _, edges = odd_graph(spark, 8)
    g = Graph(g.nodes.dropDuplicates(["id"]), g.edges)
    every = {e for x in edges for e in x[1:]} | {"n:00", "n:05"}
    seeds = spark.createDataFrame([("n:00",), ("n:05",), ("n:05",)], "id string")
    want = brute(every, edges, {"n:00", "n:05"}, "outbound", 40)
    got = walk.reach(g, seeds).collect()
    assert {(r["seed"], r["id"]): r["depth"] for r in got} == want and len(got) == len(want)
    paths = walk.shortest_paths(g, seeds, spark.createDataFrame([(i,) for i in every], "id string")).collect()
    best = {}
    level = {(s, s): (s,) for s in ("n:00", "n:05")}
    while level:
        best |= level
        more = {}
        for (seed, here), path in level.items():
            for _, a, b in edges:
                if a == here and (seed, b) not in best:
                    more[seed, b] = min(more.get((seed, b), (*path, b)), (*path, b))
        level = more
    assert {(r["seed"], r["id"]): (r["hops"], r["path"]) for r in paths} == {k: (len(p) - 1, ">".join(p)) for k, p in best.items()} and len(paths) == len(best)


def test_guards_and_neighbours_of_odd_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.choice(("AUTHORIZES", "HANDLES", "BELONGS_TO")), f"a{rng.randrange(6)}", f"x{rng.randrange(5)}") for _ in range(40)] + [("GUARDS", "a0", "a1"), ("GUARDS", "a2", "a3")]
    g = Graph(spark.createDataFrame([("a0",), ("x1",), ("x1",)], "id string"), spark.createDataFrame(edges, "type string, src string, dst string"))
    want = {(a, b) for k, a, x in edges if k == "AUTHORIZES" for m, b, y in edges if m in ("HANDLES", "BELONGS_TO") and x == y} - {(a, b) for k, a, b in edges if k == "GUARDS"}
    got = [tuple(r) for r in lookup.guard_closure(g).collect()]
    assert sorted(got) == sorted(("GUARDS", *p) for p in want)
    near = [tuple(r) for r in lookup.neighbours(g, g.nodes, "outbound").collect()]
    assert sorted(near) == sorted({(a, b, k) for k, a, b in edges if a in ("a0", "x1") and b in ("a0", "x1") and a != b})


def test_dangling_and_repeated_edges(spark):
    g, known, edges = odd_graph(spark, 9)
    assert sorted(tuple(r) for r in lookup.dangling(g).collect()) == sorted((*e, end) for e in edges for end, i in (("src", e[1]), ("dst", e[2])) if i not in known)
    twice = {e for e in edges if edges.count(e) > 1}
    got = quality.validate(g).where(F.col("code") == "duplicate-edge").collect()
    assert sorted(r["subject"] for r in got) == sorted(f"{a} {k} {b}" for k, a, b in twice)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_history_shuffles_once_by_key(spark):
    """By part, by commit, by file: no shuffle by two keys where one of them does; file_history's plan holds its table twice."""
    assert shuffles(catalog.QUERIES["file_history"](spark, str(DATA))) <= 10
    assert "Expand" not in plan(catalog.QUERIES["drift_timeline"](spark, str(DATA)))


def test_history_of_odd_changes(spark):
    """Co-changes and drift against brute force, with files without a name and commits of too many files."""
    rng = random.Random(1)
    commits = [(f"c{k}", 2019 + rng.randrange(3), f"u{k % 3}") for k in range(12)]
    changes = sorted({(f"c{k}", rng.choice(("a/x", "a/y", "B/z", "b/w", None)) or "a/v") for k in range(12) for _ in range(3)}) + [("c0", None), ("c1", None)]
    changes += [("c11", f"big/{k}") for k in range(6)]
    rows = history.normalise(
        spark.createDataFrame(commits, "hash string, year int, author string").select("hash", F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("authored_at"), "author", F.lit("s").alias("subject")),
        spark.createDataFrame([(h, f, 2, 1) for h, f in changes], "hash string, file string, additions long, deletions long"),
    )
    when, files = {h: y for h, y, _ in commits}, {}
    for h, f in changes:
        files.setdefault(h, set()).add(f)
    pairs = {}
    for h, fs in files.items():
        if len(fs) <= 5:
            for a in fs - {None}:
                for b in fs - {None}:
                    if a < b:
                        pairs.setdefault((a, b), []).append((when[h], h))
    most = max(map(len, pairs.values()))
    want = sorted(((a, b, len(v), int(len(v) / most * 1e5 + 0.5) / 1e3, max(v)[1]) for (a, b), v in pairs.items()), key=lambda r: (-r[2], r[0], r[1]))
    for k in (3, 100):
        assert [tuple(r) for r in history.co_changes(rows, max_files=5, k=k).collect()] == want[:k]
    drift = {}
    for h, f in changes:
        d = drift.setdefault((f and f.split("/")[0].lower(), when[h]), [set(), set(), 0, 0])
        d[0].add(h)
        d[1] |= {f} - {None}
        d[3] += 3
    for f in {f for _, f in changes}:
        drift[f and f.split("/")[0].lower(), min(when[h] for h, x in changes if x == f)][2] += 1
    got = {(r["feature"], r["year"]): [r["commits"], r["files_touched"], r["files_introduced"], r["churn"]] for r in history.drift(rows).collect()}
    assert got == {k: [len(h), len(f), n, c] for k, (h, f, n, c) in drift.items()}


def test_chains_of_many_partitions(spark, monkeypatch):
    """Chains are levelled over partitions that follow the files, with the same result."""
    asked = []
    monkeypatch.setattr(structure, "shards", lambda *t: 7)
    monkeypatch.setattr(structure, "spread", lambda df, n, *by: asked.append((n, by)) or tables.spread(df, n, *by))
    got = {r["id"]: r["level"] for r in catalog.QUERIES["topo_levels"](spark, str(DATA)).collect()}
    monkeypatch.undo()
    assert got == {r["id"]: r["level"] for r in catalog.QUERIES["topo_levels"](spark, str(DATA)).collect()}
    assert {(7, ("up",)), (7, ("id",))} <= set(asked)


def test_chains_leave_out_what_is_done(spark, monkeypatch):
    """No row without a pointer goes into a round's join, where all of them would meet in one task."""
    null = []
    monkeypatch.setattr(structure, "spread", lambda df, n, *by: null.append(df.where("up IS NULL").count() if by == ("up",) else 0) or df)
    assert catalog.QUERIES["topo_levels"](spark, str(DATA)).count()
    assert len(null) > 3 and not any(null)


def test_scores_and_statistics_scan_edges_once(spark):
    g, known, edges = odd_graph(spark, 5)
    g = Graph(g.nodes.dropDuplicates(["id"]), g.edges)
    into, out = [e[2] for e in edges], [e[1] for e in edges]
    points = {i: min(60, 4 * into.count(i) + 3 * out.count(i)) for i in known}
    scores = {r["id"]: r["score"] - r["importance"] for r in search.ownership_scores(g).join(search.entries(g).select("id", "importance"), "id").collect()}
    assert {k: round(v, 3) for k, v in scores.items()} == points
    assert plan(search.ownership_scores(g)).count("Aggregate") == plan(search.entries(g)).count("Aggregate")
    assert "max(struct" not in plan(measure.statistics(g))


def test_blast_radius_of_odd_graphs(spark):
    """Pairs are parted by seed alone, and counted once whatever side they are of."""
    g, known, edges = odd_graph(spark, 7)
    seeds = spark.createDataFrame([(i,) for i in sorted(known)], "id string")
    want = {}
    for direction, relations in (("both", EXPANSION), ("inbound", DEPENDENCY), ("outbound", DEPENDENCY)):
        for seed, i in brute(known, edges, known, direction, 2, relations):
            want.setdefault(seed, set()).add(i)
    df = capabilities.run("BlastRadius", g, seeds=seeds)
    assert {r["seed"]: r["affected"] for r in df.collect()} == {s: len(w - {s}) for s, w in want.items()}
    assert re.search(r"RepartitionByExpression \[seed#\d+\]", plan(df))
