"""Operators on small literal graphs, random graphs and texts."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.graph import Graph, last_write, merge_nodes
from graphloom.operators import capabilities, diff, history, lookup, measure, quality, report, search, structure, walk
from graphloom.plans import catalog
from graphloom.plans.steps import Step, execute, levels
from graphloom.sources import graph_files, manifests
from graphloom.sources.relational import star_graph
from graphloom.streaming import ingest

NODES = "id string, type string, name string, file string, package string"
EDGES = "type string, src string, dst string"


def graph(spark, nodes, edges):
    rows = [(n, t, n.split(":")[-1], None, None) for n, t in nodes]
    return Graph(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES))


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("mod:index", "Module"), ("mod:service", "Module"), ("mod:auth", "Module"), ("fn:main", "Function"), ("class:UserService", "Class"), ("method:load", "Method"), ("fn:requireUser", "Function"), ("res:PlanDefinition", "Resource"), ("model:ThresholdDto", "Model")]
    edges = [("CALLS", "fn:main", "method:load"), ("CALLS", "method:load", "fn:requireUser"), ("IMPORTS", "mod:index", "mod:service"), ("IMPORTS", "mod:service", "mod:auth"), ("CONTAINS", "class:UserService", "method:load")]
    return graph(spark, nodes, edges)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_text_match(small):
    for said in ("Plan Definition Resource", "plan-definition", "planDefinition"):
        assert ids(lookup.find_text(small.nodes, said)) == ["res:PlanDefinition"]
    assert ids(lookup.find_text(small.nodes, "threshold dto")) == ["model:ThresholdDto"]


def test_resolve_prefers_exact(small):
    assert ids(lookup.resolve(small.nodes, "fn:main")) == ["fn:main"]
    assert ids(lookup.resolve(small.nodes, "main")) == ["fn:main"]


def test_walks(small):
    seeds = lookup.find(small.nodes, id="mod:index")
    assert ids(walk.dependencies(small, seeds, 2)) == ["mod:auth", "mod:index", "mod:service"]
    back = walk.dependents(small, lookup.find(small.nodes, id="mod:auth"), 2)
    assert {r["id"]: r["depth"] for r in back.collect()} == {"mod:auth": 0, "mod:service": 1, "mod:index": 2}
    path = walk.shortest_paths(small, lookup.find(small.nodes, id="fn:main"), lookup.find(small.nodes, id="fn:requireUser"), relations=["CALLS"])
    assert path.first()["path"] == "fn:main>method:load>fn:requireUser"


def test_shortest_paths_of_any_length(spark):
    g = graph(spark, [(f"fn:{k:02}", "Function") for k in range(20)], [("CALLS", f"fn:{k:02}", f"fn:{k + 1:02}") for k in range(19)] + [("CALLS", "fn:19", "fn:00")])
    got = walk.shortest_paths(g, lookup.find(g.nodes, id="fn:00"), lookup.find(g.nodes, id="fn:19")).collect()
    assert [(r["hops"], r["path"]) for r in got] == [(19, ">".join(f"fn:{k:02}" for k in range(20)))]


def test_shortest_path_over_the_whole_graph(spark):
    """The registered query against a search of every node and edge of the star graph."""
    g = star_graph(spark, str(DATA))
    kinds, ahead = {r["id"]: r["type"] for r in g.nodes.collect()}, {}
    for e in g.edges.collect():
        ahead.setdefault(e["src"], set()).add(e["dst"])
    want = {}
    for seed in (i for i, t in kinds.items() if t == "Workspace"):
        seen = level = {seed: (seed,)}
        while level:
            more = {}
            for path in level.values():
                for there in ahead.get(path[-1], set()) - seen.keys():
                    more[there] = min(more.get(there, (*path, there)), (*path, there))
            seen, level = seen | more, more
        want |= {(seed, i): p for i, p in seen.items() if kinds[i] == "Function"}
    got = {(r["seed"], r["id"]): (r["hops"], r["path"]) for r in catalog.QUERIES["shortest_path"](spark, str(DATA)).collect()}
    assert got == {k: (len(p) - 1, ">".join(p)) for k, p in want.items()}


def test_related_by_terms(spark):
    """Terms of more than 400 entries count, and so do pairs with one term; held against all pairs."""
    rng = random.Random(5)
    terms = {i: {"common", f"t{rng.randrange(200)}", f"t{rng.randrange(200)}"} if i < 410 else {f"t{rng.randrange(200)}"} for i in range(430)}
    posts = spark.createDataFrame([(t, i) for i, ts in terms.items() for t in ts], "term string, id long")
    got = {(r["a"], r["b"]): r["shared"] for r in search.related_by_terms(posts).collect()}
    assert got == {(a, b): len(terms[a] & terms[b]) for a in terms for b in terms if a < b and terms[a] & terms[b]}


def test_empty_relations_match_nothing(small):
    assert small.by_relation([]).count() == 0
    assert small.by_relation(None).count() == 5


def test_components_and_statistics(small):
    assert structure.components(small).select("component").distinct().count() == 4
    row = measure.statistics(small).first()
    assert (row["n_nodes"], row["n_edges"], row["max_degree_id"]) == (9, 5, "method:load")


def test_cycles(spark):
    g = graph(spark, [(x, "Module") for x in "abcd"], [("IMPORTS", "a", "b"), ("IMPORTS", "b", "a"), ("IMPORTS", "b", "c"), ("IMPORTS", "c", "d")])
    assert {(r["id"], r["cycle"]) for r in structure.cycle_core(g).collect()} == {("a", "a"), ("b", "a")}
    with pytest.raises(ValueError):
        structure.topological_levels(g)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 25
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(28)}
    g = graph(spark, [(f"n:{i:02}", "Module") for i in range(n)], [("IMPORTS", f"n:{a:02}", f"n:{b:02}") for a, b in pairs])
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {r["id"]: r["component"] for r in structure.components(g).collect()} == {f"n:{i:02}": f"n:{root(i):02}" for i in range(n)}
    down = {i: {b for a, b in pairs if a == i} for i in range(n)}
    far = {0: 0}
    level = [0]
    while level:
        nxt = sorted({b for a in level for b in down[a]} - far.keys())
        far |= {b: far[level[0]] + 1 for b in nxt}
        level = nxt
    got = walk.reach(g, lookup.find(g.nodes, id="n:00"))
    assert {int(r["id"][2:]): r["depth"] for r in got.collect()} == far
    acyclic = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    dag = graph(spark, [(f"n:{i:02}", "Module") for i in range(n)], [("IMPORTS", f"n:{a:02}", f"n:{b:02}") for a, b in acyclic])
    want = [0] * n
    for i in range(n):
        want[i] = max((want[a] + 1 for a, b in acyclic if b == i), default=0)
    assert {int(r["id"][2:]): r["level"] for r in structure.topological_levels(dag).collect()} == dict(enumerate(want))


def test_diff_fields(spark):
    cols = NODES + ", metadata string"
    a = spark.createDataFrame([("1", "t", "n", None, None, None), ("2", "t", "n", None, None, None)], cols)
    b = spark.createDataFrame([("1", "t", "m", None, "p", None), ("3", "t", "n", None, None, None)], cols)
    assert {tuple(r) for r in diff.diff_nodes(a, b).collect()} == {("1", "modified", "name,package"), ("2", "removed", ""), ("3", "added", "")}


def test_history_fixture(spark):
    commits = spark.createDataFrame(
        [("0001", "2025-01-01", "Alice", "feat: start"), ("0002", "2025-02-01", "Bob", "fix bug"), ("0003", "2026-01-01", "Alice", "refactor it"), ("0004", "2026-02-01", "Alice", "add more")],
        "hash string, authored_at string, author string, subject string",
    ).withColumn("authored_at", F.to_timestamp("authored_at"))
    rows = [("0001", "module", 20, 0), ("0001", "controller", 50, 0), ("0001", "service", 80, 0), ("0002", "service", 12, 4), ("0003", "service", 25, 20), ("0003", "repository", 40, 2), ("0004", "service", 8, 1), ("0004", "controller", 6, 2)]
    changes = spark.createDataFrame([(h, f"src/auth/{f}", a, d) for h, f, a, d in rows], "hash string, file string, additions long, deletions long")
    table = history.normalise(commits, changes)
    top = history.hotspots(table, 1).first()
    assert top["file"] == "src/auth/service"
    own = {r["file"]: r for r in history.ownership(table).collect()}["src/auth/service"]
    assert (own["owner"], own["bus_factor"]) == ("Alice", 1) and own["confidence"] > 60
    pair = {(r["a"], r["b"]): (r["n"], r["score"]) for r in history.co_changes(table).collect()}
    assert pair["src/auth/controller", "src/auth/service"] == (2, 100.0)
    shuffled = history.normalise(commits.orderBy(F.desc("hash")), changes.repartition(3))
    assert sorted(map(tuple, history.file_history(shuffled).collect())) == sorted(map(tuple, history.file_history(table).collect()))


def test_parse_log(spark):
    text = ["commit:a1\x1f2025-01-01T00:00:00Z\x1fAnn\x1ffix it", "", "3\t1\tsrc/{old => new}/f.py", "-\t-\tlogo.png", "commit:b2\x1f2025-01-02T00:00:00Z\x1fBo\x1fadd", "1\t0\ta => b"]
    lines = spark.createDataFrame([("log", i, t) for i, t in enumerate(text)], "file_name string, line_no int, line string")
    commits, changes = history.parse_log(lines)
    assert sorted(r["hash"] for r in commits.collect()) == ["a1", "b2"]
    assert sorted(map(tuple, changes.collect())) == [("a1", "logo.png", 0, 0), ("a1", "src/new/f.py", 3, 1), ("b2", "b", 1, 0)]


def test_validation(spark):
    g = graph(spark, [("a", "Route"), ("a", "Route")], [("CALLS", "a", "zz"), ("CALLS", "a", "a")])
    codes = {r["code"] for r in quality.validate(g, node_types=("Module",)).collect()}
    assert {"duplicate-node", "missing-endpoint", "self-edge", "route-without-handler", "unknown-node-type"} <= codes
    empty = graph(spark, [], [])
    assert quality.validate(empty).count() == 0


def test_merging(spark):
    rows = spark.createDataFrame([("a", None, "x", 1), ("a", "f", "y", 2)], "id string, file string, name string, n int")
    assert tuple(merge_nodes(rows, "n").select("id", "file", "name").first()) == ("a", "f", "x")
    assert tuple(last_write(rows, ["id"], "n").select("id", "file", "name").first()) == ("a", "f", "y")


def test_columns(spark):
    df = spark.createDataFrame([("abc", "XMLHttpRequest2 fooBar", "cities")], "a string, b string, c string")
    row = df.select(C.fnv1a(F.col("a")).alias("h"), C.normal_text(F.col("b")).alias("n"), C.singular(F.col("c")).alias("s"), C.half_up(F.lit(2.5), 0).alias("r")).first()
    assert row["h"] == "07aigaz"
    assert (row["n"], row["s"], row["r"]) == ("xml http request2 foo bar", "city", 3.0)


def test_steps():
    steps = [Step("c", lambda d: d["a"] + d["b"], ("a", "b")), Step("a", lambda d: 1), Step("b", lambda d: d["a"] + 1, ("a",))]
    assert levels(steps) == [["a"], ["b"], ["c"]]
    assert execute(steps)["c"] == 3
    with pytest.raises(ValueError):
        levels([Step("a", print, ("b",)), Step("b", print, ("a",))])


def test_files(spark, small, tmp_path):
    graph_files.save_tables(small, str(tmp_path / "g"))
    again = graph_files.load_tables(spark, str(tmp_path / "g"))
    assert again.nodes.count() == 9 and again.edges.count() == 5
    (tmp_path / "g.json").write_text('{"version": "1", "nodes": [{"id": "a", "type": "T", "name": "n"}], "edges": [{"id": "e", "type": "R", "from": "a", "to": "a"}], "diagnostics": []}')
    loaded, issues = graph_files.load_json(spark, str(tmp_path / "g.json"))
    assert loaded.edges.first()["dst"] == "a" and issues.count() == 0
    assert graph_files.drawing(small, "dot").count() == 14


def test_follow(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        spark.range(n * 10, n * 10 + 10).write.mode("append").parquet(src)
        ingest.follow(spark, src, "id long", dst, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(dst).count() == 20


@pytest.mark.parametrize(("mode", "depth"), [("direct", 1), ("local", 2), ("blast-radius", 5)])
def test_impact_expands(spark, mode, depth):
    """The expansion goes both ways along its relations, and the blast radius counts it."""
    kinds = ("HANDLES", "CONTAINS", "MOUNTS", "PROVIDES", "EXPOSES", "DECLARES")
    rng = random.Random(3)
    edges = sorted({(rng.choice(kinds), f"n:{rng.randrange(25):02}", f"n:{rng.randrange(25):02}") for _ in range(30)})
    g = graph(spark, [(f"n:{k:02}", "Function") for k in range(25)], edges)
    near = {}
    for kind, a, b in edges:
        if kind != "DECLARES":
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for seed in (f"n:{k:02}" for k in range(25)):
        seen = level = {seed}
        for step in range(1, depth + 1):
            level = {b for a in level for b in near.get(a, ())} - seen
            seen = seen | level
            want |= {(seed, i, step) for i in level}
    got = capabilities.run("ImpactAnalysis", g, seeds=g.nodes, mode=mode).where("side = 'expansion'").collect()
    assert {(r["seed"], r["id"], r["depth"]) for r in got} == want and len(got) == len(want)
    affected = {r["seed"]: r["affected"] for r in capabilities.run("BlastRadius", g, seeds=g.nodes, mode=mode).collect()}
    assert affected == {f"n:{k:02}": len({i for s, i, _ in want if s == f"n:{k:02}"}) for k in range(25)}


def test_capabilities(spark, small):
    assert ids(capabilities.run("FindDeadCode", small)) == ["fn:main"]
    assert len(capabilities.REGISTRY) >= 26
    assert capabilities.run("EvidencePack", small, phrase="user service").count() >= 1
    with pytest.raises(ValueError):
        capabilities.run("nothing", small)


def test_average_path_length(spark):
    rng = random.Random(9)
    edges = sorted({("CALLS", f"n:{rng.randrange(20):02}", f"n:{rng.randrange(20):02}") for _ in range(18)})
    g = graph(spark, [(f"n:{k:02}", "Service" if k == 3 else "Module") for k in range(20)], [*edges, ("DEPENDS_ON", "n:01", "n:03"), ("IMPORTS", "n:03", "n:02")])
    near = {}
    for _, a, b in [*edges, ("", "n:01", "n:03"), ("", "n:03", "n:02")]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = pairs = 0
    groups = set()
    for k in range(20):
        seen, level, step = {f"n:{k:02}"}, {f"n:{k:02}"}, 0
        while level:
            total, pairs, step = total + step * len(level), pairs + (len(level) if step else 0), step + 1
            level = {b for a in level for b in near.get(a, ())} - seen
            seen |= level
        groups.add(frozenset(seen))
    row = report.full_statistics(g).first()
    assert row["average_path_length"] == pytest.approx(total / pairs, abs=1e-4)
    assert (row["components"], row["largest_component"]) == (len(groups), max(map(len, groups)))
    assert (row["most_imported"], row["most_depended"], row["most_depended_n"]) == ("n:02", "n:03", 1)


def test_manifests(spark, tmp_path):
    texts = {
        "package.json": '{"name": "root", "scripts": {"build": "tsc"}, "dependencies": {"react": "^18"}, "devDependencies": {"vitest": "1"}}',
        "apps/web/package.json": '{"dependencies": {"react": "^18"}}',
        "apps/bad/package.json": "not json",
        "node_modules/x/package.json": '{"name": "x"}',
        "svc/requirements.txt": "flask==2.0\n# note\nnumpy>=1 ; python_version > '3'\n-r other.txt\n",
        "go.mod": "module example.com/app\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n\tgolang.org/x/net v0.1.0 // indirect\n)\n",
        "Cargo.toml": '[package]\nname = "crate"\n\n[dependencies]\nserde = "1"\ntokio = { version = "1" }\n\n[dev-dependencies]\nx = "1"\n',
        "pyproject.toml": '[project]\nname = "proj"\ndependencies = [\n  "fastapi>=0.1",\n  "pydantic[email]",\n]\n',
        ".env.example": "# c\nAPI_KEY=\nexport PORT=3000\n",
        "Dockerfile": "FROM node:20 AS build\nRUN x\nfrom alpine\n",
        "docker-compose.yml": "version: '3'\nservices:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  data:\n",
        "tsconfig.json": "{}",
        "src/main.ts": "export {}",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = manifests.read_files(spark, f"file://{tmp_path}").cache()
    assert {r["path"]: r["kind"] for r in manifests.inventory(files).collect()}["src/main.ts"] == "typescript"
    g = manifests.all_facts(files)
    nodes = {(r["type"], r["name"]) for r in g.nodes.collect()}
    want = {"Package": "root web svc example.com/app crate proj", "Script": "build", "Task": "root:build", "Container": "node:20 alpine web db", "BuildTarget": "tsconfig.json", "EnvironmentVariable": "API_KEY PORT", "Framework": "React Flask FastAPI",
            "Dependency": "react vitest flask numpy github.com/gin-gonic/gin golang.org/x/net serde tokio fastapi pydantic"}
    for kind, said in want.items():
        assert {n for t, n in nodes if t == kind} == set(said.split()), kind
    edges = {tuple(r) for r in g.edges.collect()}
    assert {("DEPENDS_ON", "package:web", "dependency:react"), ("EXECUTES", "script:package.json:build", "task:package.json:root:build"), ("PROVIDES", "dependency:react", "framework:React"), ("CONFIGURES", "configuration:.env.example", "env:PORT")} <= edges


def test_text_columns(spark):
    rows = spark.createDataFrame([("houses", "UserProfileService"), ("classes", "a_b Case"), ("bus", "x"), ("cities", ""), ("day", "authGuard")], "word string, name string")
    got = rows.select(C.singular(F.col("word")), C.plural(F.col("word")), C.compact(F.col("name")), C.kebab_case(F.col("name")), F.array_join(C.variants(F.col("name")), "|")).collect()
    assert [r[0] for r in got] == ["house", "class", "bus", "city", "day"]
    assert [r[1] for r in got] == ["houses", "classes", "bus", "cities", "daies"]
    assert got[0][2:] == ("userprofileservice", "user-profile-service", "user profile|user profile service|user-profile-service|user_profile_service|userprofile|userprofileservice")
    assert got[4][4] == "auth|auth guard|auth-guard|auth_guard|authguard"
    folded = spark.createDataFrame([("Señor Ünlü ß ﬁ Éa\u0301!",)], "t string").select(C.fold(F.col("t"))).first()[0]
    assert folded == "senorunluea"
