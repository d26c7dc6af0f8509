"""Operators on hand-built micro-graphs with exact expectations."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import changes, community, cycles, dataflow, export, lookup, metrics, roles, rules, traverse

FILES = {"auth.js": 100, "middleware.js": 101, "routes.js": 102, "utils.js": 103, "auth.test.js": 104}
SYMBOLS = [
    (1, "authenticate", "function", "auth.js", 10, 1), (2, "validateToken", "function", "auth.js", 25, 1), (3, "authMiddleware", "function", "middleware.js", 5, 1),
    (4, "handleRoute", "function", "routes.js", 10, 0), (5, "formatResponse", "function", "utils.js", 1, 1), (6, "preAuthenticate", "function", "utils.js", 10, 1),
    (7, "testAuthenticate", "function", "auth.test.js", 5, 0), (8, "API_VERSION", "constant", "middleware.js", 1, 1), (9, "UserService", "class", "auth.js", 40, 0),
    (10, "UserService.getUser", "method", "auth.js", 42, 0),
]
CALLS = [(3, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (4, 5, 1.0), (1, 2, 1.0), (4, 6, 1.0), (7, 1, 1.0), (5, 2, 0.3)]
NODE = "id long, name string, kind string, file string, line int, exported int"
EDGE = "source_id long, target_id long, kind string, confidence double, dynamic int"


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame([(i, f, "file", f, 0, 0) for f, i in FILES.items()] + SYMBOLS, NODE)
    n = n.withColumns({"end_line": F.lit(None).cast("int"), "parent_id": F.when(F.col("id") == 10, 9).cast("long"), "role": F.lit(None).cast("string")})
    rows = [(a, b, "calls", c, 0) for a, b, c in CALLS] + [(101, 100, "imports", 1.0, 0), (102, 101, "imports", 1.0, 0), (102, 103, "imports", 1.0, 0), (104, 100, "imports", 1.0, 0)]
    return n.cache(), spark.createDataFrame(rows, EDGE).cache()


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_callers_and_callees(graph):
    n, e = graph
    assert pairs(lookup.neighbours(e, n, False).filter("id = 2"), "name") == [("authMiddleware",), ("authenticate",), ("formatResponse",)]
    assert pairs(lookup.neighbour_names(e, n, True).filter("id = 4"), F.array_join("names", ",")) == [("authMiddleware,formatResponse,preAuthenticate",)]


def test_parallel_edges_stay_for_callers_only(spark, graph):
    n, e = graph
    twice = e.unionByName(e.filter("source_id = 3 AND target_id = 1"))
    assert lookup.neighbours(twice, n, False).filter("id = 1").count() == 3
    assert lookup.neighbours(twice, n, False, distinct=True).filter("id = 1").count() == 2
    assert pairs(lookup.fan_in(twice).filter("id = 1"), "fan_in") == [(3,)]
    assert pairs(metrics.degree(twice.filter("kind = 'calls'")).filter("id = 1"), "fan_in") == [(2,)]


def test_symbol_relevance(graph):
    n, e = graph
    got = {r.name: r.relevance for r in lookup.find_symbols(n, e, "authenticate").collect()}
    assert got["authenticate"] == pytest.approx(100 + 5 * 1.58496, abs=1e-3) and got["testAuthenticate"] == 10


def test_impact_of_validate_token(graph):
    n, e = graph
    got = pairs(traverse.impact(e.filter("kind = 'calls'"), n.filter("id = 2").select("id"), 3), "depth", "node")
    assert got == [(1, 1), (1, 3), (1, 5), (2, 4), (2, 7)]


def test_implementors_join_the_same_frontier(spark):
    kinds = spark.createDataFrame([(1, "interface"), (2, "class"), (3, "function")], "id long, kind string")
    calls = spark.createDataFrame([(3, 2)], "source_id long, target_id long")
    implements = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    got = traverse.impact(calls, spark.createDataFrame([(1,)], "id long"), 3, implements, kinds)
    assert pairs(got, "node", "depth") == [(2, 1), (3, 2)]


def test_shortest_path(graph):
    n, e = graph
    calls = lookup.simple_graph(e)
    assert pairs(traverse.shortest_path(calls, 4, 2), "step", "node")[0] == (0, 4)
    assert traverse.shortest_path(calls, 4, 2).count() == 3
    assert traverse.shortest_path(calls, 2, 4).count() == 0
    assert pairs(traverse.shortest_path(calls, 4, 4), "step", "node") == [(0, 4)]


def test_flow_marks_cross_edges_as_back(graph):
    n, e = graph
    steps, leaves, back = traverse.flow(lookup.simple_graph(e), n.filter("id = 4").select(F.col("id").alias("root"), F.col("id").alias("node")), 4)
    assert pairs(steps.filter("depth = 1"), "node") == [(3,), (5,), (6,)]
    assert (2,) in pairs(leaves, "node") and pairs(back, "source_id", "target_id") == [(1, 2)]


def test_cycles(spark):
    e = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string, speculative boolean")
    assert pairs(cycles.cycles(e([("a", "b", False), ("b", "a", False)])), "size") == [(2,)]
    assert pairs(cycles.cycles(e([("a", "b", False), ("b", "c", False), ("c", "a", False), ("c", "d", False)])), F.array_join("members", "")) == [("abc",)]
    assert cycles.cycles(e([("a", "b", False), ("b", "c", False)])).count() == 0
    got = cycles.classify_cycles(e([("a", "b", False), ("b", "a", True), ("x", "y", False), ("y", "x", False), ("y", "x", True)]))
    assert pairs(got, F.array_join("members", ""), "speculative") == [("ab", True), ("xy", False)]


def test_distributed_components_agree_with_tarjan(spark):
    rows = [(i, (i * 7 + 3) % 40) for i in range(40)] + [(i, (i + 1) % 13) for i in range(13)] + [(50, 51), (51, 50), (51, 1)]
    e = spark.createDataFrame(rows, "source_id long, target_id long")
    assert pairs(cycles.components(e, driver_edges=0), "node", "component") == pairs(cycles.components(e), "node", "component")


def test_connected(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "source_id long, target_id long")
    assert pairs(cycles.connected(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_two_cliques_are_two_communities(spark, limit):
    rows = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a != b] + [(3, 4), (4, 3)]
    e = spark.createDataFrame(rows, "source_id long, target_id long")
    found = community.communities(e, driver_edges=limit)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert community.modularity(community.undirected_pairs(e), found).first()[0] == pytest.approx(2 * (12 / 26 - 0.25), abs=1e-9)


def test_generator_is_mulberry():
    step = community.mulberry(42)
    assert [round(step(), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]


def test_roles(graph):
    n, e = graph
    got = {r.name: r.role for r in roles.classify(roles.inputs(n, e)).collect()}
    assert got["validateToken"] == "core" and got["authMiddleware"] == "utility" and got["UserService"] == "dead-unresolved"
    # Nothing calls it, and its own calls don't make it an active sibling of itself.
    assert got["handleRoute"] == "dead-unresolved"
    live = {r.name: r.role for r in roles.classify(roles.inputs(n, e), e).collect()}
    assert live["validateToken"] == "core"


def test_risk_of_one_row_is_zero(spark):
    one = spark.createDataFrame([(1, 5, 7, 3, 50.0, "core")], "id long, fan_in long, cognitive int, churn long, mi double, role string")
    r = metrics.risk(one).first()
    assert (r.norm_fan_in, r.norm_cognitive, r.norm_churn, r.norm_mi, r.role_weight) == (0, 0, 0, 1.0, 1.0) and r.risk_score == 0.25


def test_directory_cohesion(spark):
    p = spark.createDataFrame([("src/utils.js", "src/math.js"), ("lib/format.js", "src/math.js"), ("lib/helpers.js", "lib/format.js"), ("index.js", "src/utils.js"), ("index.js", "lib/helpers.js")], "source_file string, target_file string")
    got = {r.directory: (r.intra, r.fan_in, r.fan_out, round(r.cohesion, 4)) for r in metrics.directory_edges(p).collect()}
    assert got == {"src": (1, 2, 0, 0.3333), "lib": (1, 1, 1, 0.3333)}


def test_co_changes_count_pairs_once_and_files_as_often_as_named(spark):
    c = spark.createDataFrame([(f"s{i}", 100 + i, ["a", "b", "b"]) for i in range(3)] + [("t", 50, ["a", "c"])], "sha string, epoch long, files array<string>")
    r = changes.co_changes(c).collect()
    assert [(x.file_a, x.file_b, x.commit_count, x.last_commit_epoch, round(x.jaccard, 6)) for x in r] == [("a", "b", 3, 102, round(3 / 7, 6))]
    known = spark.createDataFrame([("a", "b", 2, 900)], "file_a string, file_b string, commit_count long, last_commit_epoch long")
    assert pairs(changes.upsert_pairs(known, changes.pair_counts(c)), "file_a", "file_b", "commit_count", "last_commit_epoch")[0] == ("a", "b", 5, 900)


def test_symbol_diff(spark):
    s = "name string, kind string, line int"
    got = changes.diff_symbols(spark.createDataFrame([("a", "function", 1), ("b", "function", 2), ("c", "function", 3)], s), spark.createDataFrame([("a", "function", 1), ("b", "function", 9), ("d", "function", 3)], s))
    assert pairs(got, "name", "change") == [("b", "modified"), ("c", "removed"), ("d", "added")]


def test_owner_rules_take_the_last_match(spark):
    files = spark.createDataFrame([("docs/a.md",), ("src/api/x.py",), ("src/y.js",), ("z.js",)], "file string")
    owned = rules.file_owners(files, rules.parse_codeowners("*.js @js\n/src/ @src # all\ndocs/* @d @e\n# none\n"))
    assert pairs(owned, "file", F.array_join("owners", ",")) == [("docs/a.md", "@d,@e"), ("src/api/x.py", "@src"), ("src/y.js", "@src"), ("z.js", "@js")]


def test_boundaries(spark):
    p = spark.createDataFrame([("ui/a.js", "data/b.js"), ("data/b.js", "ui/a.js"), ("x.js", "ui/a.js")], "source_file string, target_file string")
    config = {"modules": {"ui": {"match": "ui/**", "layer": "presentation"}, "data": {"match": "data/**", "layer": "data"}}, "preset": "layered"}
    assert pairs(rules.boundary_violations(p, config), "from_module", "to_module") == [("data", "ui")]
    with pytest.raises(ValueError):
        rules.boundary_violations(p, {"modules": {}})


def test_checks(spark, graph):
    n, e = graph
    hunks = spark.createDataFrame([("auth.js", 24, 26)], "file string, start int, stop int")
    assert pairs(lookup.affected(n.filter("kind <> 'file'"), hunks), "name") == [("authenticate",), ("validateToken",)]
    got = {r.predicate: r.violations for r in rules.check_all(spark, n.filter("kind <> 'file'"), e, hunks, spark.createDataFrame([("utils.js",)], "file string"), blast=4).collect()}
    assert got == {"cycles": 0, "blast-radius": 1, "signatures": 1, "deleted-exports": 2}
    assert rules.call_shape_changed("a(b)", "a(c)") is False and rules.call_shape_changed("a(b)", "d(b)") is True


def test_dataflow(spark):
    rows = [(1, 2, "flows_to", 0, "input", 12, 1.0), (1, 3, "flows_to", 0, "result", 14, 0.9), (4, 1, "flows_to", 0, "raw", 3, 1.0), (2, 1, "returns", None, None, 12, 1.0), (5, 4, "returns", None, None, 2, 1.0)]
    facts = spark.createDataFrame(rows, "source_id long, target_id long, kind string, param_index int, expression string, line int, confidence double")
    names = spark.createDataFrame([(1, "processData"), (2, "transform"), (3, "format"), (4, "pipeline"), (5, "loadData")], "id long, name string")
    assert pairs(dataflow.dataflow(facts, names, 1), "direction", "kind", "other") == [("in", "flows_to", "pipeline"), ("in", "returns", "transform"), ("out", "flows_to", "format"), ("out", "flows_to", "transform")]
    assert pairs(dataflow.dataflow_path(facts, 4, 3), "node") == [(1,), (3,), (4,)]
    v = spark.createDataFrame([(10, 2, "param", "x", 0, 1), (11, 2, "return", "r", None, 2), (12, 1, "local", "y", None, 3), (13, 1, "local", "z", None, 4)], "id long, func_id long, kind string, name string, param_index int, line int")
    s = dataflow.summaries(v, spark.createDataFrame([(10, 11, "def_use")], "source long, target long, kind string"))
    assert pairs(s, "func_id", "flows_to_return", "is_mutated") == [(2, True, False)]
    got = dataflow.stitch(spark.createDataFrame([(1, 2, 0, 12)], "caller long, callee long, param_index int, vertex long"), spark.createDataFrame([(1, 2, 13)], "caller long, callee long, vertex long"), v, s)
    assert pairs(got, "source", "target", "kind") == [(11, 13, "return_out"), (12, 10, "arg_in")]


def test_barrels(spark):
    re_ = spark.createDataFrame([("index.js", "*", "mid.js", None), ("mid.js", "Public", "impl.js", "inner")], "file string, name string, source_file string, source_name string")
    defs = spark.createDataFrame([("impl.js", "inner"), ("mid.js", "other")], "file string, name string")
    want = spark.createDataFrame([("index.js", "Public"), ("index.js", "other"), ("index.js", "nothing")], "file string, name string")
    assert pairs(traverse.resolve_barrels(re_, defs, want), "name", "def_file", "def_name") == [("Public", "impl.js", "inner"), ("other", "mid.js", "other")]


def test_scalars(spark):
    f = spark.createDataFrame([("src/__tests__/a.js",), ("src/FooTest.java",), ("tests/x.py",), ("src/latest.py",), ("test_a.py",)], "p string")
    assert [r[0] for r in f.select(S.is_test_path(F.col("p"))).collect()] == [True, True, True, False, True]
    assert [r[0] for r in f.select(S.is_test_path_like(F.col("p"))).collect()] == [True, False, True, False, True]
    g = spark.createDataFrame([("a/b/c.js", "a/b/d.js"), ("a/b/c.js", "a/d.js"), ("a/b/c.js", "a/e/d.js"), ("a/c.js", "x/y/z.js"), ("a/c.js", "a/c.py")], "a string, b string")
    assert [r[0] for r in g.select(S.confidence(F.col("a"), F.col("b")).cast("double")).collect()] == [0.7, 0.6, 0.5, 0.3, 0.0]
    import re

    assert re.match(S.glob_regex("src/**/*.js"), "src/a.js") and re.match(S.glob_regex("src/**/*.js"), "src/a/b.js") and not re.match(S.glob_regex("src/*.js"), "src/a/b.js")


def test_exports(spark, graph):
    n, e = graph
    assert export.dot(lookup.file_edges(e, n), "source_file", "target_file").count() == 4
    assert export.graphson(n, e).count() == n.count() and export.graphml(n, e).count() == n.count() + e.count()
    assert export.aliases(["a/x.js", "b/x.js", "c/y.js"]) == {"a/x.js": "a/x.js", "b/x.js": "b/x.js", "c/y.js": "c/y.js"} and export.aliases(["a/x.js", "b/y.js"])["a/x.js"] == "x.js"


def test_reports(spark, graph):
    from graphloom.operators import reports

    n, e = graph
    hunks = spark.createDataFrame([("auth.js", 24, 30)], "file string, start int, stop int")
    got = pairs(reports.diff_impact(n.filter("kind <> 'file'"), e, hunks), "relation", "name")
    assert ("changed", "validateToken") in got and ("affected", "handleRoute") in got and ("file", "routes.js") in got
    row = {r.name: r for r in reports.context(n, e, "authenticate").collect()}["authenticate"]
    assert row.callees == ["validateToken"] and row.callers == ["authMiddleware"] and row.tests == ["testAuthenticate"]
    after = n.filter("id <> 6").unionByName(n.filter("id = 6").withColumns({"name": F.lit("fresh"), "id": F.lit(60).cast("long")}))
    got = pairs(reports.branch_compare((n, e), (after, e.filter("target_id <> 6"))), "change", "name", "impact")
    assert got == [("added", "fresh", 0), ("changed", "handleRoute", 0), ("removed", "preAuthenticate", 1)]
    health = spark.createDataFrame([(1, 20, 3, 2, 40.0)], "node_id long, cognitive int, cyclomatic int, max_nesting int, maintainability_index double")
    assert pairs(reports.audit(n, e, health, "authenticate", {"cognitive": 15}).filter("id = 1"), "impact", "exceeds") == [(3, "cognitive")]
    df, errors = reports.batch(lambda t: reports.file_deps(n, e, t) if t != "bad" else 1 / 0, ["auth.js,utils.js", "bad", "auth.js"])
    assert sorted({r.target for r in df.collect()}) == ["auth.js", "utils.js"] and list(errors) == ["bad"]


def test_points_to(spark):
    from graphloom.operators.points_to import points_to, resolve

    b = spark.createDataFrame([("f.js", "cb", "handler"), ("f.js", "alias", "cb"), ("f.js", "loop", "alias"), ("f.js", "cb", "loop"), ("g.js", "cb", "handler")], "file string, lhs string, rhs string")
    found = points_to(b, spark.createDataFrame([("f.js", "handler"), ("f.js", "other")], "file string, name string"))
    assert pairs(found, "file", "name", "target") == [("f.js", "alias", "handler"), ("f.js", "cb", "handler"), ("f.js", "loop", "handler")]
    assert resolve(spark.createDataFrame([("f.js", "alias", 3)], "file string, name string, line int"), found).count() == 1
