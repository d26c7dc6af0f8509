"""Linking against expected edges, and a rebuild after a change against a full build."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import community, details, export, roles, search
from graphloom.plans import link
from graphloom.plans.build import build
from graphloom.sources.parse import module_imports, parse, parse_file, token_complexity
from graphloom.storage import GraphStore
from graphloom.streaming import watch

FILES = "file string, content binary, hash string, mtime long, size long"
PROGRAM = {
    "app/main.ts": "import { helper as h, type Shape } from './lib';\nimport Widget from './lib/widget';\nimport * as util from './util';\n\nexport function start(x) {\n  const w = new Widget();\n  w.draw();\n  util.trim(x);\n  return h(x);\n}\nconst again = start;\nexport function loop() {\n  again();\n}\n",
    "app/lib/index.ts": "export { assist as helper } from './inner';\nexport * from './shapes';\n",
    "app/lib/inner.ts": "export function assist(a) {\n  return nearby(a);\n}\n",
    "app/lib/shapes.ts": "export interface Shape {\n}\n",
    "app/lib/widget.ts": "import { Base } from './base';\nexport default class Widget extends Base {\n  constructor() {\n    super();\n  }\n  draw() {\n    this.paint();\n    this.clean();\n  }\n  paint() {\n    return 1;\n  }\n}\n",
    "app/lib/base.ts": "export class Base {\n  clean() {\n    return 2;\n  }\n}\n",
    "app/util.ts": "export function trim(s) {\n  return s;\n}\n",
    "app/lib/deep/near.ts": "export function nearby(a) {\n  return a;\n}\n",
    "far/away/off/near.ts": "export function nearby(a) {\n  return a;\n}\n",
    "py/pkg/__init__.py": "from .core import make as build\n",
    "py/pkg/core.py": "class Thing:\n    def __init__(self):\n        self.n = 0\n\n    def go(self):\n        return self.stop()\n\n    def stop(self):\n        return 0\n\n\ndef make() -> Thing:\n    return Thing()\n",
    "py/run.py": "from py.pkg import build\n\n\ndef main():\n    t = build()\n    return t.go()\n",
}
CALLS = {
    ("start", "Widget"), ("start", "Widget.constructor"), ("start", "Widget.draw"), ("start", "trim"), ("start", "assist"), ("loop", "start"), ("assist", "nearby"),
    ("Widget.draw", "Widget.paint"), ("Widget.draw", "Base.clean"), ("main", "make"), ("main", "Thing.go"), ("Thing.go", "Thing.stop"), ("make", "Thing"), ("make", "Thing.__init__"),
}


def tree(spark, program: dict):
    return spark.createDataFrame([(f, bytearray(t.encode()), str(hash(t)), 1, len(t)) for f, t in program.items()], FILES)


def named(tables) -> set:
    names = {r.id: (r.name, r.file) for r in tables["nodes"].collect()}
    return {(*names[r.source_id], *names[r.target_id], r.kind, round(r.confidence, 6), r.technique) for r in tables["edges"].collect()}


def test_calls_by_every_tier(spark):
    files = tree(spark, PROGRAM)
    tables = build(files, parse(files))
    edges = named(tables)
    calls = {(a, b) for a, _, b, _, kind, _, _ in edges if kind == "calls"}
    assert calls == CALLS
    found = {(a, f, b, g, kind, c) for a, f, b, g, kind, c, _ in edges}
    assert ("assist", "app/lib/inner.ts", "nearby", "app/lib/deep/near.ts", "calls", 0.6) in found  # the nearer of two
    assert ("loop", "start", "points-to") in {(a, b, t) for a, _, b, _, kind, _, t in edges if kind == "calls"}
    main = {(b, kind, c) for a, _, b, _, kind, c in found if a == "app/main.ts"}
    assert {("app/lib/index.ts", "imports", 1.0), ("app/lib/inner.ts", "imports", 0.9), ("app/lib/shapes.ts", "imports-type", 0.9), ("Shape", "imports-type", 1.0)} <= main
    barrel = {(b, kind) for a, _, b, _, kind, _ in found if a == "app/lib/index.ts"}
    assert barrel == {("app/lib/inner.ts", "reexports"), ("assist", "reexports"), ("app/lib/shapes.ts", "reexports"), ("app/lib/shapes.ts", "reexports-wildcard")}
    assert ("main", "py/run.py", "Thing", "py/pkg/core.py", "receiver", 1.0) in found and ("Widget", "app/lib/widget.ts", "Base", "app/lib/base.ts", "extends", 1.0) in found
    pairs = spark.createDataFrame(sorted(CALLS), "source string, target string")
    both = link.resolution_quality(spark.createDataFrame(sorted(calls | {("a", "b")}), "source string, target string"), pairs).first()
    assert (both.precision, both.recall) == (pytest.approx(len(CALLS) / (len(CALLS) + 1)), 1.0)
    assert [r.file for r in link.barrel_files(parse(files)).collect()] == ["app/lib/index.ts"]
    assert {"draw", "trim", "go", "clean"} <= {r.name for r in link.invoked_properties(parse(files)).collect()}


def test_aliases_packages_and_rust(spark):
    files = tree(spark, {"src/a.ts": "import { x } from '@/lib/x';\nimport { y } from 'shared';\n", "src/lib/x.ts": "export function x() {\n}\n", "packages/shared/entry.ts": "export function y() {\n}\n", "src/main.rs": "use crate::net::http;\nuse crate::net::http::Client;\n", "src/net/http.rs": "pub struct Client {\n}\n"})
    found = link.resolve_imports(parse(files), files.select("file"), {"@/": "src/"}, {"shared": "packages/shared/entry.ts"})
    assert {(r.source, r.resolved) for r in found.collect()} == {("@/lib/x", "src/lib/x.ts"), ("shared", "packages/shared/entry.ts"), ("crate::net::http", "src/net/http.rs"), ("crate::net::http::Client", "src/net/http.rs")}


def test_module_syntax():
    text = "import d, { a as b, type T } from './x';\nimport * as ns from \"y\"; import 'z';\nexport { a as c } from './x'; export * from './w';\nconst { m, n: k } = require('r');\nconst p = await import('p');\nexport const s = 'str';\n"
    assert module_imports(text) == [
        ("./x", "a", "b", 1, "named"), ("./x", "T", None, 1, "type"), ("./x", "default", "d", 1, "default"), ("y", None, "ns", 2, "namespace"), ("z", None, None, 2, "side-effect"),
        ("./x", "a", "c", 3, "reexport"), ("./w", None, None, 3, "reexport-all"), ("r", "m", None, 4, "named"), ("r", "n", "k", 4, "named"), ("p", None, "p", 5, "dynamic"),
    ]
    assert token_complexity(" if (a && b || c) { for (;;) { x(); } } else if (d) { y(); } else { z } // if\n")[:3] == (7, 6, 2)
    called = lambda file, text: {c[:3] for c in parse_file(file, text.encode())["calls"]}
    assert ("f", "go", "t") in called("a.js", "function f(t) {\n  t['go'](1);\n}\n") and ("f", "go", "t") in called("a.py", "def f(t):\n    getattr(t, 'go')(1)\n")
    row = dict(zip(("name", "kind", "line", "end", "parent", "exported", "cognitive", "cyclomatic", "nesting"), parse_file("a.go", b"package a\nfunc Run(x int) int {\n  for x > 1 {\n    if x == 3 { x-- }\n  }\n  return x\n}\n")["defs"][0]))
    assert (row["cognitive"], row["cyclomatic"], row["nesting"]) == (3, 3, 2)


EDITS = [
    {"app/util.ts": "\n\nexport function trim(s) {\n  return s + extra(s);\n}\nexport function extra(s) {\n  return s;\n}\n", "app/lib/base.ts": "export class Base {\n  tidy() {\n    return 2;\n  }\n}\n"},
    {"app/lib/index.ts": "export { other as helper } from './inner';\n", "app/lib/inner.ts": "export function other(a) {\n  return nearby(a);\n}\n", "app/lib/deep/near.ts": None, "new.py": "from py.run import main\n\n\nmain()\n", "py/pkg/core.py": "class Thing:\n    def go(self):\n        return 1\n\n\ndef make():\n    return 3\n"},
]


def test_a_rebuild_is_a_full_build(spark, tmp_path):
    store, sources = GraphStore(spark, str(tmp_path / "store")), str(tmp_path / "sources")
    now = dict(PROGRAM)
    watch.apply_batch(store, tree(spark, now), 0, sources)
    parsed = []
    real = watch.parse
    watch.parse = lambda files: parsed.append(sorted(r.file for r in files.select("file").collect())) or real(files)
    try:
        for i, edit in enumerate(EDITS, 1):
            batch = tree(spark, {f: t or "" for f, t in edit.items()})
            gone = [f for f, t in edit.items() if t is None]
            watch.apply_batch(store, batch.withColumn("content", F.when(~F.col("file").isin(*gone, ""), F.col("content"))), i, sources)
            now = {f: t for f, t in (now | edit).items() if t is not None}
            files = tree(spark, now)
            whole = build(files, real(files))
            kept = {t: store.read(t) for t in ("nodes", "edges", "function_complexity", "dataflow", "cfg_blocks", "cfg_edges", "ast_nodes", "file_hashes")}
            assert named(kept) == named(whole), i
            for t in kept:
                columns = sorted(whole[t].columns)
                assert sorted(map(repr, kept[t].select(columns).collect())) == sorted(map(repr, whole[t].select(columns).collect())), t
            assert parsed.pop() == sorted(f for f, t in edit.items() if t is not None)
        version = store.manifest()
        watch.apply_batch(store, tree(spark, {"app/util.ts": now["app/util.ts"]}), 9, sources)  # nothing new
        assert not parsed and store.manifest()["tables"] == version["tables"] and store.state()["last_batch"] == 9
        watch.apply_batch(store, tree(spark, {"app/util.ts": ""}), 9, sources)  # a replay
        assert {r.drift for r in watch.drift(store, files.filter("file <> 'new.py'")).collect()} == {"removed"}
        assert watch.poll(store, files.filter("file <> 'new.py'"), sources) and not watch.poll(store, files.filter("file <> 'new.py'"), sources)
        assert watch.expire_events(store, sources, 2) > 0
        for stamp in (1, 2):
            watch.append_journal(store, spark.createDataFrame([(f"j{stamp}", stamp == 2)], "file string, removed boolean"), stamp)
        assert [tuple(r) for r in watch.read_journal(store, 1).collect()] == [("j2", True, 2)]
    finally:
        watch.parse = real


NODES = "id long, name string, kind string, file string, line int, exported int, entrypoint int, entrypoint_role int"
EDGES = "source_id long, target_id long, kind string, confidence double, dynamic int, technique string, dynamic_kind string"


def test_roles_of_members_barrels_and_entrypoints(spark):
    rows = [
        (1, "a.ts", "file", "a.ts"), (2, "index.ts", "file", "index.ts"), (3, "b.ts", "file", "b.ts"), (10, "Shape", "interface", "b.ts"), (11, "Shape.area", "method", "b.ts"), (12, "Shape.side", "property", "b.ts"),
        (13, "Box", "class", "b.ts"), (14, "Box.size", "property", "b.ts"), (15, "f.x", "parameter", "b.ts"), (16, "shown", "function", "b.ts"), (17, "alone", "function", "c.ts"), (18, "main", "function", "a.ts"),
        (19, "Circle.area", "method", "b.ts"), (20, "helper", "function", "b.ts"), (21, "deep", "function", "d.ts"), (22, "dead", "function", "d.ts"), (23, "c.test.ts", "file", "c.test.ts"), (24, "t", "function", "c.test.ts"),
    ]
    nodes = spark.createDataFrame([(*r, 1, 0, int(r[0] == 18), int(r[0] == 18)) for r in rows], NODES)
    edge = lambda a, b, k="calls": (a, b, k, 1.0, 0, None, None)
    edges = spark.createDataFrame([edge(1, 2, "imports"), edge(2, 3, "reexports"), edge(1, 18), edge(18, 20), edge(19, 20), edge(22, 21), edge(24, 22)], EDGES)
    assert {r.id for r in roles.production_reachable(nodes, edges).collect()} == {2, 3}
    loose, sure = roles.surface(nodes, edges)
    assert {r.id for r in loose.collect()} == {10, 13, 16, 20} and sure.count() == 0
    got = {r.id: r.role for r in roles.classify(roles.inputs(nodes, edges), edges).collect()}
    assert set(got) == {10, 11, 12, 13, 16, 17, 18, 19, 20, 21, 22, 24}  # no fields, no parameters
    assert got[11] == got[12] == "leaf" and got[13] == got[10] == "leaf" and got[16] == "entry" and got[17] == "dead-unresolved" and got[18] == "entry"
    assert got[20] in ("core", "utility") and got[19] == "leaf" and got[22] == "dead-unresolved" and got[21] == "dead-unresolved"
    # A full run's medians give the same to the neighbourhood of a change, but for reachability.
    medians = roles.fan_medians(roles.inputs(nodes, edges))
    part = {r.id: r.role for r in roles.incremental(nodes, edges, spark.createDataFrame([("a.ts",)], "file string"), medians).collect()}
    whole = {r.id: r.role for r in roles.classify(roles.inputs(nodes, edges)).collect()}
    assert part and all(whole[i] == r for i, r in part.items()) and 17 not in part


def test_communities_that_fall_apart_are_split():
    assert community.split_disconnected([(1, 2, 1.0), (3, 4, 1.0), (2, 3, 1.0)], {1: 1, 2: 1, 3: 9, 4: 9}) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert community.split_disconnected([(1, 2, 1.0), (3, 4, 1.0), (2, 5, 1.0), (3, 5, 1.0)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    ring = [(i, (i + 1) % 6, 1.0) for i in range(6)] + [(10 + i, 10 + (i + 1) % 6, 1.0) for i in range(6)] + [(0, 10, 0.1)]
    assert len(set(community.leiden(ring, gamma=0.05, quality="cpm").values())) == 2
    # A gain is what the quality grows by, up to its scale.
    m, g = 3.0, community.modularity_gain
    q = lambda inner, degrees: sum(inner) / m - sum((x / (2 * m)) ** 2 for x in degrees)
    assert (g(1.0, 2.0, 1.0, m)) / m == pytest.approx(q([1.0], [3.0, 3.0]) - q([0.0], [1.0, 2.0, 3.0]))
    assert community.cpm_gain(2.0, 1, 3, 0.5) == 0.5 and community.directed_modularity_gain(1, 1, 2, 2, 3, 3, 6.0) == 0.0


def test_details(spark):
    files = spark.createDataFrame([("a.ts", bytearray(b"// Adds two.\nexport function add(a, b): number {\n}\n/**\n * Takes away.\n * @x\n */\nfunction take(a) {\n}\n"), "h")], "file string, content binary, hash string")
    nodes = spark.createDataFrame([(1, "add", "function", "a.ts", 2, 3, 1, "s", "add"), (2, "take", "function", "a.ts", 8, 9, 0, None, "take"), (3, "a.ts", "file", "a.ts", 0, None, 0, None, None)], "id long, name string, kind string, file string, line int, end_line int, exported int, scope string, qualified_name string")
    assert {r.id: r.summary for r in details.summaries(nodes, files).collect()} == {1: "Adds two.", 2: "Takes away."}
    assert {(r.id, r.params, r.return_type) for r in details.signatures(nodes, files).collect()} == {(1, "a, b", "number"), (2, "a", None)}
    assert details.by_scope(nodes, "s").count() == 1 and details.by_scope(nodes, "s", "class").count() == 0 and details.by_qualified_name(nodes, "take", ("A.T",)).count() == 1
    assert details.file_nodes(nodes, "A.").count() == 1 and details.line_counts(nodes, spark.createDataFrame([(1, 9)], "node_id long, line_count int")).first().line_count == 9
    assert [tuple(r) for r in details.file_hashes_of(spark.createDataFrame([("a.ts",), ("z",)], "file string"), files).orderBy("file").collect()] == [("a.ts", "h"), ("z", None)]
    assert [r.file for r in details.stale_files(nodes, files, spark.createDataFrame([("b.ts",)], "file string")).collect()] == ["a.ts"]
    flows = spark.createDataFrame([(1, 2, "flows_to", i, f"e{i}") for i in range(5)] + [(2, 1, "returns", None, "r")], "source_id long, target_id long, kind string, param_index int, expression string")
    seen = details.annotated_messages(spark.createDataFrame([(1, 2), (2, 1)], "source_id long, target_id long"), flows)
    assert {(r.source_id, tuple(r.passed), r.returned) for r in seen.collect()} == {(1, ("e0", "e1", "e2"), True), (2, (), False)}
    vectors, rows, meta = details.embedding_rows(details.summaries(nodes, files).select("id", F.col("summary").alias("text")), "hash-64")
    assert rows.count() == 2 and details.prepared_search(vectors, nodes, meta, "hash-64", "function", globs=("*.ts",)).count() == 2
    with pytest.raises(ValueError):
        details.prepared_search(vectors, nodes, meta, "other")
    assert {r.id: r.comment for r in details.leading_comments(nodes, files).collect()} == {1: "Adds two.", 2: "Takes away. @x"}
    diff = spark.createDataFrame([("added", "function", "a.ts", "add"), ("removed", "class", "b.ts", "B")], "change string, kind string, file string, name string")
    text = "\n".join(r.line for r in details.branch_mermaid(diff).orderBy("at").collect())
    assert text.startswith("flowchart TB\n    subgraph added[\"Added\"]\n        n") and text.count("    end") == 2 and "function add" in text
    levels = spark.createDataFrame([(1, 1, 0, None), (1, 2, 1, 1)], "root long, node long, depth int, parent long")
    drawn = [r.line for r in details.impact_mermaid(nodes.filter("id = 1"), levels, nodes).orderBy("at").collect()]
    page = export.html_page(nodes, spark.createDataFrame([(1, 2)], "source_id long, target_id long"))
    assert page.startswith("<!DOCTYPE html>") and '"name": "add"' in page and "[[1, 2]]" in page
    hits = search.keyword_hits(nodes, details.summaries(nodes, files).select("id", F.col("summary").alias("text")), "takes away", 5, kind="function")
    assert [r.id for r in hits.collect()] == [2] and search.split_queries("a; b;;") == ["a", "b"]
    assert drawn[0] == "flowchart TB" and "    n1 --> n2" in drawn and drawn.count("    end") == 2
