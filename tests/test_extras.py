"""Derived graphs, advisories, texts, configuration."""

from pyspark.sql import functions as F

from graphloom.operators import extras
from graphloom.sources import config


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_structure_and_temporal_graphs(spark):
    f = spark.createDataFrame([("a/b/x.js",), ("a/y.js",), ("z.js",)], "file string")
    assert rows(extras.structure_graph(f)) == [("a", "a/b"), ("a", "a/y.js"), ("a/b", "a/b/x.js")]
    p = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.1)], "file_a string, file_b string, jaccard double")
    assert rows(extras.temporal_graph(p)) == [("a", "b", 0.5)]


def test_advisories(spark):
    n = spark.createDataFrame([(1, "f", "function", "gone.js", 3, 1), (2, "g", "function", "here.js", 1, 0), (3, "h", "function", "also.js", 1, 0)], "id long, name string, kind string, file string, line int, exported int")
    e = spark.createDataFrame([(2, 1, "calls"), (3, 1, "calls")], "source_id long, target_id long, kind string")
    one = lambda *x: spark.createDataFrame([(f,) for f in x], "file string")
    kept = extras.record_advisories(n, e, one("gone.js"), 77)
    assert [(r.name, r.consumers) for r in extras.advisories(kept, one("also.js")).collect()] == [("f", ["here.js:g"])]
    assert extras.clear_advisories(kept, one("gone.js")).count() == 0


def test_texts_and_entry_points(spark):
    n = spark.createDataFrame([(1, "parseFile", "function", "a.py", 1, 2), (2, "run", "function", "app/cli.py", 1, 1)], "id long, name string, kind string, file string, line int, end_line int")
    e = spark.createDataFrame([(2, 1, "calls")], "source_id long, target_id long, kind string")
    assert dict(rows(extras.structured_text(n, e)))[1] == "function parse File\nfile: a.py\ncalled by: run"
    files = spark.createDataFrame([("a.py", bytearray(b"def parseFile():\n    pass\nx = 1"))], "file string, content binary")
    assert dict(rows(extras.source_text(n, files)))[1].endswith("def parseFile():\n    pass")
    scripts = extras.pyproject_scripts('[project.scripts]\ngo = "app.cli:run"\n')
    assert rows(extras.mark_entrypoints(n, scripts).filter("entrypoint").select("name")) == [("run",)]
    assert [r.id for r in extras.stream(n, 1, 1, ["id"])] == [2]
    c = spark.createDataFrame([(1, 20, 50.0)], "node_id long, cognitive int, maintainability_index double")
    assert rows(extras.enriched(n, e, c).filter(F.size("flags") > 0).select("name")) == [("parseFile",)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"query": {"depth": 9}, "include": ["src/**"]}')
    got = config.load(str(tmp_path / "c.json"))
    assert got["query"] == {"depth": 9, "limit": 50} and got["include"] == ["src/**"] and config.load()["include"] == []
    assert config.path_aliases('{// c\n"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./*"], "lib": ["lib/index.ts"],}}}') == {"@/": "src", "lib": "src/lib/index.ts"}
    assert config.workspaces({"packages/a/package.json": '{"name": "@x/a", "exports": {".": {"import": "./dist/a.mjs"}}}', "package.json": "{}"}) == {"@x/a": "packages/a/dist/a.mjs"}
    p = {"exports": {"./f/*": "./src/*.js", "./g": {"default": "./g.js"}}}
    assert config.resolve_exports(p, "./f/q") == "./src/q.js" and config.resolve_exports(p, "./g") == "./g.js" and config.resolve_exports(p, "./no") is None
    r = config.Registry(str(tmp_path / "r.json"))
    assert r.register("/a/x") == "x" and r.register("/b/x") == "x-2" and r.register("/a/x") == "x" and r.unregister("x") and not r.unregister("x") and r.read() == {"x-2": "/b/x"}
