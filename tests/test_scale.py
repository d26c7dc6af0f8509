"""Operators that once did not fit into the time or memory of larger tables: their steps against plain ones."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import community, cycles, lookup, search, traverse
from graphloom.plans.queries import QUERIES
from graphloom.sources import parse
from graphloom.storage import cut

SF = "/root/testdata/sf0.001"


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def test_blocks_of_vectors_score_as_pairs_do(spark, monkeypatch):
    rng = random.Random(1)
    made = [(i, [rng.gauss(0, 1) for _ in range(4 if i % 5 else 3)]) for i in range(60)] + [(100, [0.0] * 4), (101, None), (102, [1.0, None, 0.0, 0.0]), (103, [])]
    v = spark.createDataFrame(made, "id long, v array<float>")
    q = v.filter("id % 4 = 0").select(F.concat(F.lit("q"), "id").alias("query"), F.col("v").alias("q"))
    want = v.crossJoin(q).filter(F.size("v") == F.size("q")).select("query", "id", F.round(S.cosine(F.col("v"), F.col("q")), 6).alias("score")).filter("score >= -0.5")
    monkeypatch.setattr(search, "NUMBERS", 32)
    found = search.semantic(v, q, "id", "v", -0.5)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "zip_with" not in found._jdf.queryExecution().toString()
    assert rows(found.withColumn("score", F.round("score", 6))) == rows(want)


def test_facts_of_few_files_are_held_at_a_time():
    frame = pd.DataFrame({"file": [f"m{i}.py" for i in range(50)], "content": [b"def f(a):\n    return a\n"] * 50})
    found = list(parse.fact_frames([frame]))
    assert max(map(len, found)) == parse.FILES_AT_ONCE and [x for f in found for x in f["file"]] == list(frame["file"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["build_control_flow", "build_complexity"])
def test_facts_are_not_sent_to_the_driver(spark, name):
    assert "Broadcast" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [10**6, 3, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_long_paths_take_few_rounds(spark, monkeypatch, kind, limit):
    cuts = []
    monkeypatch.setattr(cycles, "cut", lambda df, real=cycles.cut: cuts.append(1) or real(df))
    made = [(i, i + 1) for i in range(300)] + [(400 + i, 400 + (i * 7 + 3) % 40) for i in range(40)] + [(900, 900)]
    e = spark.createDataFrame(made, "source_id long, target_id long").select(*[F.format_string("%04d", c).alias(c) if kind == "string" else c for c in ("source_id", "target_id")])
    up = {x: x for p in made for x in p}
    for _ in range(300):
        for a, b in made:
            up[a] = up[b] = min(up[a], up[b])
    assert {int(a): int(b) for a, b in rows(cycles.connected(e, limit))} == up
    assert len(cuts) < 120


@pytest.mark.parametrize("limit", [10**6, 20, 0])
def test_components_by_tasks_and_by_colours_agree_with_tarjan(spark, limit):
    rng = random.Random(limit)
    made = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(70)] + [(60, 100), (104, 205), (300, 301), (301, 300), (210, 300)]
    e = spark.createDataFrame(made, "source_id long, target_id long")
    want = [(x, g[0]) for g in cycles.tarjan([p for p in made if p[0] != p[1]]) for x in g]
    assert rows(cycles.components(e, 0, limit)) == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_cycles_are_of_all_edges(spark):
    found = QUERIES["cycles"](spark, SF).collect()
    parts = {x for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey").distinct().collect() for x in r}
    assert [r.size for r in found] == [len(parts)]


def test_enclosing_definitions_are_found_without_sorting_all_pairs(spark):
    rng = random.Random(3)
    made = [(i, f"f{i % 3}", rng.randrange(40), rng.choice([None, 5, 20, 50])) for i in range(200)]
    made = [(i, f, a, b if b is None else a + b) for i, f, a, b in made]
    points = [(f"f{i % 4}", i) for i in range(-3, 100)] + [("f1", 7), ("f1", 7), (None, 3)]
    n = spark.createDataFrame(made, "id long, file string, line int, end_line int")
    p = spark.createDataFrame(points, "file string, at int")
    span = lambda r, at: (((r[3] or 999999) - r[2]), -r[2], r[0])
    want = {(f, at, min((span(r, at) for r in made if r[1] == f and r[2] <= at <= (r[3] or 999999)), default=(None,))[-1]) for f, at in points}
    found = lookup.enclosing(n, p)
    assert rows(found) == sorted(want, key=repr)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_sums_over_communities_need_no_row_a_pair(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4), (3, 4), (5, 1)], "source_id long, target_id long")
    member = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "node long, community long")
    of = lambda pairs: [round(r.quality, 9) for r in community.modularity(pairs, member).collect()]
    assert of(community.loose_pairs(e)) == of(community.undirected_pairs(e))
    assert community.loose_pairs(e)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_knots_above_are_the_closure(spark):
    made = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (5, 7), (7, 5), (8, 8)] + [(20 + i, 20 + (i + 1) % 40) for i in range(40)]
    e = spark.createDataFrame([(a, b, "extends") for a, b in made], "source_id long, target_id long, kind string")
    starts = spark.createDataFrame([(1,), (6,), (7,), (25,)], "node_id long")
    knot, up = traverse.knots_above(e, starts, ("extends",))
    members = knot.select(F.col("node").alias("ancestor_id"), F.col("knot").alias("above"))
    found = knot.withColumnRenamed("node", "node_id").join(starts, "node_id", "left_semi").join(up, "knot").join(members, "above").filter("node_id <> ancestor_id")
    want = traverse.ancestors(e).join(starts, "node_id", "left_semi").filter("node_id <> ancestor_id")
    assert rows(found.select("node_id", "ancestor_id")) == rows(want.select("node_id", "ancestor_id").distinct())
    assert up.count() < 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["roles", "roles_reachable"])
def test_roles_read_what_was_made_once(spark, name):
    assert "Window" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_large_components_move_many_nodes_at_a_time(spark):
    # Cliques of 8 nodes, each tied to the next one and to one far away: a component of 232,000 pairs and of 64,000 nodes.
    n = 8_000
    inner = spark.range(n * 28).select((F.col("id") / 28).cast("long").alias("k"), (F.col("id") % 28).alias("p"))
    inner = inner.select("k", F.expr(f"element_at(array({', '.join(f'struct({a}L AS a, {b}L AS b)' for a in range(8) for b in range(a))}), CAST(p + 1 AS INT))").alias("e")).select((F.col("k") * 8 + F.col("e.a")).alias("source_id"), (F.col("k") * 8 + F.col("e.b")).alias("target_id"))
    ties = spark.range(n).select((F.col("id") * 8).alias("source_id"), F.explode(F.array((F.col("id") + 1) % n * 8 + 1, (F.col("id") * 37 + 11) % n * 8 + 2)).alias("target_id"))
    edges = cut(inner.unionByName(ties))
    pairs, found = community.undirected_pairs(edges), cut(community.communities(edges))
    assert pairs.count() > community.SERIAL_EDGES and (found.count(), found.select("node").distinct().count()) == (n * 8, n * 8)
    assert found.groupBy("community").agg(F.min("node").alias("least")).filter("community <> least").isEmpty()
    assert found.groupBy((F.col("node") / 8).cast("long")).agg(F.count_distinct("community").alias("c")).filter("c > 1").isEmpty()
    assert community.modularity(pairs, found).first()[0] > 0.9
    assert found.exceptAll(community.communities(edges)).isEmpty()


def test_moves_at_once_are_about_as_good_as_one_after_another():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2_000, 6_000), rng.integers(0, 2_000, 6_000)
    b = np.where(rng.random(6_000) < 0.6, a // 20 * 20 + b % 20, b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)  # with loops
    a, b = pairs
    w = 1.0 + a % 3

    def quality(part):
        strength = np.bincount(part[a], w, 2_000) + np.bincount(part[b], w, 2_000)
        return w[part[a] == part[b]].sum() / w.sum() - np.square(strength / (2 * w.sum())).sum()

    serial = community.leiden(list(zip(a.tolist(), b.tolist(), w.tolist())))
    assert quality(community.leiden_at_once(a, b, w, 2_000)) > 0.98 * quality(np.array([serial.get(i, i) for i in range(2_000)]))
    # Two parts that only their own pairs hold together are two communities, whatever the total.
    alone = community.leiden_at_once(np.array([0, 1, 3, 4]), np.array([1, 2, 4, 5]), np.ones(4), 6, total=1e9)
    assert alone.tolist() == [0, 0, 0, 3, 3, 3]


def test_syntax_trees_are_walked_without_contexts_and_facts_leave_as_arrow(spark, monkeypatch):
    import ast

    with open(parse.__file__) as f:
        text = f.read()
    tree = ast.parse(text)
    assert parse.walked(tree) == [x for x in ast.walk(tree) if not isinstance(x, ast.expr_context)]
    want = parse.parse_python(text)
    assert len(want["calls"]) > 100 and want["flows"]
    for slow in ("walk", "iter_child_nodes"):
        monkeypatch.delattr(ast, slow)
    assert parse.parse_python("def f(a):\n    return g(a)\n")["flows"] == [("f", "g", "flows_to", 0, "a", 2)]
    monkeypatch.undo()
    found = parse.parse(spark.createDataFrame([("m.py", text.encode())], "file string, content binary"))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()[0].asDict()
    assert {k: [tuple(x) for x in got[k]] for k in want} == want
