"""Traversals: one frontier kernel, batched over all roots.

Each level is a join of the frontier with the edges, a distinct, and an anti-join with what was visited; the level is
written to the shared folder, so the plan stays small and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .cycles import components


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, direction: str = "forward", both_steps: DataFrame | None = None) -> DataFrame:
    """Rows 160, 165, 168, 170, 174, 182: (root, node, depth, parent): breadth-first levels from each start.

    edges has (source_id, target_id), starts has (root, node). direction is forward, backward or both. parent is the
    least predecessor on the level before, null at a start. both_steps are extra (source_id, target_id) hops that count
    like edges already turned the right way.
    """
    turned = edges.select("source_id", "target_id") if direction == "forward" else edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    if direction == "both":
        turned = turned.unionByName(edges.select("source_id", "target_id"))
    if both_steps is not None:
        turned = turned.unionByName(both_steps.select("source_id", "target_id"))
    turned = turned.filter("source_id <> target_id").distinct()
    turned = turned if max_depth == 1 else cut(turned)  # read by every level
    level = cut(starts.select("root", "node").distinct().select("root", "node", F.lit(0).alias("depth"), F.lit(None).cast(dict(edges.dtypes)["source_id"]).alias("parent")))
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        hops = level.select("root", F.col("node").alias("source_id")).join(turned, "source_id")
        fresh = hops.groupBy("root", F.col("target_id").alias("node")).agg(F.lit(depth).alias("depth"), F.min("source_id").alias("parent"))
        level = cut(fresh.join(_union(levels).select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "depth", "parent"))
        if level.isEmpty():
            break
        levels.append(level)
    return _union(levels)


def impact(edges: DataFrame, roots: DataFrame, max_depth: int, implementors: DataFrame | None = None, node_kinds: DataFrame | None = None) -> DataFrame:
    """Rows 165-167: transitive callers of each root, by depth. With implementors (source implements target), those of an
    interface found at a depth are recorded one deeper but join the same next frontier."""
    calls = edges.select("source_id", "target_id").distinct()
    calls = calls if max_depth == 1 else cut(calls)
    level = cut(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")))
    seen, frontier = [level], level
    for depth in range(max_depth):
        callers = frontier.join(calls.withColumnRenamed("target_id", "node"), "node").select("root", F.col("source_id").alias("node"), F.lit(depth + 1).alias("depth"))
        if implementors is not None:
            base = _union([callers, frontier.select("root", "node", "depth")]) if depth == 0 else callers
            more = base.join(node_kinds.filter(F.col("kind").isin("interface", "trait")).select(F.col("id").alias("node")), "node", "left_semi")
            more = more.join(implementors.select(F.col("target_id").alias("node"), F.col("source_id").alias("other")), "node").select("root", F.col("other").alias("node"), (F.col("depth") + 1).alias("depth"))
            callers = callers.unionByName(more)
        fresh = callers.groupBy("root", "node").agg(F.min("depth").alias("depth"))
        frontier = cut(fresh.join(_union(seen).select("root", "node"), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return _union(seen).filter("depth > 0")


def shortest_path(edges: DataFrame, source: int | str, target: int | str, max_depth: int = 10, direction: str = "forward") -> DataFrame:
    """Rows 161-163: (step, node) of a shortest path; empty if there is none, one row if both are the same. Of several
    predecessors the least counts."""
    kind = dict(edges.dtypes)["source_id"]
    found = cut(reach(edges, edges.sparkSession.createDataFrame([(source, source)], f"root {kind}, node {kind}"), max_depth, direction))
    # Back from the target by one join a step, each of one row; a null parent ends it at the start.
    at = found.filter(F.col("node") == target).select(F.col("depth").alias("step"), "node", "parent")
    path = [at]
    for _ in range(max_depth):
        before = found.select(F.col("node").alias("parent"), F.col("depth").alias("d"), F.col("parent").alias("next"))
        at = at.join(before, "parent").filter("d = step - 1").select((F.col("step") - 1).alias("step"), F.col("parent").alias("node"), F.col("next").alias("parent"))
        path.append(at)
    return _union(path).select("step", "node").orderBy("step")


def file_path(pairs: DataFrame, source: str, target: str, max_depth: int = 10) -> DataFrame:
    """Row 164: (step, file) of a shortest chain of imports between two files; pairs has (source_file, target_file)."""
    edges = pairs.select(F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"))
    return shortest_path(edges, source, target, max_depth).select("step", F.col("node").alias("file"))


def alternates(edges: DataFrame, found: DataFrame, target: int) -> DataFrame:
    """Row 162: edges into the target from the level before it, less one."""
    at = found.filter(F.col("node") == target).select("root", F.col("depth").alias("end"))
    before = found.join(at, "root").filter("depth = end - 1").select("root", F.col("node").alias("source_id"))
    return before.join(edges.filter(F.col("target_id") == target), "source_id").groupBy("root").agg((F.count(F.lit(1)) - 1).alias("alternate_count"))


def flow(edges: DataFrame, starts: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows 177-178: (steps, leaves, back): the levels, visited nodes without outgoing edges, and edges that lead to a
    node visited at the same level or before."""
    steps = cut(reach(edges, starts, max_depth))
    one = edges.select("source_id", "target_id").distinct()
    leaves = steps.join(one.select(F.col("source_id").alias("node")), "node", "left_anti")
    out = steps.filter(F.col("depth") < max_depth).select("root", F.col("node").alias("source_id"), "depth").join(one, "source_id")
    back = out.join(steps.select("root", F.col("node").alias("target_id"), F.col("depth").alias("seen")), ["root", "target_id"]).filter("seen <= depth").select("root", "source_id", "target_id", "depth")
    return steps, leaves.select("root", "node", "depth"), back


def ancestors(edges: DataFrame, kinds: tuple[str, ...] = ("extends",), max_depth: int | None = None) -> DataFrame:
    """Rows 78, 298, 301: (node_id, ancestor_id, depth): the closure of the class hierarchy."""
    own = cut(edges.filter(F.col("kind").isin(*kinds)).select("source_id", "target_id").distinct())
    starts = own.select(F.col("source_id").alias("root"), F.col("source_id").alias("node"))
    return reach(own, starts, max_depth).filter("depth > 0").select(F.col("root").alias("node_id"), F.col("node").alias("ancestor_id"), "depth")


def knots_above(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The closure of a hierarchy without its pairs of nodes: (node, knot), the strong component of each node, and (knot,
    above), what those of starts (node_id) reach, themselves included. All nodes of two such knots are pairs of the closure,
    but for each node and itself."""
    own = cut(edges.filter(F.col("kind").isin(*kinds)).select("source_id", "target_id").filter("source_id <> target_id").distinct())
    nodes = own.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    knot = cut(nodes.join(components(own), "node", "left").select("node", F.coalesce("component", "node").alias("knot")))
    of = lambda c: knot.select(F.col("node").alias(c), F.col("knot").alias(f"{c}_knot"))
    between = own.join(of("source_id"), "source_id").join(of("target_id"), "target_id").select(F.col("source_id_knot").alias("source_id"), F.col("target_id_knot").alias("target_id"))
    first = knot.join(starts.select(F.col("node_id").alias("node")), "node", "left_semi").select(F.col("knot").alias("root"), F.col("knot").alias("node"))
    return knot, reach(between, first).select(F.col("root").alias("knot"), F.col("node").alias("above"))


def reverse_dependencies(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Row 185: files, not changed themselves, with an edge into a changed file; changed has (file)."""
    into = pairs.join(changed.withColumnRenamed("file", "target_file"), "target_file", "left_semi").select(F.col("source_file").alias("file"))
    return into.distinct().join(changed, "file", "left_anti")


def resolve_barrels(reexports: DataFrame, definitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows 184, 410: (file, name, def_file, def_name): names imported from barrels, chased through renaming re-exports to
    the end; circles of barrels end where they began.

    reexports has (file, name, source_file, source_name), name '*' for a wildcard; definitions has (file, name).
    """
    at = wanted.select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name")).distinct()
    out, seen, at = [], [], cut(at)
    while True:
        hit = at.join(definitions.select(F.col("file").alias("at_file"), F.col("name").alias("at_name")), ["at_file", "at_name"], "left_semi")
        out.append(hit)
        seen.append(at)
        rest = at.join(hit, ["file", "name", "at_file", "at_name"], "left_anti")
        r = reexports.select(F.col("file").alias("r_file"), F.col("name").alias("r_name"), "source_file", "source_name")
        nxt = rest.join(r, (F.col("at_file") == F.col("r_file")) & ((F.col("r_name") == "*") | (F.col("at_name") == F.col("r_name"))))
        at = nxt.select("file", "name", F.col("source_file").alias("at_file"), F.when(F.col("r_name") == "*", F.col("at_name")).otherwise(F.col("source_name")).alias("at_name")).distinct()
        at = cut(at.join(_union(seen), ["file", "name", "at_file", "at_name"], "left_anti"))
        if at.isEmpty():
            break
    return _union(out).select("file", "name", F.col("at_file").alias("def_file"), F.col("at_name").alias("def_name")).distinct()
