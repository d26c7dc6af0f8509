"""Composite queries: several operators' answers in one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import cut
from . import changes, lookup, metrics, rules, traverse

CALLABLE = ("function", "method", "class")


def _stack(parts: dict[str, DataFrame], label: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(label, F.lit(k)) for k, df in parts.items()])


def stats(nodes: DataFrame, edges: DataFrame, no_tests: bool = False) -> DataFrame:
    """Row 114: (section, key, n): nodes by kind, edges by kind, files by language, roles."""
    own = nodes.filter(~S.is_test_path(F.col("file"))) if no_tests else nodes
    return _stack(
        {
            "nodes": metrics.nodes_by_kind(own).select(F.col("kind").alias("key"), "n"),
            "edges": metrics.edges_by_kind(edges, nodes, no_tests).select(F.col("kind").alias("key"), "n"),
            "languages": metrics.files_by_language(own.select("file").distinct()).select(F.col("language").alias("key"), "n"),
            "roles": own.filter("role IS NOT NULL").groupBy(F.col("role").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        },
        "section",
    )


def file_deps(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """Row 171: (relation, name): what a file imports, what imports it, and what it defines."""
    pairs = lookup.file_edges(edges, nodes)
    return _stack(
        {
            "imports": pairs.filter(F.col("source_file") == file).select(F.col("target_file").alias("name")),
            "imported_by": pairs.filter(F.col("target_file") == file).select(F.col("source_file").alias("name")),
            "defines": nodes.filter((F.col("file") == file) & (F.col("kind") != "file")).select("name"),
        },
        "relation",
    )


def fn_deps(nodes: DataFrame, edges: DataFrame, part: str, max_depth: int = 3, hierarchy: bool = False) -> DataFrame:
    """Rows 169-170: (id, relation, depth, other_id): callees, and callers by depth, of the symbols that match. With
    hierarchy, also callers of the same method of classes above: those may mean this one."""
    roots = lookup.NodeQuery(nodes).kinds(*CALLABLE).name_like(part).df.select("id")
    calls = lookup.simple_graph(edges)
    callees = calls.join(roots.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("source_id").alias("id"), F.lit(1).alias("depth"), F.col("target_id").alias("other_id"))
    callers = traverse.impact(calls, roots, max_depth).select(F.col("root").alias("id"), "depth", F.col("node").alias("other_id"))
    parts = {"callee": callees, "caller": callers}
    if hierarchy:
        owner, bare = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1), F.element_at(F.split("name", r"\."), -1)
        methods = nodes.filter("kind = 'method'").select("id", owner.alias("owner"), bare.alias("bare"))
        types = nodes.filter(F.col("kind").isin("class", "interface", "trait", "struct")).select(F.col("id").alias("type_id"), F.col("name").alias("owner"))
        mine = cut(methods.join(roots, "id", "left_semi").join(types, "owner").select("id", "bare", F.col("type_id").alias("node_id")))
        knot, up = traverse.knots_above(edges, mine.select("node_id"), ("extends", "implements"))
        wanted = methods.withColumnRenamed("id", "target_id").join(mine.select("bare").distinct(), "bare", "left_semi").join(types, "owner")
        wanted = wanted.join(knot.select(F.col("node").alias("type_id"), F.col("knot").alias("above")), "type_id")
        above = mine.join(knot.withColumnRenamed("node", "node_id"), "node_id").join(up, "knot").join(wanted, ["above", "bare"]).filter("node_id <> type_id")
        parts["caller via hierarchy"] = above.select("id", "target_id").distinct().join(calls, "target_id").select("id", F.lit(1).alias("depth"), F.col("source_id").alias("other_id")).distinct()
    return _stack(parts, "relation")


def brief(nodes: DataFrame, edges: DataFrame, files: DataFrame, max_depth: int = 5, high: int = 10, medium: int = 3) -> DataFrame:
    """Row 175: (file, symbols, callers, importers, risk) of each file: transitive callers of its symbols, counted by
    symbol, files that import it, and the tier of its worst symbol."""
    own = nodes.filter(F.col("kind").isin(*CALLABLE)).join(files, "file", "left_semi").select("id", "file", "role")
    counts = traverse.impact(lookup.simple_graph(edges), own.select("id"), max_depth).groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    rows = own.join(counts, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    sums = rows.groupBy("file").agg(F.count(F.lit(1)).alias("symbols"), F.sum("callers").alias("callers"), F.max("callers").alias("most"), F.max((F.col("role") == "core").cast("int")).alias("core"))
    importers = lookup.file_edges(edges, nodes).groupBy(F.col("target_file").alias("file")).agg(F.count(F.lit(1)).alias("importers"))
    out = files.distinct().join(sums, "file", "left").join(importers, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("file", zero("symbols").alias("symbols"), zero("callers").alias("callers"), zero("importers").alias("importers"), S.risk_tier(zero("most"), zero("core") == 1, high, medium).alias("risk"))


def diff_impact(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, max_depth: int = 3, owned: DataFrame | None = None, pairs: DataFrame | None = None, boundaries: dict | None = None) -> DataFrame:
    """Row 176: (relation, name): changed functions, functions and files they affect, and, given, owners, co-changed files
    and the boundaries that changed files break."""
    hit = lookup.affected(nodes, hunks).filter(F.col("kind").isin(*CALLABLE))
    reached = traverse.impact(lookup.simple_graph(edges), hit.select("id"), max_depth).select(F.col("node").alias("id")).distinct().join(nodes.select("id", "name", "file"), "id")
    files = reached.select(F.col("file").alias("name")).distinct()
    parts = {"changed": hit.select("name").distinct(), "affected": reached.select("name").distinct(), "file": files}
    if owned is not None:
        parts["owner"] = owned.join(files.withColumnRenamed("name", "file"), "file", "left_semi").select(F.explode("owners").alias("name")).distinct()
    if pairs is not None:
        changed = hunks.select("file").distinct()
        both = pairs.select(F.explode(F.array(F.struct(F.col("file_a").alias("file"), F.col("file_b").alias("name")), F.struct(F.col("file_b").alias("file"), F.col("file_a").alias("name")))).alias("p")).select("p.*")
        parts["co_changed"] = both.join(changed, "file", "left_semi").select("name").distinct()
    if boundaries is not None:
        own = lookup.file_edges(edges, nodes).join(hunks.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi")
        parts["boundary"] = rules.boundary_violations(own, boundaries).select(F.concat_ws(" -> ", "source_file", "target_file").alias("name")).distinct()
    return _stack(parts, "relation")


def exports(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """Row 223: (id, name, kind, consumers, used) of a file's exported symbols."""
    own = nodes.filter((F.col("file") == file) & (F.col("exported") == 1)).select("id", "name", "kind")
    consumers = lookup.external_consumers(edges, nodes).groupBy("id").agg(F.count(F.lit(1)).alias("consumers"))
    rows = own.join(consumers, "id", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))
    return rows.withColumn("used", F.col("consumers") > 0)


def exports_through(nodes: DataFrame, edges: DataFrame, reexports: DataFrame, file: str) -> DataFrame:
    """Row 223 for barrels: (name, from_file, consumers): what a file exports itself or passes on, with the consumers of
    the definition."""
    own = nodes.filter((F.col("file") == file) & (F.col("exported") == 1)).select("name", F.col("file").alias("from_file"), F.col("name").alias("def_name"))
    passed = reexports.filter(F.col("file") == file)
    named = passed.filter("name <> '*'").select("name", F.col("source_file").alias("from_file"), F.col("source_name").alias("def_name"))
    every = nodes.filter("exported = 1").select(F.col("file").alias("from_file"), "name", F.col("name").alias("def_name")).join(passed.filter("name = '*'").select(F.col("source_file").alias("from_file")), "from_file", "left_semi")
    counts = lookup.external_consumers(edges, nodes).filter(F.col("consumer_file") != file).groupBy("id").agg(F.count(F.lit(1)).alias("consumers"))
    defs = nodes.filter("kind <> 'file'").select("id", F.col("file").alias("from_file"), F.col("name").alias("def_name")).join(counts, "id", "left")
    rows = own.unionByName(named).unionByName(every.select("name", "from_file", "def_name")).distinct().join(defs, ["from_file", "def_name"], "left")
    return rows.select("name", "from_file", F.coalesce("consumers", F.lit(0)).alias("consumers")).distinct()


def reexported(nodes: DataFrame, reexports: DataFrame, file: str) -> DataFrame:
    """Row 224: (name, from_file): all exports behind a wildcard, the named ones otherwise; reexports as for barrels."""
    own = reexports.filter(F.col("file") == file).select(F.col("name").alias("as_name"), "source_file", "source_name")
    named = nodes.filter("exported = 1").select("name", F.col("file").alias("source_file"))
    hit = own.join(named, "source_file").filter((F.col("as_name") == "*") | (F.col("source_name") == F.col("name")))
    return hit.select(F.when(F.col("as_name") == "*", F.col("name")).otherwise(F.col("as_name")).alias("name"), F.col("source_file").alias("from_file")).distinct()


def structure(nodes: DataFrame, edges: DataFrame, prefix: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Row 121: a row a directory: files, symbols, density, cohesion."""
    sizes = nodes.filter("kind <> 'file'").groupBy("file").agg(F.count(F.lit(1)).alias("symbols"))
    rows = metrics.directory_rollup(sizes).join(metrics.directory_edges(lookup.file_edges(edges, nodes)).select("directory", "cohesion"), "directory", "left")
    rows = rows.withColumn("density", S.hotspot_density(F.col("symbols"), F.col("files"), F.lit(0)))
    if prefix:
        rows = rows.filter((F.col("directory") == prefix) | F.col("directory").startswith(prefix.rstrip("/") + "/"))
    return rows if max_depth is None else rows.filter(F.size(F.split("directory", "/")) <= max_depth)


def module_boundaries(nodes: DataFrame, edges: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Row 123: directories of cohesion at or above the threshold."""
    return structure(nodes, edges).filter(F.col("cohesion") >= threshold)


def compare_symbols(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Row 387: (kind, file, name, id, line, fan_in, fan_out) of a graph's symbols, of some files (file) if given; of
    symbols alike in the first three the last."""
    n = nodes.filter(F.col("kind") != "file")
    n = n if files is None else n.join(files, "file", "left_semi")
    rows = lookup.NodeQuery(n, edges).with_fan_in().with_fan_out().df
    return rows.groupBy("kind", "file", "name").agg(F.max("id").alias("id"), F.max("line").alias("line"), F.max("fan_in").alias("fan_in"), F.max("fan_out").alias("fan_out"))


def compare_callers(edges: DataFrame, ids: DataFrame, max_depth: int = 3) -> DataFrame:
    """Rows 183, 388: (root, node, depth): callers of each of many symbols (id), to a depth."""
    return traverse.impact(lookup.simple_graph(edges), ids.select("id"), max_depth)


def branch_compare(base: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], files: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """Row 154: (change, kind, file, name, impact): symbols added, removed or changed between two graphs, with the
    transitive callers in the graph that has them."""
    b, t = compare_symbols(*base, files), compare_symbols(*target, files)
    keys = ["kind", "file", "name"]
    parts = {"added": changes.added(b, t).select(*keys, "id"), "removed": changes.removed(b, t).select(*keys, "id"), "changed": changes.changed(b, t).select(*keys).join(t, keys).select(*keys, "id")}
    out = []
    for change, rows in parts.items():
        n = compare_callers((base if change == "removed" else target)[1], rows, max_depth).groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("impact"))
        out.append(rows.join(n, "id", "left").select(F.lit(change).alias("change"), *keys, F.coalesce("impact", F.lit(0)).alias("impact")))
    return reduce(lambda a, c: a.unionByName(c), out)


def audit(nodes: DataFrame, edges: DataFrame, complexity: DataFrame, part: str, thresholds: dict[str, float], max_depth: int = 3, explain: bool = False) -> DataFrame:
    """Rows 226-227: matching symbols with callees, callers, impact, complexity and the thresholds they break; with explain
    also the lists of context()."""
    own = lookup.NodeQuery(nodes, edges).kinds(*CALLABLE).name_like(part).with_fan_in().with_fan_out().df.select("id", "name", "file", "fan_in", "fan_out")
    reached = traverse.impact(lookup.simple_graph(edges), own.select("id"), max_depth).groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("impact"))
    health = metrics.complexity_report(complexity, thresholds).select(F.col("node_id").alias("id"), "cognitive", "cyclomatic", "maintainability_index", "exceeds")
    rows = own.join(reached, "id", "left").join(health, "id", "left").withColumns({"impact": F.coalesce("impact", F.lit(0)), "exceeds": F.coalesce("exceeds", F.lit(""))})
    return rows.join(context(nodes, edges, part).drop("name", "file", "kind", "line"), "id", "left") if explain else rows


def context(nodes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """Rows 172-173: matching symbols with callees, callers, callers in tests, members and implemented interfaces, as lists."""
    own = lookup.NodeQuery(nodes).name_like(part).df.select("id", "name", "kind", "file", "line")
    names = lambda df: df.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("x"))
    callers = lookup.neighbours(edges, nodes, False)
    lists = {
        "callees": names(lookup.neighbours(edges, nodes, True)), "callers": names(callers.filter(~S.is_test_path(F.col("file")))), "tests": names(callers.filter(S.is_test_path(F.col("file")))),
        "members": names(lookup.children(nodes).select(F.col("parent_id").alias("id"), "name")), "implements": names(lookup.neighbours(edges, nodes, True, ("implements",))),
    }
    for label, df in lists.items():
        own = own.join(df.withColumnRenamed("x", label), "id", "left").withColumn(label, F.coalesce(label, F.array().cast("array<string>")))
    return own


def batch(command: Callable[[str], DataFrame], targets: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows 228-230: one command over many targets, as one DataFrame with a target column, and the errors of those that
    can't be planned. Comma-separated targets are split."""
    parts, errors = {}, {}
    for target in dict.fromkeys(t.strip() for x in targets for t in x.split(",") if t.strip()):
        try:
            parts[target] = command(target)
        except Exception as x:  # noqa: BLE001  one target's failure must not end the others
            errors[target] = str(x)[:200]
    return (_stack(parts, "target") if parts else None), errors


def owners_for(files: DataFrame, owner_rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Row 133."""
    return rules.owners_summary(rules.file_owners(files, owner_rules))
