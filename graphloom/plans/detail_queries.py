"""More of the registry: small look-ups over the star adapters, and a program of the tables' parts, parsed and linked."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes, community, details, export, lookup, reports, roles, search, traverse
from ..sources.parse import parse
from ..storage import cut
from . import build, link, star
from .queries import _PAIRS, query

# 2.B, 2.C, 2.D, 2.S


@query("callable_nodes", "SELECT id, name, kind, file FROM nodes WHERE kind IN ('function', 'method', 'class')")
def _(n, e, spark, d):
    return details.callable_nodes(n)


@query("call_rows", "SELECT source_id, target_id, confidence, dynamic, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY ALL")
def _(n, e, spark, d):
    return details.call_edges(e).groupBy("source_id", "target_id", "confidence", "dynamic").agg(F.count(F.lit(1)).alias("n"))


@query("import_rows", "SELECT source_id, target_id, count(*) AS n FROM edges WHERE kind IN ('imports', 'imports-type') GROUP BY ALL")
def _(n, e, spark, d):
    return details.import_edges(e).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


@query("filtered_edges", "SELECT kind, count(*) AS n FROM edges WHERE confidence >= 0.5 AND dynamic = 0 GROUP BY 1")
def _(n, e, spark, d):
    return details.filter_edges(e, (F.col("confidence") >= 0.5) & (F.col("dynamic") == 0)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("file_ends", "SELECT file, coalesce(max(end_line), -1) AS max_end FROM nodes GROUP BY 1")
def _(n, e, spark, d):
    return details.file_ends(n).withColumn("max_end", F.coalesce("max_end", F.lit(-1)))


@query("interfaces", "SELECT n.id, n.name, n.kind, n.file, n.line, coalesce(string_agg(DISTINCT t.name || '@' || t.file, ',' ORDER BY t.name || '@' || t.file), '') AS interfaces FROM nodes n LEFT JOIN edges e ON e.source_id = n.id AND e.kind = 'implements' LEFT JOIN nodes t ON t.id = e.target_id WHERE contains(lower(n.name), 'c1') GROUP BY ALL")
def _(n, e, spark, d):
    return details.interfaces(n, e, "c1").withColumn("interfaces", F.array_join("interfaces", ","))


@query("import_degrees", "SELECT file, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT a.file, 0 AS i, 1 AS o FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file AND e.kind IN ('imports', 'imports-type') UNION ALL SELECT b.file, 1, 0 FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file AND e.kind IN ('imports', 'imports-type')) GROUP BY 1")
def _(n, e, spark, d):
    return details.import_degrees(e, n, file_targets=False)


@query("co_change_file", "SELECT min(f) AS file FROM (SELECT file_a AS f FROM pc UNION SELECT file_b FROM pc) WHERE f LIKE '%#21' HAVING count(*) > 0", prelude=False, extra=_PAIRS)
def _(spark, d):
    return details.co_change_file(changes.co_changes(star.commits(spark, d)), "#21")


@query("nodes_by_id", "SELECT id, name FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE kind = 'extends')")
def _(n, e, spark, d):
    return details.by_ids(n, e.filter("kind = 'extends'").select(F.col("target_id").alias("id"))).select("id", "name")


@query("symbols_of_files", "SELECT id, name, kind, file, line FROM nodes WHERE file IN (SELECT file FROM nodes WHERE kind = 'constant')")
def _(n, e, spark, d):
    return details.of_files(n, n.filter("kind = 'constant'").select("file"))


@query("ids_by_key", "SELECT name, kind, file, line, id FROM nodes")
def _(n, e, spark, d):
    return details.ids_by_key(n, n.select("name", "kind", "file", "line"))


@query("function_ids", "SELECT DISTINCT n.name, n.file, n.line, n.id FROM nodes n JOIN nodes k ON k.name = n.name AND k.file = n.file AND k.line = n.line WHERE n.kind IN ('function', 'method')")
def _(n, e, spark, d):
    return details.function_ids(n, n.select("name", "file", "line"))


@query("functions_of_files", "SELECT id FROM nodes WHERE kind IN ('function', 'method') AND file IN (SELECT file FROM nodes WHERE kind = 'interface')")
def _(n, e, spark, d):
    return details.functions_of_files(n, n.filter("kind = 'interface'").select("file"))


@query("exported_definitions", "SELECT id, name, kind, file, line FROM nodes WHERE kind IN ('function', 'method', 'class') AND exported = 1")
def _(n, e, spark, d):
    return details.exported_definitions(n)


@query("complexity_of", "SELECT id, name, cognitive, cyclomatic, max_nesting, maintainability_index FROM nodes JOIN complexity ON node_id = id")
def _(n, e, spark, d):
    return details.complexity_of(n, star.complexity(spark, d))


@query("symbol_refs", "SELECT DISTINCT name, kind, file, line FROM nodes")
def _(n, e, spark, d):
    return details.symbol_refs(n).select("symbol.*").distinct()


@query("file_like_targets", "SELECT DISTINCT name, contains(name, '/') OR regexp_matches(lower(name), '[^.]\\.(js|py|rs|go|c|h|m|r|v)$') AS file_like FROM nodes")
def _(n, e, spark, d):
    return n.select("name", details.is_file_like(F.col("name")).alias("file_like")).distinct()


@query("type_names", "SELECT DISTINCT file, name AS owner FROM nodes WHERE kind = 'interface'")
def _(n, e, spark, d):
    return roles.type_names(n)


@query("code_point_order", "SELECT row_number() OVER (ORDER BY file, name, id) AS place, id FROM nodes ORDER BY file, name, id LIMIT 50")
def _(n, e, spark, d):
    top = details.in_code_point_order(n.select("file", "name", "id"), "file", "name", "id").limit(50)
    return top.select(F.expr("row_number() OVER (ORDER BY file, name, id)").cast("long").alias("place"), "id")


@query("community_summary", "SELECT (SELECT count(DISTINCT c) FROM m) AS communities, round(sum(coalesce(inn, 0) / w - (deg / (2 * w)) * (deg / (2 * w))), 4) AS modularity, (SELECT CAST(floor(((SELECT count(*) FROM (SELECT dir FROM m GROUP BY 1 HAVING count(DISTINCT c) >= 2)) / (SELECT count(DISTINCT dir) FROM m) + (SELECT count(*) FROM (SELECT c FROM m GROUP BY 1 HAVING count(DISTINCT dir) >= 2)) / (SELECT count(DISTINCT c) FROM m)) / 2 * 100 + 0.5) AS INT)) AS drift_score FROM (SELECT c, sum(w) AS deg FROM (SELECT a % 5 AS c, w FROM up UNION ALL SELECT b % 5, w FROM up) GROUP BY 1) x LEFT JOIN (SELECT a % 5 AS c, sum(w) AS inn FROM up WHERE a % 5 = b % 5 GROUP BY 1) y USING (c), (SELECT CAST(sum(w) AS DOUBLE) AS w FROM up)", extra="up AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS w FROM edges GROUP BY 1, 2), m AS (SELECT DISTINCT id % 5 AS c, 'src/' || split_part(file, '/', 2) AS dir FROM nodes)")
def _(n, e, spark, d):
    members = n.select(F.col("id").alias("node"), (F.col("id") % 5).alias("community"), S.directory(F.col("file")).alias("directory"))
    return details.community_summary(community.loose_pairs(e), members)


# 2.A, 2.L, 2.M over a program


def _facts(spark, d):
    """(facts, nodes) of the program."""
    facts = cut(parse(star.sources(spark, d)))
    return facts, cut(build.node_rows(facts))


def _edges(spark, d, kind: str):
    facts, nodes = _facts(spark, d)
    return _named(build.linked(facts, nodes, facts.select("file"))[0].filter(F.col("kind") == kind), nodes)


program = partial(query, prelude=True, extra=star.FUNCTIONS)


def _named(rows, nodes):
    """rows with the names of their ends instead of ids."""
    ids = nodes.select("id", "name").hint("merge")
    return rows.join(ids.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(ids.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")


@program("build_nodes", "SELECT 'f' || id AS name, 'function' AS kind, file, 1 AS exported FROM fn UNION ALL SELECT DISTINCT file, 'file', file, 0 FROM fn")
def _(n, e, spark, d):
    return _facts(spark, d)[1].select("name", "kind", "file", "exported")


@program("build_calls", "SELECT 'f' || id AS source, 'f' || callee AS target, CAST(1.0 AS DOUBLE) AS confidence FROM linked WHERE callee <> id")
def _(n, e, spark, d):
    return _edges(spark, d, "calls").select("source", "target", "confidence")


@program("build_imports", "SELECT DISTINCT file AS source, callee_file AS target, CAST(1.0 AS DOUBLE) AS confidence FROM linked WHERE file <> callee_file")
def _(n, e, spark, d):
    return _edges(spark, d, "imports").select("source", "target", "confidence")


@program("build_contains", "SELECT file AS source, 'f' || id AS target FROM fn")
def _(n, e, spark, d):
    nodes = _facts(spark, d)[1]
    return _named(build.contains_edges(nodes), nodes).select("source", "target")


@program("resolved_imports", "SELECT DISTINCT file, callee_file AS resolved, 'f' || callee AS name, CASE WHEN callee % 2 = 1 THEN 'g' || callee END AS alias FROM linked WHERE file <> callee_file")
def _(n, e, spark, d):
    facts = parse(star.sources(spark, d))
    return link.resolve_imports(facts, star.sources(spark, d).select("file")).select("file", "resolved", "name", "alias")


@program("build_complexity", "SELECT 'f' || id AS name, branches AS cognitive, branches + 1 AS cyclomatic, least(branches, 1) AS max_nesting, 2 * branches + 2 AS loc FROM fn")
def _(n, e, spark, d):
    facts, nodes = _facts(spark, d)
    rows = build.complexity_rows(facts, nodes).join(nodes.select(F.col("id").alias("node_id"), "name").hint("merge"), "node_id")
    return rows.select("name", *[F.col(c).cast("int").alias(c) for c in ("cognitive", "cyclomatic", "max_nesting", "loc")])


@program("build_dataflow", "SELECT 'f' || id AS source, 'f' || callee AS target, 0 AS param_index, 'a' AS expression FROM linked WHERE callee IS NOT NULL")
def _(n, e, spark, d):
    facts, nodes = _facts(spark, d)
    bound = cut(link.bound_names(link.resolve_imports(facts, facts.select("file")), nodes))
    return _named(build.dataflow_rows(facts, nodes, bound).filter("kind = 'flows_to'"), nodes).select("source", "target", "param_index", "expression")


@program("build_control_flow", "SELECT 'f' || id AS name, CAST(2 * branches + 3 AS BIGINT) AS blocks, CAST(3 * branches + 2 AS BIGINT) AS jumps FROM fn")
def _(n, e, spark, d):
    facts, nodes = _facts(spark, d)
    t, ids = build.tables_of_files(facts, nodes), nodes.select(F.col("id").alias("function_id"), "name").hint("merge")
    count = lambda k, c: t[k].groupBy("function_id").agg(F.count(F.lit(1)).alias(c)).hint("merge")
    return ids.join(count("cfg_blocks", "blocks"), "function_id").join(count("cfg_edges", "jumps"), "function_id").select("name", "blocks", "jumps")


# 2.H, 2.I, 2.P composites


@query("file_path", "SELECT CAST(min(depth) AS BIGINT) AS hops FROM walk WHERE node = (SELECT max(target_file) FROM pairs)", extra="pairs AS (SELECT DISTINCT a.file AS source_file, b.file AS target_file FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file AND e.kind IN ('imports', 'imports-type')), walk AS (SELECT min(source_file) AS node, 0 AS depth FROM pairs UNION SELECT p.target_file, w.depth + 1 FROM walk w JOIN pairs p ON p.source_file = w.node WHERE w.depth < 6)")
def _(n, e, spark, d):
    pairs = lookup.file_edges(e, n)
    ends = pairs.agg(F.min("source_file").alias("a"), F.max("target_file").alias("z")).first()
    return traverse.file_path(pairs, ends.a, ends.z, 6).agg(F.max("step").cast("long").alias("hops"))


@query("function_edges", "SELECT a.name AS source_name, a.file AS source_file, b.name AS target_name, b.file AS target_file, 'calls' AS kind, max(e.confidence) AS confidence FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.kind = 'calls' GROUP BY e.source_id, e.target_id, 1, 2, 3, 4")
def _(n, e, spark, d):
    return export.function_edges(e, n)


@query("fn_deps_hierarchy", "SELECT DISTINCT m.id, c.source_id AS other_id FROM nodes m JOIN nodes t ON t.kind IN ('class', 'interface') AND t.name = split_part(m.name, '.', 1) JOIN up ON up.root = t.id AND up.node <> up.root JOIN nodes a ON a.id = up.node AND a.kind IN ('class', 'interface') JOIN nodes am ON am.kind = 'method' AND am.name = a.name || '.' || split_part(m.name, '.', 2) JOIN edges c ON c.target_id = am.id AND c.kind = 'calls' AND c.source_id <> c.target_id WHERE m.kind = 'method' AND contains(lower(m.name), '.m1')", extra="ext AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind IN ('extends', 'implements') AND source_id <> target_id), up AS (SELECT source_id AS root, source_id AS node FROM ext UNION SELECT u.root, x.target_id FROM up u JOIN ext x ON x.source_id = u.node)")
def _(n, e, spark, d):
    return reports.fn_deps(n, e, ".m1", 1, hierarchy=True).filter("relation = 'caller via hierarchy'").select("id", "other_id")


@query("search_filter", "SELECT id FROM nodes WHERE kind = 'function' AND file LIKE 'src/%/m3.js'")
def _(n, e, spark, d):
    return search.post_filter(n.select("id"), n, "function", globs=("src/**/m3.js",))
