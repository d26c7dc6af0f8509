"""Registry: SURVEY operators as queries over the star adapters, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes, community, cycles, export, lookup, metrics, reports, roles, rules, search, traverse
from . import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: bool = True, extra: str = ""):
    """Register a function of (spark, sf_dir) or, with the graph prelude, of (nodes, edges, spark, sf_dir)."""

    def add(f):
        QUERIES[name] = (lambda spark, d: f(star.nodes(spark, d), star.edges(spark, d), spark, d)) if prelude else f
        if sql:
            head = f"WITH RECURSIVE {star.PRELUDE}" if prelude else "WITH RECURSIVE one AS (SELECT 1 AS x)"
            ORACLES[name] = f"{head}{', ' + extra if extra else ''} {sql}"
        return f

    return add


_TEST = r"(regexp_matches(lower({0}), '\.test\.|\.spec\.|__test__|__tests__|\.stories\.|(^|/)(tests|test|fixtures|__fixtures__)(/|$)|_test\.go$|(^|/)test_[^/]*\.py$|_test\.py$') OR regexp_matches({0}, '(^|/)Test[A-Z]\w*\.java$|[a-z0-9]Test\.java$'))"
_FANIN = "fi AS (SELECT target_id AS id, count(*) AS fan_in FROM edges WHERE kind = 'calls' GROUP BY 1), fo AS (SELECT source_id AS id, count(*) AS fan_out FROM edges WHERE kind = 'calls' GROUP BY 1)"
_IMPORTS = "pairs AS (SELECT DISTINCT a.file AS source_file, b.file AS target_file FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file AND e.kind IN ('imports', 'imports-type'))"
_CALLS = "calls AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'calls')"


# 2.B projections and filters


@query("node_query", "SELECT n.id, n.name, n.kind, n.file, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out FROM nodes n LEFT JOIN fi USING (id) LEFT JOIN fo USING (id) WHERE kind IN ('function', 'method') AND NOT " + _TEST.format("file") + " AND contains(lower(file), 'brand#1'.replace('#', '')) AND name ILIKE '%e%'", extra=_FANIN)
def _(n, e, spark, d):
    q = lookup.NodeQuery(n, e).kinds("function", "method").exclude_tests().file_filter("BRAND1").name_like("E").with_fan_in().with_fan_out()
    return q.df.select("id", "name", "kind", "file", "fan_in", "fan_out")


@query("symbol_match", "SELECT n.id, n.name, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, floor((CASE WHEN lower(name) = 'red_widget_1' OR split_part(lower(name), '.', -1) = 'red_widget_1' THEN 100 WHEN starts_with(lower(name), 'red_widget_1') OR starts_with(split_part(lower(name), '.', -1), 'red_widget_1') THEN 60 WHEN contains(lower(name), '.red_widget_1') OR contains(lower(name), 'red_widget_1.') THEN 40 ELSE 10 END + least(log2(coalesce(fan_in, 0) + 1) * 5, 25.0)) * 10000 + 0.5) / 10000 AS relevance FROM nodes n LEFT JOIN fi USING (id) WHERE kind IN ('function', 'method', 'class') AND contains(lower(name), 'red_widget_1')", extra=_FANIN)
def _(n, e, spark, d):
    return lookup.find_symbols(n, e, "red_widget_1").select("id", "name", "fan_in", "relevance")


@query("query_name", "SELECT n.id, n.name, n.kind, n.file, n.line, coalesce((SELECT string_agg(e.kind || ':' || t.name, ',' ORDER BY e.kind || ':' || t.name) FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.source_id = n.id), '') AS callees, coalesce((SELECT string_agg(e.kind || ':' || s.name, ',' ORDER BY e.kind || ':' || s.name) FROM edges e JOIN nodes s ON s.id = e.source_id WHERE e.target_id = n.id), '') AS callers FROM nodes n WHERE contains(lower(name), 'c12')")
def _(n, e, spark, d):
    return lookup.query_name(n, e, "c12")


@query("where_symbol", "SELECT n.id, n.name, n.kind, n.file, n.line, CAST(count(DISTINCT u.source_id) AS BIGINT) AS uses, coalesce(bool_or(u.f <> n.file), false) AS exported FROM nodes n LEFT JOIN (SELECT e.target_id, e.source_id, s.file AS f FROM edges e JOIN nodes s ON s.id = e.source_id WHERE e.kind = 'calls') u ON u.target_id = n.id WHERE contains(lower(name), 'k1') GROUP BY ALL")
def _(n, e, spark, d):
    return lookup.where_symbol(n, e, "k1")


@query("list_functions", "SELECT name, kind, file, line, coalesce(end_line, 0) AS end_line FROM nodes WHERE kind IN ('function', 'method', 'class') AND contains(lower(file), 'm3')")
def _(n, e, spark, d):
    return lookup.NodeQuery(n).kinds("function", "method", "class").file_filter("m3").df.select("name", "kind", "file", "line", F.coalesce("end_line", F.lit(0)).alias("end_line"))


@query("children", "SELECT p.id AS parent_id, p.name AS parent_name, c.id, c.name, c.kind, c.line FROM nodes c JOIN nodes p ON p.id = c.parent_id")
def _(n, e, spark, d):
    return lookup.children(n)


@query("ast_glob", "SELECT id, name, file FROM nodes WHERE name GLOB 'C1*.m?'")
def _(n, e, spark, d):
    return n.filter(S.glob_name(F.col("name"), "C1*.m?")).select("id", "name", "file")


@query("role_census", "SELECT role, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'dead', count(*) FROM nodes WHERE role LIKE 'dead%'")
def _(n, e, spark, d):
    return roles.role_counts(n)


@query("dead_symbols", "SELECT id, name, role FROM nodes WHERE role LIKE 'dead%'")
def _(n, e, spark, d):
    return lookup.NodeQuery(n).role("dead").df.select("id", "name", "role")


@query("dynamic_calls", "SELECT dynamic_kind, count(*) AS n FROM edges WHERE kind = 'calls' AND dynamic_kind IS NOT NULL GROUP BY 1")
def _(n, e, spark, d):
    return e.filter("kind = 'calls' AND dynamic_kind IS NOT NULL").groupBy("dynamic_kind").agg(F.count(F.lit(1)).alias("n"))


@query("entry_points", "SELECT id, name, file, line, CASE WHEN name LIKE 'route:%' THEN 'route' ELSE 'exported' END AS type FROM nodes WHERE name LIKE 'route:%' OR role = 'entry'")
def _(n, e, spark, d):
    return lookup.entry_points(n)


@query("test_files", "SELECT DISTINCT file, " + _TEST.format("file") + " AS is_test FROM nodes")
def _(n, e, spark, d):
    return n.select("file", S.is_test_path(F.col("file")).alias("is_test")).distinct()


@query("confident_calls", "SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'calls' AND confidence >= 0.5 AND source_id <> target_id")
def _(n, e, spark, d):
    return lookup.simple_graph(e, min_confidence=0.5)


@query("subgraph_edges", "SELECT e.source_id, e.target_id, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.kind IN ('function', 'method') AND b.kind IN ('function', 'method') GROUP BY ALL")
def _(n, e, spark, d):
    return lookup.subgraph(n, e, F.col("kind").isin("function", "method"))[1].groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


# 2.C joins


@query("callees", "SELECT DISTINCT e.source_id AS id, e.target_id AS other_id, t.name, t.file FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'calls'")
def _(n, e, spark, d):
    return lookup.neighbours(e, n, True, distinct=True).select("id", "other_id", "name", "file")


@query("callers", "SELECT e.target_id AS id, e.source_id AS other_id, s.name FROM edges e JOIN nodes s ON s.id = e.source_id WHERE e.kind = 'calls'")
def _(n, e, spark, d):
    return lookup.neighbours(e, n, False).select("id", "other_id", "name")


@query("distinct_callers", "SELECT DISTINCT e.target_id AS id, e.source_id AS other_id, s.name FROM edges e JOIN nodes s ON s.id = e.source_id WHERE e.kind = 'calls'")
def _(n, e, spark, d):
    return lookup.neighbours(e, n, False, distinct=True).select("id", "other_id", "name")


@query("edges_at_nodes", "SELECT id, edge_kind, count(*) AS n FROM (SELECT source_id AS id, kind AS edge_kind FROM edges UNION ALL SELECT target_id, kind FROM edges) GROUP BY ALL")
def _(n, e, spark, d):
    both = lookup.neighbours(e, n, True, kinds=None).unionByName(lookup.neighbours(e, n, False, kinds=None))
    return both.groupBy("id", "edge_kind").agg(F.count(F.lit(1)).alias("n"))


@query("callee_names", "SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT e.source_id AS id, t.name FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'calls') GROUP BY 1")
def _(n, e, spark, d):
    return lookup.neighbour_names(e, n, True).select("id", F.array_join("names", ",").alias("names"))


@query("import_targets", "SELECT DISTINCT e.source_id AS id, e.target_id AS other_id, e.kind AS edge_kind FROM edges e WHERE e.kind IN ('imports', 'imports-type')")
def _(n, e, spark, d):
    return lookup.neighbours(e, n, True, ("imports", "imports-type"), True).select("id", "other_id", "edge_kind")


@query("cross_file_callers", "SELECT e.target_id AS id, count(DISTINCT e.source_id) AS callers FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'calls' AND s.file <> t.file GROUP BY 1")
def _(n, e, spark, d):
    return lookup.cross_file_caller_counts(e, n)


@query("external_consumers", "SELECT DISTINCT e.target_id AS id, CASE WHEN e.kind <> 'calls' THEN s.file ELSE s.name END AS consumer, s.file AS consumer_file, CASE WHEN e.kind <> 'calls' THEN 'file' ELSE 'symbol' END AS via FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind IN ('calls', 'imports', 'imports-type') AND s.file <> t.file")
def _(n, e, spark, d):
    return lookup.external_consumers(e, n)


@query("intra_file_calls", "SELECT s.file AS source_file, s.name AS source_name, s.line AS source_line, t.name AS target_name, t.line AS target_line FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'calls' AND s.file = t.file")
def _(n, e, spark, d):
    return lookup.intra_file_calls(e, n)


@query("implementations", "SELECT t.id, t.name, s.name AS implementor FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'implements' AND t.kind = 'interface' GROUP BY ALL")
def _(n, e, spark, d):
    found = lookup.neighbours(e, n, False, ("implements",), True).select("id", F.col("name").alias("implementor"))
    return n.filter("kind = 'interface'").select("id", "name").join(found, "id").distinct()


@query("exported_by_file", "SELECT file, count(*) AS n, coalesce(max(end_line), 0) AS last_line FROM nodes WHERE exported = 1 GROUP BY 1")
def _(n, e, spark, d):
    return n.filter("exported = 1").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("end_line"), F.lit(0)).alias("last_line"))


_HUNKS = "hunks AS (SELECT DISTINCT file, CAST(line - 2 AS INT) AS start, CAST(line + 9 AS INT) AS stop FROM nodes WHERE id % 50 = 7)"
_ENDS = "ends AS (SELECT *, coalesce(end_line, lead(line) OVER (PARTITION BY file ORDER BY line, id) - 1, 999999) AS stop_line FROM nodes)"


def _hunks(n):
    return n.filter("id % 50 = 7").select("file", (F.col("line") - 2).alias("start"), (F.col("line") + 9).alias("stop")).distinct()


@query("affected_functions", "SELECT id, name, file FROM ends n WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file = n.file AND n.line <= h.stop AND n.stop_line >= h.start)", extra=f"{_HUNKS}, {_ENDS}")
def _(n, e, spark, d):
    return lookup.affected(n, _hunks(n)).select("id", "name", "file")


@query("enclosing_definition", "SELECT file, pos, coalesce(id, -1) AS id FROM (SELECT p.file, p.pos, d.id, row_number() OVER (PARTITION BY p.file, p.pos ORDER BY coalesce(d.end_line, 999999) - d.line, d.line DESC, d.id) AS rn FROM points p LEFT JOIN nodes d ON d.file = p.file AND d.line <= p.pos AND coalesce(d.end_line, 999999) >= p.pos) WHERE rn = 1", extra="points AS (SELECT DISTINCT file, line + 5 AS pos FROM nodes)")
def _(n, e, spark, d):
    return lookup.enclosing(n, n.select("file", (F.col("line") + 5).alias("at")).distinct()).select("file", F.col("at").alias("pos"), F.coalesce("id", F.lit(-1)).alias("id"))


@query("file_import_pairs", "SELECT source_file, target_file FROM pairs", extra=_IMPORTS)
def _(n, e, spark, d):
    return lookup.file_edges(e, n)


# 2.D aggregations


@query("hotspots", "SELECT file, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT a.file, 0 AS i, 1 AS o FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file UNION ALL SELECT b.file, 1, 0 FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file) GROUP BY 1 ORDER BY sum(i) + sum(o) DESC, file LIMIT 20")
def hotspots(n, e, spark, d):
    return metrics.hotspots(e, n, 20)


@query("nodes_by_kind", "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def _(n, e, spark, d):
    return metrics.nodes_by_kind(n)


@query("edges_by_kind", "SELECT e.kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE NOT " + _TEST.format("a.file") + " AND NOT " + _TEST.format("b.file") + " GROUP BY 1")
def _(n, e, spark, d):
    return metrics.edges_by_kind(e, n)


@query("files_by_language", "SELECT CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.rs' THEN 'rust' ELSE 'javascript' END AS language, count(*) AS n FROM (SELECT DISTINCT file FROM nodes) GROUP BY 1")
def _(n, e, spark, d):
    return metrics.files_by_language(n.select("file").distinct())


@query("calls_by_technique", "SELECT technique, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1")
def _(n, e, spark, d):
    return e.filter("kind = 'calls'").groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


@query("quality_metrics", "SELECT round(cov, 6) AS caller_coverage, round(conf, 6) AS call_confidence, round(fp, 6) AS false_positive_ratio, CAST(floor(cov * 40 + conf * 40 + (1 - fp) * 20 + 0.5) AS INT) AS score FROM (SELECT (SELECT count(*) FROM nodes WHERE kind IN ('function', 'method') AND id IN (SELECT target_id FROM edges WHERE kind = 'calls')) / (SELECT count(*) FROM nodes WHERE kind IN ('function', 'method')) AS cov, (SELECT count(*) FILTER (confidence >= 0.7) / count(*) FILTER (confidence > 0) FROM edges WHERE kind = 'calls') AS conf, (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM edges WHERE kind = 'calls' GROUP BY target_id HAVING count(*) > 20)) / (SELECT count(*) FROM edges WHERE kind = 'calls') AS fp)")
def _(n, e, spark, d):
    q = metrics.quality_metrics(e, n)
    return q.select(*[F.round(c, 6).alias(c) for c in ("caller_coverage", "call_confidence", "false_positive_ratio")], "score")


@query("complexity_summary", "SELECT count(*) AS analyzed, floor(avg(cognitive) * 10 + 0.5) / 10 AS avg_cognitive, max(cognitive) AS max_cognitive, floor(avg(cyclomatic) * 10 + 0.5) / 10 AS avg_cyclomatic, min(maintainability_index) AS min_mi FROM complexity")
def _(n, e, spark, d):
    return metrics.complexity_summary(star.complexity(spark, d))


@query("file_metrics", "SELECT f.file, f.symbols, CAST(f.exports AS BIGINT) AS exports, coalesce(o.import_count, 0) AS import_count, coalesce(i.fan_in, 0) AS fan_in, coalesce(o.fan_out, 0) AS fan_out FROM (SELECT file, count(DISTINCT (name, kind, line)) AS symbols, sum(exported) AS exports FROM nodes GROUP BY 1) f LEFT JOIN (SELECT a AS file, count(DISTINCT b) AS import_count, count(*) AS fan_out FROM imp GROUP BY 1) o USING (file) LEFT JOIN (SELECT b AS file, count(*) AS fan_in FROM imp GROUP BY 1) i USING (file)", extra="imp AS (SELECT a.file AS a, b.file AS b FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file <> b.file AND e.kind IN ('imports', 'imports-type'))")
def _(n, e, spark, d):
    return metrics.file_metrics(n, e)


_DIRS = "dirs AS (SELECT DISTINCT file, unnest(['src', 'src/' || split_part(file, '/', 2)]) AS directory FROM nodes)"


@query("directory_rollup", "SELECT directory, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols FROM dirs JOIN (SELECT file, count(*) AS symbols FROM nodes GROUP BY 1) USING (file) GROUP BY 1", extra=_DIRS)
def _(n, e, spark, d):
    return metrics.directory_rollup(n.groupBy("file").agg(F.count(F.lit(1)).alias("symbols")))


@query("directory_cohesion", "SELECT directory, CAST(sum(i) AS BIGINT) AS intra, CAST(sum(n) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, round(sum(i) / (sum(i) + sum(n) + sum(o)), 6) AS cohesion FROM (SELECT coalesce(a.directory, b.directory) AS directory, (a.directory IS NOT NULL AND b.directory IS NOT NULL)::INT AS i, (a.directory IS NULL)::INT AS n, (b.directory IS NULL)::INT AS o FROM (SELECT p.*, d.directory FROM pairs p JOIN dirs d ON d.file = p.source_file) a FULL JOIN (SELECT p.*, d.directory FROM pairs p JOIN dirs d ON d.file = p.target_file) b ON a.source_file = b.source_file AND a.target_file = b.target_file AND a.directory = b.directory) GROUP BY 1", extra=f"{_IMPORTS}, {_DIRS}")
def _(n, e, spark, d):
    return metrics.directory_edges(lookup.file_edges(e, n)).withColumn("cohesion", F.round("cohesion", 6))


@query("fan_medians", "SELECT (SELECT median(c) FROM (SELECT count(*) AS c FROM edges WHERE kind IN ('calls', 'imports-type') GROUP BY target_id)) AS median_fan_in, (SELECT median(c) FROM (SELECT count(*) AS c FROM edges WHERE kind = 'calls' GROUP BY source_id)) AS median_fan_out")
def _(n, e, spark, d):
    return metrics.fan_medians(e)


_CHURN = "churn AS (SELECT file, CAST(count(*) AS BIGINT) AS commit_count FROM nodes GROUP BY 1)"
_WEIGHTS = "CASE role WHEN 'core' THEN 1.0 WHEN 'utility' THEN 0.9 WHEN 'entry' THEN 0.8 WHEN 'leaf' THEN 0.2 WHEN 'dead-leaf' THEN 0.0 WHEN 'dead-unresolved' THEN 0.15 ELSE 0.5 END"


@query("triage", f"SELECT id, role_weight, floor((0.25 * a + 0.3 * b + 0.2 * c + 0.15 * role_weight + 0.1 * m) * 10000 + 0.5) / 10000 AS risk_score, floor(a * 10000 + 0.5) / 10000 AS norm_fan_in, m AS norm_mi FROM (SELECT id, CAST({_WEIGHTS} AS DOUBLE) AS role_weight, (fan_in - min(fan_in) OVER ()) / (max(fan_in) OVER () - min(fan_in) OVER ()) AS a, (cognitive - min(cognitive) OVER ()) / (max(cognitive) OVER () - min(cognitive) OVER ()) AS b, (churn - min(churn) OVER ()) / (max(churn) OVER () - min(churn) OVER ()) AS c, floor((1 - (mi - min(mi) OVER ()) / (max(mi) OVER () - min(mi) OVER ())) * 10000 + 0.5) / 10000 AS m FROM (SELECT n.id, n.role, coalesce(fan_in, 0) AS fan_in, c.cognitive, h.commit_count AS churn, c.maintainability_index AS mi FROM nodes n LEFT JOIN fi USING (id) JOIN complexity c ON c.node_id = n.id JOIN churn h ON h.file = n.file WHERE n.kind IN ('function', 'method', 'class')))", extra=f"{_FANIN}, {_CHURN}")
def _(n, e, spark, d):
    churn = n.groupBy("file").agg(F.count(F.lit(1)).alias("commit_count"))
    return metrics.triage(n, e, star.complexity(spark, d), churn).select("id", "role_weight", "risk_score", "norm_fan_in", "norm_mi")


@query("manifesto", "SELECT rule, CASE WHEN count(*) FILTER (value >= fail) > 0 THEN 'fail' WHEN count(*) FILTER (value >= warn) > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) FILTER (value >= fail OR value >= warn) AS violations FROM (SELECT 'cognitive' AS rule, cognitive AS value, 15 AS warn, 22 AS fail FROM complexity UNION ALL SELECT 'cyclomatic', cyclomatic, 10, NULL FROM complexity UNION ALL SELECT 'max_nesting', max_nesting, 40, NULL FROM complexity) GROUP BY 1")
def _(n, e, spark, d):
    own = star.complexity(spark, d).withColumnRenamed("node_id", "id")
    return metrics.worst(metrics.manifesto(own, {"cognitive": (15, 22), "cyclomatic": (10, None), "max_nesting": (40, None)}))


@query("complexity_breaches", "SELECT node_id, concat_ws(',', CASE WHEN cognitive >= 20 THEN 'cognitive' END, CASE WHEN maintainability_index > 0 AND maintainability_index <= 10 THEN 'maintainability_index' END) AS exceeds FROM complexity WHERE cognitive >= 20 OR (maintainability_index > 0 AND maintainability_index <= 10)")
def _(n, e, spark, d):
    return metrics.complexity_report(star.complexity(spark, d), {"cognitive": 20, "maintainability_index": 10}, above=True).select("node_id", "exceeds")


_OWNERS = "* @all\nsrc/brand1/ @one @uno\n*.py @snakes\n/src/brand2/m3.rs @rust\n"
_OWNED = "owned AS (SELECT file, CASE WHEN file = 'src/brand2/m3.rs' THEN '@rust' WHEN file LIKE '%.py' THEN '@snakes' WHEN file LIKE 'src/brand1/%' THEN '@one,@uno' ELSE '@all' END AS o FROM (SELECT DISTINCT file FROM nodes))"


@query("owners", "SELECT owner, count(*) AS files FROM (SELECT file, unnest(string_split(o, ',')) AS owner FROM owned) GROUP BY 1", extra=_OWNED)
def _(n, e, spark, d):
    return rules.owners_summary(rules.file_owners(n, rules.parse_codeowners(_OWNERS)))


@query("owner_boundaries", "SELECT e.source_id, e.target_id, x.o AS source_owners, y.o AS target_owners FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id JOIN owned x ON x.file = a.file JOIN owned y ON y.file = b.file WHERE e.kind = 'calls' AND x.o <> y.o", extra=_OWNED)
def _(n, e, spark, d):
    return rules.owner_boundaries(e, n, rules.file_owners(n, rules.parse_codeowners(_OWNERS)))


_BOUNDARIES = {"modules": {"ui": {"match": "src/brand1?/**", "layer": "presentation"}, "core": {"match": "src/brand2*/**", "layer": "data"}}, "preset": "layered", "rules": [{"from": "ui", "only_to": ["ui"]}]}
_MODULE = "CASE WHEN regexp_matches({0}, '^src/brand1[^/]/.*$') THEN 'ui' WHEN regexp_matches({0}, '^src/brand2[^/]*/.*$') THEN 'core' END"


@query("boundary_violations", f"SELECT source_file, target_file, f AS from_module, t AS to_module, CAST(CASE f WHEN 'core' THEN 0 ELSE 1 END AS INT) AS rule FROM (SELECT *, {_MODULE.format('source_file')} AS f, {_MODULE.format('target_file')} AS t FROM pairs) WHERE (f = 'core' AND t = 'ui') OR (f = 'ui' AND t = 'core')", extra=_IMPORTS)
def _(n, e, spark, d):
    return rules.boundary_violations(lookup.file_edges(e, n), _BOUNDARIES)


@query("simple_degree", "SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM s UNION ALL SELECT target_id, 1, 0 FROM s) GROUP BY 1", extra="s AS (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id <> target_id)")
def _(n, e, spark, d):
    return metrics.degree(e)


# 2.E and 2.F


@query("file_limit", "SELECT file, id FROM (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY line, id) AS rn FROM nodes) WHERE rn <= 3")
def _(n, e, spark, d):
    return metrics.file_limit(n, "file", ["line", "id"], 3).select("file", "id")


@query("paginate", "SELECT id, name, (SELECT count(*) FROM nodes) AS total, (SELECT count(*) FROM nodes) > 60 AS has_more FROM nodes ORDER BY file, line, id LIMIT 20 OFFSET 40")
def _(n, e, spark, d):
    return lookup.paginate(n, ["file", "line", "id"], 20, 40).select("id", "name", "total", "has_more")


@query("seed_nodes", "SELECT n.id FROM nodes n LEFT JOIN fi USING (id) ORDER BY coalesce(fan_in, 0) DESC, n.id LIMIT 25", extra=_FANIN)
def _(n, e, spark, d):
    return metrics.seeds(n, e, "top-fanin", 25)


@query("align_siblings", "SELECT a.id AS old_id, b.id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY line, id) AS rn FROM nodes WHERE id % 4 <> 0) a JOIN (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY line, id) AS rn FROM nodes WHERE id % 5 <> 0) b USING (file, kind, rn)")
def _(n, e, spark, d):
    same = n.withColumn("name", F.lit("x"))
    return metrics.align_siblings(same.filter("id % 4 <> 0"), same.filter("id % 5 <> 0"))


# 2.G set operations


_SIDES = "base AS (SELECT kind, file, name, max(line) AS line FROM nodes WHERE id % 7 <> 0 GROUP BY ALL), target AS (SELECT kind, file, name, max(line + id % 2) AS line FROM nodes WHERE id % 11 <> 0 GROUP BY ALL)"


def _sides(n):
    side = lambda df, line: df.groupBy("kind", "file", "name").agg(F.max(line).alias("line"))
    return side(n.filter("id % 7 <> 0"), F.col("line").cast("long")), side(n.filter("id % 11 <> 0"), F.col("line") + F.col("id") % 2)


@query("added_symbols", "SELECT kind, file, name FROM target ANTI JOIN base USING (kind, file, name)", extra=_SIDES)
def _(n, e, spark, d):
    return changes.added(*_sides(n)).select("kind", "file", "name")


@query("removed_symbols", "SELECT kind, file, name FROM base ANTI JOIN target USING (kind, file, name)", extra=_SIDES)
def _(n, e, spark, d):
    return changes.removed(*_sides(n)).select("kind", "file", "name")


@query("changed_symbols", "SELECT kind, file, name, CAST(t.line - b.line AS BIGINT) AS d_line FROM base b JOIN target t USING (kind, file, name) WHERE t.line <> b.line", extra=_SIDES)
def _(n, e, spark, d):
    return changes.changed(*_sides(n), columns=("line",))


@query("reverse_dependencies", "SELECT DISTINCT source_file AS file FROM pairs WHERE target_file IN (SELECT file FROM nodes WHERE id % 100 = 0) AND source_file NOT IN (SELECT file FROM nodes WHERE id % 100 = 0)", extra=_IMPORTS)
def _(n, e, spark, d):
    return traverse.reverse_dependencies(lookup.file_edges(e, n), n.filter("id % 100 = 0").select("file").distinct())


# 2.H traversal


_BFS = "walk AS (SELECT id AS root, id AS node, 0 AS depth FROM nodes WHERE id % 100 = 0 UNION SELECT w.root, c.{1}, w.depth + 1 FROM walk w JOIN {2} c ON c.{0} = w.node WHERE w.depth < {3})"


@query("bfs_forward", "SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1, 2", extra=f"{_CALLS}, " + _BFS.format("source_id", "target_id", "calls", 3))
def _(n, e, spark, d):
    starts = n.filter("id % 100 = 0").select(F.col("id").alias("root"), F.col("id").alias("node"))
    return traverse.reach(lookup.simple_graph(e), starts, 3).select("root", "node", "depth")


@query("fn_impact", "SELECT root, depth, count(*) AS n FROM (SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1, 2) WHERE depth > 0 GROUP BY 1, 2", extra=f"{_CALLS}, " + _BFS.format("target_id", "source_id", "calls", 3))
def _(n, e, spark, d):
    roots = n.filter("id % 100 = 0").select("id")
    return traverse.impact(e.filter("kind = 'calls'"), roots, 3).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("shortest_path_hops", "SELECT CAST(min(depth) AS BIGINT) AS hops FROM walk WHERE node = 77", extra="sg AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'imports' AND source_id <> target_id), walk AS (SELECT 5 AS node, 0 AS depth UNION SELECT g.target_id, w.depth + 1 FROM walk w JOIN sg g ON g.source_id = w.node WHERE w.depth < 10)")
def _(n, e, spark, d):
    path = traverse.shortest_path(lookup.simple_graph(e, ("imports",)), 5, 77)
    return path.agg(F.max("step").cast("long").alias("hops"))


@query("class_ancestors", "SELECT root AS node_id, node AS ancestor_id, CAST(min(depth) AS INT) AS depth FROM up WHERE root <> node GROUP BY 1, 2", extra="ext AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'extends' AND source_id <> target_id), up AS (SELECT source_id AS root, source_id AS node, 0 AS depth FROM ext UNION SELECT u.root, x.target_id, u.depth + 1 FROM up u JOIN ext x ON x.source_id = u.node WHERE u.depth < 3)")
def _(n, e, spark, d):
    return traverse.ancestors(e, max_depth=3)


@query("file_impact", "SELECT node AS file, CAST(min(depth) AS INT) AS depth FROM walk WHERE depth > 0 AND node <> 'src/brand1/m0.js' GROUP BY 1", extra=f"{_IMPORTS}, walk AS (SELECT 'src/brand1/m0.js' AS node, 0 AS depth UNION SELECT p.source_file, w.depth + 1 FROM walk w JOIN pairs p ON p.target_file = w.node WHERE w.depth < 2)")
def _(n, e, spark, d):
    pairs = lookup.file_edges(e, n).select(F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"))
    start = spark.createDataFrame([("src/brand1/m0.js", "src/brand1/m0.js")], "root string, node string")
    return traverse.reach(pairs, start, 2, "backward").filter("depth > 0").select(F.col("node").alias("file"), "depth")


# 2.I cycles, communities, roles, checks


_CLOSURE = "hop AS (SELECT source_id AS a, target_id AS b FROM succ UNION SELECT h.a, s.target_id FROM hop h JOIN succ s ON s.source_id = h.b)"


@query("cycles", "SELECT min(b) AS component, count(*) AS size, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS members FROM (SELECT DISTINCT h.a, h.b FROM hop h JOIN hop g ON g.a = h.b AND g.b = h.a) GROUP BY a HAVING count(*) > 1 AND a = min(b)", extra=f"succ AS (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id <> target_id), {_CLOSURE}")
def _(n, e, spark, d):
    return cycles.cycles(e).select("component", "size", F.array_join("members", ",").alias("members"))


@query("connected_components", "SELECT a AS node, min(b) AS component FROM walk GROUP BY 1", extra=f"{star.SUCCESSORS}, und AS (SELECT source_id AS a, target_id AS b FROM succ UNION SELECT target_id, source_id FROM succ), walk AS (SELECT a, b FROM und UNION SELECT a, a FROM und UNION SELECT w.a, u.b FROM walk w JOIN und u ON u.a = w.b)")
def _(n, e, spark, d):
    return cycles.connected(star.successors(spark, d))


@query("modularity", "SELECT round(sum(coalesce(inn, 0) / m - (deg / (2 * m)) * (deg / (2 * m))), 6) AS quality FROM (SELECT c, sum(w) AS deg FROM (SELECT a % 5 AS c, w FROM up UNION ALL SELECT b % 5, w FROM up) GROUP BY 1) x LEFT JOIN (SELECT a % 5 AS c, sum(w) AS inn FROM up WHERE a % 5 = b % 5 GROUP BY 1) y USING (c), (SELECT CAST(sum(w) AS DOUBLE) AS m FROM up)", extra="up AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS w FROM edges GROUP BY 1, 2)")
def _(n, e, spark, d):
    member = n.select(F.col("id").alias("node"), (F.col("id") % 5).alias("community"))
    return community.modularity(community.loose_pairs(e), member).select(F.round("quality", 6).alias("quality"))


@query("coarse_graph", "SELECT least(a % 5, b % 5) AS a, greatest(a % 5, b % 5) AS b, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT source_id AS a, target_id AS b, 1 AS w FROM edges) GROUP BY 1, 2")
def _(n, e, spark, d):
    return community.coarsen(community.undirected_pairs(e), n.select(F.col("id").alias("node"), (F.col("id") % 5).alias("community")))


@query("communities")
def _(n, e, spark, d):
    return community.communities(lookup.simple_graph(e, ("imports",)))


@query("drift", "SELECT CAST((SELECT count(*) FROM (SELECT directory FROM m GROUP BY 1 HAVING count(DISTINCT community) >= 2)) AS BIGINT) AS split_directories, CAST((SELECT count(*) FROM (SELECT community FROM m GROUP BY 1 HAVING count(DISTINCT directory) >= 2)) AS BIGINT) AS merge_communities, CAST(floor(((SELECT count(*) FROM (SELECT directory FROM m GROUP BY 1 HAVING count(DISTINCT community) >= 2)) / (SELECT count(DISTINCT directory) FROM m) + (SELECT count(*) FROM (SELECT community FROM m GROUP BY 1 HAVING count(DISTINCT directory) >= 2)) / (SELECT count(DISTINCT community) FROM m)) / 2 * 100 + 0.5) AS INT) AS drift_score", extra="m AS (SELECT DISTINCT p_size AS community, p_brand || (p_partkey % 20) AS directory FROM part)")
def _(n, e, spark, d):
    own = star.table(spark, d, "part").selectExpr("p_size AS community", "concat(p_brand, p_partkey % 20) AS directory")
    return community.drift(own)


_ROLE = (
    "uses AS (SELECT e.target_id AS id, count(*) AS fan_in, count(*) FILTER (NOT " + _TEST.format("s.file") + ") AS prod, bool_or(s.file <> t.file) AS crossed "
    "FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind IN ('calls', 'imports-type') GROUP BY 1), "
    "own AS (SELECT n.*, coalesce(u.fan_in, 0) AS fan_in, coalesce(u.prod, 0) AS prod, coalesce(o.fan_out, 0) AS fan_out, n.exported = 1 OR coalesce(u.crossed, false) AS pub "
    "FROM nodes n LEFT JOIN uses u USING (id) LEFT JOIN fo o USING (id)), "
    "med AS (SELECT median(CASE WHEN fan_in > 0 THEN fan_in END) AS mi, median(CASE WHEN fan_out > 0 THEN fan_out END) AS mo FROM own), "
    "busy AS (SELECT DISTINCT file FROM own WHERE kind NOT IN ('constant', 'interface') AND (fan_in > 0 OR fan_out > 0)), "
    "called AS (SELECT DISTINCT file FROM own WHERE kind NOT IN ('constant', 'interface') AND fan_in > 0), "
)
_DEAD = "CASE WHEN kind = 'constant' THEN 'dead-leaf' WHEN file LIKE '%.rs' THEN 'dead-ffi' ELSE 'dead-unresolved' END"
_ROLE += (
    "roled AS (SELECT id, name, kind, file, exported, fan_in, fan_out, CASE WHEN name LIKE 'route:%' THEN 'entry' "
    "WHEN fan_in = 0 AND NOT pub THEN CASE WHEN kind IN ('constant', 'interface') AND file IN (SELECT file FROM busy) THEN 'leaf' "
    f"WHEN kind IN ('method', 'function') AND fan_out > 0 AND file IN (SELECT file FROM called) THEN 'leaf' ELSE {_DEAD} END "
    "WHEN fan_in = 0 THEN CASE WHEN kind IN ('function', 'method') THEN 'entry' ELSE 'leaf' END WHEN prod = 0 AND NOT pub THEN 'test-only' "
    "WHEN fan_in >= mi AND NOT (fan_out >= mo AND fan_out > 0) THEN 'core' WHEN fan_in >= mi THEN 'utility' WHEN fan_out >= mo AND fan_out > 0 THEN 'adapter' ELSE 'leaf' END AS role FROM own, med)"
)
_LIVE = (
    "live AS (SELECT id FROM roled WHERE name LIKE 'route:%' OR (kind IN ('function', 'method') AND exported = 1) "
    "UNION SELECT source_id FROM calls WHERE source_id NOT IN (SELECT id FROM roled WHERE kind IN ('function', 'method')) "
    "UNION SELECT c.target_id FROM live l JOIN calls c ON c.source_id = l.id)"
)


@query("roles", "SELECT id, fan_in, fan_out, role FROM roled", extra=f"{_FANIN}, {_ROLE}")
def _(n, e, spark, d):
    return roles.classify(roles.inputs(n, e)).select("id", "fan_in", "fan_out", "role")


@query("roles_reachable", f"SELECT id, name, kind, file, fan_in, fan_out, CASE WHEN kind IN ('function', 'method') AND fan_in > 0 AND role IN ('core', 'utility', 'adapter', 'leaf') AND id NOT IN (SELECT id FROM live) THEN {_DEAD} ELSE role END AS role FROM roled", extra=f"{_FANIN}, {_CALLS}, {_ROLE}, {_LIVE}")
def _(n, e, spark, d):
    return roles.classify(roles.inputs(n, e), e)


@query("check_signatures", "SELECT id, name, file, line FROM nodes n WHERE exported = 1 AND EXISTS (SELECT 1 FROM hunks h WHERE h.file = n.file AND n.line BETWEEN h.start AND h.stop)", extra=_HUNKS)
def _(n, e, spark, d):
    return rules.check_signatures(n, _hunks(n))


@query("check_blast_radius", "SELECT root AS id, count(*) AS callers FROM (SELECT DISTINCT root, node FROM walk WHERE node <> root) GROUP BY 1 HAVING count(*) > 150", extra=f"{_HUNKS}, {_ENDS}, {_CALLS}, hit AS (SELECT id FROM ends n WHERE kind IN ('function', 'method', 'class') AND EXISTS (SELECT 1 FROM hunks h WHERE h.file = n.file AND n.line <= h.stop AND n.stop_line >= h.start)), walk AS (SELECT id AS root, id AS node, 0 AS depth FROM hit UNION SELECT w.root, c.source_id, w.depth + 1 FROM walk w JOIN calls c ON c.target_id = w.node WHERE w.depth < 2)")
def _(n, e, spark, d):
    return rules.check_blast_radius(n, e, _hunks(n), 150, 2)


@query("check_deleted_exports", "SELECT DISTINCT t.id, t.name, t.file, s.name AS consumer_name, s.file AS consumer_file FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind IN ('calls', 'imports', 'imports-type') AND t.exported = 1 AND t.file LIKE 'src/brand3/%' AND s.file NOT LIKE 'src/brand3/%'")
def _(n, e, spark, d):
    return rules.check_deleted_exports(n, e, n.filter("file LIKE 'src/brand3/%'").select("file").distinct())


# Composite reports


@query("stats", "SELECT 'nodes' AS section, kind AS key, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'roles', role, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'languages', CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.rs' THEN 'rust' ELSE 'javascript' END, count(DISTINCT file) FROM nodes GROUP BY 2")
def _(n, e, spark, d):
    return reports.stats(n, e).select("section", "key", "n")


@query("file_deps", "SELECT 'imports' AS relation, target_file AS name FROM pairs WHERE source_file = 'src/brand1/m0.js' UNION ALL SELECT 'imported_by', source_file FROM pairs WHERE target_file = 'src/brand1/m0.js' UNION ALL SELECT 'defines', name FROM nodes WHERE file = 'src/brand1/m0.js'", extra=_IMPORTS)
def _(n, e, spark, d):
    return reports.file_deps(n, e, "src/brand1/m0.js").select("relation", "name")


@query("file_exports", "SELECT n.id, n.name, n.kind, count(u.consumer) AS consumers, count(u.consumer) > 0 AS used FROM nodes n LEFT JOIN (SELECT DISTINCT e.target_id AS id, CASE WHEN e.kind <> 'calls' THEN s.file ELSE s.name END AS consumer, s.file, e.kind <> 'calls' AS via FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind IN ('calls', 'imports', 'imports-type') AND s.file <> t.file) u USING (id) WHERE n.exported = 1 AND n.file = 'src/brand1/m1.js' GROUP BY ALL")
def _(n, e, spark, d):
    return reports.exports(n, e, "src/brand1/m1.js")


@query("fn_deps", "SELECT root AS id, 'caller' AS relation, CAST(min(depth) AS INT) AS depth, node AS other_id FROM walk WHERE node <> root GROUP BY root, node UNION ALL SELECT source_id, 'callee', 1, target_id FROM calls WHERE source_id IN (SELECT id FROM own) AND source_id <> target_id", extra=f"{_CALLS}, own AS (SELECT id FROM nodes WHERE kind IN ('function', 'method', 'class') AND contains(lower(name), 'c12')), walk AS (SELECT id AS root, id AS node, 0 AS depth FROM own UNION SELECT w.root, c.source_id, w.depth + 1 FROM walk w JOIN calls c ON c.target_id = w.node WHERE w.depth < 2)")
def _(n, e, spark, d):
    return reports.fn_deps(n, e, "c12", 2).select("id", "relation", "depth", "other_id")


@query("brief", "SELECT f.file, coalesce(s.symbols, 0) AS symbols, CAST(coalesce(s.callers, 0) AS BIGINT) AS callers, coalesce(i.importers, 0) AS importers, CASE WHEN coalesce(most, 0) >= 10 OR coalesce(core, 0) = 1 THEN 'high' WHEN coalesce(most, 0) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM files f LEFT JOIN (SELECT file, count(*) AS symbols, sum(c) AS callers, max(c) AS most, max((role = 'core')::INT) AS core FROM (SELECT o.file, o.role, (SELECT count(DISTINCT node) FROM walk w WHERE w.root = o.id AND w.node <> o.id) AS c FROM own o) GROUP BY 1) s USING (file) LEFT JOIN (SELECT target_file AS file, count(*) AS importers FROM pairs GROUP BY 1) i USING (file)", extra=f"{_CALLS}, {_IMPORTS}, files AS (SELECT DISTINCT file FROM nodes WHERE id % 100 = 0), own AS (SELECT id, file, role FROM nodes WHERE kind IN ('function', 'method', 'class') AND file IN (SELECT file FROM files)), walk AS (SELECT id AS root, id AS node, 0 AS depth FROM own UNION SELECT w.root, c.source_id, w.depth + 1 FROM walk w JOIN calls c ON c.target_id = w.node WHERE w.depth < 1)")
def _(n, e, spark, d):
    return reports.brief(n, e, n.filter("id % 100 = 0").select("file").distinct(), 1)


@query("structure", "SELECT d.directory, d.files, d.symbols, round(d.symbols / d.files, 6) AS density FROM (SELECT directory, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols FROM dirs JOIN (SELECT file, count(*) AS symbols FROM nodes GROUP BY 1) USING (file) GROUP BY 1) d WHERE d.directory <> 'src'", extra=_DIRS)
def _(n, e, spark, d):
    return reports.structure(n, e).filter("directory <> 'src'").select("directory", "files", "symbols", F.round("density", 6).alias("density"))


# 2.J co-change


_PAIRS = f"{star.COMMITS}, uniq AS (SELECT DISTINCT sha, epoch, file FROM commits), small AS (SELECT sha FROM uniq GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), fc AS (SELECT file, count(*) AS n FROM commits GROUP BY 1), pc AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS commit_count, max(a.epoch) AS last_commit_epoch FROM uniq a JOIN uniq b ON a.sha = b.sha AND a.file < b.file WHERE a.sha IN (SELECT sha FROM small) GROUP BY 1, 2)"


@query("co_changes", "SELECT file_a, file_b, commit_count, round(commit_count / (x.n + y.n - commit_count), 6) AS jaccard, last_commit_epoch FROM pc JOIN fc x ON x.file = file_a JOIN fc y ON y.file = file_b WHERE commit_count >= 3", prelude=False, extra=_PAIRS)
def _(spark, d):
    return changes.co_changes(star.commits(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query("file_commit_counts", "SELECT file, count(*) AS commit_count FROM commits GROUP BY 1", prelude=False, extra=star.COMMITS)
def _(spark, d):
    return changes.file_commit_counts(star.commits(spark, d))


@query("co_change_partners", "SELECT CASE WHEN file_a = 'Brand#7' THEN file_b ELSE file_a END AS file, commit_count, round(commit_count / (x.n + y.n - commit_count), 6) AS jaccard FROM pc JOIN fc x ON x.file = file_a JOIN fc y ON y.file = file_b WHERE commit_count >= 3 AND (file_a = 'Brand#7' OR file_b = 'Brand#7') ORDER BY round(commit_count / (x.n + y.n - commit_count), 6) DESC, 1 LIMIT 10", prelude=False, extra=_PAIRS)
def _(spark, d):
    pairs = changes.co_changes(star.commits(spark, d)).withColumn("jaccard", F.round("jaccard", 6))
    return changes.partners(pairs, "Brand#7", 0.0, 10)


# 2.K scalars


@query("path_scalars", "SELECT DISTINCT file, 'src/' || split_part(file, '/', 2) AS directory, CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.rs' THEN 'rust' ELSE 'javascript' END AS family, 2 AS ancestors FROM nodes")
def _(n, e, spark, d):
    c = F.col("file")
    return n.select("file", S.directory(c).alias("directory"), S.language_family(c).alias("family"), F.size(S.ancestor_dirs(c)).alias("ancestors")).distinct()


@query("edge_confidence", "SELECT DISTINCT a.file AS source_file, b.file AS target_file, CAST(CASE WHEN a.file = b.file THEN 1.0 WHEN (a.file LIKE '%.py') <> (b.file LIKE '%.py') OR (a.file LIKE '%.rs') <> (b.file LIKE '%.rs') THEN 0.0 WHEN split_part(a.file, '/', 2) = split_part(b.file, '/', 2) THEN 0.7 ELSE 0.5 END AS DOUBLE) AS score FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.kind = 'extends'")
def _(n, e, spark, d):
    rows = lookup.with_ends(e.filter("kind = 'extends'"), n, "file")
    return rows.select("source_file", "target_file", S.confidence(F.col("source_file"), F.col("target_file")).cast("double").alias("score")).distinct()


@query("identifier_words", "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS words, CAST(ceil(length(name) / 4) AS BIGINT) AS tokens FROM nodes")
def _(n, e, spark, d):
    return n.select("id", S.split_identifier(F.col("name")).alias("words"), S.estimate_tokens(F.col("name")).alias("tokens"))


@query("halstead", "SELECT id, round(v, 6) AS volume, round(dd * v, 6) AS effort, floor(least(100, greatest(0, (171 - 5.2 * ln(v) - 0.23 * cyc - 16.2 * ln(sloc)) * 100 / 171)) * 10 + 0.5) / 10 AS mi FROM (SELECT p_partkey AS id, (p_size * 3 + 7) * log2(p_size + 5) AS v, (p_size / 2) * ((p_size + 7) / 5) AS dd, p_size % 17 + 1 AS cyc, p_size + 3 AS sloc FROM part)", prelude=False)
def _(spark, d):
    p = star.table(spark, d, "part")
    size = F.col("p_size")
    h = S.halstead(size, F.lit(5), size * 2, size + 7)
    return p.select(F.col("p_partkey").alias("id"), F.round(h["volume"], 6).alias("volume"), F.round(h["effort"], 6).alias("effort"), S.maintainability_index(h["volume"], size % 17 + 1, size + 3).alias("mi"))


@query("epoch_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders", prelude=False)
def _(spark, d):
    o = star.table(spark, d, "orders").selectExpr("o_orderkey", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS epoch")
    return o.select("o_orderkey", S.epoch_date(F.col("epoch")).alias("day"))


# 2.O search


@query("keyword_search", "SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM (SELECT h.*, count(*) OVER (PARTITION BY term) AS df, n, avg_len FROM (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len, unnest(ts) AS term FROM own) WHERE term IN ('thedin', 'shthble') GROUP BY ALL) h, (SELECT count(*) AS n, avg(len) AS avg_len FROM own)) GROUP BY 1", prelude=False, extra="own AS (SELECT doc_id AS id, ts, len(ts) AS len FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM documents))")
def _(spark, d):
    found = search.bm25(star.table(spark, d, "documents"), "doc_id", "text", "thedin OR (and) shthble")
    return found.select("id", F.round("score", 6).alias("score"))


_COSINE = "cos AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"


def _similar(spark, d):
    v = star.table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found = search.semantic(v, q, "vec_id", "embedding", 0.2 - 1e-6)  # no score that rounds up to 0.2 is lost
    return found.withColumn("score", F.round("score", 6)).filter("score >= 0.2")


@query("semantic_search", "SELECT query, id, score FROM cos WHERE score >= 0.2", prelude=False, extra=_COSINE)
def _(spark, d):
    return _similar(spark, d)


@query("fused_search", "SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*) AS lists FROM (SELECT id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM cos WHERE score >= 0.2) WHERE rank <= 75 GROUP BY 1", prelude=False, extra=_COSINE)
def _(spark, d):
    return search.fuse(search.ranked(_similar(spark, d), 75)).withColumn("rrf", F.round("rrf", 9))


# 2.P export


@query("export_dot", "SELECT '  \"' || source_file || '\" -> \"' || target_file || '\";' AS line FROM pairs", extra=_IMPORTS)
def _(n, e, spark, d):
    return export.dot(lookup.file_edges(e, n), "source_file", "target_file")


@query("export_neo4j", "SELECT source_id AS \":START_ID\", target_id AS \":END_ID\", upper(replace(kind, '-', '_')) AS \":TYPE\", confidence AS \"confidence:float\" FROM edges")
def _(n, e, spark, d):
    return export.neo4j_relationships(e)


@query("directory_groups", "SELECT 'src/' || split_part(file, '/', 2) AS directory, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT DISTINCT file FROM nodes) GROUP BY 1")
def _(n, e, spark, d):
    return export.directory_groups(n).select("directory", F.array_join("files", ",").alias("files"))


from . import detail_queries  # noqa: E402,F401  (registers more)
