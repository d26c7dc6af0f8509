"""Derived graphs, advisories, texts for embedding, entry points and enrichment."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import community, lookup, metrics


def temporal_graph(pairs: DataFrame, min_jaccard: float = 0.3) -> DataFrame:
    """Row 237: undirected (source_id, target_id, weight) of co-changed files."""
    return pairs.filter(F.col("jaccard") >= min_jaccard).select(F.col("file_a").alias("source_id"), F.col("file_b").alias("target_id"), F.col("jaccard").alias("weight"))


def structure_graph(files: DataFrame) -> DataFrame:
    """Rows 120, 238: (parent, child): each directory contains its directories and files."""
    chain = F.concat(S.ancestor_dirs(F.col("file")), F.array("file"))
    steps = F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain)), lambda a, b: F.struct(a.alias("parent"), b.alias("child")))
    return files.select("file").distinct().select(F.explode(steps).alias("s")).select("s.parent", "s.child").distinct()


def record_advisories(nodes: DataFrame, edges: DataFrame, removed: DataFrame, deleted_at: int) -> DataFrame:
    """Row 225: exported symbols of removed files and who used them, to be kept before the files' rows are purged."""
    rows = lookup.with_ends(edges.filter(F.col("kind").isin("calls", "imports", "imports-type")), nodes, "name", "file", "kind", "line", "exported").filter("target_exported = 1")
    rows = rows.join(removed.select(F.col("file").alias("target_file")), "target_file", "left_semi").filter("source_file <> target_file")
    return rows.select(F.col("target_file").alias("file"), F.col("target_name").alias("name"), F.col("target_kind").alias("kind"), F.col("target_line").alias("line"), F.col("source_name").alias("consumer_name"), F.col("source_file").alias("consumer_file"), F.lit(deleted_at).cast("long").alias("deleted_at")).distinct()


def advisories(recorded: DataFrame, deleted_consumers: DataFrame) -> DataFrame:
    """Row 362: (file, name, kind, line, consumers) without consumers that are deleted themselves."""
    kept = recorded.join(deleted_consumers.select(F.col("file").alias("consumer_file")), "consumer_file", "left_anti")
    return kept.groupBy("file", "name", "kind", "line").agg(F.array_sort(F.collect_set(F.concat_ws(":", "consumer_file", "consumer_name"))).alias("consumers"))


def clear_advisories(recorded: DataFrame, returned: DataFrame) -> DataFrame:
    """Row 363: a file that is back needs none."""
    return recorded.join(returned.select("file"), "file", "left_anti")


def source_text(nodes: DataFrame, files: DataFrame, lines: int = 60) -> DataFrame:
    """Row 330: (id, text): name, place and the first lines of each symbol."""
    own = files.select("file", F.split(F.decode("content", "UTF-8"), "\n").alias("ls"))
    body = F.array_join(F.expr(f"slice(ls, line, least({lines}, greatest(1, coalesce(end_line, line) - line + 1)))"), "\n")
    return nodes.filter("line > 0").join(own, "file").select("id", F.concat_ws("\n", F.concat_ws(" ", "kind", S.split_identifier(F.col("name"))), F.concat(F.lit("file: "), "file"), body).alias("text"))


def structured_text(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Row 331: (id, text): kind and words of the name, file, at most `limit` callees and callers in order of name."""
    out = nodes.filter("kind <> 'file'")
    for label, direction in (("calls", True), ("called by", False)):
        names = lookup.neighbour_names(edges, nodes, direction, limit).select("id", F.concat(F.lit(f"{label}: "), F.array_join("names", ", ")).alias(label))
        out = out.join(names, "id", "left")
    return out.select("id", F.concat_ws("\n", F.concat_ws(" ", "kind", S.split_identifier(F.col("name"))), F.concat(F.lit("file: "), "file"), "calls", "called by").alias("text"))


def enriched(nodes: DataFrame, edges: DataFrame, complexity: DataFrame) -> DataFrame:
    """Row 341: symbols with fans, community and risk flags, for a viewer."""
    own = nodes.select("id", "name", "kind", "file").join(metrics.degree(edges), "id", "left").fillna(0, ["fan_in", "fan_out"])
    groups = community.communities(lookup.simple_graph(edges)).select(F.col("node").alias("id"), "community")
    rows = own.join(groups, "id", "left").join(complexity.select(F.col("node_id").alias("id"), "cognitive", "maintainability_index"), "id", "left")
    flags = F.array_compact(F.array(F.when(F.col("cognitive") >= 15, "high-complexity"), F.when(F.col("maintainability_index").between(0.1, 20), "low-maintainability"), F.when(F.col("fan_in") >= 10, "high-fan-in")))
    return rows.withColumn("flags", flags)


def pyproject_scripts(text: str) -> list[tuple[str, str]]:
    """Row 407: (module path, function) of the console scripts of a pyproject file."""
    project = tomllib.loads(text)
    scripts = project.get("project", {}).get("scripts", {}) | project.get("tool", {}).get("poetry", {}).get("scripts", {})
    return [(m.replace(".", "/") + ".py", f) for m, _, f in (str(x).partition(":") for x in scripts.values()) if f]


def mark_entrypoints(nodes: DataFrame, scripts: list[tuple[str, str]]) -> DataFrame:
    """Rows 306, 407: nodes with `entrypoint` for the functions that scripts name; the list is that of one project file."""
    hit = F.lit(False)
    for path, function in scripts:
        hit = hit | ((F.col("file") == path) | F.col("file").endswith("/" + path)) & (F.col("name") == function)
    return nodes.withColumn("entrypoint", hit)


def stream(df: DataFrame, limit: int | None = None, offset: int = 0, order: list | None = None) -> Iterator[Row]:
    """Rows 353, 356-358: rows one partition at a time, the driver never holding more."""
    rows = df.orderBy(*order) if order else df
    rows = rows.offset(offset) if offset else rows
    return (rows if limit is None else rows.limit(limit)).toLocalIterator()
