"""Build a graph from parsed facts: rows of nodes, complexity, flow, and what link.py ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.parse import exploded
from ..storage import cut
from . import link


def node_rows(facts: DataFrame) -> DataFrame:
    """Row 25: file nodes and definitions; ids are hashes of the natural key."""
    files = facts.select("file", F.col("file").alias("name"), F.lit("file").alias("kind"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("exported"))
    defs = exploded(facts, "defs").select("file", "name", "kind", "line", "end_line", "parent", "exported")
    rows = files.unionByName(defs).dropDuplicates(["name", "kind", "file", "line"]).withColumn("id", F.xxhash64("name", "kind", "file", "line"))
    owners = rows.filter(F.col("kind").isin("class", "interface", "struct", "trait", "module", "enum", "record")).groupBy("file", F.col("name").alias("parent")).agg(F.min("id").alias("parent_id"))
    return rows.join(owners, ["file", "parent"], "left").select("id", "name", "kind", "file", "line", "end_line", "parent_id", "exported", F.col("name").alias("qualified_name"), F.col("parent").alias("scope"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("string").alias("role"))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """Rows 25, 120: files contain their top definitions, types their members."""
    ids = nodes.filter("kind = 'file'").select("file", F.col("id").alias("file_id"))
    rows = nodes.filter("kind <> 'file'").join(ids, "file").select(F.coalesce("parent_id", "file_id").alias("source_id"), F.col("id").alias("target_id"))
    return link.edge_rows(rows, "contains", F.lit(1.0))


def complexity_rows(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 30."""
    own = exploded(facts, "defs").filter("cyclomatic IS NOT NULL")
    return own.join(nodes.select(F.col("id").alias("node_id"), "file", "name", "line"), ["file", "name", "line"]).select("node_id", "cognitive", "cyclomatic", "max_nesting", "loc", "sloc", F.col("comments").alias("comment_lines"), F.col("volume").alias("halstead_volume"), F.col("effort").alias("halstead_effort"), (F.col("volume") / 3000).alias("halstead_bugs"), F.col("mi").alias("maintainability_index"))


def dataflow_rows(facts: DataFrame, nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """Row 32: function-level facts, ends found by what the file imports under their name, by their full name in the file,
    by the last part of it there, then by either anywhere. Every step is an equi-join with one row a name."""
    flows = cut(exploded(facts, "flows").withColumn("n", F.monotonically_increasing_id()))
    ids = nodes.filter(F.col("kind").isin("function", "method")).select("id", F.col("file").alias("d_file"), "name", F.element_at(F.split("name", r"\."), -1).alias("bare"))
    here = ids.select("d_file", F.col("name").alias("key"), F.lit(0).alias("rank"), "id").unionByName(ids.select("d_file", F.col("bare").alias("key"), F.lit(1).alias("rank"), "id"))
    here = here.groupBy("d_file", "key").agg(F.min(F.struct("rank", "id")).alias("here"))
    there = here.groupBy("key").agg(F.min(F.struct("here.rank", "d_file", "here.id")).alias("there"))

    def end(df: DataFrame, column: str) -> DataFrame:
        last = F.element_at(F.split(column, r"\."), -1)
        names = bound.filter("NOT space").groupBy("file", F.col("local").alias(column)).agg(F.min(F.struct("target", "original")).alias("b")).select("file", column, F.col("b.target").alias("of_file"), F.col("b.original").alias("of_name"))
        far = names.join(here.select(F.col("d_file").alias("of_file"), F.col("key").alias("of_name"), F.col("here.id").alias("imported")), ["of_file", "of_name"]).select("file", column, "imported")
        out = df.withColumn("last", last).join(far, ["file", column], "left")
        for key in (column, "last"):
            out = out.join(here.select(F.col("d_file").alias("file"), F.col("key").alias(key), F.col("here.id").alias(f"in_{key}")), ["file", key], "left")
        for key in (column, "last"):
            out = out.join(there.select(F.col("key").alias(key), F.col("there.id").alias(f"at_{key}")), key, "left")
        found = F.coalesce("imported", f"in_{column}", "in_last", f"at_{column}", "at_last")
        return out.withColumn(f"{column}_id", found).filter(F.col(f"{column}_id").isNotNull()).select(*df.columns, f"{column}_id")

    rows = end(end(flows, "source"), "target")
    return rows.select("source_id", "target_id", "kind", F.col("param").alias("param_index"), "expression", "line", F.lit(1.0).alias("confidence"))


def linked(facts: DataFrame, nodes: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, packages: dict[str, str] | None = None, only: DataFrame | None = None, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All edges of a graph: rows 286-303. With only (file), those from these files are made, and kept are the others.
    Also what the files' imports bind."""
    wanted = facts if only is None else cut(facts.join(only, "file", "left_semi"))
    resolved = cut(link.resolve_imports(facts, files, aliases, packages))
    bound = cut(link.bound_names(resolved, nodes))
    here = (lambda df: df) if only is None else (lambda df: df.join(only, "file", "left_semi"))
    fresh = cut(link.hierarchy_edges(wanted, nodes, bound))
    hierarchy = fresh if kept is None else fresh.unionByName(kept.filter("kind IN ('extends', 'implements')"))
    calls = link.call_edges(link.call_targets(facts, nodes, bound, hierarchy, only), nodes)
    edges = link.import_edges(here(resolved), here(bound), nodes).unionByName(calls).unionByName(fresh).unionByName(link.receiver_edges(wanted, nodes, bound))
    edges = cut(edges.unionByName(contains_edges(here(nodes))))
    edges = edges if kept is None else cut(edges.unionByName(kept).distinct())
    return cut(edges.unionByName(link.cha_edges(nodes, edges))), bound


def tables_of_files(facts: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """The tables whose rows depend on their own file only."""
    b, j = exploded(facts, "blocks"), exploded(facts, "jumps")
    of = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("function_id"), "file", F.col("name").alias("func"))
    return {
        "function_complexity": complexity_rows(facts, nodes),
        "cfg_blocks": b.join(of, ["file", "func"]).select("function_id", F.col("idx").alias("block_index"), F.col("kind").alias("block_type"), F.col("start").alias("start_line"), F.col("stop").alias("end_line"), F.lit(None).cast("string").alias("label")),
        "cfg_edges": j.join(of, ["file", "func"]).select("function_id", F.col("source").alias("source_block"), F.col("target").alias("target_block"), "kind"),
        "ast_nodes": exploded(facts, "nodes").select("file", "line", "kind", "name", F.col("name").alias("text"), F.lit(None).cast("long").alias("parent_id")),
    }


def build(files: DataFrame, facts: DataFrame, aliases: dict[str, str] | None = None, packages: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Section 3.1: the tables of a graph from (file, content, hash, mtime, size) and their facts. aliases are path aliases,
    packages the entry files of the workspace's packages."""
    facts = cut(facts)
    nodes = cut(node_rows(facts))
    edges, bound = linked(facts, nodes, files.select("file"), aliases, packages)
    return {"nodes": nodes, "edges": edges, "file_hashes": files.select("file", "hash", "mtime", "size"), "facts": facts, "dataflow": dataflow_rows(facts, nodes, bound)} | tables_of_files(facts, nodes)


def affected_files(facts: DataFrame, changed: DataFrame, nodes: DataFrame, before: DataFrame, resolved_pairs: DataFrame) -> DataFrame:
    """Rows 305, 314: (file) of the files whose edges a change can touch: those changed, those that import them in any
    number of steps, those that say a name which they define or defined, and those with types below theirs.

    facts and nodes are as they are now, before the nodes before; resolved_pairs are (source_file, target_file).
    """
    defined = nodes.select("file", "name").unionByName(before.select("file", "name")).join(changed, "file", "left_semi")
    names = cut(defined.select(F.explode(F.array("name", F.element_at(F.split("name", r"\."), -1))).alias("said")).distinct())
    last = lambda c: F.element_at(F.split(c, r"[.:/]+"), -1)
    said = [exploded(facts, "calls").select("file", F.explode(F.array("name", "receiver")).alias("said")), exploded(facts, "bases").select("file", last("base").alias("said")), exploded(facts, "imports").select("file", F.col("name").alias("said"))]
    said += [exploded(facts, "flows").select("file", F.explode(F.array("source", "target", last("source"), last("target"))).alias("said")), exploded(facts, "types").select("file", F.explode(F.array(last("type"), last("source"))).alias("said"))]
    rows = said[0]
    for x in said[1:]:
        rows = rows.unionByName(x)
    out = cut(changed.unionByName(rows.join(names, "said", "left_semi").select("file")).distinct())
    while True:
        more = resolved_pairs.join(out.withColumnRenamed("file", "target_file"), "target_file", "left_semi").select(F.col("source_file").alias("file"))
        fresh = cut(more.distinct().join(out, "file", "left_anti"))
        if fresh.isEmpty():
            return out
        out = cut(out.unionByName(fresh))


def rebuild(old: dict[str, DataFrame], files: DataFrame, changed: DataFrame, fresh: DataFrame, aliases: dict[str, str] | None = None, packages: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Rows 267, 305, 313-314, 392: the tables after a change, equal to those of a full build. old are the tables before, files
    (file, hash, mtime, size) all files that there are now, changed (file) those changed, added or removed, and fresh the
    facts of those that are still there. Only they are parsed, and only affected files are linked anew."""
    unchanged = lambda df: df.join(changed, "file", "left_anti")
    facts = cut(unchanged(old["facts"]).unionByName(fresh))
    fresh_nodes = cut(node_rows(fresh))
    nodes = cut(unchanged(old["nodes"]).select(fresh_nodes.columns).unionByName(fresh_nodes))
    now = link.resolve_imports(facts, files.select("file"), aliases, packages).select(F.col("file").alias("source_file"), F.col("resolved").alias("target_file"))
    was = old["edges"].filter(F.col("kind").isin("imports", "imports-type", "dynamic-imports", "reexports", "reexports-wildcard", "extends", "implements"))
    of = old["nodes"].select("id", "file")
    was = was.join(of.select(F.col("id").alias("source_id"), F.col("file").alias("source_file")), "source_id").join(of.select(F.col("id").alias("target_id"), F.col("file").alias("target_file")), "target_id")
    touched = affected_files(facts, changed.select("file"), nodes, old["nodes"], cut(now.unionByName(was.select("source_file", "target_file")).distinct()))
    sources = old["nodes"].join(touched, "file", "left_anti").select(F.col("id").alias("source_id"))
    kept = cut(old["edges"].filter("technique IS NULL OR technique <> 'cha'").join(sources, "source_id", "left_semi"))
    edges, bound = linked(facts, nodes, files.select("file"), aliases, packages, touched, kept.select("source_id", "target_id", "kind", "confidence", "dynamic", "technique", "dynamic_kind"))
    ids = unchanged(old["nodes"]).select("id")
    # Flows are joins of names with definitions, and any definition may be nearer now: all of them.
    out = {"nodes": nodes, "edges": edges, "file_hashes": files.select("file", "hash", "mtime", "size"), "facts": facts, "dataflow": dataflow_rows(facts, nodes, bound)}
    for name, df in tables_of_files(fresh, fresh_nodes).items():
        key = next((c for c in ("node_id", "function_id") if c in df.columns), None)
        before = unchanged(old[name]) if key is None else old[name].join(ids.withColumnRenamed("id", key), key, "left_semi")
        out[name] = before.select(df.columns).unionByName(df)
    return out
