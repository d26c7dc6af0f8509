"""Architectural roles: one ordered chain of conditions, then the reachability
downgrade.

Files, directories, parameters and fields of classes have no role: that nothing calls them says nothing about them.
Members of interfaces and other type declarations are leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import cut
from .lookup import fan_out, with_ends
from .traverse import reach

TYPE_KINDS = ("struct", "enum", "trait", "type", "interface", "record")
ANNOTATION_KINDS = ("constant", *TYPE_KINDS)
NO_FAN_KINDS = ("file", "directory", "parameter", "property")
USES = ("calls", "imports-type")
_ENTRY_PATH = r"cli[/\\]commands[/\\]|mcp[/\\]|routes?[/\\]|handlers?[/\\]|middleware[/\\]"


def dead_role() -> Column:
    """Row 208: leaf before ffi before entry before unresolved."""
    return (
        F.when(F.col("kind").isin("parameter", "property", "constant"), "dead-leaf")
        .when(F.col("file").rlike(r"\.(rs|c|cpp|h|go|java|cs)$"), "dead-ffi")
        .when(F.col("file").rlike(_ENTRY_PATH), "dead-entry")
        .otherwise("dead-unresolved")
    )


def _id(column: str) -> Column:
    return F.col(column).alias("id")


def production_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row 181: (id) of what files outside tests import, and of what those re-export, in any number of steps."""
    files = nodes.filter((F.col("kind") == "file") & ~S.is_test_path_like(F.col("file"))).select(F.col("id").alias("source_id"))
    imported = edges.filter(F.col("kind").isin("imports", "dynamic-imports", "imports-type")).join(files, "source_id", "left_semi")
    starts = imported.select(F.lit(0).cast("long").alias("root"), F.col("target_id").alias("node"))
    return reach(edges.filter("kind = 'reexports'"), starts).select(F.col("node").alias("id")).distinct()


def surface(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of (id): symbols that production barrels re-export in any way, and those they surely do.

    A re-export of a file counts for all its top-level symbols in the first; in the second only a wildcard does, and a
    named one counts for the symbol that it names.
    """
    reachable = production_reachable(nodes, edges).select(F.col("id").alias("source_id"))
    from_barrels = lambda kind: edges.filter(F.col("kind") == kind).join(reachable, "source_id", "left_semi").select(_id("target_id")).distinct()
    top = nodes.filter(~F.col("kind").isin(*NO_FAN_KINDS, "method"))

    def of_files(ids: DataFrame) -> DataFrame:
        return top.join(nodes.filter("kind = 'file'").join(ids, "id", "left_semi").select("file").distinct(), "file", "left_semi").select("id")

    named = from_barrels("reexports")
    sure = named.join(nodes.filter("kind <> 'file'"), "id", "left_semi").unionByName(of_files(from_barrels("reexports-wildcard")))
    return of_files(named).distinct(), sure.distinct()


def type_names(nodes: DataFrame) -> DataFrame:
    """Row 383: (file, owner): the type declarations of each file."""
    return nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select("file", F.col("name").alias("owner")).distinct()


def inputs(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Row 212: the nodes to classify with fan_in, fan_out, production_fan_in, is_exported, public_surface, active (has
    active siblings) and type_member. files restricts them to those of some files, as the incremental driver does.

    Exported is what says so, what another file uses, and what production barrels re-export; the public surface leaves
    the second out. Columns entrypoint and entrypoint_role of nodes count if they are there.
    """
    # Every part of this reads the edges, which may cost a sort of the whole input to make.
    edges = cut(edges.select("source_id", "target_id", "kind"))
    wanted = nodes if files is None else nodes.join(files, "file", "left_semi")
    own = wanted.filter(~F.col("kind").isin(*NO_FAN_KINDS) | (F.col("kind") == "property"))
    own = own.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c in nodes.columns else F.lit(0) for c in ("entrypoint", "entrypoint_role")})
    if files is not None:
        edges_in, edges_out = (edges.join(own.select(F.col("id").alias(c)), c, "left_semi") for c in ("target_id", "source_id"))
    else:
        edges_in = edges_out = edges
    uses = with_ends(edges_in.filter(F.col("kind").isin(*USES)).select("source_id", "target_id"), nodes, "file")
    test, crosses = S.is_test_path_like(F.col("source_file")).cast("int"), (F.col("source_file") != F.col("target_file")).cast("int")
    fans = uses.groupBy(_id("target_id")).agg(F.count(F.lit(1)).alias("fan_in"), F.sum(1 - test).alias("production_fan_in"), F.max(crosses).alias("crossed"))
    own = own.join(fans, "id", "left").join(fan_out(edges_out), "id", "left")
    own = own.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "production_fan_in", "fan_out", "crossed")})
    loose, sure = (x.withColumn(c, F.lit(True)) for x, c in zip(surface(nodes, edges), ("barrel", "public")))
    own = own.join(loose, "id", "left").join(sure, "id", "left")
    says = F.coalesce(F.col("exported"), F.lit(0)) == 1
    own = own.withColumns({"is_exported": says | (F.col("crossed") == 1) | F.col("barrel").isNotNull(), "public_surface": says | F.col("public").isNotNull()})

    # Siblings count by calls, and those that are used without calls (constants, types) not at all. A function's own
    # outgoing calls must not make its file active for itself.
    fanned = own.filter(~F.col("kind").isin(*ANNOTATION_KINDS, "property") & ((F.col("fan_in") > 0) | (F.col("fan_out") > 0)))
    sides = fanned.groupBy("file").agg(F.lit(True).alias("busy"), (F.max("fan_in") > 0).alias("called"))
    own = own.join(sides, "file", "left")
    active = F.when(F.col("kind").isin(*ANNOTATION_KINDS), F.col("busy")).when(F.col("kind").isin("method", "function"), F.col("called"))
    own = own.withColumn("owner", F.when(F.col("kind").isin("method", "property") & F.col("name").contains("."), F.substring_index("name", ".", 1)))
    own = own.join(type_names(wanted).withColumn("typed", F.lit(True)), ["file", "owner"], "left")
    own = own.withColumns({"active": F.coalesce(active, F.lit(False)), "type_member": F.coalesce("typed", F.lit(False))})
    return own.filter("kind <> 'property' OR type_member").drop("typed", "owner", "busy", "called", "barrel", "public", "crossed")


def fan_medians(rows: DataFrame) -> DataFrame:
    """One row (mi, mo): medians of non-zero fans, 0 without any."""
    own = rows.filter("kind <> 'property'")
    return own.agg(*[F.coalesce(F.median(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(k) for c, k in (("fan_in", "mi"), ("fan_out", "mo"))])


def classify(rows: DataFrame, edges: DataFrame | None = None, medians: DataFrame | None = None) -> DataFrame:
    """Rows 205-211, 381-382: (id, name, kind, file, fan_in, fan_out, role). The order of the conditions is the semantics.

    rows come from inputs(); edges, if given, are those of the reachability downgrade. Medians are of rows, if not given.
    """
    rows = cut(rows) if medians is None or edges is not None else rows  # read for the medians, too, and for the roots
    framework = F.col("name").rlike("^(route|event|command):")
    dispatched = F.col("name").isin("execute", "validate") & F.col("file").rlike(_ENTRY_PATH)
    rescued = F.col("active") & (F.col("kind").isin(*ANNOTATION_KINDS) | F.col("kind").isin("method", "function") & (F.col("fan_out") > 0))
    high_in, high_out = F.col("fan_in") >= F.col("mi"), (F.col("fan_out") >= F.col("mo")) & (F.col("fan_out") > 0)
    callable_ = F.col("kind").isin("function", "method")
    role = (
        F.when(F.col("file").rlike(r"\.(tf|hcl)$") | F.col("type_member"), "leaf")
        .when(framework | (F.col("entrypoint_role") == 1), "entry")
        .when((F.col("fan_in") == 0) & ~F.col("is_exported"), F.when(dispatched, "entry").when(rescued, "leaf").otherwise(dead_role()))
        .when(F.col("fan_in") == 0, F.when(callable_, "entry").otherwise("leaf"))
        .when((F.col("production_fan_in") == 0) & ~F.col("is_exported"), "test-only")
        .when(high_in & ~high_out, "core").when(high_in & high_out, "utility").when(high_out, "adapter").otherwise("leaf")
    )
    out = rows.crossJoin(F.broadcast(fan_medians(rows) if medians is None else medians)).withColumn("role", role).drop("mi", "mo")
    if edges is not None:
        out = _downgraded(out, edges, framework | (F.col("entrypoint") == 1) | callable_ & (F.col("public_surface") | dispatched))
    return out.select("id", "name", "kind", "file", "fan_in", "fan_out", "role")


def _downgraded(out: DataFrame, edges: DataFrame, root: Column) -> DataFrame:
    """Rows 209-210: functions and methods with callers that no live root reaches are dead after all."""
    callable_ = F.col("kind").isin("function", "method")
    bare = F.when(F.col("name").contains("."), F.expr("substring(name, locate('.', name) + 1)")).otherwise(F.col("name"))
    named = out.withColumn("bare", bare)
    declared = named.filter("type_member AND kind = 'method'").select("bare").distinct()
    dispatch = named.filter("kind = 'method' AND fan_in = 0 AND fan_out > 0 AND active AND NOT type_member").join(declared, "bare", "left_semi")
    calls = cut(edges.filter("kind = 'calls'").select("source_id", "target_id").distinct())
    # Code that is no function's runs when its file is loaded.
    outside = calls.select(F.col("source_id").alias("node")).distinct().join(out.filter(callable_).select(F.col("id").alias("node")), "node", "left_anti")
    roots = out.filter(~F.col("type_member") & root).select(F.col("id").alias("node")).unionByName(dispatch.select(F.col("id").alias("node"))).unionByName(outside)
    live = reach(calls, roots.distinct().select(F.lit(0).cast("long").alias("root"), "node")).select(_id("node")).distinct().withColumn("live", F.lit(True))
    lost = callable_ & (F.col("fan_in") > 0) & ~F.col("type_member") & F.col("role").isin("core", "utility", "adapter", "leaf") & F.col("live").isNull()
    return out.join(live, "id", "left").withColumn("role", F.when(lost, dead_role()).otherwise(F.col("role")))


def incremental(nodes: DataFrame, edges: DataFrame, changed: DataFrame, medians: DataFrame) -> DataFrame:
    """Row 213: roles of the symbols of changed files (file) and of their neighbours', by medians kept from a full run.
    Reachability is a property of the whole graph and is left to that."""
    ends = with_ends(edges.filter(F.col("kind").isin(*USES, "reexports")).select("source_id", "target_id"), nodes, "file", "kind")
    sides = []
    for here, there in (("source", "target"), ("target", "source")):
        at = ends.join(changed.select(F.col("file").alias(f"{here}_file")), f"{here}_file", "left_semi")
        sides.append(at.filter(~F.col(f"{there}_kind").isin("file", "directory")).select(F.col(f"{there}_file").alias("file")))
    files = sides[0].unionByName(sides[1]).unionByName(changed.select("file")).distinct()
    return classify(inputs(nodes, edges, files), medians=medians)


def role_counts(classified: DataFrame) -> DataFrame:
    """Rows 55, 112: (role, n), with a line 'dead' for all dead roles together."""
    own = classified.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    dead = own.filter(F.col("role").startswith("dead")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("dead").alias("role"), "n")
    return own.unionByName(dead)
