"""Projections, filters, joins and lookups over nodes and edges.

nodes and edges are DataFrames of schema.TABLES. Edges are a multigraph: parallel edges stay unless an operator says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S

CALLABLE = ("function", "method", "class")


def fan_in(edges: DataFrame, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """Row 99: (id, fan_in), parallel edges counted; aggregated before any join."""
    return edges.filter(F.col("kind").isin(*kinds)).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))


def fan_out(edges: DataFrame, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """Row 100."""
    return edges.filter(F.col("kind").isin(*kinds)).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))


class NodeQuery:
    """Row 41: a fluent query over nodes; each step returns a new one."""

    def __init__(self, nodes: DataFrame, edges: DataFrame | None = None):
        self.df, self.edges = nodes, edges

    def _with(self, df: DataFrame) -> NodeQuery:
        return NodeQuery(df, self.edges)

    def where(self, condition) -> NodeQuery:
        return self._with(self.df.filter(condition))

    def kinds(self, *kinds: str) -> NodeQuery:
        return self.where(F.col("kind").isin(*kinds))

    def exclude_tests(self, enabled: bool = True) -> NodeQuery:
        return self.where(~S.is_test_path_like(F.col("file"))) if enabled else self

    def file_filter(self, *files: str) -> NodeQuery:
        return self.where(S.file_filter(F.col("file"), list(files))) if files else self

    def role(self, role: str | None) -> NodeQuery:
        """Row 47: 'dead' stands for all dead roles."""
        return self if role is None else self.where(F.col("role").startswith("dead") if role == "dead" else F.col("role") == role)

    def name_like(self, part: str) -> NodeQuery:
        return self.where(F.lower("name").contains(part.lower()))

    def with_fan_in(self) -> NodeQuery:
        return self._with(self.df.join(fan_in(self.edges), "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0))))

    def with_fan_out(self) -> NodeQuery:
        return self._with(self.df.join(fan_out(self.edges), "id", "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0))))

    def with_columns_of(self, other: DataFrame, key: str, *columns: str) -> NodeQuery:
        """Complexity or churn: a left join that turns nulls into 0."""
        joined = self.df.join(other.select(key, *columns), key, "left")
        return self._with(joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns}))

    def order_by(self, *columns) -> NodeQuery:
        return self._with(self.df.orderBy(*columns))

    def limit(self, n: int) -> NodeQuery:
        return self._with(self.df.limit(n))


def find_symbols(nodes: DataFrame, edges: DataFrame, query: str, kinds: tuple[str, ...] = CALLABLE) -> DataFrame:
    """Row 48: nodes whose name holds the query, with relevance."""
    own = NodeQuery(nodes, edges).kinds(*kinds).name_like(query).with_fan_in().df
    return own.withColumn("relevance", S.round_half_up(S.symbol_relevance(F.col("name"), query, F.col("fan_in")), 4))


def neighbours(edges: DataFrame, nodes: DataFrame, out: bool, kinds: tuple[str, ...] | None = ("calls",), distinct: bool = False) -> DataFrame:
    """Rows 64-74, 79-80: (id, edge_kind, other_id, name, kind, file, line): the nodes that id's edges lead to (out) or come from.

    Callees and distinct callers are distinct; plain callers keep parallel edges.
    """
    here, there = ("source_id", "target_id") if out else ("target_id", "source_id")
    own = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    rows = own.select(F.col(here).alias("id"), F.col(there).alias("other_id"), F.col("kind").alias("edge_kind"))
    found = rows.join(nodes.select(F.col("id").alias("other_id"), "name", "kind", "file", "line"), "other_id").select("id", "edge_kind", "other_id", "name", "kind", "file", "line")
    return found.distinct() if distinct else found


def neighbour_names(edges: DataFrame, nodes: DataFrame, out: bool, limit: int | None = None) -> DataFrame:
    """Rows 70-71, 331: (id, names): sorted distinct names."""
    names = F.array_sort(F.collect_set("name"))
    return neighbours(edges, nodes, out).groupBy("id").agg((names if limit is None else F.slice(names, 1, limit)).alias("names"))


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """edges with the named columns of both ends, as source_* and target_*."""
    ends = [nodes.select(F.col("id").alias(f"{e}_id"), *[F.col(c).alias(f"{e}_{c}") for c in columns]) for e in ("source", "target")]
    return edges.join(ends[0], "source_id").join(ends[1], "target_id")


def cross_file_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows 75-76: calls whose ends are in different files."""
    return with_ends(edges.filter("kind = 'calls'"), nodes, "name", "kind", "file", "line").filter("source_file <> target_file")


def cross_file_caller_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return cross_file_calls(edges, nodes).groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("callers"))


def external_consumers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 77: (id, consumer, consumer_file, via): a file for imports, topLevelCall for calls by a file node, else symbol."""
    rows = with_ends(edges.filter(F.col("kind").isin("calls", "imports", "imports-type")), nodes, "name", "kind", "file").filter("source_file <> target_file")
    via = F.when(F.col("kind") != "calls", "file").when(F.col("source_kind") == "file", "topLevelCall").otherwise("symbol")
    return rows.select(F.col("target_id").alias("id"), F.when(via == "symbol", F.col("source_name")).otherwise(F.col("source_file")).alias("consumer"), F.col("source_file").alias("consumer_file"), via.alias("via")).distinct()


def intra_file_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 81."""
    return with_ends(edges.filter("kind = 'calls'"), nodes, "name", "file", "line").filter("source_file = target_file").select("source_file", "source_name", "source_line", "target_name", "target_line")


def children(nodes: DataFrame) -> DataFrame:
    """Rows 53, 349: (parent_id, id, name, kind, line) of members."""
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return nodes.filter("parent_id IS NOT NULL").join(parents, "parent_id").select("parent_id", "parent_name", "id", "name", "kind", "line")


def effective_end(nodes: DataFrame) -> DataFrame:
    """Row 139: end_line, else the line before the next definition of the file, else 999999."""
    following = F.lead("line").over(W.partitionBy("file").orderBy("line", "id"))
    return nodes.withColumn("end", F.coalesce("end_line", following - 1, F.lit(999999)))


def affected(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Rows 92-93: definitions that overlap a changed range (file, start, stop) of their file."""
    own = effective_end(nodes)
    h = hunks.select(F.col("file").alias("hunk_file"), "start", "stop")
    return own.join(h, (F.col("file") == F.col("hunk_file")) & (F.col("line") <= F.col("stop")) & (F.col("end") >= F.col("start")), "left_semi")


#: Parts that the points of a file are dealt into, and tasks that take them.
DEALS, FILE_TASKS = 8, 64


def enclosing(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Rows 94-95: (file, at, id) of the innermost definition over each point; null without one.

    Of equal spans the later line, then the lesser id. Definitions of one span count once, by the least id, and the rows of
    a file are dealt by their lines, so that no task has a whole file.
    """
    own = nodes.groupBy(F.col("file").alias("def_file"), "line", F.coalesce("end_line", F.lit(999999)).alias("end")).agg(F.min("id").alias("id"))
    p = points.select("file", "at").distinct()
    dealt = p.withColumn("deal", F.pmod("at", F.lit(DEALS))).repartition(FILE_TASKS, "file", "deal")
    defs = own.select(F.col("def_file").alias("file"), "line", "end", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal")).repartition(FILE_TASKS, "file", "deal")
    # One number for span and line: a struct would be aggregated by sorting all pairs.
    order = (F.col("end") - F.col("line")).cast("long") * (1 << 32) + (F.lit((1 << 31) - 1).cast("long") - F.col("line"))
    hit = dealt.hint("merge").join(defs, ["file", "deal"]).filter("line <= at AND end >= at").groupBy("file", "at").agg(F.min(order).alias("order"))
    line = F.lit((1 << 31) - 1) - F.pmod("order", F.lit(1 << 32))
    best = hit.select("file", "at", line.alias("line"), (line + F.shiftright("order", 32)).alias("end"))
    best = best.join(own.withColumnRenamed("def_file", "file"), ["file", "line", "end"]).select("file", "at", "id")
    return p.join(best, ["file", "at"], "left")


def query_name(nodes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """Row 50: nodes whose name holds part, with their edges' other ends as sorted 'kind:name' lists."""
    own = NodeQuery(nodes).name_like(part).df.select("id", "name", "kind", "file", "line")
    out = own
    for label, direction in (("callees", True), ("callers", False)):
        found = neighbours(edges, nodes, direction, kinds=None).join(own.select("id"), "id", "left_semi")
        lists = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "edge_kind", "name"))), ",").alias(label))
        out = out.join(lists, "id", "left").withColumn(label, F.coalesce(label, F.lit("")))
    return out


def where_symbol(nodes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """Row 51: definition sites, uses, and exported = has callers in other files."""
    own = NodeQuery(nodes).name_like(part).df.select("id", "name", "kind", "file", "line")
    uses = with_ends(edges.filter("kind = 'calls'"), nodes, "file").groupBy(F.col("target_id").alias("id")).agg(
        F.countDistinct("source_id").alias("uses"), F.max((F.col("source_file") != F.col("target_file")).cast("int")).alias("outside")
    )
    return own.join(uses, "id", "left").select("id", "name", "kind", "file", "line", F.coalesce("uses", F.lit(0)).alias("uses"), (F.coalesce("outside", F.lit(0)) > 0).alias("exported"))


def entry_points(nodes: DataFrame) -> DataFrame:
    """Row 57."""
    kind = S.entry_point_type(F.col("name"))
    return nodes.filter(kind.isNotNull() | (F.col("role") == "entry")).select("id", "name", "file", "line", F.coalesce(kind, F.lit("exported")).alias("type"))


def subgraph(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Row 62: the induced subgraph."""
    kept = nodes.filter(condition)
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, inner


def simple_graph(edges: DataFrame, kinds: tuple[str, ...] | None = ("calls",), min_confidence: float | None = None) -> DataFrame:
    """Rows 60, 239: distinct (source_id, target_id) without self-loops; a null confidence fails a threshold."""
    own = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    own = own if min_confidence is None else own.filter(F.col("confidence") >= min_confidence)
    return own.filter("source_id <> target_id").select("source_id", "target_id").distinct()


def file_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("imports", "imports-type"), min_confidence: float | None = None) -> DataFrame:
    """Rows 98, 332: distinct (source_file, target_file) of different files."""
    own = edges.filter(F.col("kind").isin(*kinds))
    own = own if min_confidence is None else own.filter(F.col("confidence") >= min_confidence)
    return with_ends(own.select("source_id", "target_id"), nodes, "file").filter("source_file <> target_file").select("source_file", "target_file").distinct()


def methods_in_hierarchy(nodes: DataFrame, ancestors: DataFrame, method: str) -> DataFrame:
    """Row 96: every method `*.m`, then the same method of each ancestor of its class; duplicates kept."""
    methods = nodes.filter((F.col("kind") == "method") & F.col("name").endswith("." + method)).withColumn("owner", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1))
    classes = nodes.filter(F.col("kind").isin("class", "interface")).select(F.col("id").alias("class_id"), F.col("name").alias("owner"))
    above = methods.select("owner").join(classes, "owner").join(ancestors, F.col("class_id") == F.col("node_id")).join(classes.select(F.col("class_id").alias("ancestor_id"), F.col("owner").alias("above")), "ancestor_id").select(F.col("above").alias("owner"))
    return methods.select("id", "name", "file").unionByName(above.join(methods, "owner").select("id", "name", "file"))


def normalize_symbol(nodes: DataFrame, file_hashes: DataFrame) -> DataFrame:
    """Row 61."""
    return nodes.join(file_hashes.select("file", F.col("hash").alias("file_hash")), "file", "left").select("name", "kind", "file", "line", "end_line", "role", "file_hash")


def paginate(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows 145-146: a page in a total order, with the total and whether more follows."""
    if limit is None:
        return df
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)
