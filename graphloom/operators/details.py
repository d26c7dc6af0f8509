"""Small look-ups and projections: rows that reports and tools ask for.

Keys are columns or tables of many keys at once, never one row a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import LANGUAGE_OF
from . import community, lookup, search

CORE = ("id", "name", "kind", "file", "line")


def filter_edges(edges: DataFrame, condition: Column) -> DataFrame:
    """Row 63: the edges that a condition keeps; nodes stay as they are."""
    return edges.filter(condition)


def callable_nodes(nodes: DataFrame) -> DataFrame:
    """Row 82."""
    return nodes.filter(F.col("kind").isin(*lookup.CALLABLE)).select("id", "name", "kind", "file")


def call_edges(edges: DataFrame) -> DataFrame:
    """Row 83: every call, parallel ones too."""
    return edges.filter("kind = 'calls'").select("source_id", "target_id", "confidence", "dynamic")


def file_nodes(nodes: DataFrame, part: str | None = None) -> DataFrame:
    """Rows 84, 345: file nodes, or those with `part` in their path, whatever the case."""
    own = nodes.filter("kind = 'file'")
    return (own if part is None else own.filter(F.lower("file").contains(part.lower()))).select("id", "name", "file")


def import_edges(edges: DataFrame) -> DataFrame:
    """Row 85."""
    return edges.filter(F.col("kind").isin("imports", "imports-type")).select("source_id", "target_id")


def by_scope(nodes: DataFrame, scope: str, kind: str | None = None, files: tuple[str, ...] = ()) -> DataFrame:
    """Row 86: members of a scope."""
    return _narrowed(nodes.filter(F.col("scope") == scope), kind, files)


def by_qualified_name(nodes: DataFrame, name: str, files: tuple[str, ...] = ()) -> DataFrame:
    """Row 87."""
    return _narrowed(nodes.filter(F.col("qualified_name") == name), None, files)


def _narrowed(rows: DataFrame, kind: str | None, files: tuple[str, ...]) -> DataFrame:
    rows = rows if kind is None else rows.filter(F.col("kind") == kind)
    return rows.filter(S.file_filter(F.col("file"), list(files))) if files else rows


def file_ends(nodes: DataFrame) -> DataFrame:
    """Row 89: (file, max_end): the last end line of each file's symbols, null if none has one."""
    return nodes.groupBy("file").agg(F.max("end_line").alias("max_end"))


def interfaces(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Row 91: symbols whose name holds `name`, with what they implement as sorted 'name@file' lists."""
    own = lookup.NodeQuery(nodes).name_like(name).df.select(*CORE)
    found = lookup.neighbours(edges, nodes, True, ("implements",)).join(own.select("id"), "id", "left_semi")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws("@", "name", "file"))).alias("interfaces"))
    return own.join(lists, "id", "left").withColumn("interfaces", F.coalesce("interfaces", F.array().cast("array<string>")))


def import_degrees(edges: DataFrame, nodes: DataFrame, file_targets: bool = True) -> DataFrame:
    """Row 115: (file, fan_in, fan_out) over import edges between files, parallel ones counted; of edges into file nodes
    only, unless file_targets is off."""
    own = lookup.with_ends(edges.filter(F.col("kind").isin("imports", "imports-type")).select("source_id", "target_id"), nodes, "file", "kind").filter("source_file <> target_file")
    own = own.filter("target_kind = 'file'") if file_targets else own
    sides = own.select(F.explode(F.array(F.struct(F.col("source_file").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_file").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("s"))
    return sides.groupBy("s.file").agg(F.sum("s.i").alias("fan_in"), F.sum("s.o").alias("fan_out"))


def in_code_point_order(df: DataFrame, *columns: str) -> DataFrame:
    """Row 147: by Unicode code points, which is the order of UTF-8 bytes and so of Spark's strings."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in columns])


def co_change_file(pairs: DataFrame, file: str) -> DataFrame:
    """Row 156: one row (file): that of the pairs which equals `file`, or else ends with it; the least if several do."""
    every = pairs.select(F.explode(F.array("file_a", "file_b")).alias("file")).distinct()
    rows = every.filter(F.col("file").endswith(file)).select("file", (F.col("file") != file).alias("partial"))
    return rows.agg(F.min(F.struct("partial", "file")).alias("x")).filter("x IS NOT NULL").select("x.file")


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Row 343: the nodes of many ids (id)."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def of_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows 344, 348: the symbols of files (file), without the files themselves."""
    return nodes.filter("kind <> 'file'").join(files.select("file").distinct(), "file", "left_semi").select(*CORE)


def ids_by_key(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Row 346: keys (name, kind, file, line) with their id; null for those that no node has."""
    key = ["name", "kind", "file", "line"]
    return keys.select(*key).distinct().join(nodes.select(*key, "id"), key, "left")


def function_ids(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Row 347: keys (name, file, line) with the id of the function or method there."""
    key = ["name", "file", "line"]
    return keys.select(*key).distinct().join(nodes.filter(F.col("kind").isin("function", "method")).select(*key, "id"), key)


def functions_of_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Row 390: (id)."""
    return nodes.filter(F.col("kind").isin("function", "method")).join(files.select("file").distinct(), "file", "left_semi").select("id")


def exported_definitions(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Row 350: exported functions, methods and classes, of all files or of some."""
    own = nodes.filter(F.col("kind").isin(*lookup.CALLABLE) & (F.col("exported") == 1))
    return (own if files is None else own.join(files.select("file").distinct(), "file", "left_semi")).select(*CORE)


def line_counts(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Row 351: (id, line_count) from node metrics (node_id, line_count)."""
    return nodes.select("id").join(metrics.select(F.col("node_id").alias("id"), "line_count"), "id")


def complexity_of(nodes: DataFrame, complexity: DataFrame) -> DataFrame:
    """Row 361: (id, name, cognitive, cyclomatic, max_nesting, maintainability_index) of the nodes that have them."""
    own = complexity.select(F.col("node_id").alias("id"), "cognitive", "cyclomatic", "max_nesting", "maintainability_index")
    return nodes.select("id", "name").join(own, "id")


def file_hashes_of(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Row 364: (file, hash), null where the store knows none."""
    return files.select("file").distinct().join(hashes.select("file", "hash"), "file", "left")


def symbol_refs(rows: DataFrame) -> DataFrame:
    """Row 365: rows as one struct of the four fields by which symbols are named."""
    return rows.select(F.struct("name", "kind", "file", "line").alias("symbol"))


def is_file_like(target: Column) -> Column:
    """Row 369: a path, or a name with the extension of a known language."""
    extension = F.lower(F.regexp_extract(target, r"[^/\\.](\.[^./\\]+)$", 1))
    return target.contains("/") | target.contains("\\") | extension.isin(*LANGUAGE_OF)


def community_summary(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Row 384: one row (communities, modularity, drift_score) of members (node, community, directory)."""
    count = members.agg(F.countDistinct("community").alias("communities"))
    quality = community.modularity(pairs, members.select("node", "community")).select(F.round("quality", 4).alias("modularity"))
    return count.crossJoin(quality).crossJoin(community.drift(members.select("community", "directory")).select("drift_score"))


def annotated_messages(messages: DataFrame, dataflow: DataFrame, most: int = 3) -> DataFrame:
    """Row 393: the messages (source_id, target_id) of a sequence with `passed`, the first `most` expressions that flow into
    the callee in order of parameter, and `returned`, whether something flows back."""
    passed = dataflow.filter("kind = 'flows_to'").groupBy("source_id", "target_id").agg(F.array_sort(F.collect_set(F.struct("param_index", "expression"))).alias("p"))
    back = dataflow.filter("kind = 'returns'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(True).alias("returned")).distinct()
    out = messages.join(passed, ["source_id", "target_id"], "left").join(back, ["source_id", "target_id"], "left")
    return out.select(*messages.columns, F.transform(F.slice(F.coalesce("p", F.array().cast("array<struct<param_index:int,expression:string>>")), 1, most), lambda x: x["expression"]).alias("passed"), F.coalesce("returned", F.lit(False)).alias("returned"))


def stale_files(nodes: DataFrame, hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """Row 411: (file) of those that the store has, by nodes or hashes, and a scan does not expect; '\\' counts as '/'."""
    known = nodes.select("file").unionByName(hashes.select("file")).distinct().withColumn("path", F.translate("file", "\\", "/"))
    return known.join(expected.select(F.col("file").alias("path")), "path", "left_anti").select("file")


def branch_mermaid(compared: DataFrame) -> DataFrame:
    """Row 342: lines (at, line) of a Mermaid flowchart of compared symbols (change, kind, file, name): a subgraph a change."""
    one = compared.select("change", F.xxhash64("change", "kind", "file", "name").alias("key"), F.concat(F.lit('["'), F.concat_ws(" ", "kind", "name"), F.lit('"]')).alias("label"), "file", "name")
    colour = F.when(F.col("change") == "added", "fill:#e8f5e9,stroke:#4caf50").when(F.col("change") == "removed", "fill:#ffebee,stroke:#f44336").otherwise("fill:#fff3e0,stroke:#ff9800")
    node = F.concat(F.lit("        n"), F.hex(F.col("key")), F.col("label"))
    heads = one.select("change").distinct()
    rows = heads.select(F.concat("change", F.lit("0")).alias("at"), F.concat(F.lit("    subgraph "), "change", F.lit('["'), F.initcap("change"), F.lit('"]')).alias("line"))
    rows = rows.unionByName(one.select(F.concat_ws("", "change", F.lit("1"), "file", "name").alias("at"), node.alias("line")))
    rows = rows.unionByName(heads.select(F.concat("change", F.lit("2")).alias("at"), F.concat(F.lit("    end\n    style "), "change", F.lit(" "), colour).alias("line")))
    top = compared.sparkSession.createDataFrame([("", "flowchart TB")], "at string, line string")
    return top.unionByName(rows)


def impact_mermaid(affected: DataFrame, levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 417: lines (at, line) of a Mermaid flowchart of an impact: a subgraph for each file of affected functions (id),
    one for the callers in levels (root, node, depth, parent), and an arrow from each level to the one that it was reached
    from."""
    label = F.concat(F.lit("        n"), F.col("id").cast("string"), F.lit('["'), F.col("name"), F.lit('"]'))
    own = nodes.join(affected.select("id").distinct(), "id", "left_semi")
    callers = levels.filter("depth > 0").select(F.col("node").alias("id")).distinct().join(affected.select("id"), "id", "left_anti")
    blast = nodes.join(callers, "id", "left_semi")
    heads = own.select("file").distinct()
    rows = heads.select(F.concat(F.lit("1"), "file", F.lit("0")).alias("at"), F.concat(F.lit("    subgraph f"), F.hex(F.xxhash64("file")), F.lit('["'), "file", F.lit('"]')).alias("line"))
    rows = rows.unionByName(own.select(F.concat(F.lit("1"), "file", F.lit("1"), "name").alias("at"), label.alias("line")))
    rows = rows.unionByName(heads.select(F.concat(F.lit("1"), "file", F.lit("2")).alias("at"), F.lit("    end").alias("line")))
    ends = affected.sparkSession.createDataFrame([("0", "flowchart TB"), ("20", '    subgraph blast["Callers"]'), ("22", "    end")], "at string, line string")
    rows = rows.unionByName(ends).unionByName(blast.select(F.concat(F.lit("21"), "name").alias("at"), label.alias("line")))
    arrows = levels.filter("parent IS NOT NULL").select("parent", "node").distinct()
    return rows.unionByName(arrows.select(F.concat_ws(" ", F.lit("3"), "parent", "node").alias("at"), F.concat(F.lit("    n"), F.col("parent").cast("string"), F.lit(" --> n"), F.col("node").cast("string")).alias("line")))


def summaries(nodes: DataFrame, files: DataFrame, most: int = 100) -> DataFrame:
    """Row 367: (id, summary): the first words of the comment right above a definition, of its last line if it is a line
    comment, of its first text if it is a block; null without one."""
    lines = files.select("file", F.split(F.decode("content", "UTF-8"), "\n").alias("ls"))
    rows = nodes.filter("line > 1").join(lines, "file").withColumn("above", F.trim(F.element_at("ls", F.col("line") - 1)))
    single = F.regexp_extract("above", r"^(?://+|#+|--)\s*(.*)$", 1)
    start = F.greatest(F.lit(1), F.col("line") - 21)
    block = F.regexp_extract(F.array_join(F.slice("ls", start, F.col("line") - start), "\n"), r"(?s).*/\*\*?(.*?)\*/\s*$", 1)
    texts = F.filter(F.transform(F.split(block, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*+\s?", ""))), lambda x: (x != "") & ~x.startswith("@"))
    found = F.when(single != "", single).when(F.col("above").endswith("*/"), F.try_element_at(texts, F.lit(1)))
    return rows.select("id", F.substring(found, 1, most).alias("summary"))


def leading_comments(nodes: DataFrame, files: DataFrame, most: int = 15) -> DataFrame:
    """Row 247: (id, comment): the unbroken run of comment lines right above a definition, at most `most`, without their
    marks; null without one."""
    lines = files.select("file", F.split(F.decode("content", "UTF-8"), "\n").alias("ls"))
    start = F.greatest(F.lit(1), F.col("line") - most)
    rows = nodes.filter("line > 1").join(lines, "file").withColumn("above", F.reverse(F.transform(F.slice("ls", start, F.col("line") - start), lambda x: F.trim(x))))
    marks = F.transform("above", lambda x: x.rlike(r"^(//|#|--|/\*|\*)"))
    broken = F.array_position(marks, False)
    run = F.reverse(F.when(broken == 0, F.col("above")).otherwise(F.slice("above", 1, F.greatest(F.lit(0), broken.cast("int") - 1))))
    text = F.trim(F.array_join(F.transform(run, lambda x: F.trim(F.regexp_replace(x, r"^(//+|#+|--|/\*+|\*+/?)\s?|\s*\*/$", ""))), " "))
    return rows.select("id", F.nullif(text, F.lit("")).alias("comment"))


_SIGNATURES = (
    (r"(?:export\s+)?(?:async\s+)?function\s*\*?\s*\w*\s*\(([^)]*)\)\s*(?::\s*([^\n{]+))?", "javascript"),
    (r"=\s*(?:async\s+)?\(([^)]*)\)\s*(?::\s*([^=>\n{]+))?\s*=>", "arrow"),
    (r"def\s+\w+\s*\(([^)]*)\)\s*(?:->\s*([^:\n]+))?", "python"),
    (r"func\s+(?:\([^)]*\)\s+)?\w+\s*\(([^)]*)\)\s*\(?([^\n{)]*)", "go"),
    (r"fn\s+\w+\s*\(([^)]*)\)\s*(?:->\s*([^\n{]+))?", "rust"),
)


def signatures(nodes: DataFrame, files: DataFrame, gather: int = 5) -> DataFrame:
    """Row 368: (id, params, return_type) read off the first lines of a definition; null where there is none."""
    lines = files.select("file", F.split(F.decode("content", "UTF-8"), "\n").alias("ls"))
    chunk = F.array_join(F.slice("ls", F.col("line"), gather), "\n")
    rows = nodes.filter("line > 0").join(lines, "file").withColumn("chunk", chunk)
    params, returns = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, _ in reversed(_SIGNATURES):
        hit = F.col("chunk").rlike(rule)
        params = F.when(hit, F.nullif(F.trim(F.regexp_extract("chunk", rule, 1)), F.lit(""))).otherwise(params)
        returns = F.when(hit, F.nullif(F.trim(F.regexp_extract("chunk", rule, 2)), F.lit(""))).otherwise(returns)
    return rows.select("id", params.alias("params"), returns.alias("return_type"))


def embedding_rows(texts: DataFrame, model: str, embed=search.hashing_embedding) -> tuple[DataFrame, DataFrame, dict]:
    """Row 33: what a store of embeddings holds of texts (id, text): vectors (id, vector), the searchable rows (id, text)
    and the model's entry. embed turns a column of texts into one of vectors."""
    return texts.select("id", embed(F.col("text")).alias("vector")), texts.select("id", "text"), {"embedding_model": model}


def prepared_search(vectors: DataFrame, nodes: DataFrame, meta: dict, model: str | None = None, kind: str | None = None, files: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> DataFrame:
    """Row 329: the vectors to search with their symbols, narrowed by kind, parts of paths and globs. Raises ValueError if
    they were made by another model."""
    made = meta.get("embedding_model")
    if model is not None and made is not None and made != model:
        raise ValueError(f"embeddings are of {made}, not {model}")
    own = _narrowed(nodes.select(*CORE), kind, files)
    own = own.filter(S.passes(F.col("file"), list(globs), [])) if globs else own
    return vectors.join(own, "id")
