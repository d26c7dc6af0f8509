"""Adapters: the driver's tables as nodes, edges, commits and metric rows. Plain projections, said once in SQL expressions
that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'interface' WHEN 3 THEN 'constant' ELSE 'function' END"
_NAME = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('C', p_partkey) WHEN 1 THEN concat('C', p_partkey - 1, '.m', p_partkey % 11) WHEN 2 THEN concat('I', p_partkey) "
    "WHEN 3 THEN concat('K', p_partkey) ELSE concat(CASE WHEN p_partkey % 40 = 4 THEN 'route:' ELSE '' END, replace(p_name, ' ', '_'), '_', p_partkey % 50) END"
)
_FILE = "concat('src/', lower(replace(p_brand, '#', '')), '/m', p_partkey % 7, CASE p_partkey % 5 WHEN 0 THEN '.test.js' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' ELSE '.js' END)"
NODE_COLUMNS = {
    "id": "p_partkey", "name": _NAME, "kind": _KIND, "file": _FILE, "line": "CAST(p_partkey % 97 + 1 AS INT)",
    "end_line": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 97 + 1 + p_size AS INT) END",
    "parent_id": "CASE WHEN p_partkey % 6 = 1 THEN p_partkey - 1 ELSE NULL END", "exported": "CAST(p_partkey % 2 AS INT)",
    "role": "CASE p_partkey % 9 WHEN 0 THEN 'core' WHEN 1 THEN 'entry' WHEN 2 THEN 'dead-leaf' WHEN 3 THEN 'dead-unresolved' WHEN 4 THEN 'utility' ELSE 'leaf' END",
}
_NEXT = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
EDGE_COLUMNS = {
    "source_id": "l_partkey", "target_id": _NEXT,
    "kind": "CASE (l_partkey + l_suppkey) % 10 WHEN 1 THEN 'imports' WHEN 2 THEN 'imports-type' WHEN 3 THEN 'extends' WHEN 4 THEN 'implements' ELSE 'calls' END",
    "confidence": "l_quantity / 50", "dynamic": "CAST(l_suppkey % 2 AS INT)",
    "technique": "CASE l_suppkey % 3 WHEN 0 THEN 'ts-native' WHEN 1 THEN 'points-to' ELSE 'cha' END",
    "dynamic_kind": "CASE WHEN l_suppkey % 5 = 0 THEN 'eval' WHEN l_suppkey % 5 = 1 THEN 'computed-key' ELSE NULL END",
}
COMPLEXITY_COLUMNS = {
    "node_id": "p_partkey", "cognitive": "CAST(p_size % 25 AS INT)", "cyclomatic": "CAST(p_size % 17 + 1 AS INT)", "max_nesting": "CAST(p_size % 7 AS INT)",
    "maintainability_index": "CAST(p_partkey % 101 AS DOUBLE)",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


NODES = f"SELECT {_select(NODE_COLUMNS)} FROM part"
EDGES = f"SELECT * FROM (SELECT {_select(EDGE_COLUMNS)} FROM lineitem) q WHERE target_id IS NOT NULL"
COMPLEXITY = f"SELECT {_select(COMPLEXITY_COLUMNS)} FROM part"
PRELUDE = f"nodes AS ({NODES}), edges AS ({EDGES}), complexity AS ({COMPLEXITY})"
#: Commits: an order is a commit, and the part's brand the file.
COMMITS = "commits AS (SELECT o_orderkey AS sha, epoch_s AS epoch, p_brand AS file FROM (SELECT o_orderkey, CAST(date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS BIGINT) AS epoch_s FROM orders) o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), NODE_COLUMNS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), EDGE_COLUMNS).filter("target_id IS NOT NULL")


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), COMPLEXITY_COLUMNS)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, epoch, files): files of one order, a brand as often as it occurs."""
    from pyspark.sql import functions as F

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_brand"), "l_partkey")
    files = items.groupBy("l_orderkey").agg(F.collect_list("p_brand").alias("files"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS epoch")
    return files.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("sha"), "epoch", "files")


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A functional graph: each part's most frequent successor, ties by id."""
    from pyspark.sql import functions as F

    counted = edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("source_id").agg(F.min_by("target_id", F.struct(-F.col("n"), "target_id")).alias("target_id"))


SUCCESSORS = "succ AS (SELECT source_id, target_id FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, target_id) AS rn FROM edges GROUP BY source_id, target_id) WHERE rn = 1)"


_SOURCE_FILE = "concat('src/', lower(replace(p_brand, '#', '')), '/m', CAST(floor(p_partkey / 2000) AS BIGINT), '.py')"
#: Functions of the program below: id, the file, how many branches, and the function that is called.
FUNCTIONS = f"{SUCCESSORS}, fn AS (SELECT p.p_partkey AS id, {_SOURCE_FILE} AS file, p_size % 4 AS branches, target_id AS callee FROM part p LEFT JOIN succ ON source_id = p_partkey), linked AS (SELECT a.*, b.file AS callee_file FROM fn a LEFT JOIN fn b ON b.id = a.callee)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content, hash, mtime, size): a Python program with a function a part, that branches by its size and calls its
    most frequent successor, imported if it is in another file, and renamed if its number is odd."""
    from pyspark.sql import functions as F

    own = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_SOURCE_FILE} AS file", "p_size % 4 AS branches")
    linked = own.join(successors(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("target_id").alias("callee")), "id", "left")
    linked = linked.join(own.select(F.col("id").alias("callee"), F.col("file").alias("callee_file")), "callee", "left")
    far = F.col("callee_file") != F.col("file")
    name = F.concat(F.when(far & (F.col("callee") % 2 == 1), "g").otherwise("f"), "callee")
    module = F.regexp_replace(F.replace("callee_file", F.lit("/"), F.lit(".")), r"\.py$", "")
    rename = F.when(F.col("callee") % 2 == 1, F.concat(F.lit(" as g"), "callee")).otherwise("")
    line = F.when(far, F.concat(F.lit("from "), module, F.lit(" import f"), "callee", rename))
    result = F.coalesce(F.concat(name, F.lit("(a)")), F.lit("a"))
    body = F.concat(F.lit("def f"), "id", F.lit("(a):\n"), F.repeat(F.lit("    if a > 1:\n        a = a + 1\n"), F.col("branches")), F.lit("    return "), result, F.lit("\n"))
    files = linked.groupBy("file").agg(F.array_sort(F.collect_set(line)).alias("imports"), F.array_sort(F.collect_list(F.struct("id", body.alias("body")))).alias("defs"))
    text = F.concat(F.array_join("imports", "\n"), F.lit("\n\n"), F.array_join(F.transform("defs", lambda d: d["body"]), "\n\n"))
    return files.select("file", text.cast("binary").alias("content"), F.sha2(text.cast("binary"), 256).alias("hash"), F.lit(0).cast("long").alias("mtime"), F.octet_length(text).cast("long").alias("size"))
