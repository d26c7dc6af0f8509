"""Aggregations, rankings and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..schema import NON_COUPLING_KINDS, ROLE_WEIGHTS
from .lookup import fan_in, fan_out, with_ends

#: For windows over one row of totals a group: an explicit single group of bounded size.


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def edges_by_kind(edges: DataFrame, nodes: DataFrame, no_tests: bool = True) -> DataFrame:
    """Row 104: tests are left out at both ends."""
    rows = with_ends(edges, nodes, "file")
    if no_tests:
        rows = rows.filter(~S.is_test_path(F.col("source_file")) & ~S.is_test_path(F.col("target_file")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def files_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy(S.language(F.col("file")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    """Row 138: in and out degree on the simple graph."""
    one = edges.filter("source_id <> target_id").select("source_id", "target_id").distinct()
    both = one.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(one.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hotspots(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Rows 106-107: files by coupling edges in and out; ties by file."""
    rows = with_ends(edges.filter(~F.col("kind").isin(*NON_COUPLING_KINDS)), nodes, "file").filter("source_file <> target_file")
    ends = rows.select(F.explode(F.array(F.struct(F.col("source_file").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_file").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.file").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return sums.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), "file").limit(limit)


def quality_metrics(edges: DataFrame, nodes: DataFrame, fp_threshold: int = 20) -> DataFrame:
    """Rows 109-111: caller coverage, call confidence and false-positive ratio, and the score of the three."""
    callable_ = nodes.filter(F.col("kind").isin("function", "method")).select("id")
    calls = edges.filter("kind = 'calls'")
    n = callable_.agg(F.count(F.lit(1)).alias("callables"))
    covered = callable_.join(calls.select(F.col("target_id").alias("id")), "id", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    sure = calls.agg(F.count_if(F.col("confidence") >= 0.7).alias("sure"), F.count_if(F.col("confidence") > 0).alias("valued"), F.count(F.lit(1)).alias("all_calls"))
    names = calls.join(nodes.select(F.col("id").alias("target_id"), "name"), "target_id").groupBy("target_id").count().filter(F.col("count") > fp_threshold)
    false = names.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("suspect"))
    one = n.crossJoin(covered).crossJoin(sure).crossJoin(false)  # four single rows
    coverage = F.when(F.col("callables") > 0, F.col("covered") / F.greatest("callables", F.lit(1))).otherwise(0.0)
    certainty = F.when(F.col("valued") > 0, F.col("sure") / F.greatest("valued", F.lit(1))).otherwise(0.0)
    suspect = F.when(F.col("all_calls") > 0, F.col("suspect") / F.greatest("all_calls", F.lit(1))).otherwise(0.0)
    return one.select(coverage.alias("caller_coverage"), certainty.alias("call_confidence"), suspect.alias("false_positive_ratio"), S.quality_score(coverage, certainty, suspect).alias("score"))


def directory_rollup(files: DataFrame) -> DataFrame:
    """Row 117: (directory, files, symbols) for every ancestor directory; files has (file, symbols)."""
    return files.select(F.explode(S.ancestor_dirs(F.col("file"))).alias("directory"), "symbols").groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"))


def directory_edges(pairs: DataFrame) -> DataFrame:
    """Rows 118-119: (directory, intra, fan_in, fan_out, cohesion) of distinct file edges; cohesion null without edges."""
    a, b = S.ancestor_dirs(F.col("source_file")), S.ancestor_dirs(F.col("target_file"))
    part = lambda dirs, i, n, o: pairs.select(F.explode(dirs).alias("directory"), F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(o).alias("o"))
    rows = part(F.array_intersect(a, b), 1, 0, 0).unionByName(part(F.array_except(b, a), 0, 1, 0)).unionByName(part(F.array_except(a, b), 0, 0, 1))
    sums = rows.groupBy("directory").agg(F.sum("i").alias("intra"), F.sum("n").alias("fan_in"), F.sum("o").alias("fan_out"))
    return sums.withColumn("cohesion", F.try_divide("intra", F.col("intra") + F.col("fan_in") + F.col("fan_out")))


def file_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row 116: symbols, exports, distinct imported files and fans of each file."""
    own = nodes.filter("kind <> 'file'").groupBy("file").agg(F.countDistinct("name", "kind", "line").alias("symbols"), F.sum("exported").alias("exports"))
    imports = with_ends(edges.filter(F.col("kind").isin("imports", "imports-type")), nodes, "file").filter("source_file <> target_file")
    out = imports.groupBy(F.col("source_file").alias("file")).agg(F.countDistinct("target_file").alias("import_count"), F.count(F.lit(1)).alias("fan_out"))
    in_ = imports.groupBy(F.col("target_file").alias("file")).agg(F.count(F.lit(1)).alias("fan_in"))
    joined = own.join(out, "file", "left").join(in_, "file", "left")
    return joined.select("file", "symbols", "exports", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("import_count", "fan_in", "fan_out")])


def fan_medians(edges: DataFrame) -> DataFrame:
    """Row 124: medians of the fan-ins and fan-outs that aren't zero."""
    i = fan_in(edges, ("calls", "imports-type")).agg(F.coalesce(F.median("fan_in"), F.lit(0.0)).alias("median_fan_in"))
    return i.crossJoin(fan_out(edges).agg(F.coalesce(F.median("fan_out"), F.lit(0.0)).alias("median_fan_out")))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row 126: adds norm_<column>; all equal is 0. The extremes are one row."""
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(ends))
    norm = {f"norm_{c}": F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0))) for c in columns}
    return wide.withColumns(norm).drop(*ends.columns)


def risk(items: DataFrame) -> DataFrame:
    """Row 127: items has fan_in, cognitive, churn, mi, role; adds norms, role_weight and risk_score."""
    rows = min_max(items, ["fan_in", "cognitive", "churn", "mi"]).withColumn("norm_mi", S.round_half_up(1 - F.col("norm_mi"), 4))
    weight = F.coalesce(S.literal_map(ROLE_WEIGHTS)[F.coalesce("role", F.lit(""))], F.lit(0.5))
    score = 0.25 * F.col("norm_fan_in") + 0.3 * F.col("norm_cognitive") + 0.2 * F.col("norm_churn") + 0.15 * weight + 0.1 * F.col("norm_mi")
    rows = rows.withColumn("role_weight", weight).withColumn("risk_score", S.round_half_up(score, 4))
    return rows.withColumns({c: S.round_half_up(F.col(c), 4) for c in ("norm_fan_in", "norm_cognitive", "norm_churn")})


def triage(nodes: DataFrame, edges: DataFrame, complexity: DataFrame, churn: DataFrame, kinds=("function", "method", "class"), min_score: float = 0.0) -> DataFrame:
    """Rows 102, 128: risk of each symbol; missing complexity or churn counts as 0."""
    own = nodes.filter(F.col("kind").isin(*kinds)).select("id", "name", "kind", "file", "line", "role")
    rows = own.join(fan_in(edges), "id", "left").join(complexity.select(F.col("node_id").alias("id"), "cognitive", F.col("maintainability_index").alias("mi")), "id", "left").join(churn.select("file", F.col("commit_count").alias("churn")), "file", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "cognitive", "churn")} | {"mi": F.coalesce("mi", F.lit(0.0))})
    return risk(rows).filter(F.col("risk_score") >= min_score)


RULES = {"cognitive": (15, None), "cyclomatic": (10, None), "max_nesting": (4, None)}


def manifesto(metrics: DataFrame, rules: dict[str, tuple[float | None, float | None]] = RULES) -> DataFrame:
    """Rows 130-131: (id, rule, value, status) of metrics (id, one column a rule); fail comes before warn."""
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("double").alias("value"), F.lit(w).cast("double").alias("warn"), F.lit(f).cast("double").alias("fail")) for k, (w, f) in rules.items()])
    rows = metrics.select("id", F.explode(cells).alias("c")).select("id", "c.*")
    status = F.when(F.col("value") >= F.col("fail"), "fail").when(F.col("value") >= F.col("warn"), "warn").otherwise("pass")
    return rows.select("id", "rule", "value", status.alias("status"))


def worst(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("rule").agg(F.when(F.max((F.col("status") == "fail").cast("int")) == 1, "fail").when(F.max((F.col("status") == "warn").cast("int")) == 1, "warn").otherwise("pass").alias("status"), F.count_if(F.col("status") != "pass").alias("violations"))


def complexity_report(complexity: DataFrame, thresholds: dict[str, float], above: bool = False) -> DataFrame:
    """Row 129: `exceeds` lists the thresholds that a function breaks; for the maintainability index, low is bad."""
    broken = {k: (F.col(k) > 0) & (F.col(k) <= t) if k == "maintainability_index" else F.col(k) >= t for k, t in thresholds.items()}
    rows = complexity.withColumn("exceeds", F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in broken.items()])), ","))
    return rows.filter("exceeds <> ''") if above else rows


def complexity_summary(complexity: DataFrame) -> DataFrame:
    """Row 113."""
    return complexity.agg(
        F.count(F.lit(1)).alias("analyzed"), S.round_half_up(F.avg("cognitive"), 1).alias("avg_cognitive"), F.max("cognitive").alias("max_cognitive"),
        S.round_half_up(F.avg("cyclomatic"), 1).alias("avg_cyclomatic"), F.min("maintainability_index").alias("min_mi"),
    )


def top_by(df: DataFrame, metric: str, key: str, limit: int) -> DataFrame:
    """Rows 122, 148, 235: a top-k report in a total order; nulls last."""
    return df.orderBy(F.col(metric).desc_nulls_last(), key).limit(limit)


def seeds(nodes: DataFrame, edges: DataFrame, strategy: str, n: int) -> DataFrame:
    """Row 150."""
    if strategy == "top-fanin":
        ranked = nodes.join(fan_in(edges), "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
        return ranked.orderBy(F.col("fan_in").desc(), "id").limit(n).select("id")
    return (nodes.filter("role = 'entry'") if strategy == "entry" else nodes).select("id")


def file_limit(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """Row 149: the first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def align_siblings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row 143: (old_id, new_id): symbols of a file matched by their rank among those of one name and kind."""
    rank = lambda df, k: df.select("file", "name", "kind", F.row_number().over(W.partitionBy("file", "name", "kind").orderBy("line", "id")).alias("n"), F.col("id").alias(k))
    return rank(old, "old_id").join(rank(new, "new_id"), ["file", "name", "kind", "n"]).select("old_id", "new_id")
