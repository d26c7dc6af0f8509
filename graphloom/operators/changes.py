"""Set operations, symbol diffs and co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["kind", "file", "name"]


def added(base: DataFrame, target: DataFrame) -> DataFrame:
    """Row 151."""
    return target.join(base.select(*_KEY), _KEY, "left_anti")


def removed(base: DataFrame, target: DataFrame) -> DataFrame:
    """Row 152."""
    return base.join(target.select(*_KEY), _KEY, "left_anti")


def changed(base: DataFrame, target: DataFrame, columns=("line", "fan_in", "fan_out")) -> DataFrame:
    """Row 153: common symbols with a difference in one of the columns, as d_<column>."""
    t = target.select(*_KEY, *[F.col(c).alias(f"t_{c}") for c in columns])
    rows = base.join(t, _KEY).select(*_KEY, *[(F.col(f"t_{c}") - F.col(c)).alias(f"d_{c}") for c in columns])
    return rows.filter(" OR ".join(f"d_{c} <> 0" for c in columns))


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row 155: (name, kind, change) of one file's symbols: added, removed or modified (the line moved). Of symbols alike
    in name and kind the last line counts."""
    last = lambda df, c: df.groupBy("name", "kind").agg(F.max("line").alias(c))
    both = last(old, "a").join(last(new, "b"), ["name", "kind"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("name", "kind", change.alias("change")).filter("change IS NOT NULL")


def merge_nodes(own: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Row 158: the other graph's rows override."""
    return own.join(other.select(key), key, "left_anti").unionByName(other)


def removed_files(known: DataFrame, current: DataFrame) -> DataFrame:
    """Row 159."""
    return known.select("file").join(current.select("file"), "file", "left_anti").distinct()


def file_changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """Rows 311, 315: (file, change) by content hash where there is one, else by mtime and size."""
    k = known.select("file", F.col("hash").alias("h0"), F.col("mtime").alias("m0"), F.col("size").alias("s0"))
    both = k.withColumn("old", F.lit(True)).join(current.withColumn("new", F.lit(True)), "file", "full")
    same = F.coalesce(F.col("h0") == F.col("hash"), (F.col("m0") == F.col("mtime")) & (F.col("s0") == F.col("size")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.coalesce(same, F.lit(False)), "changed")
    return both.select("file", change.alias("change")).filter("change IS NOT NULL")


def file_commit_counts(commits: DataFrame) -> DataFrame:
    """Row 134: commits has (sha, epoch, files); a file named twice in a commit counts twice."""
    return commits.select(F.explode("files").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("commit_count"))


def pair_counts(commits: DataFrame, max_files: int = 50) -> DataFrame:
    """Row 135: unordered pairs of different files, counted over commits of at most max_files files.

    The limit is the reference feature that keeps a bulk commit from pairing everything with everything, so a commit
    makes at most max_files (max_files - 1) / 2 pairs.
    """
    own = commits.select("epoch", F.array_sort(F.array_distinct("files")).alias("fs")).filter(F.size("fs").between(2, max_files))
    first = own.select("epoch", "fs", F.posexplode("fs").alias("i", "file_a"))
    rows = first.select("epoch", "file_a", F.explode(F.expr(f"slice(fs, i + 2, {max_files})")).alias("file_b"))
    return rows.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("commit_count"), F.max("epoch").alias("last_commit_epoch"))


def with_jaccard(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows 136, 233."""
    a, b = (counts.select(F.col("file").alias(f"file_{x}"), F.col("commit_count").alias(f"n_{x}")) for x in "ab")
    rows = pairs.join(a, "file_a").join(b, "file_b")
    jaccard = F.try_divide("commit_count", F.col("n_a") + F.col("n_b") - F.col("commit_count"))
    return rows.select("file_a", "file_b", "commit_count", jaccard.alias("jaccard"), "last_commit_epoch")


def co_changes(commits: DataFrame, min_support: int = 3, max_files: int = 50) -> DataFrame:
    """Rows 136, 231: pairs with support, over all history at once."""
    return with_jaccard(pair_counts(commits, max_files).filter(F.col("commit_count") >= min_support), file_commit_counts(commits))


def upsert_pairs(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Row 232: counts add up, the later epoch stays."""
    columns = ["file_a", "file_b", "commit_count", "last_commit_epoch"]
    return known.select(columns).unionByName(fresh.select(columns)).groupBy("file_a", "file_b").agg(F.sum("commit_count").alias("commit_count"), F.max("last_commit_epoch").alias("last_commit_epoch"))


def partners(pairs: DataFrame, file: str, min_jaccard: float = 0.3, limit: int = 20) -> DataFrame:
    """Row 234."""
    rows = pairs.filter((F.col("file_a") == file) | (F.col("file_b") == file)).filter(F.col("jaccard") >= min_jaccard)
    other = F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a"))
    return rows.select(other.alias("file"), "commit_count", "jaccard").orderBy(F.col("jaccard").desc(), "file").limit(limit)


def coupled_to(pairs: DataFrame, files: list[str], min_jaccard: float = 0.3, limit: int = 20) -> DataFrame:
    """Row 236: the limit comes before the partners inside the set are left out."""
    inside = lambda c: F.col(c).isin(*files)
    top = pairs.filter((inside("file_a") | inside("file_b")) & (F.col("jaccard") >= min_jaccard)).orderBy(F.col("jaccard").desc(), "file_a", "file_b").limit(limit)
    return top.filter(~(inside("file_a") & inside("file_b"))).select(F.when(inside("file_a"), F.col("file_b")).otherwise(F.col("file_a")).alias("file"), "commit_count", "jaccard")


def drifted(before: int, after: int, limit: float = 0.2) -> bool:
    """Row 318: whether a count moved by more than the limit."""
    return before > 0 and abs(after - before) / before > limit
