"""Operator 3: Merkle fixity audit of WARC replicas.

Every record is hashed. Records are ordered by id and cut into ranges of FAN consecutive ids; a range's hash is that of
its records' hashes in order, and FAN ranges make the next one up, to a single root. Replicas with equal roots are
alike. Otherwise only the children of mismatching nodes are compared, level by level, down to the damaged records.
Native: hashing, trees and descent are DataFrame operations; the driver sees one root a replica.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage, table

#: Children of a node at most, a power of 2 (and one more at 0, see parent_of).
FAN = 64
#: Nodes of a task above the leaves.
ROWS = 100_000
#: The leaf of rows without an id: below all others.
NO_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.0 resource record; a null payload is an empty block, a null uri an empty field."""
    block = F.coalesce(payload.cast("binary"), F.lit(b""))
    fields = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(fields.cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))


def parse_records(data: bytes) -> list[tuple[dict[str, str], int, int, bytes]]:
    """(fields, offset, length, block) of each record of a WARC file; ends at the first damaged header."""
    out, at = [], 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0 and data.startswith(b"WARC/", at):
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", "0"))
        stop = end + 4 + size + 4
        out.append((fields, at, stop - at, data[end + 4 : end + 4 + size]))
        at = stop
    return out


def parent_of(node: str) -> Column:
    """The range that a node is in. Going up, all numbers end at 0, those below 0 by way of -1: the range of 0 begins
    with -1, that of -1 ends with -2."""
    return F.when(F.col(node) == -1, F.lit(0)).otherwise(F.shiftright(node, FAN.bit_length() - 1))


def leaves(records: DataFrame, id_col: str, record: Column) -> DataFrame:
    """(parent, node, n, length, hash): a leaf for each id. Rows of one id are one leaf, their hashes in order; a null id
    is the leaf below all others, for which the least 64-bit number stands. Equal rows of a hot id are counted before
    the shuffle."""
    rows = records.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("node"), F.sha2(record, 256).alias("hash"), F.octet_length(record).cast("long").alias("length"))
    alike = rows.groupBy("node", "hash", "length").agg(F.count(F.lit(1)).alias("n"))
    own = alike.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("length"), F.count(F.lit(1)).alias("kinds"), F.min("hash").alias("only"), F.min("n").alias("times"),
        F.bit_xor(F.xxhash64("hash", "n")).alias("x"), F.sum(F.xxhash64(F.lit(1), "hash", "n").cast("decimal(38,0)")).alias("s"),
    )
    several = F.sha2(F.concat_ws(":", F.lit("set"), F.col("only"), "kinds", "n", "x", "s").cast("binary"), 256)
    return own.select(parent_of("node").alias("parent"), "node", "n", "length", F.when((F.col("kinds") == 1) & (F.col("times") == 1), F.col("only")).otherwise(several).alias("hash"))


def _tasks(rows: int) -> int:
    """How many tasks and files so many nodes take: the levels above the leaves are small."""
    return max(1, -(-rows // ROWS))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (node, parent, n, length, hash) from leaves to the root, each with its number of nodes as `size`. A node's
    group has FAN children at most, and one more at 0."""
    levels = [stage(leaf)]
    while True:
        size = levels[-1].size = levels[-1].agg(F.count(F.lit(1))).first()[0]
        if size <= 1:
            return levels
        own = levels[-1].groupBy(F.col("parent").alias("node")).agg(
            F.sum("n").alias("n"), F.sum("length").alias("length"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["hash"])), ";").cast("binary"), 256).alias("hash"),
        )
        levels.append(stage(own.select(parent_of("node").alias("parent"), "node", "n", "length", "hash").coalesce(_tasks(size))))


def audit(own: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """(node, status) of the leaves that differ between two trees: corrupt, missing (in the replica) or extra (only in
    the replica).

    The trees may differ in height; the lower one's root is then carried up unchanged.
    """
    a, b = list(own), list(replica)
    most = [max((x[i].size for x in (a, b) if i < len(x)), default=1) for i in range(max(len(a), len(b)))]
    for x in (a, b):
        while len(x) < max(len(a), len(b)):
            up = x[-1].select(parent_of("node").alias("node"), "n", "length", "hash")
            x.append(up.select(parent_of("node").alias("parent"), "node", "n", "length", "hash"))
    suspects = None
    for x, y, size in zip(reversed(a), reversed(b), reversed(most)):
        if suspects is not None:
            below = suspects.select(F.col("node").alias("parent"))
            x, y = x.join(below, "parent", "left_semi"), y.join(below, "parent", "left_semi")
        both = x.select("node", F.col("hash").alias("ha")).join(y.select("node", F.col("hash").alias("hb")), "node", "full")
        suspects = stage(both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).coalesce(_tasks(size)))
        if suspects.isEmpty():
            break
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt")
    return suspects.select("node", status.alias("status"))


def offsets(levels: list[DataFrame]) -> DataFrame:
    """(node, offset) of the leaves in the file of all records in order: sums of the siblings before, from the root
    down, so that no window spans more than FAN rows."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum("length").over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = levels[-1].select("node", F.lit(0).cast("long").alias("offset"))
    for level in reversed(levels[:-1]):
        shifted = level.select("node", "parent", before.alias("shift"))
        start = shifted.join(start.withColumnRenamed("node", "parent"), "parent").select("node", (F.col("offset") + F.col("shift")).alias("offset"))
    return start


def fixity_report(records: DataFrame, replica: DataFrame, id_col: str, record: Column, replica_record: Column | None = None) -> DataFrame:
    """One row for each id of either replica: id (null for rows without one), n_records, offset and length in the first
    replica's file in order of ids (-1 for extra ones), sha256 of the leaf, status (ok, corrupt, missing, extra).

    Empty replicas have no nodes; if both are, so is the report. Repeated ids are one leaf. Only id_col and the columns
    of the record expressions are read.
    """
    own = tree(leaves(records, id_col, record))
    other = tree(leaves(replica, id_col, record if replica_record is None else replica_record))
    bad = audit(own, other)
    discard(*other)
    rows = own[0].join(offsets(own), "node") if len(own) > 1 else own[0].withColumn("offset", F.lit(0).cast("long"))
    rows = rows.join(bad.filter("status <> 'extra'"), "node", "left").select("node", "n", "offset", "length", "hash", F.coalesce("status", F.lit("ok")).alias("status"))
    extra = bad.filter("status = 'extra'").select("node", *[F.lit(v).cast("long").alias(c) for c, v in (("n", 0), ("offset", -1), ("length", 0))], F.lit("").alias("hash"), "status")
    return rows.unionByName(extra).select(
        F.when(F.col("node") != NO_ID, F.col("node")).alias(id_col), F.col("n").alias("n_records"), "offset", "length", F.col("hash").alias("sha256"), "status"
    )


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: of the pages, every 97th is cut short, the next one missing, the next renamed."""
    k = F.pmod("page_id", F.lit(97))
    html = F.when(k == 0, F.substring("html", 2, 1 << 30)).otherwise(F.col("html"))
    return pages.filter(~(k == 1) | F.col("page_id").isNull()).select(F.when(k == 2, -F.col("page_id") + 10_000_000_000).otherwise(F.col("page_id")).alias("page_id"), "url", html.alias("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity_report(pages, damaged(pages), "page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")))


ORACLE = f"""
WITH own AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages)
SELECT page_id, CAST(1 AS BIGINT) AS n_records, CAST(coalesce(sum(strlen(rec)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256, CASE page_id % 97 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'missing' WHEN 2 THEN 'missing' ELSE 'ok' END AS status
FROM own
UNION ALL
SELECT 10000000000 - page_id, 0, -1, 0, '', 'extra' FROM pages WHERE page_id % 97 = 2
"""
