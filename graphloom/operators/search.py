"""Keyword, semantic and hybrid search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S

K1, B = 1.2, 0.75


def terms(text) -> F.Column:
    """Words of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings (term, id, tf), lengths (id, length)); counted before the shuffle."""
    own = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("ts"))
    postings = own.select("id", F.explode("ts").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return postings, own.select("id", F.size("ts").alias("length"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """Row 325: (id, score) of the documents with any word of the query. The query's words are a short list: the
    postings are filtered before they are grouped."""
    words = list(dict.fromkeys(S.fts_tokens(query)))
    own = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("ts"))
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("average"))
    hits = own.select("id", F.size("ts").alias("length"), F.explode(F.filter("ts", lambda t: t.isin(*words))).alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row a query word; one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return rows.groupBy("id").agg(F.sum(idf * weight).alias("score"))


#: Vectors and queries that are multiplied at a time, and the numbers that either side holds at most.
VECTORS, QUERIES, NUMBERS = 2048, 512, 1 << 18


def _packed(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(dim, {key}s, {vector}s): rows of one length of vector, packed by about `most` into lists of keys and of numbers.
    Null vectors, and those with nulls, are near nothing."""
    own = rows.select(key, vector).filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).withColumn("dim", F.size(vector))
    n, dim = own.agg(F.count(F.lit(1)), F.max("dim")).first()
    blocks = max(1, -(-n // max(1, min(most, NUMBERS // max(1, dim or 1)))))
    own = own.withColumn("block", F.pmod(F.xxhash64(key, vector), F.lit(blocks))).repartition(blocks, "block")
    lists = own.groupBy("dim", "block").agg(F.collect_list(F.struct(key, vector)).alias("rows"))
    return lists.select("dim", F.transform("rows", lambda r: r[key]).alias(f"{key}s"), F.flatten(F.transform("rows", lambda r: r[vector])).alias(f"{vector}s"))


def semantic(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, min_score: float = 0.2) -> DataFrame:
    """Row 326: (query, id, score) of the vectors near each query vector (query, q). Every block of vectors meets every block
    of queries, and a pair of blocks is one product of matrices in doubles; a task holds one pair at a time."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    pairs = _packed(own, "id", "v", VECTORS).join(_packed(queries, "query", "q", QUERIES), "dim")

    def product(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch["dim"][i].as_py()
                ids, names = batch["ids"][i].values, batch["querys"][i].values
                v, q = (batch[c][i].values.to_numpy(zero_copy_only=False).astype(float).reshape(len(k), dim) for c, k in (("vs", ids), ("qs", names)))
                norm = np.outer(*(np.sqrt((x * x).sum(1)) for x in (v, q)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(norm == 0, 0.0, v @ q.T / np.where(norm == 0, 1.0, norm))
                a, b = np.nonzero(~(score < min_score))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(b)), ids.take(pa.array(a)), pa.array(score[a, b])], names=["query", "id", "score"])

    types = [("query", dict(queries.dtypes)["query"]), ("id", dict(own.dtypes)["id"]), ("score", "double")]
    return pairs.select("dim", "ids", "vs", "querys", "qs").mapInArrow(product, ", ".join(f"{c} {t}" for c, t in types))


def post_filter(hits: DataFrame, nodes: DataFrame, kind: str | None = None, files: tuple[str, ...] = (), globs: tuple[str, ...] = (), tests: bool = True) -> DataFrame:
    """Rows 58-59: the hits (id, ...) whose symbols are of a kind, in paths that hold one of files or match one of globs,
    and, without tests, not in test files."""
    own = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    own = own.filter(S.file_filter(F.col("file"), list(files))) if files else own
    own = own.filter(S.matches_any(F.col("file"), list(globs))) if globs else own
    own = own if tests else own.filter(~S.is_test_path(F.col("file")))
    return hits.join(own.select("id"), "id", "left_semi")


def keyword_hits(nodes: DataFrame, texts: DataFrame, query: str, limit: int = 15, **filters) -> DataFrame:
    """Row 325: (id, score) of the `limit` best symbols by name and content; texts has (id, text). Five times as many are
    fetched and then filtered as post_filter() does."""
    own = nodes.select("id", "name").join(texts.select("id", "text"), "id", "left").select("id", F.concat_ws(" ", S.split_identifier(F.col("name")), "name", "text").alias("text"))
    hits = bm25(own, "id", "text", query).orderBy(F.col("score").desc(), "id").limit(5 * limit)
    return post_filter(hits, nodes, **filters).orderBy(F.col("score").desc(), "id").limit(limit)


def split_queries(text: str) -> list[str]:
    """Row 328: the queries of a text with semicolons between them."""
    return [q.strip() for q in text.split(";") if q.strip()]


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Row 140: 1-based rank of each query's hits; ties by id."""
    rows = scores.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id")))
    return rows if limit is None else rows.filter(F.col("rank") <= limit)


def fuse(hits: DataFrame, k: int = 60) -> DataFrame:
    """Rows 141-142: reciprocal ranks summed over the lists that hold an id."""
    return hits.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("lists"))


def hybrid(docs: DataFrame, id_col: str, text_col: str, vectors: DataFrame, vector_id: str, vector_col: str, queries: list[tuple[str, list[float]]], limit: int = 15, k: int = 60) -> DataFrame:
    """Row 328: BM25 and cosine lists of 5 x limit for each query, fused."""
    spark = docs.sparkSession
    vs = spark.createDataFrame([(q, v) for q, v in queries], "query string, q array<float>")
    lists = ranked(semantic(vectors, vs, vector_id, vector_col), 5 * limit).select("query", "id", "rank")
    for text, _ in queries:
        own = ranked(bm25(docs, id_col, text_col, text).withColumn("query", F.lit(text)), 5 * limit)
        lists = lists.unionByName(own.select("query", "id", "rank"))
    return fuse(lists, k).orderBy(F.col("rrf").desc(), "id").limit(limit)


def query_overlap(queries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Row 327: pairs of query vectors that say nearly the same."""
    a, b = queries.select(F.col("query").alias("a"), F.col("q").alias("qa")), queries.select(F.col("query").alias("b"), F.col("q").alias("qb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", S.cosine(F.col("qa"), F.col("qb")).alias("score")).filter(F.col("score") >= threshold)


def hashing_embedding(text, size: int = 64) -> F.Column:
    """Row 323: an offline stand-in for an embedding model: signed word hashes, summed into `size` cells."""
    h = F.transform(terms(text), lambda t: F.xxhash64(t))
    cells = [F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(size)) == i), F.lit(0.0), lambda a, x: a + F.when(F.shiftright(x, 40) % 2 == 0, 1.0).otherwise(-1.0)) for i in range(size)]
    return F.array(*cells).cast("array<float>")
