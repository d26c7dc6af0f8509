"""Operator 2: near-duplicates by a containment ensemble over MinHash.

Documents are near-duplicates if the larger one's distinct word shingles are contained in the smaller one to SIMILARITY
or more (so each is contained in the other to that degree; a Jaccard similarity of SIMILARITY or more implies it, and a
short text inside a long one isn't its duplicate). Documents are partitioned by their number of shingles; containment
becomes, for each partition's range of sizes, the least Jaccard similarity that it allows, and the banding of that
partition is tuned to it. Documents near a partition's upper bound are guests in the next one. Candidates are checked
exactly on their texts, and classes are the connected components of the links between different texts.

Groups: equal texts are one node, aggregated before the shuffle. A band bucket of at most PAIRS nodes gives its pairs.
A larger one first gives the pairs of all its nodes with its least and its greatest one, as many as it has nodes. Most
such buckets are copies of one text and are one class then. In the others every two texts of different classes are
compared, and no others: the bucket is dealt into blocks of about BLOCK texts, those of a large class in blocks of
their own, and two blocks are a unit of work, which returns the classes that it ties. So classes lose no link, and what
a bucket costs beyond its size is the number of pairs in it that no class holds together.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, discard, mix, shingles, signed, stage, table, word_values

SHINGLE, SIMILARITY = 5, 0.8
#: MinHash rows for bands.
ROWS = 200
RECALL, PAIRS, SPAN = 0.995, 32, 2.0
#: Texts in a block of a group, and distinct shingles that are compared at a time.
BLOCK, WIDTH = 128, 4096
_rng = np.random.default_rng(42)
_A = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64)


def partition_of(n: int) -> int:
    """Partition p holds sizes from SPAN**p up to, not including, SPAN**(p + 1)."""
    return int(math.log(n, SPAN) + 1e-9)


@cache
def jaccard_bound(p: int, similarity: float) -> float:
    """The least Jaccard similarity of near-duplicates that meet in partition p."""
    low, high = max(1, math.ceil(SPAN**p * similarity)), math.ceil(SPAN ** (p + 1))
    sizes = range(low, high) if high - low < 4000 else (10**9,)
    shared = {b: math.ceil(similarity * b - 1e-9) for b in sizes}
    return min(s / (2 * b - s) for b, s in shared.items())


@cache
def banding(bound: float, rows: int = ROWS, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows a band): the most selective one that finds pairs at the bound with the recall asked for."""
    for r in range(rows, 0, -1):
        b = rows // r
        if 1 - (1 - bound**r) ** b >= recall:
            return b, r
    return rows, 1


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each of ROWS hash functions over the shingles, in bounded memory."""
    best = np.full(ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(best, (found[i : i + 1024, None] * _A + _B).min(axis=0), out=best)
    return mix(best)


def band_keys(sig: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """The document's bucket keys: of its own partition and, as a guest, of the next if a partner may be there."""
    p = partition_of(n)
    keys = []
    for tag in (p, p + 1) if n / similarity >= SPAN ** (p + 1) - 1e-9 else (p,):
        b, r = banding(jaccard_bound(tag, similarity))
        rows = sig[: b * r].reshape(b, r)
        own = np.full(b, tag << 16, np.uint64) + np.arange(b, dtype=np.uint64)
        for j in range(r):
            own = mix(own * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, j])
        keys.append(own)
    return np.concatenate(keys)


def _values(text: bytes) -> np.ndarray:
    return word_values(text.lower().split())


def _nodes(own: DataFrame, size: int, similarity: float) -> DataFrame:
    """One row for each different text: h1, h2, node (least doc_id), keys."""

    def run(batch: pa.RecordBatch) -> dict:
        keys = []
        for text in batch.column("text").to_pylist():
            found = shingles(_values(text), size)
            keys.append(signed(band_keys(signature(found), len(found), similarity)) if len(found) else [])
        return {c: batch.column(c) for c in ("h1", "h2", "ord")} | {"keys": keys}

    signed_rows = arrow_pass(own, run, "h1 long, h2 long, ord long, keys array<long>")
    least = signed_rows.groupBy("h1", "h2").agg(F.min(F.struct("ord", "keys")).alias("s"), F.count(F.lit(1)).alias("copies"))
    return stage(least.select("h1", "h2", F.col("s.ord").alias("node"), "s.keys", "copies"))


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, to be checked, and the members (key, node) of large buckets."""
    rows = nodes.select("node", F.explode("keys").alias("key")).distinct()
    buckets = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("c > 1"))
    members = stage(rows.join(buckets, "key"))
    few = members.filter(F.col("c") <= PAIRS).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("ns"))
    first = few.select("ns", F.posexplode("ns").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr(f"slice(ns, i + 2, {PAIRS})")).alias("b"))
    large = members.filter(F.col("c") > PAIRS)
    stars = large.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))).alias("p"))
    return stage(pairs.unionByName(stars.select("p.a", "p.b").filter("a < b")).distinct()), large.select("key", "node")


def _texts(own: DataFrame, pairs: DataFrame, large: DataFrame) -> DataFrame:
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("ord")).unionByName(large.select(F.col("node").alias("ord"))).distinct())
    # Merged at any size: whether the ids could be broadcast depends on the corpus, and so would the plan.
    return stage(own.join(wanted.hint("merge"), "ord", "left_semi").groupBy("ord").agg(F.min("text").alias("text")))


def _links(texts: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose texts pass the exact check."""
    both = pairs.join(texts.select(F.col("ord").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("ord").alias("b"), F.col("text").alias("tb")), "b")

    def run(batch: pa.RecordBatch) -> dict:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta, tb = batch.column("ta"), batch.column("tb")
        sets: dict[int, np.ndarray] = {}

        def of(node: int, column: pa.Array, i: int) -> np.ndarray:
            if node not in sets:
                if len(sets) > 256:
                    sets.clear()
                sets[node] = shingles(_values(column[i].as_py()), size)
            return sets[node]

        ok = []
        for i in range(len(a)):
            x, y = of(a[i], ta, i), of(b[i], tb, i)
            most = max(len(x), len(y))
            least = min(len(x), len(y))
            if least >= similarity * most - 1e-9 and len(np.intersect1d(x, y, assume_unique=True)) >= similarity * most - 1e-9:
                ok.append(i)
        return {"a": [a[i] for i in ok], "b": [b[i] for i in ok]}

    return stage(arrow_pass(both, run, "a long, b long"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share (the diagonal is left open), in bounded memory."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n > 1
    row, column = row[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(common.sum()), WIDTH):
        i, j = np.searchsorted(column, (start, start + WIDTH))
        has = np.zeros((len(sets), WIDTH), np.float32)
        has[row[i:j], column[i:j] - start] = 1
        counts += (has @ has.T).astype(np.int64)
    return counts


def _split_buckets(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the large buckets that hold several classes; of buckets with the same members one."""
    named = stage(large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    sums = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *sums).filter("lo <> hi")
    chosen = stage(several.groupBy("s0", "s1").agg(F.min("key").alias("key")).select("key"))
    return stage(named.join(chosen, "key"))


def _ties(left: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): classes that links between texts of different classes of a bucket tie together."""
    of_class = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    small = of_class.filter(F.col("m") < BLOCK).groupBy("key").agg(F.sum("m").alias("total"))
    classes = stage(of_class.join(small, "key", "left"))
    alone = F.col("m") >= BLOCK
    block = F.when(alone, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("total") / BLOCK)))
    dealt = stage(left.join(classes, ["key", "root"]).select("key", "node", "root", block.alias("block"), F.when(alone, F.col("root")).alias("of")))
    blocks = stage(dealt.groupBy("key", "block", "of").agg(F.count(F.lit(1)).alias("n")))
    one = blocks.select("key", F.col("block").alias("s"), F.col("of").alias("of_s"))
    other = blocks.select("key", F.col("block").alias("t"), F.col("of").alias("of_t"))
    # A large class is one already, so its blocks meet only those of others; a mixed block also meets itself.
    units = one.join(other, "key").filter("s <= t AND (of_s IS NULL OR of_t IS NULL OR of_s <> of_t)").select("key", "s", "t")
    sides = stage(units.select("key", "s", "t", F.explode(F.array_distinct(F.array("s", "t"))).alias("block")))
    rows = sides.join(dealt.select("key", "block", "node", "root"), ["key", "block"]).join(texts.withColumnRenamed("ord", "node"), "node")

    def run(unit: pa.Table) -> pa.Table:
        root, own = unit.column("root").to_numpy(), unit.column("block").to_numpy()
        sets = [shingles(_values(x), size) for x in unit.column("text").to_pylist()]
        n = np.array([len(x) for x in sets])
        ok = shared_counts(sets) >= similarity * np.maximum(n[:, None], n) - 1e-9
        ok &= root[:, None] < root
        if unit.column("s")[0].as_py() != unit.column("t")[0].as_py():
            ok &= own[:, None] != own
        a, b = np.nonzero(ok)
        found = np.unique(np.stack([root[a], root[b]], axis=1), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return stage(rows.groupBy("key", "s", "t").applyInArrow(run, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes, root the least of the component: alternating large-star and small-star."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has a shuffle on either side and splits where a node has very many edges.
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = stage(large)
        lower = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").filter("u > v").distinct())
        discard(least, large, lower)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), n_copies (rows with its text).

    Words are white-space words with A-Z lower-cased; a text of fewer than `size` words is one shingle; null or empty
    texts are equal to one another and near nothing else. Rows that share a doc_id share a class. Rows with a null
    doc_id are left alone: their class_id is null. Only the named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("ord"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.cast("binary").alias("text"))
    own = read.filter("ord IS NOT NULL")
    nodes = _nodes(own, size, similarity)
    pairs, large = _candidates(nodes)
    texts = _texts(own.select("ord", "text"), pairs, large)
    roots = components(_bound(nodes, own, _links(texts, pairs, size, similarity)))
    left = _split_buckets(large, roots)
    if not left.isEmpty():
        ties = _ties(left, texts, size, similarity)
        higher = components(ties).select(F.col("node").alias("low"), F.col("root").alias("top"))
        every = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("low"))
        roots = stage(every.join(higher, "low", "left").select("node", F.coalesce("top", "low").alias("root")).filter("node <> root"))
    names = nodes.select("h1", "h2", "node", "copies").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("class_id"), F.col("copies").alias("n_copies"))
    done = own.select("ord", "h1", "h2").join(stage(names), ["h1", "h2"])
    lone = read.filter("ord IS NULL").select(F.col("ord").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return done.select(F.col("ord").alias("doc_id"), "class_id", "n_copies").unionByName(lone)


def _bound(nodes: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """links, with ties between the texts of a repeated doc_id."""
    ids = own.select("ord", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).filter("ord <> node")
    # A copy's own id can be another text's node only if that id is repeated.
    ties = ids.join(nodes.select(F.col("node").alias("ord")), "ord", "left_semi").select(F.col("node").alias("a"), F.col("ord").alias("b"))
    return links.unionByName(ties.distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
