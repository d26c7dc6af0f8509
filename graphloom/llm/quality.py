"""Operator 6: quality classifier, histogram gradient-boosted trees over document statistics.

Trees of a fixed depth are fitted on binned statistics of a bounded sample of labelled documents and flattened into
arrays (feature, threshold, leaf value), which numpy traverses for all rows and trees of a batch at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table

#: Labelled rows that the trees are fitted on, at most; those of the least hashes of doc_id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2 = 120, 4, 64, 0.12, 1.0
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (_b < 128 and _c.isupper(), _b < 128 and _c.islower(), _c in "0123456789", _c in ".,;:!?'\"-", _c in "%*#&$@|<>{}[]^~_=+\\/`", _b >= 128)
NAMES = (
    "log_chars", "log_words", "upper", "lower", "digit", "punctuation", "symbol", "wide", "space", "word_length", "word_spread",
    "distinct_words", "top_word", "upper_words", "tail_marks", "line_length", "distinct_lines", "bars", "marks_per_word", "pairs",
)


def statistics(text: bytes) -> np.ndarray:
    """Of a text, in the order of NAMES; all zero for an empty one."""
    out = np.zeros(len(NAMES))
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ _CLASSES / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split(b"\n")
    out[:] = (
        np.log1p(n), np.log1p(len(words)), *shares, (counts[32] + counts[9] + counts[10] + counts[13]) / n, lengths.mean(), lengths.std(),
        len(seen) / m, max(seen.values(), default=0) / m, sum(map(bytes.isupper, words)) / m, sum(map(_marked, words)) / m,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), counts[124] / m, (counts[33] + counts[63]) / m,
        len(set(zip(words, words[1:]))) / m,
    )
    return out


def _marked(word: bytes) -> bool:
    return word[-1] in b"%*#&$!"


@dataclass
class Trees:
    """Complete binary trees, level by level: node i's children are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        if not len(x):
            return np.empty(0)
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(DEPTH):
            go = np.take_along_axis(x, self.feature[trees, at], axis=1) > self.threshold[trees, at]
            at = 2 * at + 1 + go
        margin = self.base + self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic loss. With no rows, or labels of one kind, every score is the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    base = float(np.log(share / (1 - share)))
    trees = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), base)
    if not 0 < y.sum() < len(y):
        return trees
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    features = x.shape[1]
    flat = bins + np.arange(features) * BINS
    margin = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            cell = (at - first)[:, None] * (features * BINS) + flat
            size = count * features * BINS
            sums = [np.bincount(cell.ravel(), np.repeat(v, features), size).reshape(count, features, BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (ga, ha) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(hl < 1e-3) | (ha - hl < 1e-3)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                f, cut = divmod(b, BINS)
                if gain[i, f, cut] > 1e-9:
                    trees.feature[t, first + i], trees.threshold[t, first + i] = f, edges[f][cut]
            node_f, node_t = trees.feature[t, at], trees.threshold[t, at]
            at = 2 * at + 1 + (x[np.arange(len(y)), node_f] > node_t)
        leaf = at - inner
        trees.leaf[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += trees.leaf[t][leaf]
    return trees


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most `sample` labelled rows whose doc_id isn't held out; null ids, labels and rows with neither match none."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` pairs of numbers: safe to broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": [statistics(t or b"").tolist() for t in batch.column("text").to_pylist()]}

    rows = arrow_pass(texts, run, "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist()).reshape(-1, len(NAMES))
    return fit(x, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, trees: Trees, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, a narrow pass. A null or empty text is scored by its all-zero
    statistics; the fold of a null doc_id is that of its empty text; repeated rows get a row each."""

    def run(batch: pa.RecordBatch) -> dict:
        x = np.stack([statistics(t or b"") for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "score": trees.score(x)}

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return arrow_pass(read, run, "doc_id long, score double").select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
