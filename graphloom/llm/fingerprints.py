"""Operator 4: document fingerprints, as bottom-k sketches of word-shingle hashes.

A sketch is the K least distinct hashes of a text's shingles. The sketch of a union is the K least of two sketches
together, so parts of a document, or documents of a collection, merge; two sketches estimate resemblance, containment
and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, doc_id_of, enter, keyed, shingles, table, word_values

K, SHINGLE, BITS = 128, 5, 48


def sketch(text: bytes, k: int = K, size: int = SHINGLE) -> np.ndarray:
    """The k least hashes (BITS bits each, ascending) of the text's shingles of white-space words."""
    found = np.unique(shingles(word_values(text.split()), size) >> np.uint64(64 - BITS))
    return found[:k]


def pack(hashes: np.ndarray) -> str:
    """Base64 of the hashes, BITS / 8 bytes each, most significant first."""
    return base64.b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    own = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, BITS // 8)
    return np.concatenate([np.zeros((len(own), 8 - BITS // 8), np.uint8), own], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike, an empty one and another aren't."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, n_shingles) for every row: a narrow pass. A null or empty text has an empty fingerprint; a
    text shorter than `size` words is one shingle; repeated rows get a row each."""

    def run(batch: pa.RecordBatch) -> dict:
        own = [sketch(t or b"", k, size) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fingerprint": list(map(pack, own)), "n_shingles": [distinct(a, k) for a in own]}

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return arrow_pass(read, run, "doc_id long, fingerprint string, n_shingles double")


def merged(prints: DataFrame, key: str, fingerprint_col: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """(key, fingerprint, n_shingles) of each group's union. Hot groups are merged within Arrow batches, then within
    salted parts, so that no task sees more than a sketch for each batch of a part. Null fingerprints count as empty."""

    def union(batch: pa.RecordBatch) -> dict:
        groups: dict = {}
        for g, f in zip(batch.column("key").to_pylist(), batch.column("f").to_pylist()):
            own = unpack(f or "")
            groups[g] = merge(groups[g], own, k) if g in groups else own
        return {"key": pa.array(list(groups), type=batch.column("key").type), "f": list(map(pack, groups.values()))}

    kind = dict(prints.dtypes)[key]
    part = arrow_pass(prints.select(F.col(key).alias("key"), F.col(fingerprint_col).alias("f")), union, f"key {kind}, f string")
    salted = part.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(salts)))

    def reduce(batch: pa.RecordBatch) -> dict:
        out = []
        for fs in batch.column("fs").to_pylist():
            own = np.empty(0, np.uint64)
            for f in fs:
                own = merge(own, unpack(f), k)
            out.append(own)
        return {"key": batch.column("key"), "f": list(map(pack, out)), "n": [distinct(a, k) for a in out]}

    def step(df: DataFrame, *by: str) -> DataFrame:
        return arrow_pass(df.groupBy(*by).agg(F.collect_set("f").alias("fs")).select("key", "fs"), reduce, f"key {kind}, f string, n double")

    return step(step(salted, "key", "salt"), "key").select(F.col("key").alias(key), F.col("f").alias("fingerprint"), F.col("n").alias("n_shingles"))


def _neighbours(own: DataFrame) -> DataFrame:
    """Each row in its bucket of consecutive documents, and behind each bucket the next one's first document.

    Buckets are cut at quantiles of doc_id, one a shuffle partition, and rows without a doc_id, which come last, by the
    first bits of their texts' hashes; the least document of each bucket is all that the driver sees.
    """
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(own.filter("th >= 0").approxQuantile("ord", [i / n for i in range(1, n)], 0.2 / n)))
    bounds = np.array(cuts, np.float64)

    def bucket(ords: np.ndarray, ths: np.ndarray) -> np.ndarray:
        known = np.searchsorted(bounds, ords.astype(np.float64), side="left")
        return np.where(ths >= 0, known, len(bounds) + 1 + (ords >> 58) + 32).astype(np.int32)

    def number(batch: pa.RecordBatch) -> dict:
        ords, ths = batch.column("ord"), batch.column("th")
        return {"ord": ords, "th": ths, "bucket": bucket(ords.to_numpy(), ths.to_numpy())}

    numbered = arrow_pass(own.select("ord", "th"), number, "ord long, th long, bucket int")
    least = numbered.groupBy("bucket").agg(F.min(F.struct("ord", "th")).alias("first")).orderBy("bucket").collect()
    before = {tuple(b.first): a.bucket for a, b in zip(least, least[1:] + least[:1])}

    def place(batch: pa.RecordBatch) -> dict:
        ords, ths = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
        some = np.flatnonzero(np.isin(ords, [o for o, _ in before]))
        guests = np.array([i for i in some.tolist() if (ords[i], ths[i]) in before], np.int64)
        take = pa.array(np.concatenate([np.arange(len(ords)), guests]))
        both = batch.take(take)
        of = np.concatenate([bucket(ords, ths), np.array([before[ords[i], ths[i]] for i in guests.tolist()], np.int32)])
        return {c: both.column(c) for c in ("ord", "th", "text")} | {"bucket": of, "guest": np.arange(len(of)) >= len(ords)}

    placed = arrow_pass(own, place, "ord long, th long, text binary, bucket int, guest boolean")
    return placed.repartitionById(n, "bucket").sortWithinPartitions("bucket", "guest", "ord", "th")


def edited_and_next(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Each document against its edited text and the next document.

    The edited text replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next document's
    text, in order of doc_id, after the last the first. Null texts are empty; null doc_ids come last; rows of one doc_id
    follow one another in order of their texts' hashes; a lone document is its own next. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    schema = "ord long, th long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target, step = to_arrow_schema(StructType.fromDDL(schema)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(step)
        held = None
        for batch in batches:
            rows = []
            for o, th, text, b, guest in zip(*(batch.column(c).to_pylist() for c in ("ord", "th", "text", "bucket", "guest"))):
                if guest and (held is None or held[0] != b):
                    continue  # a further row of the guest's doc_id
                own = sketch(text, k, size)
                if held is not None and held[0] == b:
                    _, key, before, old = held
                    chars = before.decode("utf-8", "replace")
                    cut = len(chars) // 4
                    edited = (chars[: len(chars) - cut] + text.decode("utf-8", "replace")[:cut]).encode()
                    new = sketch(edited, k, size)
                    rows.append((*key, len(chars), hashlib.sha256(edited).hexdigest(), pack(old), pack(new), resemblance(old, new, k), resemblance(old, own, k)))
                held = None if guest else (b, (o, th), text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), target)], schema=target)

    done = _neighbours(keyed(docs, id_col, text_col)).mapInArrow(run, schema)
    return done.select(doc_id_of().alias("doc_id"), *done.columns[2:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents"))
