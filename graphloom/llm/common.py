"""What the training-data operators share: reading, Arrow passes, shared-storage stages, 64-bit sequence hashes."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where an order is needed: such rows come after all others.
LAST = (1 << 63) - 1
COLLECT_S = 5.0
_collected = 0.0
#: Bytes that a per-process cache may hold, by estimate, before it is emptied; results never depend on it.
CACHE_BYTES = 32 << 20


class Cache(dict):
    """A dict of bounded bytes, in two generations: when half the bound is used up, the entries grow old, and old ones that
    nothing asks for again go with the next generation. All go when a worker turns to another operator's tasks."""

    every: list[Cache] = []
    step = ""

    def __init__(self, limit: int = CACHE_BYTES, inner: bool = False):
        """inner: it is part of an object that such a cache holds, and goes with it."""
        self.limit, self.used, self.old, self.unit = limit, 0, {}, 0
        if not inner:
            Cache.every.append(self)

    def put(self, key: object, value: object, cost: int):
        """Keep value, whose entry takes about `cost` bytes, and return it."""
        if self.used + cost > self.limit // 2:
            self.old, self.unit = dict(self), self.used // max(1, len(self))
            super().clear()
            self.used = 0
        if cost <= self.limit // 2:
            self.used += cost
            self[key] = value
        return value

    def recall(self, key: object):
        """The value of an old entry, which is young again; None if there is none."""
        value = self.old.get(key)
        return None if value is None else self.put(key, value, self.unit)

    def clear(self) -> None:
        super().clear()
        self.old, self.used = {}, 0


def enter(step: str) -> None:
    """A task of `step` begins in this worker: what other steps have cached goes, as workers are used again and again."""
    if Cache.step != step:
        for cache in Cache.every:
            cache.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)
        Cache.step = step


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def halved(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes, or of one row."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), most)
        yield from halved(batch.slice(half), most)


def arrow_pass(df: DataFrame, columns: Callable[[pa.RecordBatch], dict], schema: str, most: int | None = None) -> DataFrame:
    """Apply columns(batch) -> {name: values} to every Arrow batch; schema is Spark DDL. A narrow, stateless stage. With
    most, it gets pieces of at most so many bytes, or of one row: what it makes of a piece is gone before the next one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target, step = to_arrow_schema(StructType.fromDDL(schema)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(step)
        for batch in (piece for b in batches for piece in ([b] if most is None else halved(b, most))):
            if batch.num_rows:
                got = columns(batch)
                arrays = [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and survives lost executors.

    The shuffles behind it are of no more use. Spark deletes their files once the driver's JVM has collected what refers
    to them, which may be much later than the next shuffle needs the disk (there is no other call for it), so it is
    asked to collect now; not more often than every COLLECT_S seconds, as what short stages shuffle is little.
    """
    global _collected
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    if time.monotonic() - _collected > COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete what stage() wrote, once nothing still to be computed reads it."""
    for df in staged:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(Cache):
    """word (bytes) -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = self.recall(word)
        return self.put(word, xxhash.xxh64_intdigest(word), 170 + len(word)) if value is None else value


WORDS = WordHashes()

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _to_length(n: int) -> None:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequence:
    """Position-independent 64-bit hashes of slices of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        _to_length(n + 1)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers[0][:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers[1][start])

    def windows(self, m: int) -> np.ndarray:
        """Of all slices of m values, in order of their starts."""
        k = self.n - m + 1
        if k <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[m:] - self.sums[:k]) * _powers[1][:k])


def shingles(values: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of `size` values; a shorter text that isn't empty is one shingle."""
    if not len(values):
        return np.empty(0, np.uint64)
    return np.unique(Sequence(values).windows(min(size, len(values))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(ord, th, text): a row's doc_id, 31 bits of its text's hash and its UTF-8 bytes (null: empty).

    A row without a doc_id gets a hash of its text as ord, so that such rows are many keys and not one, and a negative
    th, by which rank_of() puts it after all others. With carry, also the struct carried: those columns as c0, c1, ...,
    and the field `n`, their number.

    Rows of one id with different texts differ in th; repeated rows are alike in all three and get like results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits, known = (1 << 31) - 1, F.col(id_col).cast("long")
    th = F.xxhash64(text).bitwiseAND(F.lit(bits))
    return docs.select(
        F.coalesce(known, F.xxhash64(F.lit(7), text)).alias("ord"),
        F.when(known.isNull(), th - F.lit(bits + 1)).otherwise(th).alias("th"),
        text.cast("binary").alias("text"),
        *([] if carry is None else [F.struct(F.lit(len(carry)).alias("n"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")]),
    )


def without(docs: DataFrame, id_col: str, rejected: DataFrame) -> DataFrame:
    """docs less the rows whose id is among rejected.ord; rows with a null id stay. The ids are staged first, so that
    Spark knows their size and broadcasts them only below its threshold."""
    gone = stage(rejected.select(F.col("ord").alias("_rejected_ord")).distinct())
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_rejected_ord"), "left_anti")


def rank_of(sign: str) -> F.Column:
    """The place of a row of keyed() in the order of documents; sign is a column that is negative where th is."""
    return F.when(F.col(sign) < 0, F.lit(LAST)).otherwise(F.col("ord"))


def doc_id_of() -> F.Column:
    return F.when(F.col("th") >= 0, F.col("ord"))
