"""Operator 5: substring deduplication by bucket-pointer refinement over sampled suffixes.

Every suffix has a bucket, named by a 64-bit identifier. The first buckets are those of the q-grams of GRAM = q / 4
bytes, where a string to look for has 2q bytes. A refinement names a suffix's next bucket by the pair of its bucket's
identifier and that of the suffix at a later offset, so identifiers of q / 2 bytes come from those of q / 4, those of q
bytes from those of q / 2, and a whole string's from those of q bytes at s and at s + q; each round uses the updated
identifiers of the round before. Identifiers are made from the bucket's content, so equal in all documents without a
sort of all suffixes, of which the corpus has as many as bytes.

Suffixes are sampled for the rounds that need the whole corpus: in every string the leftmost least q-byte identifier is
its anchor, a choice that equal strings share. Rows are sorted and grouped by the anchors' identifiers; an anchor alone
in its bucket is unique, and so are all strings it stands for. The others are refined, by the same step each time:

1. anchors, by identifiers at the offsets that cover all the strings that they stand for;
2. blocks of BLOCK strings beside an anchor, likewise, in buckets of the bytes that those strings share;
3. single strings, by those at s and s + q, and an independent second hash.

Members of a bucket that stays shared have all their strings repeated, and one of them remains as the bucket's witness;
only members that are alone in a bucket of several, and witnesses of those, go on to the next step.

Sorting and grouping by identifiers are Spark's: aggregated before the shuffle and written, so that the joins by which
members are found again split where a bucket is hot. What is collected is one document's own places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sequence, arrow_pass, discard, doc_id_of, keyed, mix, signed, stage, table
from .word_dedup import _TH, _listed, _of, _rows

LENGTH = 200
#: Strings of a block; texts are shorter than 4 GB / BLOCK.
BLOCK = 8
_CHUNK = 1 << 20
_LETTERS, _OTHERS = np.random.default_rng(20240229).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over `width` values, by block-wise prefix and suffix minima."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - width + 1
    return np.minimum(behind[:k], ahead[width - 1 : width - 1 + k])


class Strings:
    """Bucket identifiers of the suffixes of a text, and the anchors of its strings of 2q bytes."""

    def __init__(self, text: bytes, q: int):
        self.text, self.n, self.q = text, len(text), q
        parts = [self._refine(low) for low in range(0, max(self.n - q + 1, 0), _CHUNK)]
        #: Of each suffix, the bucket of its first q bytes.
        self.bucket = np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def _refine(self, low: int) -> np.ndarray:
        """Identifiers of q bytes from those of shorter grams, for a piece of bounded size."""
        q, gram = self.q, -(-self.q // 4)
        data = np.frombuffer(self.text, np.uint8)[low : low + _CHUNK + q - 1]
        own, width = Sequence(_LETTERS[data]).windows(gram), gram
        while width < q:
            step = min(width, q - width)
            own, width = _pair(own[: len(own) - step], own[step:]), width + step
        return own

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first string, end of strings) of each anchor."""
        q, total = self.q, self.n - 2 * self.q + 1
        parts = []
        for low in range(0, max(total, 0), _CHUNK):
            high = min(low + _CHUNK, total)
            at = np.arange(low, high + q)
            ranks = mix(self.bucket[low : high + q] ^ np.uint64(0x5851F42D4C957F2D))
            ranked = (ranks >> np.uint64(24) << np.uint64(24)) | np.arange(len(at), dtype=np.uint64)
            of = (_least(ranked, q + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            parts.append((of[new] + low, new + low, np.append(new[1:], high - low) + low))
        if not parts:
            return (np.empty(0, np.int64),) * 3
        places, first, end = map(np.concatenate, zip(*parts))
        new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))  # a run may go on in the next piece
        return places[new], first[new], np.append(end[new[1:] - 1], end[-1])

    def keys(self, places: np.ndarray) -> np.ndarray:
        return self.bucket[places]

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The identifier of [start, end), of q to 3q bytes, by the buckets at the offsets that cover it."""
        second = np.minimum(start + self.q, end - self.q)
        return _pair(_pair(self.bucket[start], self.bucket[second]), self.bucket[end - self.q])

    def spans(self, places: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identifier of all bytes of the strings that an anchor stands for, with their place around it."""
        around = ((places - first) << 32 | (end - first)).astype(np.uint64)
        return mix(self.over(first, end - 1 + 2 * self.q) ^ mix(around))

    def names(self, starts: np.ndarray) -> np.ndarray:
        return _pair(self.bucket[starts], self.bucket[starts + self.q])

    def checks(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the strings that no bucket has a part in."""
        return Sequence(_OTHERS[np.frombuffer(self.text, np.uint8)]).hashes(starts, starts + 2 * self.q)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket identifier of what has a, and b at the later offset."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x2545F4914F6CDD1D)))


def _anchors(docs: DataFrame, q: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        texts, contexts = batch.column("text"), []

        def make(i: int):
            text = texts[i].as_py()
            if len(text) < 2 * q:
                return None
            strings = Strings(text, q)
            places, first, end = strings.anchors()
            contexts.append(signed(strings.spans(places, first, end)))
            return strings.keys(places), places

        key, ords, loc = _rows(batch, make)
        return {"k": key, "c": np.concatenate(contexts) if contexts else [], "ord": ords, "loc": loc}

    return arrow_pass(docs, run, "k long, c long, ord long, loc long")


def _strings_at(strings: Strings, places: np.ndarray) -> np.ndarray:
    """Starts of the strings whose anchor is one of places."""
    at, first, end = strings.anchors()
    ours = np.isin(at, places)
    return _ranges(first[ours], end[ours])


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of [first, end) of all rows, one after another."""
    n = end - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _block_strings(blocks: np.ndarray) -> np.ndarray:
    """Starts of the strings of blocks given as start * BLOCK + (strings - 1)."""
    first = blocks // BLOCK
    return np.unique(_ranges(first, first + blocks % BLOCK + 1))


def _blocks(listed: DataFrame, q: int) -> DataFrame:
    """Of the anchors listed: their strings in blocks, bucketed by the bytes that all strings of the whole block share."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, whole = batch.column("text"), []

        def make(i: int):
            wanted = _of(batch, i)
            if not len(wanted):
                return None
            strings = Strings(texts[i].as_py(), q)
            places, first, end = strings.anchors()
            ours = np.isin(places, wanted)
            at, first, end = places[ours], first[ours], end[ours]
            # A block is the strings whose distance before the anchor is j * BLOCK and up to BLOCK - 1 more.
            low, high = (at - end + 1) // BLOCK, (at - first) // BLOCK
            j, of = _ranges(low, high + 1), np.repeat(np.arange(len(at)), high - low + 1)
            start, stop = np.maximum(at[of] - j * BLOCK - BLOCK + 1, first[of]), np.minimum(at[of] - j * BLOCK + 1, end[of])
            core = at[of] - j * BLOCK
            around = (j << 40 | (at[of] - start) << 20 | (at[of] - stop)).astype(np.uint64)
            whole.append(signed(mix(strings.over(start, stop - 1 + 2 * q) ^ mix(around))))
            return mix(strings.over(core, core + 2 * q - BLOCK + 1) ^ mix(j.astype(np.uint64))), start * BLOCK + (stop - start - 1)

        key, ords, loc = _rows(batch, make)
        return {"k": key, "c": np.concatenate(whole) if whole else [], "ord": ords, "loc": loc}

    return arrow_pass(listed, run, "k long, c long, ord long, loc long")


def _names(listed: DataFrame, q: int) -> DataFrame:
    """Of the blocks listed: the identifiers of their strings."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, checks = batch.column("text"), []

        def make(i: int):
            blocks = _of(batch, i)
            if not len(blocks):
                return None
            strings, starts = Strings(texts[i].as_py(), q), _block_strings(blocks)
            checks.append(signed(strings.checks(starts)))
            return strings.names(starts), starts

        key, ords, loc = _rows(batch, make)
        return {"w": key, "v": np.concatenate(checks) if checks else [], "ord": ords, "loc": loc}

    return arrow_pass(listed, run, "w long, v long, ord long, loc long")


def _refined(rows: DataFrame) -> DataFrame:
    """One refinement of buckets k by c: (ord, th, whole, locs), the members that are repeated whole, and those to refine
    on."""
    shared = stage(rows.groupBy("k").count().filter("count > 1").select("k"))
    members = stage(rows.join(shared, "k"))
    buckets = stage(members.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "loc")).alias("witness")))
    mixed = stage(buckets.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k", F.lit(True).alias("mixed")))
    named = stage(buckets.join(mixed, "k", "left"))
    # A bucket's witness stands for all its members; one that is alone is its own.
    witness = F.col("mixed") & (F.col("ord") == F.col("witness.ord")) & (F.col("loc") == F.col("witness.loc"))
    found = members.join(named, ["k", "c"]).withColumn("stays", witness).selectExpr("ord", _TH, "loc", "n", "stays").groupBy("ord", "th").agg(
        F.collect_set(F.when(F.col("n") > 1, F.col("loc"))).alias("whole"), F.collect_set(F.when(F.col("stays"), F.col("loc"))).alias("locs")
    )
    found = stage(found.filter("size(whole) + size(locs) > 0"))
    discard(shared, members, buckets, mixed, named)
    return found


def repeated(docs: DataFrame, q: int) -> DataFrame:
    """(ord, th, whole, blocks, locs): each document's anchors and blocks all of whose strings, and the single strings,
    that are repeated."""
    key = ["ord", "th"]
    further = lambda found: docs.join(found.filter("size(locs) > 0").select(*key, "locs"), key)
    anchors = _refined(_anchors(docs, q))
    rows = stage(_blocks(further(anchors), q))
    blocks = _refined(rows)
    discard(rows)
    names = stage(_names(further(blocks), q))
    twice = stage(names.groupBy("w", "v").count().filter("count > 1").select("w", "v"))
    single = stage(_listed(names.join(twice, ["w", "v"]).select("ord", "loc")))
    discard(names, twice)
    return anchors.select(*key, "whole").join(blocks.select(*key, F.col("whole").alias("blocks")), key, "full").join(single, key, "full")


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans ([first, end) of maximal removed runs, in bytes), kept (binary).

    A byte goes if a string of `length` bytes over it also starts anywhere else in any row, the same one included. A
    null or empty text has no bytes; shorter texts than `length` lose none. Repeated rows are copies of one another like
    other equal texts. Only the named columns are read. length must be even, 2 * BLOCK or more.
    """
    if length % 2 or length < 2 * BLOCK:
        raise ValueError(f"length must be even, {2 * BLOCK} or more")
    q = length // 2
    own = keyed(docs, id_col, text_col)
    joined = own.join(repeated(own, q), ["ord", "th"], "left").select("ord", "th", "text", "whole", "blocks", "locs")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            places, blocks, starts = (_of(batch, i, c) for c in ("whole", "blocks", "locs"))
            if len(places):
                starts = np.union1d(starts, _strings_at(Strings(text, q), places))
            if len(blocks):
                starts = np.union1d(starts, _block_strings(blocks))
            spans = []
            if len(starts):
                gap = np.flatnonzero(np.diff(starts) > length)
                spans = list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))
            edges = [0, *[x for s in spans for x in s], len(text)]
            kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
            out.append((len(text), spans, kept))
        return {"ord": batch.column("ord"), "th": batch.column("th"), "n_bytes": [x[0] for x in out], "spans": [[list(s) for s in x[1]] for x in out], "kept": [x[2] for x in out]}

    done = arrow_pass(joined, run, "ord long, th long, n_bytes long, spans array<array<long>>, kept binary")
    return done.select(doc_id_of().alias("doc_id"), "n_bytes", "spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
