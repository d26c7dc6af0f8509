"""Operator 10: substring deduplication by difference-cover anchors.

Windows of ANCHOR words are hashed only where their place in the document, modulo PERIOD, lies in a difference cover.
For any two places some shift below PERIOD takes both onto cover places, so two equal runs of WINDOW >= ANCHOR +
PERIOD - 1 words always share an aligned anchor. Anchors that occur in several documents are then extended, first by as
many words on both sides as windows around them can reach: if a document with a smaller id has the same, all those
windows are repeated. Only around the other anchors, near the ends of what documents share, windows are hashed whole
and compared, and each is removed if a document with a smaller id has it.

Hot keys: counts and least ids of anchors and windows are aggregated before their shuffle and written; the joins that
find the members again have nothing but shuffles on either side, so that Spark splits them where a key is skewed. What
is collected is one document's own places.

Anchors with equal contexts agree in two 64-bit hashes, of the anchor and of all its context; windows are compared by
two independent ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sequence, arrow_pass, discard, doc_id_of, keyed, mix, rank_of, signed, stage, table

WINDOW = 50
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
ANCHOR = WINDOW - PERIOD + 1
_PLACE = (1 << 32) - 1
#: Bytes of texts whose words are hashed together.
PIECE = 4 << 20
#: Bytes of words that are hashed eight at a time; longer words are hashed one by one.
LONG = 64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _cover_places(n: int, anchor: int) -> np.ndarray:
    last = n - anchor
    if last < 0:
        return np.empty(0, np.int64)
    places = (np.arange(0, last + 1, PERIOD)[:, None] + COVER).ravel()
    return places[places <= last]


def _values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the words of all texts, one after another, and where each text's begin, with the end."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined + bytes(8), np.uint8)
    inside = np.zeros(len(joined) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data[: len(joined)]]
    edges = np.flatnonzero(np.diff(inside))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(joined) + 1,), "<u8", data, strides=(1,))
    values = mix(eights[starts] & _MASKS[np.minimum(size, 8)] ^ size.astype(np.uint64) * _STEP)
    for done in range(8, LONG, 8):
        at = np.flatnonzero((size > done) & (size <= LONG))
        if not len(at):
            break
        values[at] = mix(values[at] * _STEP ^ eights[starts[at] + done] & _MASKS[np.minimum(size[at] - done, 8)])
    for i in np.flatnonzero(size > LONG).tolist():
        values[i] = xxhash.xxh64_intdigest(joined[starts[i] : starts[i] + size[i]])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return values, np.searchsorted(starts, begins)


def _rows(batch: pa.RecordBatch, make: Callable) -> tuple[np.ndarray, ...]:
    """Concatenate the arrays of make(row) over rows; ord and loc (th << 32 | place) go with each."""
    parts = []
    for i, (o, th) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("th").to_pylist())):
        got = make(i)
        if got is not None and len(got[0]):
            parts.append((signed(got[0]), np.full(len(got[0]), o, np.int64), (th << 32) | got[1].astype(np.int64)))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*parts)))


def _contexts(words: Sequence, at: np.ndarray, window: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifier of the words that windows around each anchor can reach, and of how far the ends of its text, which are
    at first and end, cut them."""
    low, high = np.maximum(at - PERIOD + 1, first), np.minimum(at + window, end)
    return mix(words.hashes(low, high) ^ mix(((at - low) << 32 | (high - at)).astype(np.uint64)))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    anchor = window - PERIOD + 1

    def run(batch: pa.RecordBatch) -> dict:
        values, offsets = _values(batch.column("text").to_pylist())
        n = np.diff(offsets)
        every = _cover_places(int(n.max()), anchor)
        counts = np.where(n >= window, np.searchsorted(every, n - anchor, "right"), 0)
        row = np.repeat(np.arange(len(n)), counts)
        place = every[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)]
        at, words = place + offsets[row], Sequence(values)
        ords, ths = (batch.column(c).to_numpy()[row] for c in ("ord", "th"))
        return {
            "k": signed(words.hashes(at, at + anchor)), "c": signed(_contexts(words, at, window, offsets[row], offsets[row + 1])),
            "ord": ords, "loc": (ths.astype(np.int64) << 32) | place,
        }

    return arrow_pass(docs, run, "k long, c long, ord long, loc long", PIECE)


def _near(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of places."""
    last = n - window
    delta = np.zeros(n + 2, np.int32)
    np.add.at(delta, np.maximum(places - PERIOD + 1, 0), 1)
    np.add.at(delta, np.minimum(places, last) + 1, -1)
    return np.flatnonzero(np.cumsum(delta[: last + 1]) > 0)


def _of(batch: pa.RecordBatch, i: int, column: str = "locs") -> np.ndarray:
    """Places listed for row i: those whose loc carries the row's own th."""
    locs = batch.column(column)[i].values
    if locs is None:
        return np.empty(0, np.int64)
    locs = locs.to_numpy(zero_copy_only=False)
    return np.unique(locs[locs >> 32 == batch.column("th")[i].as_py()] & _PLACE)


def _windows(listed: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        every, offsets = _values(batch.column("text").to_pylist())
        checks = []

        def make(i: int):
            values = every[offsets[i] : offsets[i + 1]]
            # What an earlier document is known to have needs no window: the least document that has it shows its own.
            at = np.setdiff1d(_near(_of(batch, i), len(values), window), _near(_of(batch, i, "whole"), len(values), window), assume_unique=True)
            if len(at):
                checks.append(signed(Sequence(mix(values)).hashes(at, at + window)))
            return Sequence(values).hashes(at, at + window), at

        key, ords, loc = _rows(batch, make)
        return {"w": key, "v": np.concatenate(checks) if checks else [], "ord": ords, "loc": loc}

    return arrow_pass(listed, run, "w long, v long, ord long, loc long", PIECE)


#: SQL: the th that a loc carries.
_TH = "shiftright(loc, 32) AS th"


def _listed(rows: DataFrame) -> DataFrame:
    """(ord, th, locs): the places of each document that concern it, bounded by its own length. A set, as many equal
    rows may share a key."""
    return rows.selectExpr("ord", _TH, "loc").groupBy("ord", "th").agg(F.collect_set("loc").alias("locs"))


def removal_marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ord, th, whole, locs): each document's anchors all of whose windows, and single windows, that an earlier one
    has."""
    anchors, rank = _anchors(docs, window), rank_of("loc")
    shared = stage(anchors.groupBy("k").agg(F.min(rank).alias("a"), F.max(rank).alias("z")).filter("a < z").select("k"))
    members = stage(anchors.join(shared, "k"))
    groups = stage(members.groupBy("k", "c").agg(F.min(rank).alias("least")))
    mixed = stage(groups.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("k", F.lit(True).alias("mixed")))
    named = stage(groups.join(mixed, "k", "left"))
    state = members.join(named, ["k", "c"]).withColumn("rank", rank).selectExpr("ord", _TH, "loc", "rank", "least", "mixed")
    found = state.groupBy("ord", "th").agg(
        F.collect_set(F.when(F.col("rank") > F.col("least"), F.col("loc"))).alias("whole"),
        F.collect_set(F.when((F.col("rank") == F.col("least")) & F.col("mixed"), F.col("loc"))).alias("locs"),
    )
    found = stage(found.filter("size(whole) + size(locs) > 0"))
    discard(shared, members, groups, mixed, named)
    windows = stage(_windows(docs.join(found.filter("size(locs) > 0"), ["ord", "th"]), window))
    first = stage(windows.groupBy("w", "v").agg(F.min(rank).alias("a"), F.max(rank).alias("z")).filter("a < z").select("w", "v", "a"))
    single = stage(_listed(windows.join(first, ["w", "v"]).filter(rank > F.col("a")).select("ord", "loc")))
    discard(windows, first)
    return found.select("ord", "th", "whole").join(single, ["ord", "th"], "full")


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, carry: tuple[str, ...] = (), preserve: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the kept words joined by single spaces), and the
    columns named in carry. With preserve, a text that loses nothing is kept as it is.

    Words are [^\\x20\\x09-\\x0D]+. A null or empty text has no words; shorter documents than the window lose none. Rows
    of one doc_id never remove from each other; a null doc_id comes after all others, so such rows lose what any other
    document has. Only the named columns are read. The window must be at least PERIOD words.
    """
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} or more")
    own = keyed(docs, id_col, text_col, carry)
    marks = removal_marks(own.select("ord", "th", "text"), window)
    joined = own.join(marks, ["ord", "th"], "left")
    kind = own.schema["carried"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = text.split()
            starts = _of(batch, i)
            whole = _of(batch, i, "whole")
            if len(whole):
                starts = np.union1d(starts, _near(whole, len(words), window))
            if len(starts):
                delta = np.zeros(len(words) + 1, np.int32)
                delta[starts] += 1
                delta[starts + window] -= 1
                keep = np.cumsum(delta[:-1]) == 0
                left = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(text if preserve and len(left) == len(words) else b" ".join(left))
        return {"ord": batch.column("ord"), "th": batch.column("th"), "carried": batch.column("carried"), "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    done = arrow_pass(joined.select("ord", "th", "text", "whole", "locs", "carried"), run, f"ord long, th long, n_words long, n_removed long, kept string, carried {kind}")
    return done.select(doc_id_of().alias("doc_id"), "n_words", "n_removed", "kept", *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
firsts AS (SELECT p, min(doc_id) AS a FROM starts GROUP BY p),
gone AS (SELECT doc_id, list(DISTINCT pos) AS g FROM (SELECT doc_id, unnest(range(s, s + 50)) AS pos FROM starts JOIN firsts USING (p) WHERE doc_id > a) GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
flagged AS (SELECT f.doc_id, f.word, f.pos, x.pos IS NOT NULL AS out FROM flat f LEFT JOIN (SELECT doc_id, unnest(g) AS pos FROM gone) x ON x.doc_id = f.doc_id AND x.pos = f.pos),
kept AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT out) AS t FROM flagged GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
