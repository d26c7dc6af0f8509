"""Operator 7: benchmark decontamination over a distributed positional inverted index.

The index stores the postings of every word of the corpus once. It is sharded by document, as search engines do it: a
segment holds some whole documents' postings, which for each term are the sorted positions at which it stands. Sharding
by term would give one task all postings of a frequent word, and a shuffle to every further term of a phrase.

All phrases of test items are looked up in a segment together. Each begins with the positions of its rarest term there,
and keeps those whose offset-adjusted position is in the list of its next rarest term, and so on. Proximity matches
extend each occurrence of the rarest term to the nearest ones of the others. Test items are a stated query set: they
go to the executors in blocks of BLOCK_WORDS words, one pass over the index a block, and what the passes find for a
row of the corpus is merged by its place in the index.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, discard, stage, table

WINDOW = 10
#: Words of test items that go to the executors at a time (a few MB).
BLOCK_WORDS = 400_000
#: Words of a segment of the index; a longer document is one on its own.
SEGMENT_WORDS = 1 << 20
#: Bytes of texts that are split into words at a time; segments of the index end with them.
TEXT_BYTES = 1 << 24
#: Positions of rarest terms that are followed up at a time.
_CANDIDATES = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; none for null."""
    return (text or b"").translate(_FOLD).split()


def _folded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and the number of each text's."""
    texts = pc.fill_null(texts, b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]]
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(bytes(data).translate(_FOLD))))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # not those before a leading space and behind a last one
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return words.filter(real), np.diff(before[ends])


def _segments(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """[first, end) of the documents of each segment."""
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if len(lengths):
        yield first, len(lengths)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, which compresses well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


class Segment:
    """Positional postings of some documents; a free position behind each document stops phrases."""

    def __init__(self, lengths: np.ndarray, terms: pa.Array, counts: np.ndarray, keys: np.ndarray):
        self.lengths, self.terms, self.counts, self.keys = lengths, terms, counts, keys
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.bits = _bits(self.starts[-1])

    @classmethod
    def build(cls, words: pa.Array, lengths: np.ndarray) -> Segment:
        """words: those of the documents one after another, lengths[i] of document i."""
        coded = words.dictionary_encode()
        at = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        bits = _bits(len(words) + len(lengths))
        keys = np.sort(coded.indices.to_numpy().astype(np.int64) << bits | at)
        return cls(lengths, coded.dictionary.cast(pa.binary()), np.bincount(keys >> bits, minlength=len(coded.dictionary)), keys)

    def packed(self) -> bytes:
        """All postings, each list as its first position and the steps from there."""
        at = self.keys & ((1 << self.bits) - 1)
        steps = np.diff(at, prepend=0)
        steps[self.bounds[:-1]] = at[self.bounds[:-1]]
        return _pack(steps)

    @classmethod
    def unpack(cls, lengths: np.ndarray, terms: pa.Array, counts: np.ndarray, packed: bytes) -> Segment:
        steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        at = total[1:] - np.repeat(total[first], counts)
        bits = _bits(int(lengths.sum()) + len(lengths))
        return cls(lengths, terms, counts, np.repeat(np.arange(len(counts)), counts) << bits | at)

    def postings(self, term: int) -> np.ndarray:
        """Positions of a term, ascending; none for -1."""
        return self.keys[self.bounds[term] : self.bounds[term + 1]] & ((1 << self.bits) - 1) if term >= 0 else np.empty(0, np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The words' term numbers here, -1 for those that do not occur."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def phrases(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all exact occurrences. ids: phrases x words, as term numbers; sizes: words of each."""
        here = np.arange(ids.shape[1]) < sizes[:, None]
        count = np.where(here, np.where(ids >= 0, self.counts[ids] if len(self.counts) else 0, 0), np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")  # offsets, from the rarest term's
        rare = count.min(axis=1, initial=np.iinfo(np.int64).max)
        some = np.flatnonzero((rare > 0) & (sizes > 0))
        parts = [(np.empty(0, np.int64),) * 2]
        for own in np.split(some, np.flatnonzero(np.diff(np.cumsum(rare[some]) // _CANDIDATES)) + 1):
            parts.append(self._intersect(ids, sizes, order, own, rare[own]))
        phrase, start = map(np.concatenate, zip(*parts))
        return phrase, start

    def _intersect(self, ids: np.ndarray, sizes: np.ndarray, order: np.ndarray, some: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the phrases `some`: the positions of the rarest term, then those in all further lists."""
        lead = ids[some, order[some, 0]]
        phrase = np.repeat(some, rare)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(rare) - rare, rare)
        start = (self.keys[np.repeat(self.bounds[lead], rare) + within] & ((1 << self.bits) - 1)) - order[phrase, 0]
        keep = start >= 0
        phrase, start = phrase[keep], start[keep]
        for step in range(1, ids.shape[1]):
            offset = order[phrase, step]
            place = start + offset
            wanted = ids[phrase, offset] << self.bits | place
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = (step >= sizes[phrase]) | (place < self.starts[-1]) & (self.keys[at] == wanted)
            phrase, start = phrase[ok], start[ok]
        return phrase, start

    def near(self, ids: list[int], slop: int) -> list[tuple[int, int, int]]:
        """(document, first, last) of each match with the terms in order and at most slop other words between them, and no
        shorter match inside.

        Every occurrence of the rarest term is extended to the nearest earlier terms on its left and the nearest later
        ones on its right, which gives the shortest such span around it; those that hold another one go.
        """
        lists = [self.postings(t) for t in ids]
        if not all(map(len, lists)):
            return []
        pivot = min(range(len(ids)), key=lambda i: len(lists[i]))
        first = last = lists[pivot]
        for listed in reversed(lists[:pivot]):
            at = np.searchsorted(listed, first) - 1
            first = np.where(at >= 0, listed[at], -(1 << 40))
        for listed in lists[pivot + 1 :]:
            at = np.searchsorted(listed, last + 1)
            last = np.where(at < len(listed), listed[np.minimum(at, len(listed) - 1)], 1 << 40)
        doc = np.searchsorted(self.starts, lists[pivot], side="right") - 1
        ok = (first >= self.starts[doc]) & (last < self.starts[doc + 1])
        spans = np.unique(np.stack([first[ok], last[ok], doc[ok]], axis=1), axis=0)
        # By descending start, then ascending end: a span goes if one further right ends no later.
        spans = spans[np.lexsort((spans[:, 1], -spans[:, 0]))]
        before = np.concatenate([[1 << 40], np.minimum.accumulate(spans[:, 1])[:-1]]) if len(spans) else np.empty(0)
        spans = spans[(spans[:, 1] < before) & (spans[:, 1] - spans[:, 0] + 1 - len(ids) <= slop)][::-1]
        return [(d, f - int(self.starts[d]), e - int(self.starts[d])) for f, e, d in spans.tolist()]


def _bits(positions: int) -> int:
    return max(1, int(positions).bit_length())


def positional_index(docs: DataFrame, id_col="doc_id", text_col="text", segment_words: int | None = None) -> DataFrame:
    """The index, written to the shared folder: a row a segment, with segment (its number), ids and lengths of its
    documents, terms, counts (of each term's positions) and postings. Null texts have no words; only the named columns
    are read."""
    most = segment_words or SEGMENT_WORDS

    def run(batch: pa.RecordBatch) -> dict:
        words, lengths = _folded(batch.column("text"))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = batch.column("doc_id").to_pylist()
        out = defaultdict(list)
        for first, end in _segments(lengths, most):
            own = Segment.build(words.slice(ends[first], ends[end] - ends[first]), lengths[first:end])
            row = {"ids": ids[first:end], "lengths": own.lengths, "terms": own.terms, "counts": own.counts, "postings": own.packed()}
            for k, v in row.items():
                out[k].append(v)
        return out | {"terms": pa.array([t.to_pylist() for t in out["terms"]], pa.list_(pa.binary()))}

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    built = arrow_pass(read, run, "ids array<long>, lengths array<long>, terms array<binary>, counts array<long>, postings binary", TEXT_BYTES)
    return stage(built.select(F.monotonically_increasing_id().alias("segment"), "*"))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, Segment]]:
    """(row, segment) of the segments of a batch of the index."""
    for i in range(batch.num_rows):
        lengths, terms, counts = (batch.column(c)[i].values for c in ("lengths", "terms", "counts"))
        yield i, Segment.unpack(lengths.to_numpy(zero_copy_only=False), terms, counts.to_numpy(zero_copy_only=False), batch.column("postings")[i].as_py())


class Phrases:
    """Distinct phrases of a block of items, padded to the longest, with the items that contain each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        terms: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [terms.setdefault(w, len(terms)) for w in fold_words(text)]
            for s in range(max(1, len(ids) - window + 1)) if ids else ():
                owners[tuple(ids[s : s + window])].add(str(item))
        self.terms = pa.array(list(terms), pa.binary())
        self.sizes = np.array(list(map(len, owners)), np.int64)
        self.ids = np.full((len(owners), self.sizes.max(initial=0)), -1, np.int64)
        for i, p in enumerate(owners):
            self.ids[i, : len(p)] = p
        self.owners = [sorted(x) for x in owners.values()]


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    block, size = [], 0
    for item, text in items.select(item_col, F.col(text_col).cast("binary")).toLocalIterator():
        if text:
            block.append((item, bytes(text)))
            size += len(text) // 6
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def _hits(index: DataFrame, block: list[tuple[object, bytes]], window: int) -> DataFrame:
    """(segment, place, items, spans) of the documents that have phrases of the block."""

    def scan(batch: pa.RecordBatch, cache={}) -> dict:
        if "phrases" not in cache:
            cache["phrases"] = Phrases(block, window)
        phrases, out = cache["phrases"], defaultdict(list)
        for i, own in _each(batch):
            # One more, for the padding, that is nowhere.
            ids = np.append(own.numbers(phrases.terms), -1)[phrases.ids]
            phrase, start = own.phrases(ids, phrases.sizes)
            doc = np.searchsorted(own.starts, start, side="right") - 1
            order = np.argsort(doc, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
                d = int(doc[rows[0]])
                first = start[rows] - own.starts[d]
                out["segment"].append(batch.column("segment")[i].as_py())
                out["place"].append(d)
                out["items"].append(sorted({x for p in np.unique(phrase[rows]).tolist() for x in phrases.owners[p]}))
                out["spans"].append(_union(first, first + phrases.sizes[phrase[rows]]))
        return {k: out[k] for k in ("segment", "place", "items", "spans")}

    return arrow_pass(index.select("segment", "lengths", "terms", "counts", "postings"), scan, "segment long, place int, items array<string>, spans array<array<long>>")


def _union(first: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Maximal [first, end) runs of what the spans cover."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return np.stack([first[new], np.append(reach[new[1:] - 1], reach[-1])], axis=1).tolist() if len(first) else []


def _rows(index: DataFrame) -> DataFrame:
    """(segment, place, doc_id, n_words) of the rows of the corpus."""
    each = index.select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "d"))
    return each.select("segment", "place", F.col("d.ids").alias("doc_id"), F.col("d.lengths").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (ids as sorted strings), spans of hit words.

    A null or empty text has no words; a null or wordless item has no windows; an item shorter than the window is one
    window. Equal windows of several items count for each of them. Repeated rows get a row each. With no items at all,
    nothing is hit. Only the named columns are read, so other columns can't clash.
    """
    index = positional_index(docs, id_col, text_col)
    found = None
    for block in _blocks(items, item_col, item_text):
        own = stage(_hits(index, block, window))
        found = own if found is None else found.unionByName(own)
    rows = stage(_rows(index)) if found is not None else _rows(index)
    if found is None:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<array<long>>").alias("spans"))
    discard(index)
    both = found.groupBy("segment", "place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batch: pa.RecordBatch) -> dict:
        merged = [_union(*np.array(s, np.int64).reshape(-1, 2).T) for s in batch.column("spans").to_pylist()]
        return {c: batch.column(c) for c in ("segment", "place", "items")} | {"spans": merged, "n_hit": [sum(e - f for f, e in s) for s in merged]}

    merged = arrow_pass(both, merge, "segment long, place int, items array<string>, spans array<array<long>>, n_hit long")
    joined = rows.join(merged, ["segment", "place"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("items", "array<string>"), none("spans", "array<array<long>>"))


def proximity(docs: DataFrame, phrases: list[str], slop: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, phrase, first, last): the phrases' terms in order with at most slop other words between them and no shorter
    match inside.

    phrases is a stated query set and goes to the executors whole; wordless phrases match nothing, and a phrase that is
    asked for twice gets its matches once.
    """
    queries = {p: words for p in phrases if (words := fold_words(p.encode()))}
    index = positional_index(docs, id_col, text_col)

    def scan(batch: pa.RecordBatch) -> dict:
        out = defaultdict(list)
        for i, own in _each(batch):
            ids = batch.column("ids")[i].as_py()
            for p, words in queries.items():
                for d, first, last in own.near(own.numbers(pa.array(words, pa.binary())).tolist(), slop):
                    for k, v in (("doc_id", ids[d]), ("phrase", p), ("first", first), ("last", last)):
                        out[k].append(v)
        return {k: out[k] for k in ("doc_id", "phrase", "first", "last")}

    # A segment at a time: frequent words make many matches.
    return arrow_pass(index.drop("segment"), scan, "doc_id long, phrase string, first long, last long", 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: What the registered proximity query looks for, and how many other words may be between the terms.
NEAR, SLOP = ("the of", "in the", "en er"), 12


def proximity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(table(spark, sf_dir, "documents"), list(NEAR), SLOP)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0)),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM words),
found AS (
  SELECT d.doc_id, d.s, x.n, x.item_id FROM (
    SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS p FROM starts, (SELECT DISTINCT n FROM windows) WHERE s + n - 1 <= len(w)) d
  JOIN windows x ON x.n = d.n AND x.p = d.p),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id),
of_doc AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN of_doc USING (doc_id)
"""

#: A match of two terms without another inside: the second follows the first with neither of them in between.
NEAR_ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM words),
phrases AS (SELECT p AS phrase, split_part(p, ' ', 1) AS a, split_part(p, ' ', 2) AS b FROM (VALUES %s) v(p)),
near AS (
  SELECT doc_id, phrase, a, b, word, pos, lag(word) OVER q AS prior_word, lag(pos) OVER q AS prior_pos
  FROM flat JOIN phrases ON word = a OR word = b WINDOW q AS (PARTITION BY doc_id, phrase ORDER BY pos))
SELECT doc_id, phrase, prior_pos AS "first", pos AS "last" FROM near WHERE word = b AND prior_word = a AND pos - prior_pos - 1 <= %d
""" % (", ".join(f"('{p}')" for p in NEAR), SLOP)
