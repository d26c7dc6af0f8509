"""Operator 8: byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that stand next to each other inside no token of the vocabulary can never be merged into one, so
the place between them is a certain cut. A pre-token falls into fragments there; each is encoded on its own, and the
fragments' ids are concatenated. The pass over the texts is narrow: no shuffle, and memory bounded by the cache of words
and by the pieces of PIECE bytes that texts are taken in. Words of a piece that the cache doesn't have are encoded
together, the fragments of one length as the rows of a matrix in which each round merges the best pair of every row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_BYTES, Cache, arrow_pass, table

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters whose class and case no Unicode version of this decade has changed; texts with others take the library's split.
_ODD = regex.compile("[^\\x00-\\u0557\\u1e00-\\u1fff\\u2010-\\u205f\\u20a0-\\u20bf\\u2100-\\u2bff\\u3000-\\u30ff\\u4e00-\\u9fef\\uac00-\\ud7a3\\U0001f300-\\U0001f64f]")
#: Bytes of texts whose words are encoded together.
PIECE = 2 << 20
#: Fragments up to this length are merged as rows of matrices.
SHORT = 48


_SPLIT = regex.compile(rf"\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: The same for lower-case ASCII, where `re` is faster.
_SPLIT_ASCII = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+")


_NONE = 1 << 60


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encodes as the vocabulary file asks: lower case, white space dropped, word ends marked by a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.spec = spec
        self.library = None
        self.stops = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges[(self.vocab[a] << 20) | self.vocab[b]] = (rank, self.vocab[a + b])
        letters = _byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.joined = bytearray(65536)
        for token in self.vocab:
            own = [byte_of[c] for c in token.removesuffix(self.end)]
            for a, b in zip(own, own[1:]):
                self.joined[a << 8 | b] = 1
        self._table()
        self.words: Cache = Cache(3 * CACHE_BYTES, inner=True)

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(word)):
            if not joined[word[i - 1] << 8 | word[i]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _merge_short(self, ids: list[int]) -> list[int]:
        return [x for x in self._merge_rows(np.array([ids], np.int64))[0].tolist() if x >= 0]

    def _table(self) -> None:
        """The merges as an open hash table: keys, and what the pair of a key becomes, with its rank above it."""
        size = 1 << (4 * max(1, len(self.merges))).bit_length()
        self.keys, self.made = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        made = np.fromiter((r << 20 | new for r, new in self.merges.values()), np.int64, len(keys))
        at = self._slot(keys)
        while len(keys):
            # Of those that want one free slot the last written has it; the others go on to the next slot.
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.made[at[mine]] = made[mine]
            keys, made, at = keys[~mine], made[~mine], (at[~mine] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.keys).bit_length() - 1
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | new id for each pair, _NONE for those that no merge has."""
        keys = a << 20 | b
        at = self._slot(keys)
        out, open_ = np.full(len(keys), _NONE), np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys
            out[open_[hit]] = self.made[at[hit]]
            more = ~hit & (there >= 0)
            open_, keys, at = open_[more], keys[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge each row, of one length, to its end; -1 fills what is left free on its right."""
        n, width = ids.shape
        if width < 2 or not n:
            return ids
        done = np.full((n, width), -1, np.int64)
        pairs = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        while True:
            at = pairs.argmin(1)
            best = pairs[np.arange(len(rows)), at]
            go = best < _NONE
            if not go.all():
                done[rows[~go], : ids.shape[1]] = ids[~go]
                rows, ids, pairs, at, best = rows[go], ids[go], pairs[go], at[go], best[go]
            if not len(rows):
                return done
            each, w = np.arange(len(rows)), ids.shape[1]
            # The new id stands in the pair's first place; what is behind the pair moves up by one.
            shift = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            ids = np.take_along_axis(ids, shift, 1)
            ids[each, at] = best & 0xFFFFF
            if w == 2:
                done[rows, :1] = ids
                return done
            pairs = np.take_along_axis(pairs, shift[:, :-1] if w > 2 else shift, 1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < w - 2)
                ok[ok] = ids[each[ok], side[ok] + 1] >= 0
                r, c = each[ok], side[ok]
                pairs[r, c] = self._pairs(ids[r, c], ids[r, c + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and a linked list, for fragments where rescanning would be quadratic."""
        n, get = len(ids), self.merges.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else -1
                if x >= 0 and y >= 0 and (m := get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def _fragments(self, parts: list[tuple[bytes, bool]]) -> dict[tuple[bytes, bool], list[int]]:
        """The ids of each fragment (bytes, whether it ends a word)."""
        out, by_length = {}, {}
        for p in parts:
            if p not in out:
                out[p] = None
                by_length.setdefault(len(p[0]), []).append(p)
        inner, last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        for length, group in by_length.items():
            if length > SHORT:
                for part, ends in group:
                    ids = [self.inner[b] for b in part]
                    ids[-1] = self.last[part[-1]] if ends else ids[-1]
                    out[part, ends] = self._merge_long(ids)
                continue
            own = np.frombuffer(b"".join([p for p, _ in group]), np.uint8).reshape(len(group), length)
            ids = inner[own]
            ids[:, -1] = np.where([e for _, e in group], last[own[:, -1]], ids[:, -1])
            merged = self._merge_rows(ids)
            for p, row, n in zip(group, merged.tolist(), (merged >= 0).sum(1).tolist()):
                out[p] = row[:n]
        return out

    def word(self, token: str) -> list[int]:
        return list(map(int, self._entries([token])[0].partition("\t")[0].split(" ")))

    def _entries(self, tokens: list[str]) -> list[str]:
        """Ids, a tab and token strings, joined by spaces, of each of these words, which are kept."""
        cut = [self.cuts(t.encode("utf-8")) for t in tokens]
        known = self._fragments([(p, i == len(c) - 1) for c in cut for i, p in enumerate(c)])
        names, out = self.names, []
        for token, c in zip(tokens, cut):
            ids = known[c[0], True] if len(c) == 1 else [x for i, p in enumerate(c) for x in known[p, i == len(c) - 1]]
            got = f"{' '.join(map(str, ids))}\t{' '.join([names[i] for i in ids])}"
            out.append(got)
            if len(token) <= 64:
                self.words.put(token, got, 220 + len(token) + len(got))
        return out

    def _known(self, tokens: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """The ids of these words, and their token strings."""
        get, recall, missing, ids, strings = self.words.get, self.words.recall, [], {}, {}
        for t in tokens:
            got = get(t) or recall(t)
            if got is None:
                missing.append(t)
            else:
                ids[t], _, strings[t] = got.partition("\t")
        for t, got in zip(missing, self._entries(missing)):
            ids[t], _, strings[t] = got.partition("\t")
        return ids, strings

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # One letter at a time: a final capital sigma must not become the final small one.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _split(self, text: str) -> list[str]:
        if not _ODD.search(text):
            text = self._normal(text)
            return (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            split = self.spec | {"pre_tokenizer": self.spec["pre_tokenizer"]["pretokenizers"][0]}
            self.library = Tokenizer.from_str(json.dumps(split))
        return [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _parts(self, text: str) -> list[str | list[str]]:
        """The words of the text, in lists, and the special tokens between them."""
        cut = self.stops.split(text) if self.stops and "<|" in text else (text,)
        return [part if part in self.special else self._split(part) for part in cut]

    def _joined(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids, token strings) of each text, joined by spaces."""
        own = [self._parts(t) for t in texts]
        ids, names = self._known(set().union(*[p for parts in own for p in parts if not isinstance(p, str)]))
        out = []
        for parts in own:
            if len(parts) == 1 and not isinstance(parts[0], str):
                out.append((" ".join(map(ids.__getitem__, parts[0])), " ".join(map(names.__getitem__, parts[0]))))
            else:
                a = [x for p in parts for x in ([str(self.special[p])] if isinstance(p, str) else map(ids.__getitem__, p))]
                b = [x for p in parts for x in ([p] if isinstance(p, str) else map(names.__getitem__, p))]
                out.append((" ".join(a), " ".join(b)))
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, ids.split(" "))) if ids else [] for ids, _ in self._joined(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the file names no decoder; ids outside the vocabulary are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def digests_all(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, SHA-256 of ids, SHA-256 of the decoded text) of each text."""
        return [((ids.count(" ") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) for ids, decoded in self._joined(texts)]

    def digests(self, text: str) -> tuple[int, str, str]:
        return self.digests_all([text])[0]


_encoders = Cache()


def encoder(path: str) -> Encoder:
    """One per process and vocabulary file; the file is found on every machine by the same path."""
    return _encoders.get(path) or _encoders.put(path, Encoder(path), 0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; a null or empty text has no ids; repeated rows get a row each."""
    path = path or default_path()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(read, lambda b: {"doc_id": b.column("doc_id"), "ids": encoder(path).encode_all(_texts(b))}, "doc_id long, ids array<int>", PIECE)


def decode(encoded: DataFrame, path: str | None = None, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, text): the tokens' strings joined by spaces; null ids decode to an empty text."""
    path = path or default_path()
    read = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return arrow_pass(read, lambda b: {"doc_id": b.column("doc_id"), "text": [encoder(path).decode(i or []) for i in b.column("ids").to_pylist()]}, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); a null text counts as empty; repeated rows get a row each."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        rows = encoder(path).digests_all(_texts(batch))
        return {"doc_id": batch.column("doc_id")} | {k: [r[i] for r in rows] for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(read, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", PIECE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
