"""Operator 1: token counts of a unigram segmentation, by dynamic programming over a shared trie.

The distinct pre-tokens of a batch (words with the space mark in front) go into a trie in order, which visits its nodes
depth first. A node stands for a prefix and holds the best score of any segmentation of it into pieces, computed once
however many words share the prefix; the nodes where words end store their count of tokens. Only the nodes above the
current one are kept, so that the trie takes no more room than its longest word. Texts are then sums of the terminal
counts of their words, in one narrow pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_BYTES, Cache, arrow_pass, table

MARK = "▁"


class Trie:
    """Unigram forward scores over prefixes. pieces: {piece: score}; an unknown character costs UNKNOWN below the least
    score and counts as its UTF-8 bytes. Of equal scores the segmentation with fewer tokens counts."""

    UNKNOWN = 10.0

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - self.UNKNOWN
        self.pieces = pieces
        self.longest: dict[str, int] = {}  # of the pieces that end in a letter
        for p in pieces:
            self.longest[p[-1:]] = max(len(p), self.longest.get(p[-1:], 0))
        #: Terminal counts that later batches need again.
        self.known = Cache(CACHE_BYTES, inner=True)
        # The path to the current node: its letters, and of each prefix the best forward score and that one's tokens.
        self.text, self.score, self.tokens = "", [0.0], [0]

    def _insert(self, text: str) -> int:
        """The terminal count of text; nodes shared with the word before are there already."""
        pieces, longest, score, tokens = self.pieces, self.longest, self.score, self.tokens
        shared = 0
        for a, b in zip(text, self.text):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            letter = text[end - 1]
            best, least = None, 0
            for start in range(end - 1, max(0, end - longest.get(letter, 0)) - 1, -1):
                own = pieces.get(text[start:end])
                if own is not None:
                    total = score[start] + own
                    if best is None or total > best or total == best and tokens[start] + 1 < least:
                        best, least = total, tokens[start] + 1
            if letter not in pieces:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, least = total, tokens[end - 1] + len(letter.encode("utf-8", "surrogatepass"))
            score.append(best)
            tokens.append(least)
        self.text = text
        return tokens[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of MARK + word for each of the words; an empty word has none."""
        known, got, new = self.known, np.empty(len(words), np.int64), []
        for i, w in enumerate(words):
            n = known.get(w)
            if n is None:
                n = known.recall(w)
            if n is None:
                new.append((w, i))
            else:
                got[i] = n
        for w, i in sorted(new):
            got[i] = self._insert(MARK + w) if w else 0
        for w, i in new:
            if len(w) <= 64:
                known.put(w, int(got[i]), 160 + len(w))
        return got


def pieces_of(path: str) -> dict[str, float]:
    """{piece: score} of a sentencepiece file, without its control, unknown, byte and unused pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.vocab_size())
    return {model.id_to_piece(i): model.get_score(i) for i in n if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


_tries = Cache()


def trie(path: str) -> Trie:
    return _tries.get(path) or _tries.put(path, Trie(pieces_of(path)), 0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row: white-space words, and tokens of their best segmentations.

    A null or empty text has neither. Repeated rows get a row each; only the named columns are read.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        lists = pc.utf8_split_whitespace(pc.fill_null(batch.column("text"), ""))
        coded = lists.flatten().dictionary_encode()
        own = trie(path).counts(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
        # White space at a text's ends gives empty words, which have no tokens and aren't counted.
        sums = [np.concatenate([[0], np.cumsum(x[at])])[ends] for x in (own, own > 0)]
        return {"doc_id": batch.column("doc_id"), "n_pretokens": np.diff(sums[1]), "n_tokens": np.diff(sums[0])}

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(read, run, "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
