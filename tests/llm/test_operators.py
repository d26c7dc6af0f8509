"""The ten operators against brute force, on a corpus of edge cases, and on empty tables."""

import hashlib
import json
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, byte_dedup, common, decontaminate, fingerprints, fixity, language, near_dedup, quality, token_counts, word_dedup
from graphloom.llm.common import Sequence, word_values

from .conftest import SCHEMA, corpus, prose

LAST = 10**18


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(got, want) -> None:
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# 1


def test_token_counts_are_those_of_a_unigram_model(docs, none):
    from tokenizers import Tokenizer, models

    pieces = token_counts.pieces_of(token_counts.default_path())
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0))

    def count(word: str) -> int:
        return sum(1 if t in pieces else len(t.encode()) for t in model.encode("▁" + word).tokens)

    got = {(r.doc_id, r.n_pretokens): r.n_tokens for r in token_counts.token_counts(docs).collect()}
    for i, text, *_ in corpus():
        words = (text or "").split()
        if len(words) < 300 and not any(len(w) > 100 for w in words):
            assert got[i, len(words)] == sum(map(count, words)), text[:50]
    assert token_counts.token_counts(none).count() == 0


def tokens_of(word: str, pieces: dict, unknown: float) -> int:
    """By every start of every prefix, without a trie."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = [(best[s][0] + pieces[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        letter = word[end - 1]
        if letter not in pieces and (not found or best[-1][0] + unknown > max(found)[0]):
            found = [(best[-1][0] + unknown, -best[-1][1] - len(letter.encode()))]
        score, tokens = max(found)
        best.append((score, -tokens))
    return best[-1][1]


def test_trie_gives_the_counts_of_a_plain_program():
    pieces = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁ab": -3.0}
    trie = token_counts.Trie(pieces)
    assert trie.counts(["ab", "abab", "aé", "", "ab" * 50]).tolist() == [1, 2, 2 + 2, 0, 50]
    rng = random.Random(4)
    for _ in range(20):  # terminal counts kept from earlier batches, shared prefixes, long and unknown ones
        words = list({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 90 if i % 9 == 0 else 7))) for i in range(60)})
        assert trie.counts(words).tolist() == [tokens_of("▁" + w, pieces, trie.unknown) for w in words]


def test_token_counts_of_long_texts_and_words(spark):
    pieces = token_counts.pieces_of(token_counts.default_path())
    trie = token_counts.Trie(pieces)
    texts = [prose(5, 9000), "ab" * 900 + "\x85 x\u3000y\x1cz ", " lead\n\ttail  ", "\u00a0", "日本語 " * 40]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = {w: tokens_of("▁" + w, pieces, trie.unknown) if len(w) < 100 else int(trie.counts([w])[0]) for w in set(t.split())}
        assert got[i] == (len(t.split()), sum(want[w] for w in t.split()))


# 2


def shingle_set(text) -> set:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows: list[tuple]) -> dict:
    own = [(i, t or "") for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t) for _, t in own]
    for a in range(len(own)):
        for b in range(a):
            most = max(len(sets[a]), len(sets[b]))
            if own[a][1] == own[b][1] or most and len(sets[a] & sets[b]) >= 0.8 * most:
                x, y = sorted((find(own[a][0]), find(own[b][0])))
                parent[y] = x
    return {i: find(i) for i, _ in own}


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(corpus()) and all(r.class_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes(corpus())
    assert near_dedup.near_duplicates(none).count() == 0


def test_large_buckets_lose_no_class(spark):
    base = prose(20, 120).split()
    rng, rows = random.Random(3), []
    for i in range(90):  # more near-copies than a bucket pairs
        own = list(base)
        own[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:40]) + " " + prose(100 + i, 90)) for i in range(60)]  # a common passage only
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_every_pair_of_a_template_is_compared(spark):
    base, rng, rows = prose(30, 240).split(), random.Random(8), []
    for i in range(200):  # about as near the template as two of them are near each other: buckets of far more than PAIRS
        own = list(base)
        for k in range(4 + i % 3):
            own[5 + 38 * k + rng.randrange(30)] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)


def test_links_between_classes_of_a_large_bucket(spark, monkeypatch):
    """A chain in a bucket that everything shares: neither its least nor its greatest text is near the others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)  # many blocks, of classes large and small
    monkeypatch.setattr(near_dedup, "PAIRS", 4)
    monkeypatch.setattr(near_dedup, "band_keys", lambda sig, n, similarity: np.array([7, 8 + (int(sig[0]) & 1)], np.uint64))
    words, rows = prose(40, 400).split(), []
    for i in range(40):
        rows.append((i * 3, " ".join(words[6 * i : 6 * i + 60])))  # near its neighbours only
    rows += [(1 + i * 3, prose(50 + i, 60)) for i in range(25)] + [(200 + i, " ".join(words[300:360] + [f"end{i}"])) for i in range(30)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_banding_meets_its_recall():
    for p in range(12):
        s = near_dedup.jaccard_bound(p, 0.8)
        b, r = near_dedup.banding(s)
        assert b * r <= near_dedup.ROWS and 1 - (1 - s**r) ** b >= near_dedup.RECALL
    assert near_dedup.jaccard_bound(0, 0.8) == 1.0 and near_dedup.jaccard_bound(8, 0.8) == pytest.approx(2 / 3)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# 3


def test_fixity_finds_each_damage(spark):
    rows = [(i, f"http://h/{i}", f"page {i}" * 3) for i in range(0, 9000, 7)] + [(None, None, None), (14, "again", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    whole = fixity.fixity_report(pages, pages, "page_id", record)
    assert {r.status for r in whole.collect()} == {"ok"} and whole.count() == len(rows) - 1
    hurt = spark.createDataFrame([(i, u, h if i != 70 else "bad") for i, u, h in rows if i not in (21, 14)] + [(99999, "new", "x")], "page_id long, url string, html string")
    got = {r.page_id: r.status for r in fixity.fixity_report(pages, hurt, "page_id", record).filter("status <> 'ok'").collect()}
    assert got == {70: "corrupt", 21: "missing", 14: "missing", 99999: "extra"}
    none = pages.limit(0)
    assert fixity.fixity_report(none, none, "page_id", record).count() == 0
    assert {r.status for r in fixity.fixity_report(pages, none, "page_id", record).collect()} == {"missing"}


def test_fixity_of_ids_below_zero_and_far_apart(spark):
    ids = [-2, -1, 0, 5, None, -64, -65, -4097, 2**62, -(2**62), 63, 64]
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in ids], "page_id long, url string, html string")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = fixity.fixity_report(pages, pages, "page_id", record).collect()
    order = sorted(ids, key=lambda i: -(2**63) if i is None else i)
    assert [r.page_id for r in sorted(rows, key=lambda r: r.offset)] == order and {(r.n_records, r.status) for r in rows} == {(1, "ok")}
    hurt = pages.withColumn("html", F.when(F.col("page_id") == -65, "bad").otherwise(F.col("html"))).filter("page_id IS NULL OR page_id <> -1")
    got = {r.page_id: r.status for r in fixity.fixity_report(pages, hurt, "page_id", record).filter("status <> 'ok'").collect()}
    assert got == {-65: "corrupt", -1: "missing"}


def test_offsets_are_those_in_the_file(spark):
    pages = spark.createDataFrame([(i * 5, f"http://h/{i}", "é" * i) for i in range(300)], "page_id long, url string, html string")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    report = fixity.fixity_report(pages, pages, "page_id", record).orderBy("page_id").collect()
    data = b"".join(bytes(r[0]) for r in pages.orderBy("page_id").select(record).collect())
    parsed = fixity.parse_records(data)
    assert [(r.offset, r.length) for r in report] == [(at, n) for _, at, n, _ in parsed]
    assert [block.decode() for *_, block in parsed] == ["é" * i for i in range(300)] and all(sha(data[r.offset : r.offset + r.length]) == r.sha256 for r in report)


# 4


def test_fingerprints_and_edits(spark, docs, none):
    def check(df, rows: list[tuple]) -> None:
        got = fingerprints.edited_and_next(df).collect()
        hashed = {t: h for t, h in df.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()}
        later = {t: h for t, h in df.select("text", F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))).distinct().collect()}
        place = lambda r: (r[0] is None, later[r[1]] if r[0] is None else r[0], hashed[r[1]] & ((1 << 31) - 1))
        order = [(i, t or "") for i, t, *_ in sorted(rows, key=place)]
        want = []
        for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
            cut = len(a) // 4
            edited = a[: len(a) - cut] + b[:cut]
            own = [fingerprints.sketch(t.encode()) for t in (a, edited, b)]
            want.append((i, len(a), sha(edited), *map(fingerprints.pack, own[:2]), fingerprints.resemblance(own[0], own[1]), fingerprints.resemblance(own[0], own[2])))
            assert abs(jaccard(a, b) - want[-1][6]) < 0.15 and abs(jaccard(a, edited) - want[-1][5]) < 0.15
        same([tuple(r) for r in got], want)

    check(docs, corpus())
    # Rows without an id are many, some of them alike, and lie in buckets of their own.
    rows = [(None if i % 3 else i, prose(i % 70, 40)) for i in range(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert fingerprints.edited_and_next(none).count() == 0


def jaccard(a: str, b: str) -> float:
    x, y = (set(_shingles(t)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def _shingles(text: str) -> list:
    words = text.encode().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_edited_wraps_around_and_a_lone_document_is_its_own_next(spark):
    one = fingerprints.edited_and_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abcdefab") and one.near_next == 1.0
    rows = [(i, chr(97 + i) * 8) for i in range(20)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: sha(t[:6] + rows[(i + 1) % 20][1][:2]) for i, t in rows}


def test_sketches_merge_and_estimate(spark):
    texts = [prose(s, 400).encode() for s in range(3)]
    a, b, c = map(fingerprints.sketch, texts)
    joined = fingerprints.merge(fingerprints.merge(a, b), c)
    exact = np.unique(np.concatenate([fingerprints.sketch(t, 10**6) for t in texts]))
    assert (joined == exact[: fingerprints.K]).all() and (fingerprints.unpack(fingerprints.pack(a)) == a).all()
    assert fingerprints.distinct(joined) == pytest.approx(len(exact), rel=0.3) and fingerprints.distinct(a[:5]) == 5
    both = fingerprints.sketch(texts[0] + b" " + texts[1])
    assert fingerprints.containment(a, both) > 0.85 and fingerprints.resemblance(a, b) < 0.05 and fingerprints.resemblance(a[:0], a[:0]) == 1.0
    df = spark.createDataFrame([("x", t.decode()) for t in texts] + [("y", ""), (None, None)], "g string, text string").withColumn("doc_id", F.lit(1).cast("long"))
    prints = df.select("g", F.monotonically_increasing_id().alias("doc_id"), "text")
    named = prints.select("doc_id", "g").join(fingerprints.fingerprints(prints), "doc_id")
    got = {r.g: r.fingerprint for r in fingerprints.merged(named, "g").collect()}
    assert got == {"x": fingerprints.pack(joined), "y": "", None: ""}


# 5


def repeated_bytes(rows: list[tuple], length: int) -> list[tuple]:
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        on = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                on[s : s + length] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[False], on[:-1], [False]]).astype(int))).reshape(-1, 2).tolist()
        out.append((i, len(t), runs, bytes(b for b, o in zip(t, on) if not o)))
    return out


@pytest.mark.parametrize("length", [200, 20])
def test_byte_dedup(docs, none, length):
    got = [(r.doc_id, r.n_bytes, [list(s) for s in r.spans], bytes(r.kept)) for r in byte_dedup.dedup(docs, length=length).collect()]
    same(got, repeated_bytes(corpus(), length))
    assert byte_dedup.dedup(none).count() == 0


def test_byte_dedup_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(byte_dedup, "_CHUNK", 37)
    for text in (b"ab" * 300, prose(30, 300).encode()):
        strings = byte_dedup.Strings(text, 20)
        places, first, end = strings.anchors()
        monkeypatch.setattr(byte_dedup, "_CHUNK", 1 << 20)
        assert all((x == y).all() for x, y in zip((places, first, end), byte_dedup.Strings(text, 20).anchors()))
        monkeypatch.setattr(byte_dedup, "_CHUNK", 37)
        assert (first[1:] == end[:-1]).all() and first[0] == 0 and end[-1] == len(text) - 39 and ((first <= places) & (places <= first + 20)).all()


# 6


def test_quality_learns_and_scores_edge_cases(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(None, 1, 0), (9999, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(df, labels)
    got = quality.score(df, trees).collect()
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got) and all(r.held_out == quality.held_out(r.doc_id) for r in got)
    edge = quality.score(docs, trees).collect()
    assert len(edge) == len(corpus()) and all(0 <= r.score <= 1 for r in edge) and quality.score(none, trees).count() == 0
    blank = quality.train(none, labels.limit(0))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5} and rng


def test_statistics_are_those_of_a_plain_program():
    text = "Big BIG cat!! sat | on 3 mats.\nBig cat\nBig cat\n%% é"
    got = dict(zip(quality.NAMES, quality.statistics(text.encode())))
    words, data, lines = text.encode().split(), text.encode(), text.encode().split(b"\n")
    share = lambda f: sum(map(f, data)) / len(data)
    want = {
        "log_chars": np.log1p(len(data)), "log_words": np.log1p(len(words)), "upper": share(lambda b: 65 <= b <= 90), "lower": share(lambda b: 97 <= b <= 122),
        "digit": share(lambda b: 48 <= b <= 57), "punctuation": share(lambda b: chr(b) in ".,;:!?'\"-"), "symbol": share(lambda b: chr(b) in "%*#&$@|<>{}[]^~_=+\\/`"),
        "wide": share(lambda b: b >= 128), "space": share(lambda b: chr(b) in " \t\n\r"), "word_length": np.mean([len(w) for w in words]), "word_spread": np.std([len(w) for w in words]),
        "distinct_words": len(set(words)) / len(words), "top_word": Counter(words).most_common(1)[0][1] / len(words), "upper_words": sum(w.isupper() for w in words) / len(words),
        "tail_marks": sum(chr(w[-1]) in "%*#&$!" for w in words) / len(words), "line_length": np.log1p(len(data) / len(lines)), "distinct_lines": len(set(lines)) / len(lines),
        "bars": text.count("|") / len(words), "marks_per_word": (text.count("!") + text.count("?")) / len(words), "pairs": len(set(zip(words, words[1:]))) / len(words),
    }
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert not quality.statistics(b"").any()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_quality_of_documents_that_were_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, sf).filter("held_out").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    assert all(quality.held_out(i) for i in got) and len(labels) > 40
    assert np.mean([got[i].predicted == y for i, y in labels]) >= 0.93
    pairs = [(got[i].score > got[j].score) + 0.5 * (got[i].score == got[j].score) for i, x in labels for j, y in labels if x > y]
    assert np.mean(pairs) >= 0.95


def test_trees_are_those_of_a_plain_walk():
    x = np.random.default_rng(0).normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    trees = quality.fit(x, y)
    for row, score in zip(x[:20], trees.score(x[:20])):
        margin = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            margin += leaf[node - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


# 7


def contaminated(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            grams[tuple(w[s : s + window])].add(str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for s in range(len(w)):
            for n in {len(g) for g in grams}:
                g = tuple(w[s : s + n])
                if len(g) == n and g in grams:
                    hit |= set(range(s, s + n))
                    found |= grams[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark, docs, none):
    first, fifth = prose(1, 70).split(), prose(5, 9000).split()
    items = [(10, " ".join(first[5:40]).upper()), (9, " ".join(fifth[100:110]) + "."), (2, "One, two!"), (3, None), (4, "?!"), (5, "one two"), (None, "nothing like it")]
    df = spark.createDataFrame(items, "item_id long, text string")
    pick = lambda d: [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in d.collect()]
    same(pick(decontaminate.contamination(docs, df)), contaminated(corpus(), items))
    assert {r.n_hit for r in decontaminate.contamination(docs, df.limit(0)).collect()} == {0} and decontaminate.contamination(none, df).count() == 0


def test_blocks_and_segments_change_nothing(spark, docs, monkeypatch):
    items = [(i, " ".join(prose(1, 70).split()[i : i + 15])) for i in range(0, 55, 3)] + [(99, "one two"), (98, "ab" * 900)]
    df = spark.createDataFrame(items, "item_id long, text string")
    # Rows of one id and as many words, whose findings must stay apart.
    twins = spark.createDataFrame([(1, "one two x"), (1, "x y z"), (1, "z one two"), (None, "one two x"), (None, "q one two")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(twins)
    rows = [(r.doc_id, r.text) for r in both.collect()]
    pick = lambda d: [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in d.collect()]
    want = contaminated(rows, items)
    same(pick(decontaminate.contamination(both, df)), want)
    spans = rows_of(decontaminate.contamination(both, df).select("doc_id", "n_words", "spans"))
    for name, value in (("BLOCK_WORDS", 150), ("SEGMENT_WORDS", 40)):
        monkeypatch.setattr(decontaminate, name, value)
    found = decontaminate.contamination(both, df)
    same(pick(found), want)
    assert rows_of(found.select("doc_id", "n_words", "spans")) == spans


def test_segments_pack_and_find_as_plain_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "_CANDIDATES", 7)

    rng = random.Random(9)
    for n in (0, 1, 7, 60):
        docs = [[rng.choice(["a", "b", "c", "d", "eé"]).encode() for _ in range(rng.randrange(30))] for _ in range(n)]
        lengths = np.array(list(map(len, docs)), np.int64)
        words = pa.array([w for d in docs for w in d], pa.binary()).cast(pa.string())
        built = decontaminate.Segment.build(words, lengths)
        own = decontaminate.Segment.unpack(lengths, built.terms, built.counts, built.packed())
        assert (own.keys == built.keys).all()
        phrases = [[rng.choice(["a", "b", "c", "d", "eé", "zz"]).encode() for _ in range(rng.randrange(1, 4))] for _ in range(30)]
        terms = sorted({w for p in phrases for w in p})
        ids = np.full((len(phrases), 3), -1)
        numbers = own.numbers(pa.array(terms, pa.binary()))
        for i, p in enumerate(phrases):
            ids[i, : len(p)] = [numbers[terms.index(w)] for w in p]
        got = sorted(zip(*(x.tolist() for x in own.phrases(ids, np.array(list(map(len, phrases)))))))
        assert got == sorted((i, int(own.starts[d]) + s) for i, p in enumerate(phrases) for d, text in enumerate(docs) for s in range(len(text)) if text[s : s + len(p)] == p)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x b y y c"), (2, "b a c"), (3, None), (4, "a b z a b c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.phrase, r.first, r.last) for r in decontaminate.proximity(df, ["a b c", "a b", "?"], 3).collect())
    assert got == [(1, "a b", 0, 2), (1, "a b c", 0, 5), (4, "a b", 0, 1), (4, "a b", 3, 4), (4, "a b c", 3, 5)]


def test_texts_and_matches_are_held_a_piece_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, decontaminate.proximity(df, ["a b"], 3).collect()))
    monkeypatch.setattr(decontaminate, "TEXT_BYTES", 1_000)
    index = decontaminate.positional_index(df)
    assert index.count() >= 8 and index.selectExpr("max(aggregate(lengths, 0L, (x, y) -> x + y))").first()[0] <= 500
    seen = common.arrow_pass(index.coalesce(1).select("segment"), lambda b: {"n": [b.num_rows]}, "n int", 1)
    assert {r.n for r in seen.collect()} == {1}
    assert sorted(map(tuple, decontaminate.proximity(df, ["a b"], 3).collect())) == whole and len(whole) == 2_000


def test_proximity_does_not_depend_on_segments(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice("aabbccdde") for _ in range(rng.randrange(40)))) for i in range(30)]
    phrases = ["a b", "c a b", "e a", "a a b"]
    want = []
    for i, text in rows:
        w = text.split()
        for p in phrases:
            terms, spans = p.split(), set()
            for s in range(len(w)):
                at, ok = s - 1, True
                for t in terms:
                    at = next((k for k in range(at + 1, len(w)) if w[k] == t), -1)
                    ok = ok and at >= 0
                    if not ok:
                        break
                if ok and w[s] == terms[0]:
                    spans.add((s, at))
            least = [(f, e) for f, e in spans if not any((g, h) != (f, e) and f <= g and h <= e for g, h in spans)]
            want += [(i, p, f, e) for f, e in least if e - f + 1 - len(terms) <= 4]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for words in (1 << 20, 50):
        monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", words)
        same([tuple(r) for r in decontaminate.proximity(df, phrases, 4).collect()], want)


# 8


def test_bpe_is_the_librarys(docs, none):
    from tokenizers import Tokenizer

    own, library = bpe.Encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    odd = ["<|startoftext|> hi <|endoftext|>x<|endoftext|", "ΑΣ Σ ΟΔΟΣ İstanbul ǅ ﬁ ẞ", "a\x1cb\x85c d　e f", "it's we'LL 'S don''t", "!" * 3000, "ab" * 2000, "ⅷ ² ½ é é ՘ Ᲊ \U00010940x", "naïve–q ＡＢＣ 你好世界 🤖🏽"]
    for text in [t or "" for _, t, *_ in corpus()] + odd:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want and own.decode(want) == library.decode(want, skip_special_tokens=False)
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.digests(docs).collect()}
    for i, text, *_ in corpus():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = rows[i, len(ids)]
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode(docs)
    assert rows_of(bpe.decode(encoded.filter("doc_id = 4")).select("text")) == [(own.decode(own.encode(next(t for i, t, *_ in corpus() if i == 4))),)]
    assert bpe.digests(none).count() == 0 and bpe.encode(none).count() == 0


def test_cuts_are_certain():
    own = bpe.Encoder(bpe.default_path())
    for word in ("naïve", "zxqj", "mañana", "über", "hello"):
        parts = own.cuts(word.encode())
        assert b"".join(parts) == word.encode()
        whole = [own.inner[b] for b in word.encode()[:-1]] + [own.last[word.encode()[-1]]]
        assert own._merge_short(list(whole)) == own.word(word) == own._merge_long(list(whole))


def test_words_of_a_piece_are_merged_together():
    own, rng = bpe.Encoder(bpe.default_path()), random.Random(8)
    for length in (1, 2, 3, 7, 48):
        made = [[own.inner[b] for b in rng.choices(b"etaoinshr", k=length)] for _ in range(200)]
        assert [[x for x in row if x >= 0] for row in own._merge_rows(np.array(made)).tolist()] == [own._merge_long(list(m)) for m in made]
    pairs = list(own.merges)[::97] + [3 << 20 | 3]
    got = own._pairs(np.array(pairs) >> 20, np.array(pairs) & 0xFFFFF).tolist()
    assert got == [own.merges[p][0] << 20 | own.merges[p][1] if p in own.merges else bpe._NONE for p in pairs]
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 60))) for _ in range(40)) for _ in range(30)] + ["", "<|endoftext|>", "aé <|endoftext|>b"]
    own.words.limit = 4000  # entries are dropped in the middle of a piece
    assert own.encode_all(texts) == [bpe.encoder(bpe.default_path()).encode(t) for t in texts]


# 9


def test_language(spark, docs, none):
    rng = random.Random(2)
    words = {"xx": ["the", "and", "with", "shore"], "yy": ["der", "und", "mit", "strand"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(12)), k, "h" + k) for i in range(60) for k in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(df)
    assert model.languages == ["xx", "yy"]
    got = {r.doc_id: r for r in language.documents_language(df).collect()}
    assert all(got[i].language == k and got[i].accepted for i, _, k, _ in rows)
    edge = language.identify(docs, model, declared=F.col("lang"), levels={"host": F.col("source")}).collect()
    assert len(edge) == len(corpus()) and not any(r.accepted for r in edge if r.doc_id in (6, 7, 8, 18)) and all(r.language in ("xx", "yy") for r in edge)
    assert language.documents_language(none).count() == 0


def test_evidence_is_fused_as_bayes_says(spark):
    model = language.TextModel(["aa", "bb"], np.log(np.full((2, language.BUCKETS), 1 / language.BUCKETS)))
    rows = [(i, "q", "bb" if i < 3 else None, "h") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, host string")
    got = {r.doc_id: r for r in language.identify(df, model, declared=F.col("d"), levels={"host": F.col("host")}).collect()}
    # The flat text model votes aa everywhere; prior (4+1)/(4+2), smoothed with 4 votes of the host.
    p = (4 + 8 * 5 / 6) / 12
    assert got[3].probability == pytest.approx(p) and got[3].language == "aa"
    told_a, told_b = (3 + 4) / (3 + 8), 4 / 8
    assert got[0].probability == pytest.approx(told_a * p / (told_a * p + told_b * (1 - p)))


def test_priors_of_three_levels_are_those_of_a_plain_program(spark):
    rng = random.Random(12)
    words = {"xx": ["the", "and", "with", "shore"], "yy": ["der", "und", "mit", "strand"], "zz": ["le", "et", "avec", "plage"]}
    rows = []
    for i in range(150):
        k = rng.choice(["xx", "xx", "yy", "zz"])
        text = None if i % 29 == 0 else "?!" if i % 31 == 0 else " ".join(rng.choice(words[rng.choice([k, k, k, "xx"])]) for _ in range(4))
        top = rng.choice(["de", "fr", None])
        domain = top and f"d{rng.randrange(3)}.{top}"
        rows.append((i, text, rng.choice([k, k, "xx", "other", None]), top, domain, domain and f"h{rng.randrange(2)}.{domain}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, suffix string, domain string, host string")
    model = language.train(df.withColumn("lang", F.when(F.col("said").isin(*words), F.col("said"))))
    names = ("suffix", "domain", "host")
    found = language.identify(df, model, declared=F.col("said"), levels={x: F.col(x) for x in names}).collect()
    logs = {r[0]: model.evidence((r[1] or "").encode()) for r in rows}
    votes = {i: int(x.argmax()) for i, x in logs.items() if x is not None}
    n, smooth = len(model.languages), language.SMOOTHING
    everywhere = [(sum(v == k for v in votes.values()) + 1) / (len(votes) + n) for k in range(n)]

    def trust(k: int, said) -> float:
        own = [i for i, v in votes.items() if v == k and rows[i][2] in model.languages]
        return (sum(rows[i][2] == said for i in own) + smooth / n) / (len(own) + smooth)

    for r in found:
        own = rows[r.doc_id]
        p = everywhere
        for column in (3, 4, 5):
            there = [votes[i] for i in votes if rows[i][column] == own[column]] if own[column] else []
            if there:
                p = [(there.count(k) + smooth * p[k]) / (len(there) + smooth) for k in range(n)]
        joint = [float(np.log(p[k])) + (0 if logs[own[0]] is None else logs[own[0]][k]) + (np.log(trust(k, own[2])) if own[2] in model.languages else 0) for k in range(n)]
        odds = np.exp(np.array(joint) - max(joint))
        assert r.language == model.languages[int(np.argmax(joint))] and r.probability == pytest.approx(1 / odds.sum())
        assert r.accepted == (logs[own[0]] is not None and 1 / odds.sum() >= language.ACCEPT)


def test_texts_are_judged_by_counts_without_them(spark):
    rows = [(i, " ".join(f"{k}{w}{i % 7}" for w in ("one", "two", "three")), k) for i in range(40) for k in ("aa", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    half = {t: h for t, h in df.select("text", language.half_of(F.col("text"))).distinct().collect()}
    for h in (0, 1):
        counts = np.stack([sum((np.bincount(language.trigrams(t.encode()), minlength=language.BUCKETS) for _, t, k in rows if k == own and half[t] != h), np.zeros(language.BUCKETS)) for own in ("aa", "bb")])
        assert np.allclose(model.halves[h], np.log((counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)))


def test_pages_evidence(spark):
    html = '<!DOCTYPE html><HTML class=x lang="EN-us"><script>var x = "<p>"</script><!-- no --><p>The text&amp;more</p>'
    df = spark.createDataFrame([(1, "https://u@WWW.Site.example.CO:80/a?b", html), (2, None, None), (3, "nonsense", "<p>x")], "page_id long, url string, html string")
    levels = language.address_levels(F.col("url"))
    got = rows_of(df.select("page_id", language.declared_language(F.col("html")), F.trim(language.visible_text(F.col("html"))), *levels.values()))
    assert got == [(1, "en", "The text more", "co", "example.co", "www.site.example.co"), (2, None, None, None, None, None), (3, None, "x", None, None, None)]


# 10


def removed_words(rows: list[tuple], window: int) -> list[tuple]:
    words = [(LAST if i is None else i, i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for o, _, w in words:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, LAST), o)
    out = []
    for o, i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < o:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [50, 33])
def test_word_dedup(docs, none, window):
    same([tuple(r) for r in word_dedup.dedup(docs, window=window).collect()], removed_words(corpus(), window))
    assert word_dedup.dedup(none).count() == 0


def test_word_dedup_on_random_overlaps(spark):
    rng = random.Random(11)
    stock = [prose(s, 120).split() for s in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(4):
            s = rng.choice(stock)
            a = rng.randrange(80)
            parts += s[a : a + rng.randrange(20, 110)]
        rows.append((rng.randrange(40), " ".join(parts)))
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in word_dedup.dedup(df).collect()], removed_words(rows, 50))
    got = [(r.doc_id, r.n_bytes, [list(s) for s in r.spans], bytes(r.kept)) for r in byte_dedup.dedup(df).collect()]
    same(got, repeated_bytes(rows, 200))


def test_every_shift_meets_the_cover():
    cover, period = set(word_dedup.COVER.tolist()), word_dedup.PERIOD
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))
    with pytest.raises(ValueError):
        word_dedup.dedup(None, window=10)


def test_slices_hash_alike_wherever_they_are():
    words = prose(1, 300).encode().split()
    a, b = Sequence(word_values(words)), Sequence(word_values(words[37:]))
    assert (a.windows(50)[37:] == b.windows(50)).all() and json.dumps(SCHEMA)


def test_words_of_a_piece_are_hashed_together(monkeypatch):
    rng = random.Random(10)
    texts = [b"", b" \t\n", b"a", b"a\x00 a", b"x" * 64 + b" " + b"x" * 65, b"\x1ca \x85b\xc2\x85"] + [bytes(rng.choices(b"ab \t\x0b\x00", k=rng.randrange(300))) for _ in range(200)]
    values, offsets = word_dedup._values(texts)
    words = [w for t in texts for w in t.split()]
    assert np.diff(offsets).tolist() == [len(t.split()) for t in texts] and len(values) == len(words)
    assert len(set(zip(words, values.tolist()))) == len(set(words)) == len(set(values.tolist()))
    pieces = []
    monkeypatch.setattr(word_dedup, "arrow_pass", lambda df, run, schema, most=None: pieces.append((run, most)))
    word_dedup._anchors(None, 50)
    (run, most), = pieces
    rows = [b" ".join(b"w%d" % rng.randrange(400) for _ in range(n)) for n in (0, 49, 50, 51, 300)]
    batch = pa.RecordBatch.from_pydict({"ord": pa.array(range(10)), "th": pa.array(range(10)), "text": pa.array(rows + rows, pa.binary())})
    found = run(batch)
    key = {(o, p >> 32, p & 0xFFFFFFFF): (k, c) for k, c, o, p in zip(*(found[x].tolist() for x in ("k", "c", "ord", "loc")))}
    assert most and {x[0] for x in key} == {2, 3, 4, 7, 8, 9} and all(o == th for o, th, _ in key)
    assert all(key[o, o, p] == key[o - 5, o - 5, p] for o, _, p in key if o > 4)
    assert sorted(p for o, _, p in key if o == 4) == word_dedup._cover_places(300, 20).tolist()
