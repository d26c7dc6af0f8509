"""Operator 9: language identification by Bayesian fusion of evidence.

The posterior of a document's language multiplies the likelihood of its text (byte trigrams), the likelihood of the
language that its markup declares, and a prior from its address. The prior is smoothed hierarchically, each level with
the one above it: all documents, address suffix, domain, host. Its counts come from grouped aggregations over all
documents, and so does the reliability of declarations. The text model is fitted on a bounded sample of labelled rows.
Where the labels of that sample are also the declarations that are weighed, a text is judged by a model that has not seen
it: the sample has two halves by the texts' hashes, and each half's texts are judged by the other's counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, stage, table

#: Labelled rows of the text model, about as many at most.
SAMPLE = 20_000
BUCKETS = 1 << 16
#: Trigrams are dependent: a text counts as so many independent ones at most.
EVIDENCE = 60.0
#: Weight of the level above, in documents.
SMOOTHING = 8.0
ACCEPT = 0.5
#: Levels of addresses with at most so many rows are broadcast; larger ones are joined by shuffle.
SMALL = 50_000
_LETTER = np.array([b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the text with A-Z lower-cased and runs of other than letters as one space."""
    folded = b" ".join([b"", *text.translate(_FOLD).split(), b""])
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.uint32)
    x = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS
    halves: tuple[np.ndarray, np.ndarray] | None = None  # for texts of each half, from the other half's counts

    def evidence(self, text: bytes, half: int | None = None) -> np.ndarray | None:
        """Log-likelihood of each language, scaled to EVIDENCE trigrams at most; None without any letter."""
        grams = trigrams(text)
        if not len(grams):
            return None
        log_p = self.log_p if half is None or self.halves is None else self.halves[half]
        total = np.zeros(len(self.languages))
        for i in range(0, len(grams), 1 << 16):
            total += log_p[:, grams[i : i + (1 << 16)]].sum(axis=1)
        return total * min(1.0, EVIDENCE / len(grams))


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), text), F.lit(2)).cast("int")


def train(docs: DataFrame, text_col="text", label_col="lang", sample: int = SAMPLE) -> TextModel:
    """Trigram counts of each label, over rows chosen by their text's hash; rows with null text or label are left out."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample / total))

    def run(batch: pa.RecordBatch) -> dict:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
            own = sums.setdefault((label, half), np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text), minlength=BUCKETS)
        cells = [(*k, np.flatnonzero(v), v) for k, v in sums.items()]
        return {
            "label": [k for k, _, at, _ in cells for _ in range(len(at))], "half": [h for _, h, at, _ in cells for _ in range(len(at))],
            "g": np.concatenate([at for *_, at, _ in cells]), "c": np.concatenate([v[at] for *_, at, v in cells]),
        }

    counts = arrow_pass(rows.select(F.col("text").cast("binary").alias("text"), "label", half_of(F.col("text")).alias("half")), run, "label string, half int, g int, c long")
    found = counts.groupBy("label", "half", "g").agg(F.sum("c").alias("c")).toPandas()  # 2 x labels x BUCKETS numbers at most
    languages = sorted(found["label"].unique())
    own = np.zeros((2, len(languages), BUCKETS))
    own[found["half"].to_numpy(np.int64, na_value=0), found["label"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64, na_value=0), found["g"]] += found["c"]

    def logs(x: np.ndarray) -> np.ndarray:
        return np.log((x + 0.1) / (x + 0.1).sum(axis=1, keepdims=True))

    # A half in which a language is missing can't tell it: then all counts must do.
    halves = tuple(logs(x if (x.sum(axis=1) > 0).all() else own.sum(axis=0)) for x in own[::-1])
    return TextModel(languages, logs(own.sum(axis=0)), halves)


def declared_language(html: Column) -> Column:
    """Primary subtag of the lang attribute of the html element, in lower case; null without one."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1)
    return F.when(found != "", F.lower(found))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[A-Za-z#0-9]{1,10};", " ")


def address_levels(url: Column) -> dict[str, Column]:
    """suffix, domain and host of a URL, in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    part = lambda n: F.when(host != "", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), "."))
    return {"suffix": part(1), "domain": part(2), "host": F.when(host != "", host)}


def identify(docs: DataFrame, model: TextModel, id_col="doc_id", text_col="text", declared: Column | None = None, levels: dict[str, Column] | None = None, accept: float = ACCEPT, unseen: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, th (hash of its text), text_language, declared, language, probability, accepted.

    declared is a column of language codes; levels are columns from the widest part of the address to the narrowest. A
    null, empty or letterless text has no text evidence: it gets the likeliest language by the rest and isn't accepted.
    Null or unknown declarations and null address parts say nothing. A model of no language accepts none. Ties go to the
    first language in order. Repeated rows get a row each. With unseen, docs may be those of the model's sample, and each
    text is judged by the half of it that it isn't in.
    """
    levels = levels or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = list(levels)
    none = F.lit(None).cast("string")
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"), (half_of(text) if unseen else F.lit(None).cast("int")).alias("half"),
        (none if declared is None else declared.cast("string")).alias("declared"), *[c.cast("string").alias(f"level_{k}") for k, c in levels.items()],
    )
    languages = model.languages
    if not languages:
        out = read.select("doc_id", "th", none.alias("text_language"), "declared", none.alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"))
        return out

    def run(batch: pa.RecordBatch) -> dict:
        found = [model.evidence(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
        kept = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "half")}
        return kept | {"logs": [None if x is None else x.tolist() for x in found], "text_language": [None if x is None else languages[int(x.argmax())] for x in found]}

    kinds = "".join(f"level_{k} string, " for k in names)
    scored = stage(arrow_pass(read, run, f"doc_id long, th long, declared string, {kinds}logs array<double>, text_language string"))
    voting = scored.filter("text_language IS NOT NULL")
    counted = {r["text_language"]: r["count"] for r in voting.groupBy("text_language").count().collect()}  # one number a language
    total = sum(counted.values())
    prior = [(counted.get(x, 0) + 1) / (total + len(languages)) for x in languages]
    said = {(r["text_language"], r["declared"]): r["count"] for r in voting.filter(F.col("declared").isin(languages)).groupBy("text_language", "declared").count().collect()}
    share = [sum(said.get((a, d), 0) for d in languages) for a in languages]
    trust = {d: [float(np.log((said.get((a, d), 0) + SMOOTHING / len(languages)) / (share[i] + SMOOTHING))) for i, a in enumerate(languages)] for d in languages}

    # From the widest level to the narrowest: a level's counts, smoothed with the prior of the level above.
    rows = scored.withColumn("p", F.array(*map(F.lit, prior)))
    for k in names:
        key = f"level_{k}"
        votes = voting.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col("text_language") == x).cast("double").alias(f"n{i}") for i, x in enumerate(languages)])
        votes = stage(votes.select(key, F.array(*[f"n{i}" for i in range(len(languages))]).alias("votes")))
        joined = rows.join(F.broadcast(votes) if votes.count() <= SMALL else votes, key, "left")
        weight = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x) + SMOOTHING
        smoothed = F.zip_with("votes", "p", lambda v, p: v + F.lit(SMOOTHING) * p)
        rows = joined.withColumn("p", F.when(F.col("votes").isNull(), F.col("p")).otherwise(F.transform(smoothed, lambda x: x / weight))).drop("votes")

    flat = F.array(*[F.lit(0.0)] * len(languages))
    told = F.coalesce(F.create_map(*[y for d in languages for y in (F.lit(d), F.array(*map(F.lit, trust[d])))])[F.coalesce("declared", F.lit(""))], flat)
    logs = F.zip_with(F.zip_with(F.coalesce("logs", flat), told, lambda a, b: a + b), F.transform("p", lambda p: F.log(p)), lambda a, b: a + b)
    rows = rows.withColumn("joint", logs).withColumn("top", F.array_max("joint"))
    norm = F.aggregate(F.transform("joint", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    language = F.array(*map(F.lit, languages))[(F.array_position("joint", F.col("top")) - 1).cast("int")]
    return rows.select(
        "doc_id", "th", "text_language", "declared", language.alias("language"), (1 / norm).alias("probability"),
        (F.col("logs").isNotNull() & (1 / norm >= accept)).alias("accepted"),
    )


def documents_language(docs: DataFrame) -> DataFrame:
    """Documents declare their language in lang, and their source stands for the host."""
    return identify(docs, train(docs), declared=F.col("lang"), levels={"host": F.col("source")}, unseen=True)


def pages_language(pages: DataFrame, model: TextModel) -> DataFrame:
    own = pages.select("page_id", visible_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), F.col("url"))
    found = identify(own, model, id_col="page_id", declared=F.col("declared"), levels=address_levels(F.col("url")))
    return found.withColumnRenamed("doc_id", "page_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents_language(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_language", "declared", "language", F.round("probability", 6).alias("probability"), "accepted")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages_language(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
    return found.select("page_id", "text_language", "declared", "language", F.round("probability", 6).alias("probability"), "accepted")
