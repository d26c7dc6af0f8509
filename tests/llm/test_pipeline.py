"""The pipeline's stages against brute force, on edge cases and on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline as p
from graphloom.llm.queries import ORACLES, QUERIES

from .conftest import corpus
from .test_operators import classes, contaminated, removed_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    first = corpus()[0][1]
    spark.createDataFrame([(1, " ".join(first.split()[3:20])), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def kept(df) -> list:
    assert df.columns == list(p.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, docs, none, folder):
    language = kept(p.language_stage(spark, docs, folder))
    assert language == sorted(((i, t) for i, t, *_ in corpus() if any(c.isalpha() for c in t or "")), key=repr)
    of = classes(corpus())
    near = kept(p.near_dedup_stage(spark, docs, folder))
    assert sorted(i for i, _ in near if i is not None) == sorted(set(of.values())) and sum(i is None for i, _ in near) == 2
    want = [(i, t or "" if not n else k) for (i, t, *_), (_, w, n, k) in zip(corpus(), removed_words(corpus(), 50)) if not n or n < w]
    assert kept(p.substring_dedup_stage(spark, docs, folder)) == sorted(want, key=repr)
    bad = {r[0] for r in contaminated(corpus(), [(1, " ".join(corpus()[0][1].split()[3:20]))]) if r[2]} - {None}
    assert kept(p.decontamination_stage(spark, docs, folder)) == sorted(((i, t) for i, t, *_ in corpus() if i not in bad), key=repr)
    assert p.encode_stage(spark, docs, folder).count() == len(corpus())
    for _, stage in p.STAGES:
        assert stage(spark, none, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_run_keeps_clean_documents(spark):
    got = {r.doc_id for r in p.run(spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    of = classes(rows)
    leaks = {r[0] for r in contaminated(rows, items) if r[2]}
    first = [(i, t) for i, t in rows if of[i] == i and any(c.isalpha() for c in t)]
    gone = {r[0] for r in removed_words(first, 50) if r[1] and r[1] == r[2]}
    assert got <= {i for i, _ in first} - gone and {i for i, _ in first} - gone - leaks <= got
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    frames = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert frames[0].equals(frames[1])
