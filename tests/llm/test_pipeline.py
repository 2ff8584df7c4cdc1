"""The pipeline's stages on a small corpus, against plain versions of their rules."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .fixtures import documents, prose
from .test_corpus import labelled

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture()
def corpus(spark, tmp_path):
    rows, labels = labelled(120)
    clean = rows[2][1]
    leak = prose(7777, 40)
    rows += [(500, clean, "en"), (501, clean + " Mail me@here.org now.", "en"), (502, "Before " + leak + " after", "en"), (503, None, "en"), (504, prose(31, 30) + " call +1 212 555 0100", "en")]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(leak.split()[3:20]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, corpus)
        if name != "byte_bpe":
            assert after.columns == docs.columns
            after.write.parquet(f"{corpus}/{name}")
            docs = spark.read.parquet(f"{corpus}/{name}")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            last = {r.doc_id: r for r in after.collect()}
    assert {500, 501, 502, 504} <= set(kept["quality"]) and not {0, 5, 10, 1, 6, 503} & set(kept["quality"])
    assert 2 in kept["near_duplicates"] and not {500, 501} & set(kept["near_duplicates"]) and 502 in kept["near_duplicates"]
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {502}
    assert kept["personal_data"][504].endswith("call <PHONE>") and set(kept["personal_data"]) == set(kept["decontamination"]) == set(last)
    assert all(last[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept["personal_data"].items())


def test_repeated_rows_leave_one(spark):
    docs = documents(spark, [(1, prose(1, 30), "en"), (1, prose(1, 30), "en"), (2, prose(1, 30), "en"), (3, prose(2, 30), "en"), (None, prose(3, 30), "en")]).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted((r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()), key=str) == [1, 3, None]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_run_on_the_smallest_tables(spark):
    found = corpus_pipeline.run(spark, str(DATA))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < found.count() < docs.count() and found.select("doc_id").distinct().count() == found.count()
    assert found.join(docs, "doc_id", "left_anti").count() == 0 and found.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
