import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from evidentia.operators import embedding as E, ranking as R
from evidentia.operators.embedding import LocalHash, provider_for
from evidentia.sources.schemas import schema


@pytest.fixture()
def tables(spark):
    chunks = spark.createDataFrame(
        [("c1", "d1", 1, 1, 0, "Neighbors worry about parking near the station. Parking, parking!", 10, "Public Comment", "May 2, 2024 Letters - p. 1"),
         ("c2", "d2", 2, 3, 0, "The CEQA chapter measures shadow.", 8, "CEQA", "Undated Report - pp. 2-3"),
         ("c3", "d2", 4, 4, 1, "", 1, None, None)], schema("chunks"))
    documents = spark.createDataFrame([("d1", "h1", "correspondence_pre_hearing", "Letters", "https://a/l.pdf", None, None, None, None, None), ("d2", None, "staff_report", "Report", "https://a/r.pdf", None, None, None, None, None)], schema("source_documents"))
    hearings = spark.createDataFrame([("h1", date(2024, 5, 2), "T", "scheduled", None, None, None, "s", datetime(2024, 1, 1))], schema("hearings"))
    return chunks, documents, hearings


def brute(query, rows):
    """(id, lexical) by plain loops over the terms of each text."""
    from evidentia.functions.text import query_terms

    plain = lambda t: [w for w in query_terms(t)]
    terms, texts = list(dict.fromkeys(query_terms(query))), {i: R_terms(t) for i, t in rows}
    out = {}
    for i, own in texts.items():
        idf = {t: math.log((len(rows) + 1) / (sum(t in x for x in texts.values()) + 1)) + 1 for t in terms}
        out[i] = min(1.0, sum(min(1, own.count(t) / 3) * idf[t] for t in terms) / sum(idf.values()))
    assert plain("") == []
    return out


def R_terms(text):
    from evidentia.functions.text import query_terms

    return query_terms(text, {})


def test_lexical_scores_match_plain_loops(spark):
    rows = [(1, "parking parking garage"), (2, "shadow"), (3, ""), (4, "cars and stations, parking")]
    found = R.lexical_scores(spark.createDataFrame(rows, "id int, text string"), "parking near the station").collect()
    want = brute("parking near the station", rows)
    assert all(abs(r.lexical - want[r.id]) < 1e-12 for r in found) and len(found) == 4


def test_lexical_search_ranks_and_has_no_vector(tables):
    chunks, documents, hearings = tables
    rows = R.search(chunks, documents, hearings, "parking station").collect()
    assert rows[0].chunk_id == "c1" and all(r.vector_score == 0 for r in rows) and rows[0].score <= 0.45


def test_hybrid_search_and_filters(spark, tables):
    chunks, documents, hearings = tables
    provider = LocalHash(dimensions=64)
    vectors = E.embedded_rows(chunks, provider, datetime(2024, 1, 1))
    rows = R.search(chunks, documents, hearings, "parking station", vectors, provider).collect()
    assert rows[0].chunk_id == "c1" and rows[0].vector_score > 0.5
    only = R.search(chunks, documents, hearings, "parking", vectors, provider, types=["staff_report"]).collect()
    assert {r.document_id for r in only} == {"d2"}
    dated = R.search(chunks, documents, hearings, "parking", vectors, provider, date_start=date(2024, 1, 1)).collect()
    assert {r.document_id for r in dated} == {"d1"}
    with pytest.raises(ValueError):
        R.search(chunks, documents, hearings, "x", limit=0)


def test_ties_follow_date_document_and_chunk(tables):
    chunks, documents, hearings = tables
    same = chunks.withColumn("text", F.lit("parking")).withColumns({"section_hint": F.lit(None).cast("string"), "citation_label": F.lit("x")})
    rows = R.search(same, documents.withColumn("title", F.lit("x")).withColumn("source_type", F.lit("x")).withColumn("url", F.lit("x")), hearings, "parking").collect()
    assert [r.chunk_id for r in rows] == ["c1", "c2", "c3"]


def test_empty_corpus_and_query(spark, tables):
    chunks, documents, hearings = tables
    assert R.search(chunks.limit(0), documents, hearings, "parking").collect() == []
    assert R.search(chunks, documents, hearings, "").collect() == []


def test_top_k_plan_has_no_cross_product(tables):
    plan = R.search(*tables, "parking")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_hash_embeddings_are_unit_vectors_and_deterministic(spark):
    df = spark.createDataFrame([(1, "parking near housing"), (2, ""), (3, None), (4, "parking near housing")], "id int, text string")
    rows = {r.id: list(r.embedding) for r in LocalHash(dimensions=32).embed(df).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and rows[1] == rows[4] and rows[2] == [0.0] * 32 == rows[3]


def test_pending_chunks_are_an_anti_join(spark, tables):
    chunks = tables[0]
    provider = LocalHash(dimensions=16)
    done = E.embedded_rows(chunks.where("chunk_id = 'c1'"), provider, datetime(2024, 1, 1))
    todo = E.pending(chunks, done, "local_hash", "local-hash-v1")
    assert [r.chunk_id for r in todo.collect()] == ["c2", "c3"] and "LeftAnti" in todo._jdf.queryExecution().toString()
    assert [r.chunk_id for r in E.pending(chunks, done, "local_hash", "other", 1).collect()] == ["c1"]


def test_provider_factory():
    assert provider_for("local-hash").dimensions == 384 and provider_for("HASH", dimensions=8).dimensions == 8
    for name in ("openai", "gemini", "nothing"):
        with pytest.raises(RuntimeError):
            provider_for(name, keys={"x": "y"})
    assert provider_for("google", "m", 0, {"google": "k"}).dimensions == 768


def test_texts_are_not_ranked_with_the_joined_rows(spark, monkeypatch):
    chunks, documents, hearings = corpus_of_search(spark)
    seen, rank = [], R.rank
    monkeypatch.setattr(R, "rank", lambda df, *rest: seen.append(df.columns) or rank(df, *rest))
    assert [r.text for r in R.search(chunks, documents, hearings, "parking").collect()] == ["parking here"]
    assert "text" not in seen[0]


def corpus_of_search(spark):
    chunks = spark.createDataFrame([("c1", "d1", 0, "parking here", None, None), ("c2", "d1", 1, "none", None, None)], "chunk_id string, document_id string, chunk_index int, text string, section_hint string, citation_label string")
    documents = spark.createDataFrame([("d1", "h1", "x", "x", "x")], "document_id string, hearing_id string, title string, source_type string, url string")
    return chunks, documents, spark.createDataFrame([("h1", None)], "hearing_id string, hearing_date date")


@pytest.mark.parametrize("made", ["embed", "archive", "supporting"])
def test_arrow_batches_are_cut_by_bytes(spark, made):
    from evidentia.operators.embedding import LocalHash
    from evidentia.sources import html

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.createDataFrame([("h", "https://a.org/", "x")], "hearing_id string, source_url string, html string")
    {"embed": lambda: LocalHash().embed(pages, "html"), "archive": lambda: html.archive_hearings(pages), "supporting": lambda: html.supporting_documents(pages)}[made]()
    rows = F.pandas_udf(lambda texts: texts.map(lambda _: len(texts)), "int")
    assert spark.range(0, 3000, 1, 1).select(rows(F.concat(F.repeat(F.lit("x"), 8000), F.col("id").cast("string"))).alias("n")).agg(F.max("n")).first()[0] < 1000
