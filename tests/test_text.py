from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import dates, keys, text as T, urls, vectors


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x"))
    return row.first()["x"]


def test_clean_text_collapses_no_break_spaces(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" a\xa0\xa0b\n c ") == "a b c"
    assert one(spark, T.clean_lines(F.col("t")), t=" a \r\n\n \xa0\nb  c\x85d") == "a\nb c\nd"


def test_terms_are_stemmed_and_synonyms_are_not(spark):
    assert one(spark, T.terms_of(F.col("t")), t="The Agencies' cars: units, A-1 x stories") == ["the", "agency", "cars", "unit", "a-1", "story"]
    assert one(spark, T.expanded(T.terms_of(F.col("t"))), t="housing bus") == ["housing", "dwelling", "residential", "unit", "units", "apartment", "bus"]
    assert T.query_terms("Parking stories") == ["parking", "garage", "vehicle", "vehicles", "car", "cars", "story"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abcs -iesXY9.\n", max_size=40))
def test_driver_and_column_terms_agree(spark, text):
    assert one(spark, T.expanded(T.terms_of(F.col("t"))), t=text) == T.query_terms(text)


def test_token_estimate_and_quality(spark):
    assert [one(spark, T.token_estimate(F.col("t")), t=t) for t in ("", "abc", "a" * 9)] == [1, 1, 2]
    assert [one(spark, T.quality_of(F.lit(n))) for n in (500, 499, 100, 99)] == ["good", "medium", "medium", "poor"]


def test_headings(spark):
    for line, want in (("EXECUTIVE SUMMARY", True), ("Plain words here", False), ("Anything at all:", True), ("ENDS.", False), ("X" * 91, False), ("12345 678", False), ("A", False), ("", False)):
        assert one(spark, T.is_heading(F.col("t")), t=line) is want, line


def test_section_hints(spark):
    cases = {
        "12a. 2024-001234CUA MAIN ST": "Agenda Item 12a - 2024-001234CUA", "3. Officers": "Agenda Item 3", "ceqa:": "CEQA", "PUBLIC WORKS DIRECTOR'S NOTE": "Public Works Director'S Note",
        "Next Steps:": None, "plain text of a paragraph": None,
    }
    for line, want in cases.items():
        assert one(spark, T.section_hint(F.col("t")), t=line) == want, line


def test_citations(spark):
    label = lambda d, title, a, b: one(spark, T.citation_label(F.lit(d).cast("date"), F.lit("staff_report"), F.lit(title).cast("string"), F.lit(a), F.lit(b)))
    assert label(date(2024, 5, 2), None, 3, 3) == "May 2, 2024 Staff Report - p. 3"
    assert label(None, "Memo", 1, 4) == "Undated Memo - pp. 1-4"
    assert [one(spark, T.first_section(F.col("t")), t=t) for t in ("staff_report", "agenda", "correspondence_at_hearing", "public_notice", "")] == ["Staff Report", "Agenda", "Correspondence", "Public Notice", None]


def test_written_dates(spark):
    assert one(spark, dates.written_date(F.col("t")), t="on MAY 2 2024.") == date(2024, 5, 2)
    assert one(spark, dates.written_date(F.col("t")), t="February 30, 2024") is None
    assert one(spark, dates.archive_date(F.col("t")), t="January 4. 2024 (x)") == date(2024, 1, 4)


def test_keys(spark):
    import hashlib

    want = "doc-" + hashlib.sha256(b"h|u").hexdigest()[:20]
    assert one(spark, keys.document_id(F.lit("h"), F.lit(" u "))) == want
    assert one(spark, keys.agenda_item_id(F.lit("h"), F.lit("1"), F.lit(None), F.lit(" a  b"))) == "agenda-" + hashlib.sha256(b"h|1||a b").hexdigest()[:20]
    assert one(spark, keys.page_id(F.lit("d"), F.lit(7))) == "page-d-0007"


def test_source_types(spark):
    cases = {"Correspondence received at the hearing": "correspondence_at_hearing", "correspondence": "correspondence_pre_hearing", "STAFF  report agenda": "staff_report", "Agenda minutes": "agenda", "x": "other"}
    for text, want in cases.items():
        assert one(spark, urls.source_type_of(F.col("t")), t=text) == want


def test_document_links_and_titles(spark):
    link = lambda u, t: one(spark, urls.is_document_link(F.lit(u), F.lit(t)))
    assert link("https://a/b.PDF?x", "x") and link("https://a/b", "get PDF") and not link("https://a/b.pdfx", "x")
    title = lambda t, c, u: one(spark, urls.document_title(F.lit(t), F.lit(c), F.lit(u)))
    assert title("View PDF", "Memo", "u") == "Memo" and title("", "pdf", "https://a/b/c.pdf/") == "c.pdf" and title("", "", "https://a") == "https://a"
    assert one(spark, urls.joined_url(F.lit("https://a/b/c"), F.lit("../d"))) == "https://a/d"


def test_pdf_recognition(spark):
    pdf = lambda m, c, u: one(spark, urls.is_pdf(F.lit(m).cast("string"), F.lit(c), F.lit(u)))
    assert pdf("application/pdf", b"x", "u") and pdf("application/octet-stream", b"%PDF-1", "u") and pdf("text/html", b"%PDF", "a.PDF?q") and not pdf(None, b"%PDF", "a")


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.dot(v(1.0, 2.0, 3.0), v(1.0, 1.0))) == 3.0
    assert one(spark, vectors.normalised(v(0.0, 0.0))) == [0.0, 0.0] and one(spark, vectors.normalised(v(3.0, 4.0))) == [0.6, 0.8]
    assert one(spark, vectors.vector_score(v(1.0), F.lit(None).cast("array<float>"))) == 0.0
    assert one(spark, vectors.vector_score(v(1.0, 0.0), v(0.0, 1.0))) == 0.5
