from datetime import date, datetime
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.functions import urls
from evidentia.operators import rollups
from evidentia.plans import catalogue, pipeline
from evidentia.plans.catalogue import AGENDA, ARCHIVE
from evidentia.session import Settings, setting
from evidentia.sources import dom, files, html, store as S
from evidentia.sources.store import Store
from evidentia.streaming.ingest import stream_upserts

NOW = datetime(2024, 6, 1)
SUPPORTING = """<html><body><h2>Staff Reports</h2><ul><li>Case 2024-001234 Main Street <a href="/docs/2024-001234.pdf">View PDF</a></li></ul>
<h2>Other</h2><p><a href="x/plan.pdf">Plan set</a> <a href="/about">About</a></p>
<h2>Correspondence Received at Hearing</h2><div><a href="/docs/letters.pdf">Letters</a></div>
<p>Public notice <a href="/docs/letters.pdf">again</a></p><script>"<a href='z.pdf'>z</a>"</script></body></html>"""


def archive(spark):
    return spark.createDataFrame([("https://c.org/archive/", ARCHIVE)], "source_url string, html string")


def supporting(spark, hearing="cpc-2024-01-11"):
    return spark.createDataFrame([(hearing, "https://c.org/s/1", SUPPORTING)], "hearing_id string, source_url string, html string")


def test_archive_bounds_and_limit(spark):
    days = lambda **k: [r.hearing_date for r in html.archive_hearings(archive(spark), **k).orderBy("position").collect()]
    assert days() == [date(2024, 1, 11), date(2024, 1, 4), date(2023, 12, 14)]
    assert days(since=date(2024, 1, 4), until=date(2024, 1, 4)) == [date(2024, 1, 4)]
    assert days(limit=2) == days()[:2] and days(limit=0) == days()


def test_supporting_documents(spark):
    rows = html.supporting_documents(supporting(spark)).orderBy("position").collect()
    assert [(r.source_type, r.title, r.url) for r in rows] == [
        ("staff_report", "Case 2024-001234 Main Street View PDF", "https://c.org/docs/2024-001234.pdf"),
        ("staff_report", "Plan set", "https://c.org/s/x/plan.pdf"),
        ("correspondence_at_hearing", "Letters", "https://c.org/docs/letters.pdf"),
    ]


def test_preference_among_equal_documents(spark):
    rows = [("d", 0, "h", "other", "A", "u"), ("d", 1, "h", "notice", None, "u"), ("d", 2, "h", "other", "C", "u"), ("e", 0, "h", "agenda", "A", "u"), ("e", 1, "h", "notice", "B", "u")]
    df = spark.createDataFrame(rows, "document_id string, position int, hearing_id string, source_type string, title string, url string")
    found = {r.document_id: (r.source_type, r.title) for r in html.preferred_documents(df).collect()}
    assert found == {"d": ("other", "C"), "e": ("agenda", "A")}


def test_empty_and_broken_html(spark):
    df = spark.createDataFrame([("h", "s", None), ("h", "s2", ""), ("h", "s3", "<a href='a.pdf'><p></b>x")], "hearing_id string, source_url string, html string")
    assert [r.url for r in html.supporting_documents(df).collect()] == ["a.pdf"]


def test_download_retries_skips_and_isolates_failures(spark):
    docs = spark.createDataFrame([("a", "https://x/a.pdf", None), ("b", "https://x/b.pdf", None), ("c", "https://x/c", None)], "document_id string, url string, sha256 string")

    def get(url):
        if url.endswith("b.pdf"):
            raise OSError("down")
        return (b"%PDF-1", "application/octet-stream") if url.endswith(".pdf") else (b"<html>", "text/html")

    rows = {r.document_id: r for r in files.download(docs, get=get, sleep=lambda s: None).collect()}
    assert rows["a"].status == "downloaded" and rows["a"].mime_type == "application/pdf" and rows["a"].file_size_bytes == 6
    assert "OSError" in rows["b"].error and "not a PDF" in rows["c"].error
    known = spark.createDataFrame([("a", b"%PDF-1")], "document_id string, content binary")
    again = {r.document_id: r.status for r in files.download(docs.where("document_id = 'a'"), known, get=get).collect()}
    assert again == {"a": "skipped"}
    waits = []
    with pytest.raises(OSError):
        files.fetch("https://x/b.pdf", get, 3, waits.append)
    assert waits == [1, 2]


def test_pages_and_failures(spark):
    contents = spark.createDataFrame([("a", b"one|"), ("b", b"bad")], "document_id string, content binary")

    def read(content):
        if content == b"bad":
            raise ValueError("broken")
        return [t or None for t in content.decode().split("|")]

    pages, failures = files.pdf_pages(contents, read)
    assert [(r.page_id, r.text, r.extraction_quality) for r in pages.orderBy("page_number").collect()] == [("page-a-0001", "one", "poor"), ("page-a-0002", "", "poor")]
    assert [r.document_id for r in failures.collect()] == ["b"]


def test_store_versions_and_constraints(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.create()
    store.create()
    assert store.versions("hearings") == [1] and store.read("chunks").count() == 0
    link = spark.createDataFrame([("l", "i", "d", "case_number_match", 1.0)], S.schema("document_links"))
    store.write("document_links", link)
    seen = []
    checked = S.violations
    monkeypatch.setattr(S, "violations", lambda df, table: seen.append(store.versions(table)) or checked(df, table))
    with pytest.raises(ValueError):
        store.write("document_links", link.union(link))
    assert seen == [[1, 2]]  # while it was checked nobody saw the bad version
    assert store.versions("document_links") == [1, 2] and store.read("document_links").count() == 1
    for _ in range(3):
        store.write("document_links", link)
    store.vacuum("document_links", 1)
    assert len(store.versions("document_links")) == 1


def test_upsert_policies(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, keep string")
    new = spark.createDataFrame([("b", 20, "z"), ("c", 30, "z")], "k string, n int, keep string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(S.upsert(old, new, ["k"])) == [("a", 1, "x"), ("b", 20, "z"), ("c", 30, "z")]
    part = S.upsert(old, new, ["k"], ["n"])
    assert {r[0]: r for r in rows(part.na.fill("-"))} == {"a": ("a", 1, "x"), "b": ("b", 20, "y"), "c": ("c", 30, "-")}
    assert rows(S.upsert(S.upsert(old, new, ["k"]), new, ["k"])) == rows(S.upsert(old, new, ["k"]))
    assert rows(S.replace(old, new.limit(0), old.where("k = 'a'"), ["k"])) == [("b", 2, "y")]
    assert rows(S.last_of(new.withColumn("n", F.lit(1)).union(new), ["k"], F.col("n"))) == [("b", 20, "z"), ("c", 30, "z")]


def test_ingest_from_html_to_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    for _ in range(2):  # a second run changes nothing
        pipeline.crawl_archive(store, archive(spark), date(2024, 2, 1), NOW)
        pipeline.crawl_supporting(store, supporting(spark))
    assert store.read("hearings").count() == 3 and store.read("source_documents").count() == 6
    text = AGENDA + "\n" + "More about parking near the station. " * 20
    folder = str(tmp_path / "contents")
    fetched = lambda **k: pipeline.download_pdfs(store, folder, NOW, get=lambda u: (b"%PDF", "application/pdf"), sleep=lambda s: None, **k)
    first, failures = fetched(limit=2)
    assert first == {"total": 2, "downloaded": 2, "skipped": 0, "failed": 0} and failures.count() == 0
    assert pipeline.parse_downloaded(store, folder, lambda c: [text]).count() == 0 and store.read("pages").select("document_id").distinct().count() == 2
    assert fetched()[0] == {"total": 6, "downloaded": 4, "skipped": 2, "failed": 0}
    assert fetched()[0]["skipped"] == 6 and fetched(force=True)[0]["downloaded"] == 6 and fetched(limit=1)[0]["total"] == 1
    assert pipeline.contents_of(store, folder).count() == 6  # earlier contents stay, the last ones count
    one = store.read("source_documents").first()
    assert one.local_path == f"{folder}/{one.document_id}.pdf" and fetched(document_id=one.document_id)[0]["total"] == 1
    assert store.read("source_documents").where("sha256 is not null").count() == 6
    broken, failures = pipeline.download_pdfs(store, folder, NOW, force=True, get=lambda u: (b"<html>", "text/html"), sleep=lambda s: None)
    assert broken["failed"] == 6 and {r.error for r in failures.collect()} == {"ValueError: not a PDF: text/html"}
    assert pipeline.parse_downloaded(store, folder, lambda c: [text]).count() == 0
    pipeline.parse_agendas(store)
    items = store.read("agenda_items")
    assert items.where("hearing_id = 'cpc-2024-01-11'").count() == 3
    assert store.read("document_links").count() == 1
    pipeline.chunk_documents(store, Settings(chunk_target=60, chunk_max=90, chunk_overlap=10))
    first = pipeline.embed_chunks(store, NOW, Settings(dimensions=16))
    again = pipeline.embed_chunks(store, NOW, Settings(dimensions=16))
    assert first["embedded_count"] == first["chunk_count"] > 0 and again["embedded_count"] == 0 == again["skipped_count"] - again["chunk_count"]
    pipeline.chunk_documents(store, Settings(chunk_target=60, chunk_max=90, chunk_overlap=10))
    assert store.read("chunk_embeddings").count() == 0  # of chunks that were replaced
    tables = {n: store.read(n) for n in S.SCHEMAS}
    summary = rollups.dashboard_summary(spark, tables).first()
    assert (summary.hearings_indexed, summary.pdfs_downloaded, summary.staff_reports_linked) == (3, 6, 1)
    recent = rollups.recent_activity(tables["hearings"], tables["source_documents"], tables["pages"], tables["agenda_items"]).collect()
    assert [r.hearing_id for r in recent][0] == "cpc-2024-01-11" and recent[0].document_count == 5 and recent[0].page_count == 5
    assert rollups.hearing_list(tables["hearings"], tables["source_documents"], tables["agenda_items"], 1).count() == 1
    detail = rollups.hearing_detail(tables["hearings"], tables["source_documents"], tables["agenda_items"], "cpc-2024-01-11").first()
    assert [d.source_type for d in detail.documents] == sorted(d.source_type for d in detail.documents) and [i.item_number for i in detail.agenda_items] == ["1", "2", "3a"]
    assert rollups.hearing_detail(tables["hearings"], tables["source_documents"], tables["agenda_items"], "none").count() == 0
    assert rollups.exists(tables["hearings"], F.col("status") == "cancelled")
    themes = [r.theme for r in rollups.theme_mentions(tables["chunks"]).collect()]
    assert themes[0] in ("parking", "transit") and len(themes) == 6
    one = items.first()
    assert rollups.item_detail(items, one.agenda_item_id).count() == 1


def test_stream_upserts_are_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    rows = spark.createDataFrame([("l1", "i", "d", "r", 1.0), ("l2", "i", "d", "r", 0.5)], S.schema("document_links"))
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(S.schema("document_links")).parquet(str(tmp_path / "in"))
        stream_upserts(store, "document_links", stream, str(tmp_path / "state")).awaitTermination()
        assert store.read("document_links").count() == 2


def test_last_row_of_a_batch_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    rows = spark.createDataFrame([("l", "i", "d", "r", x) for x in (0.3, 0.9, 0.5)], S.schema("document_links")).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    for n, (order, want) in enumerate(((None, 0.5), (F.col("confidence"), 0.9))):
        stream = spark.readStream.schema(S.schema("document_links")).parquet(str(tmp_path / "in"))
        stream_upserts(store, "document_links", stream, str(tmp_path / f"state{n}"), order=order).awaitTermination()
        assert store.read("document_links").first().confidence == want


def test_downloaded_documents(spark):
    rows = [("a", "x/a", "application/pdf"), ("b", "x/b.PDF", None), ("c", "x/c", "text/html"), ("d", None, "application/pdf"), ("e", "x/e", None)]
    docs = spark.createDataFrame(rows, "document_id string, local_path string, mime_type string")
    assert [r.document_id for r in files.downloaded_pdfs(docs).collect()] == ["a", "b"]
    assert [r.document_id for r in files.downloaded_pdfs(docs, 1).collect()] == ["a"] and files.downloaded_pdfs(docs, document_id="c").isEmpty()


def test_rows_as_json_and_listed_items(spark):
    items = spark.createDataFrame([("i1", "h", "10", None), ("i2", "h", "2", "x"), ("i3", "h", None, None), ("i4", "g", "1", None)], "agenda_item_id string, hearing_id string, item_number string, case_suffix string")
    listed = rollups.hearing_items(items.withColumns({"continued_from": F.lit(None), "proposed_continuance_date": F.lit(None)}), "h")
    assert [r.agenda_item_id for r in listed.collect()] == ["i2", "i1", "i3"] and "case_suffix" not in listed.columns
    day = spark.createDataFrame([(1, date(2024, 5, 2), NOW, None)], "n int, d date, t timestamp_ntz, s string")
    assert rollups.as_json(day).first().json == '{"n":1,"d":"2024-05-02","t":"2024-06-01T00:00:00","s":null}'


def test_settings(monkeypatch):
    monkeypatch.setenv("EVIDENTIA_DIMENSIONS", "")
    monkeypatch.setenv("EVIDENCE_DIMENSIONS", "12")
    assert Settings.from_environment().dimensions == 12 and setting("EVIDENTIA_NOTHING", "d") == "d"
    monkeypatch.setenv("EVIDENTIA_DIMENSIONS", "x")
    with pytest.raises(ValueError):
        Settings.from_environment()


def test_cli_rejects_bad_limits():
    from evidentia.cli import parser

    with pytest.raises(SystemExit):
        parser().parse_args(["search", "q", "--limit", "0"])
    assert parser().parse_args(["search", "q", "--types", "a,b"]).limit == 10
    assert parser().parse_args(["embed", "--batch-size", "7"]).batch_size == 7 and parser().parse_args(["download-pdfs", "--contents", "c", "--document-id", "d"]).document_id == "d"


def test_embedding_services_by_fake_replies(monkeypatch):
    from evidentia.operators import embedding

    calls = []

    def openai(url, body, headers):
        calls.append(body)
        return {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [3.0, 4.0]}]}

    monkeypatch.setattr(embedding, "_posted", openai)
    assert embedding.OpenAIService("k", "m").vectors(["a", "b"], "document") == [[0.6, 0.8], [0.0, 1.0]] and "dimensions" not in calls[0]
    embedding.OpenAIService("k", "m", 2).vectors(["a", "b"], "query")
    assert calls[1]["dimensions"] == 2
    monkeypatch.setattr(embedding, "_posted", lambda url, body, headers: calls.append(body) or {"embedding": {"values": [3.0, 4.0, 12.0]}})
    assert embedding.GoogleService("k", "m", 2).vectors(["a"], "query") == [[0.6, 0.8]] and calls[-1]["taskType"] == "RETRIEVAL_QUERY"


def test_a_change_writes_the_buckets_of_its_owners_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=64)
    rows = spark.range(2000).selectExpr("concat('d', id) as document_id", "'h' as hearing_id", "'agenda' as source_type", "'t' as title", "'u' as url").withColumns({c: F.lit(None) for c in ("local_path", "sha256", "mime_type", "file_size_bytes", "downloaded_at")})
    store.write("source_documents", rows)
    table = store.tables["source_documents"]
    before = table.manifest(1)
    assert before["buckets"] == 64 and len(before["folders"]) == 64
    reader = store.read("source_documents")
    one = rows.where("document_id = 'd7'").withColumn("title", F.lit("new"))
    store.upsert("source_documents", one)
    after = table.manifest(2)
    assert sum(before["folders"][b] != f for b, f in after["folders"].items()) == 1
    assert len(list((tmp_path / "source_documents").glob(f"{next(f for b, f in after['folders'].items() if before['folders'][b] != f)}/__bucket=*"))) == 1
    assert store.read("source_documents").where("title = 'new'").count() == 1 and store.read("source_documents").count() == 2000
    assert reader.where("title = 'new'").count() == 0 and reader.count() == 2000  # a reader of the version before sees it whole
    assert len(store.lookup("source_documents", ["d7", "none"]).inputFiles()) <= 2
    assert [r.title for r in store.lookup("source_documents", ["d7", "none"]).collect()] == ["new"]
    seen = []
    with pytest.raises(ValueError, match="repeated key"):
        store.change("source_documents", one, lambda old: seen.append(old.count()) or old.union(one))
    assert seen[0] < 100 and store.versions("source_documents") == [1, 2]
    with pytest.raises(ValueError, match="not about"):
        store.change("source_documents", one, lambda old: old.union(rows.where("document_id = 'd8'")))
    store.vacuum("source_documents", 1)
    assert store.read("source_documents").count() == 2000 and store.versions("source_documents") == [2]
    store.write("source_documents", store.read("source_documents"), buckets=4)
    assert len(table.manifest(3)["folders"]) == 4 and store.read("source_documents").count() == 2000


def test_two_writers_of_a_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    link = spark.createDataFrame([("l", "i", "d", "r", 1.0)], S.schema("document_links"))

    def late(old):
        Store(spark, str(tmp_path)).upsert("document_links", link.withColumn("confidence", F.lit(0.5)))
        return old.union(link)

    with pytest.raises(Exception, match="(?i)exist"):
        store.change("document_links", link, late)
    assert [r.confidence for r in store.read("document_links").collect()] == [0.5]


def test_a_key_that_moves_to_another_owner(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    page = spark.createDataFrame([("p", "a", 1, "x", 1, "m", "poor")], S.schema("pages"))
    store.upsert("pages", page)
    store.upsert("pages", page.withColumn("document_id", F.lit("b")))
    assert [r.document_id for r in store.read("pages").collect()] == ["b"]


def test_the_latest_file_wins_whatever_its_size(spark, tmp_path):
    import os

    store = Store(spark, str(tmp_path / "store"))
    store.create()
    names = []
    for n, (value, more) in enumerate(((0.9, 3000), (0.5, 300), (0.1, 0))):  # of falling size, the last is the latest
        rows = spark.range(more).selectExpr("concat('x', id) as link_id", "'i' as agenda_item_id", "'d' as document_id", "uuid() as relationship", "1.0D as confidence")
        rows = rows.union(spark.createDataFrame([("l", "i", "d", "r", value - 0.05), ("l", "i", "d", "r", value)], S.schema("document_links"))).coalesce(1)
        rows.write.parquet(str(tmp_path / f"made{n}"))
        file = next((tmp_path / f"made{n}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        names.append(tmp_path / "in" / f"{9 - n}.parquet")
        file.rename(names[-1])
        os.utime(names[-1], (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(S.schema("document_links")).parquet(str(tmp_path / "in"))
    stream_upserts(store, "document_links", stream, str(tmp_path / "state")).awaitTermination()
    found = store.read("document_links")
    assert found.where("link_id = 'l'").first().confidence == 0.1 and found.count() == 3001


def test_the_last_archive_page_wins(spark, tmp_path):
    row = "<table><tr><td>{}</td><td><a href='/{}.pdf'>Agenda</a></td><td></td></tr></table>"
    store = Store(spark, str(tmp_path))
    store.create()
    first, last = "<table><tr><td>x</td><td>y</td></tr></table>" * 5 + row.format("January 11, 2024", "old"), row.format("January 11, 2024", "new")
    pages = spark.createDataFrame([(first, "https://a.org/z", 1), (last, "https://a.org/a", 2)], "html string, source_url string, page_order int")
    pipeline.crawl_archive(store, pages, date(2024, 2, 1), NOW)
    assert store.read("hearings").first().agenda_url == "https://a.org/new.pdf"
    pipeline.crawl_archive(store, pages.drop("page_order"), date(2024, 2, 1), NOW)
    assert store.read("hearings").first().agenda_url == "https://a.org/old.pdf"  # in order of the urls


def test_counts_take_no_jobs_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    rows = [(f"c{i}", "d", 1, 1, i, "some text", 2, None, None) for i in range(5)]
    store.upsert("chunks", spark.createDataFrame(rows, S.schema("chunks")))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("counted", "")
    try:
        counts = pipeline.embed_chunks(store, NOW, Settings(dimensions=8), limit=3)
        whole = jobs()
        store.read("chunks").count()
        assert jobs() > whole
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"chunk_count": 5, "embedded_count": 3, "skipped_count": 2}
    assert pipeline.embed_chunks(store, NOW, Settings(dimensions=8)) == {"chunk_count": 5, "embedded_count": 2, "skipped_count": 3}
    assert pipeline.embed_chunks(store, NOW, Settings(dimensions=8), force=True) == {"chunk_count": 5, "embedded_count": 5, "skipped_count": 0}


def test_orders_are_dealt_before_they_become_pages(spark):
    from evidentia.plans import catalogue

    made = catalogue.archive_of_orders(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


@pytest.mark.parametrize("page, plain", [
    ('<TABLE><!-- c --><tr><th>a<td class="x">b &amp; c</td></tr></table>', True),
    ('<tr><td>a<table><tr><td>b<a href="1">l</a></td></tr></table><a href="2" HREF="3">m</a></td><td>c</tr>d<td>e', True),
    ("<!DOCTYPE html>x > y<tr/><tr><td/><br/><td ><a name=\"n\">o</a></p><a href=\"\"> </a>", True),
    ("<tr><td><a href='q'>single</a></td></tr>", False),
    ('<tr><td><a href="a?b&amp;c">d</a><a href="x>y<z">e</a></td></tr>', False),
    ("<tr><td>a<script>'<td>'</script><template><tr><td>b</td></tr></template></td></tr>", False),
    ("<tr><td>a<!-- b-c --></td x><td>d < e</td></tr><tr", False),
])
def test_rows_of_plain_pages_are_those_of_the_parser(page, plain):
    found, out = dom.plain_rows(page), dom.TableRows()
    parser = dom._Rows(out)
    parser.feed(page)
    parser.close()
    out.leave(0)
    assert (found is not None) == plain and dom.rows_of(page) == out.rows != []


def test_rows_of_scripts_and_templates():
    rows = dom.rows_of("<tr><td>a<script>'<td>'</script><template><tr><td>b <a href='u'>c</a></td></tr></template>d</td></tr>")
    assert [(r["text"], [(c["text"], c["links"]) for c in r["cells"]]) for r in rows] == [("a d", [("a d", [{"text": "c", "href": "u"}])]), ("b c", [("b c", [{"text": "c", "href": "u"}])])]


def test_plain_links_are_joined_as_others():
    bases = ["https://c.org/o/1/", "https://c.org", "http://c.org/a/b", "https://c.org/a/../b/", "https://c.org/a?q#f", "https://c.org//x/", "x", "", "HTTPS://c.org/"]
    links = ["/a/1.pdf", "s7", "a/b/", "../x", "./x", "/a/./b", ".x", "//h.org/p", "http://e.org/a", "?q=1", "#f", "", " x ", "a:b", "a;p", "x/..", "é"]
    assert [urls.joined(b, r) for b in bases for r in links] == [urljoin(b, r).strip() for b in bases for r in links]


def test_a_page_is_read_in_two_workers_and_its_dates_once(spark):
    plan = html.archive_hearings(archive(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("gettimestamp") == 1


def test_orders_without_keys_or_dates(spark, tmp_path):
    day = datetime(1996, 1, 2)
    orders = spark.createDataFrame([(1, 10, day), (2, None, day), (None, 30, day), (4, 40, None)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    result = duckdb.sql(catalogue.SQL["archive_of_orders"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    found = catalogue.archive_of_orders(spark, str(tmp_path)).select(*result.columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, result.fetchall()))
