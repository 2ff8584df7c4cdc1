"""Files: download with retries, recognition, hashing, and pages of PDF documents.

Failures are rows, so one bad document does not stop a batch. Contents travel as a binary column.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import keys
from evidentia.functions.text import quality_of

AGENT = "evidentia/1.0"
FETCHED = "document_id string, status string, error string, content binary, mime_type string, sha256 string, file_size_bytes bigint"


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_url, html) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_url"), F.col("value").alias("html"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, file_size_bytes)"""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size_bytes"))


def http_get(url: str, timeout: float = 60) -> tuple[bytes, str]:
    """Content and type; raises on an error status."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as reply:
        return reply.read(), reply.headers.get_content_type()


def looks_like_pdf(mime: str, content: bytes, url: str) -> bool:
    kind, magic = (mime or "").lower(), content[:4] == b"%PDF"
    return "pdf" in kind or (magic and ("octet-stream" in kind or url.split("?")[0].lower().endswith(".pdf")))


def fetch(url: str, get: Callable = http_get, retries: int = 3, sleep: Callable = time.sleep) -> tuple[bytes, str]:
    """Tries again after any error, waiting 1, 2, 4, ... seconds; the last error is raised."""
    for attempt in range(1, retries + 1):
        try:
            content, mime = get(url)
            if not looks_like_pdf(mime, content, url):
                raise ValueError(f"not a PDF: {mime}")
            return content, "application/pdf" if "octet-stream" in mime.lower() else mime
        except Exception:
            if attempt == retries:
                raise
            sleep(2 ** (attempt - 1))
    raise ValueError("retries must be at least 1")


def _chosen(documents: DataFrame, limit: int | None, document_id: str | None) -> DataFrame:
    found = documents if document_id is None else documents.where(F.col("document_id") == document_id)
    found = found.orderBy("document_id")
    return found if limit is None else found.limit(limit)


def pdf_candidates(documents: DataFrame, limit: int | None = None, document_id: str | None = None) -> DataFrame:
    """Documents whose url holds .pdf anywhere, by id."""
    return _chosen(documents.where(F.lower("url").contains(".pdf")), limit, document_id)


def downloaded_pdfs(documents: DataFrame, limit: int | None = None, document_id: str | None = None) -> DataFrame:
    """Documents that were downloaded as PDF, by their type or the ending of their path, by id."""
    pdf = (F.col("mime_type") == "application/pdf") | F.lower("local_path").endswith(".pdf")
    return _chosen(documents.where(F.col("local_path").isNotNull() & pdf), limit, document_id)


def pdf_path(folder: str, document_id: Column) -> Column:
    """A document's path: its id under the folder. The contents of a folder are rows of one table."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), document_id, F.lit(".pdf"))


def latest(contents: DataFrame) -> DataFrame:
    """The last fetched content of each document. Which row that is, is settled without the contents."""
    last = contents.groupBy("document_id").agg(F.max_by("fetch_id", F.struct("fetched_at", "fetch_id")).alias("fetch_id"))
    return contents.join(last, ["document_id", "fetch_id"], "left_semi").select("document_id", "content", "mime_type", "sha256", "file_size_bytes")


def download(documents: DataFrame, known: DataFrame | None = None, force: bool = False, get: Callable = http_get, retries: int = 3, sleep: Callable = time.sleep) -> DataFrame:
    """(document_id, status, error, content, ...): status is downloaded, skipped or failed. A document is
    skipped if its content is among ``known`` (document_id, content) and its stored hash agrees or is null."""
    want = documents.select("document_id", "url", "sha256")
    held = want.withColumn("held", F.lit(None).cast("binary")) if known is None or force else want.join(known.select("document_id", F.col("content").alias("held")), "document_id", "left")
    marked = held.withColumn("skip", F.col("held").isNotNull() & F.coalesce(F.sha2("held", 256) == F.col("sha256"), F.lit(True)))

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    content, mime = (bytes(r.held), "application/pdf") if r.skip else fetch(r.url, get, retries, sleep)
                    rows.append((r.document_id, "skipped" if r.skip else "downloaded", None, content, mime, hashlib.sha256(content).hexdigest(), len(content)))
                except Exception as e:  # a failure is a row
                    rows.append((r.document_id, "failed", f"{type(e).__name__}: {e}", None, None, None, None))
            out = pd.DataFrame(rows, columns=["document_id", "status", "error", "content", "mime_type", "sha256", "file_size_bytes"])
            yield out.astype({"file_size_bytes": "Int64"})

    return marked.mapInPandas(fetched, FETCHED)


def pdf_pages(contents: DataFrame, read: Callable[[bytes], list[str | None]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of (document_id, content). ``read`` gives the text of each page; the default
    needs the optional pymupdf library."""

    def default(content: bytes) -> list[str | None]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("the pymupdf library is not installed") from e
        with pymupdf.open(stream=content, filetype="pdf") as doc:
            return [page.get_text() for page in doc]

    chosen = read or default

    def extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows += [(r.document_id, n, t or "", None) for n, t in enumerate(chosen(bytes(r.content)), 1)]
                except Exception as e:  # a failure is a row
                    rows.append((r.document_id, 0, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "error"])

    found = contents.select("document_id", "content").mapInPandas(extracted, "document_id string, page_number int, text string, error string")
    return page_rows(found.where(F.col("error").isNull())), found.where(F.col("error").isNotNull()).select("document_id", "error")


def page_rows(texts: DataFrame, method: str = "pymupdf") -> DataFrame:
    """Rows of the pages table from (document_id, page_number, text)."""
    text = F.coalesce("text", F.lit(""))
    return texts.select(
        keys.page_id(F.col("document_id"), F.col("page_number")).alias("page_id"), "document_id", "page_number", text.alias("text"),
        F.length(text).alias("char_count"), F.lit(method).alias("extraction_method"), quality_of(F.length(text)).alias("extraction_quality"),
    )
