"""HTML pages to hearings and documents.

Arrow functions only take the pages apart into rows of text and links; every rule on them is a
Column expression or a window over the order of the elements.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from evidentia.functions import keys, text as T
from evidentia.functions.dates import archive_date
from evidentia.functions.urls import SOURCE_TYPES, document_title, is_document_link, joined_url, source_type_of
from evidentia.session import small_batches
from evidentia.sources.dom import parsed, rows_of

#: Elements that open a section, and blocks whose text stands around a link.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "th"))
CONTEXTS = frozenset(("li", "p", "tr", "td", "div", "section"))
BODY = "Planning Commission"
CANCELLED = r"(?i)\b(cancelled|canceled|cancellation)\b"

_LINK = StructType().add("text", "string").add("href", "string")
_CELL = StructType().add("text", "string").add("links", ArrayType(_LINK))
ROWS = ArrayType(StructType().add("text", "string").add("cells", ArrayType(_CELL)))
ELEMENTS = ArrayType(StructType().add("kind", "string").add("text", "string").add("href", "string").add("context", "string"))


@F.arrow_udf(ROWS)
def table_rows(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Rows of all tables of a page, with their own cells; a few pages at a time are held as Python objects."""
    kind = to_arrow_type(ROWS)
    for page in pages:
        yield pa.concat_arrays([pa.array([], kind), *(pa.array([rows_of(html) for html in page[i : i + 256].to_pylist()], kind) for i in range(0, len(page), 256))])


@F.pandas_udf(ELEMENTS)
def headings_and_links(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Headings, and links with the text of the nearest block around them, in document order."""
    for page in pages:
        out = []
        for html in page:
            own, texts = [], {}  # the text of a block is made once for all its links
            for e in parsed(html).walk():
                if e.name in HEADINGS:
                    own.append({"kind": "heading", "text": e.text(), "href": None, "context": None})
                if e.name == "a" and "href" in e.attributes:
                    around = e.above(CONTEXTS)
                    if around not in texts:
                        texts[around] = around.text() if around else ""
                    own.append({"kind": "link", "text": e.text(), "href": e.attributes["href"] or "", "context": texts[around]})
            out.append(own)
        yield pd.Series(out, dtype="object")


def qualifiers(text: Column) -> Column:
    """What stands in parentheses, without words of cancellation; may be empty."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1)), T.clean_text)
    return T.clean_text(F.array_join(F.filter(found, lambda q: ~q.rlike(CANCELLED)), " "))


def column_link(cell: Column, label: str) -> Column:
    """The first link whose text holds the label; the first of all if the cell's text holds it."""
    text = F.lower(T.clean_text(cell["text"]))
    named = F.get(F.filter(cell["links"], lambda a: F.lower(T.clean_text(a["text"])).contains(label)), F.lit(0))["href"]
    first = F.when(text.contains(label), F.get(cell["links"], F.lit(0))["href"])
    return F.when(~text.isin("", "n/a", "na"), F.coalesce(named, first))


def archive_hearings(pages: DataFrame, since: datetime.date | None = None, until: datetime.date | None = None, limit: int | None = None) -> DataFrame:
    """Hearings of archive pages (html, source_url, and page_order, else all pages count as one in order of their urls), in
    document order. Bounds are inclusive; no limit, or 0, is none."""
    small_batches(pages.sparkSession)
    place = F.col("page_order").cast("bigint") if "page_order" in pages.columns else F.lit(0).cast("bigint")
    rows = pages.select("source_url", place.alias("page_order"), F.posexplode(table_rows(F.col("html"))).alias("position", "row")).where(F.size("row.cells") >= 2)
    cleaned = rows.withColumn("first", T.clean_text(F.col("row.cells")[0]["text"])).where(~F.lower("first").startswith("hearing date"))
    # A filter moves below a column that is an expression, which is then evaluated twice; it does not move below an array's elements.
    dated = cleaned.select("source_url", "page_order", "position", "row", "first", F.explode(F.array(archive_date(F.col("first")))).alias("hearing_date"))
    found = dated.where("hearing_date is not null").withColumn("suffix", qualifiers(F.col("first")))
    if since:
        found = found.where(F.col("hearing_date") >= F.lit(since))
    if until:
        found = found.where(F.col("hearing_date") <= F.lit(until))
    if limit:
        found = found.orderBy("page_order", "source_url", "position").limit(limit)
    cell = lambda i, label: joined_url(F.col("source_url"), column_link(F.get(F.col("row.cells"), F.lit(i)), label))
    return found.select(
        keys.hearing_id(F.col("hearing_date"), F.col("suffix")).alias("hearing_id"), "hearing_date",
        F.concat_ws(" - ", F.lit(BODY), T.blank_to_null(F.col("suffix"))).alias("title"),
        F.when(F.col("row.text").rlike(CANCELLED), "cancelled").otherwise("scheduled").alias("status"),
        cell(1, "agenda").alias("agenda_url"), cell(2, "minutes").alias("minutes_url"), cell(3, "supporting").alias("supporting_url"),
        "source_url", "page_order", "position",
    )


def normalised_documents(df: DataFrame) -> DataFrame:
    """hearing_id, source_type, title, url (and position) with unknown types as other, and the key."""
    url = F.trim("url")
    return df.select(
        keys.document_id(F.col("hearing_id"), url).alias("document_id"), "hearing_id",
        F.when(F.col("source_type").isin(*SOURCE_TYPES), F.col("source_type")).otherwise("other").alias("source_type"),
        T.blank_to_null(T.clean_text(F.coalesce("title", F.lit("")))).alias("title"), url.alias("url"), "position",
    )


def archive_documents(hearings: DataFrame) -> DataFrame:
    """The agenda and minutes links of hearings as documents."""
    wide = hearings.select("hearing_id", F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("source_type"), F.lit(t.title()).alias("title"), F.col(f"{t}_url").alias("url")) for i, t in enumerate(("agenda", "minutes"))])).alias("d"))
    return normalised_documents(wide.select("hearing_id", "d.*").where(F.col("url").isNotNull() & (F.col("url") != "")))


def carried_type(found: DataFrame, page: list[str]) -> DataFrame:
    """Adds ``carried``: the type of the last heading that has one, else other."""
    kind = source_type_of(F.col("text"))
    onward = Window.partitionBy(*page).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("carried", F.coalesce(F.last(F.when((F.col("kind") == "heading") & (kind != "other"), kind), ignorenulls=True).over(onward), F.lit("other")))


def first_of(df: DataFrame, keys_: list[str], order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys_).orderBy(order))).where("__rank = 1").drop("__rank")


def supporting_documents(pages: DataFrame) -> DataFrame:
    """Documents that pages (hearing_id, source_url, html) link to: typed by what surrounds the link,
    else by the section it stands in; the first of each url."""
    small_batches(pages.sparkSession)
    found = pages.select("hearing_id", "source_url", F.posexplode(headings_and_links(F.col("html"))).alias("position", "e")).select("hearing_id", "source_url", "position", "e.*")
    links = carried_type(found, ["hearing_id", "source_url"]).where("kind = 'link'").withColumn("url", joined_url(F.col("source_url"), F.col("href")))
    kept = first_of(links.where(is_document_link(F.col("url"), F.col("text"))), ["hearing_id", "source_url", "url"], F.col("position"))
    context, text = T.clean_text(F.col("context")), T.clean_text(F.col("text"))
    own = source_type_of(F.concat_ws(" ", context, text, F.col("url")))
    typed = kept.select("hearing_id", "url", "position", F.when(own == "other", F.col("carried")).otherwise(own).alias("source_type"), document_title(text, context, F.col("url")).alias("title"))
    return normalised_documents(typed)


def preferred_documents(df: DataFrame) -> DataFrame:
    """One row of each document: the first, unless it is ``other`` and a later one is not, or its title
    is null and a later one's is not. The rule looks at one row after the other, so it is a fold over
    a document's rows in order."""
    row = F.struct("position", "hearing_id", "source_type", "title", "url")
    rows = df.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    better = lambda a, b: ((a["source_type"] == "other") & (b["source_type"] != "other")) | (a["title"].isNull() & b["title"].isNotNull())
    chosen = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), F.col("rows")[0], lambda a, b: F.when(better(a, b), b).otherwise(a))
    return rows.select("document_id", chosen.alias("r"), F.col("rows")[0]["position"].alias("position")).select("document_id", "r.hearing_id", "r.source_type", "r.title", "r.url", "position")
