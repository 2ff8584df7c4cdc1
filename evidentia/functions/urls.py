"""URLs and links."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.functions.text import blank_to_null, clean_text

#: Link texts that say nothing about the document.
GENERIC_TITLES = ("", "download", "download pdf", "pdf", "view", "view document", "view pdf")
SOURCE_TYPES = ("agenda", "minutes", "staff_report", "presentation", "correspondence_pre_hearing", "correspondence_at_hearing", "notice", "other")
AT_HEARING = ("at hearing", "at the hearing", "during hearing", "during the hearing")


#: Parts without dots at their start, queries or other marks, which joining leaves as they are.
_PART = "[A-Za-z0-9_~-][A-Za-z0-9._~-]*"
PLAIN_BASE = re.compile(rf"((https?://[A-Za-z0-9.-]+)(?:/{_PART})*/)(?:{_PART})?")
PLAIN_LINK = re.compile(rf"/?{_PART}(?:/{_PART})*/?")


def joined(base: str, link: str) -> str:
    """urljoin; plain ones are put together by hand, in a tenth of the time."""
    if (at := PLAIN_BASE.fullmatch(base)) and PLAIN_LINK.fullmatch(link):
        return at[2 if link[0] == "/" else 1] + link
    return urljoin(base, link).strip()


@F.arrow_udf(StringType())
def joined_url(bases: pa.Array, links: pa.Array) -> pa.Array:
    """A reference resolved against its base by RFC 3986; null if either is null. No iterator, so that Spark evaluates
    several calls of a row in one worker."""
    return pa.array([None if b is None or r is None else joined(b, r) for b, r in zip(bases.to_pylist(), links.to_pylist(), strict=True)], pa.string())


def source_type_of(text: Column) -> Column:
    """The first of these words decides; correspondence divides by when it was received."""
    plain = F.lower(clean_text(text))
    at_hearing = plain.rlike("|".join(AT_HEARING))
    rules = F.when(plain.contains("correspondence"), F.when(at_hearing, "correspondence_at_hearing").otherwise("correspondence_pre_hearing"))
    for words in ("staff report", "presentation", "agenda", "minutes", "notice"):
        rules = rules.when(plain.contains(words), words.replace(" ", "_"))
    return rules.otherwise("other")


def is_document_link(url: Column, text: Column) -> Column:
    plain = F.lower(clean_text(text))
    return url.rlike(r"(?i)\.pdf(?:$|[?#])") | plain.endswith("pdf") | plain.contains(" pdf")


def url_path(url: Column) -> Column:
    """What stands between the host and ? or #."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def file_name(url: Column) -> Column:
    """The last part of the path, else the url."""
    return F.coalesce(blank_to_null(F.regexp_extract(F.regexp_replace(url_path(url), "/+$", ""), "([^/]*)$", 1)), url)


def document_title(link: Column, context: Column, url: Column) -> Column:
    link, context = clean_text(link), clean_text(F.coalesce(context, F.lit("")))
    return F.when(~F.lower(link).isin(*GENERIC_TITLES), link).when(~F.lower(context).isin(*GENERIC_TITLES), context).otherwise(file_name(url))


def is_pdf(mime: Column, content: Column, url: Column) -> Column:
    """The type says so, or the bytes do and the type or the url's path leaves it open."""
    magic = F.substring(content, 1, 4) == F.lit(b"%PDF")
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return kind.contains("pdf") | (magic & (kind.contains("octet-stream") | F.lower(F.split(url, r"\?")[0]).endswith(".pdf")))
