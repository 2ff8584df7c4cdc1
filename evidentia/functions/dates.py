"""Written dates. An impossible date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def written_date(text: Column, separators: str = r",?\s+") -> Column:
    """The first ``Month D, YYYY``; ``separators`` stands between day and year."""
    pattern = rf"(?i)\b({MONTHS})\s+(\d{{1,2}}){separators}(\d{{4}})\b"
    plain = F.regexp_replace(F.regexp_extract(text, pattern, 0), r"[,.\s]+", " ")
    return F.to_date(F.try_to_timestamp(F.nullif(plain, F.lit("")), F.lit("MMMM d yyyy")))


def archive_date(text: Column) -> Column:
    return written_date(text, r"[,.\s]+")
