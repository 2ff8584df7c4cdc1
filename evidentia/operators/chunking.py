"""Pages to paragraphs, blocks and structure-aware, citable chunks.

Texts are split, cleaned and joined by built-in functions. What is greedy, the packing of words into
pieces and of blocks into chunks, is one walk over numbers: lengths, token estimates and sections go to an
Arrow function, and index ranges come back, so no text leaves the JVM. (A fold by Spark's ``aggregate``
copies what it has gathered at each step, which makes it quadratic.) Rows are shuffled once, by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import keys, text as T

RANGES = "array<struct<from:int,to:int>>"


def paragraphs_of(text: Column) -> Column:
    """Paragraphs between blank lines; headings and item lines stand alone, other lines flow together."""
    raw = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), r"(?U)\n\s*\n")
    solo = lambda line: T.is_heading(line) | T.is_item_line(line)

    def split(part):
        lines = F.filter(F.transform(T.lines_of(part), T.clean_text), lambda x: (x != "") & ~T.is_low_value(x))
        marked = F.transform(lines, lambda x: F.when(solo(x), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x))
        return F.transform(F.split(F.array_join(marked, " "), "\n"), lambda p: F.trim(p))  # cleaned lines hold no line ends

    found = F.flatten(F.transform(raw, split))
    return F.filter(found, lambda p: (p != "") & ((T.token_estimate(p) >= 8) | solo(p)))


def word_runs(lengths, most: int) -> list[tuple[int, int]]:
    """Index ranges of runs of words of up to ``most`` characters, a space for each word included; a longer word is a run."""
    out, first, n = [], 0, 0
    for at, length in enumerate(lengths):
        if first < at and n + length + 1 > most:
            out.append((first, at - 1))
            first, n = at, 0
        n += length + 1
    return out + [(first, len(lengths) - 1)] if len(lengths) else []


def pieces_of(text: Column, max_tokens: int) -> Column:
    """A text of more than ``max_tokens`` as runs of words of up to four times as many characters."""
    long = T.token_estimate(text) > max_tokens
    words = F.filter(F.split(text, T.SPACES), lambda w: w != "")

    @F.pandas_udf(RANGES)
    def runs(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: None if x is None else word_runs(x.tolist(), 4 * max_tokens))

    ranges = runs(F.when(long, F.transform(words, F.length)))
    joined = lambda own: F.transform(own["ranges"], lambda r: F.array_join(F.slice(own["words"], r["from"] + 1, r["to"] - r["from"] + 1), " "))
    both = F.struct(ranges.alias("ranges"), words.alias("words"))
    found = F.aggregate(F.array(F.lit(0)), both, lambda held, _: held, joined)  # so the words are split off once, not for each range
    return F.when(long, found).otherwise(F.array(text))


def skipped(text: Column, quality: Column) -> Column:
    """Blank pages, and poor ones of fewer than 20 tokens."""
    plain = T.clean_text(F.coalesce(text, F.lit("")))
    return (plain == "") | (F.coalesce(quality == "poor", F.lit(False)) & (T.token_estimate(plain) < 20))


def blocks_of(pages: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """(document_id, page_number, position, text, section): ``pages`` also has the document's
    source_type. A section runs on from its heading over the pages of a document."""
    split = pages.where(~skipped(F.col("text"), F.col("extraction_quality"))).select("document_id", "source_type", "page_number", F.posexplode(paragraphs_of(F.col("text"))).alias("at", "paragraph"))
    onward = Window.partitionBy("document_id").orderBy("page_number", "at").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(T.section_hint(F.col("paragraph")), ignorenulls=True).over(onward), T.first_section(F.col("source_type")))
    return split.withColumn("section", section).select("document_id", "page_number", "at", "section", F.posexplode(pieces_of(F.col("paragraph"), max_tokens)).alias("piece", "text"))


def pack(sizes: list[int], chars: list[int], sections: list[str | None], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Index ranges of the chunks. Each block is passed once, and once more by the overlap of the chunk that it ends."""
    out, first, n = [], 0, 0
    for i, size in enumerate(sizes):
        own, here = sections[i - 1], sections[i]
        changed = first < i and own is not None and here is not None and own != here
        if first < i and (n + size > most or (changed and n >= max(16, target // 4))):
            out.append((first, i - 1))
            low, first, n, held = first, i, 0, 0
            if overlap > 0 and not (own and here and own != here):
                while first > low and held < 4 * overlap and sections[first - 1] == own:
                    first -= 1
                    held += chars[first]
                    n += sizes[first]
        n += size
        if n >= target:
            out.append((first, i))
            first, n = i + 1, 0
    return out + [(first, len(sizes) - 1)] if first < len(sizes) else out


def packed(sizes: Column, chars: Column, sections: Column, target: int, most: int, overlap: int) -> Column:
    """Index ranges struct<from,to> of the chunks, from the blocks' token estimates, lengths and sections.

    A block that would pass ``most`` tokens, or opens another section once a quarter of the target is
    held, closes the chunk before it, and the next begins with whole blocks of overlap of the same
    section. A chunk that reaches the target is closed without overlap.
    """

    @F.pandas_udf(RANGES)
    def ranges(sizes: pd.Series, chars: pd.Series, sections: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else pack(s.tolist(), c.tolist(), x.tolist(), target, most, overlap) for s, c, x in zip(sizes, chars, sections, strict=True)])

    return ranges(sizes, chars, sections)


def chunks_of(pages: DataFrame, target: int = 1000, most: int = 1200, overlap: int = 120) -> DataFrame:
    """Chunks of ``pages`` (document_id, source_type, title, hearing_date, page_number, text, extraction_quality)."""
    blocks = blocks_of(pages, most)
    facts = pages.groupBy("document_id").agg(F.min_by(F.struct("hearing_date", "source_type", "title"), "page_number").alias("doc"))
    held = (
        blocks.groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_number", "at", "piece", "text", "section"))).alias("blocks"))
        .withColumn("sizes", F.transform("blocks", lambda b: T.token_estimate(b["text"])))
        .withColumn("chars", F.transform("blocks", lambda b: F.length(b["text"])))
        .withColumn("sections", F.transform("blocks", lambda b: b["section"]))
        .join(facts, "document_id")
    )
    ranges = packed(F.col("sizes"), F.col("chars"), F.col("sections"), target, most, overlap)
    own = held.select("document_id", "doc", "blocks", F.posexplode(ranges).alias("chunk_index", "r")).select("document_id", "doc", "chunk_index", F.slice("blocks", F.col("r.from") + 1, F.col("r.to") - F.col("r.from") + 1).alias("own"))
    made = own.select(
        "document_id", "doc", "chunk_index",
        F.array_min("own.page_number").alias("page_start"), F.array_max("own.page_number").alias("page_end"),
        T.clean_text(F.array_join("own.text", "\n\n")).alias("text"),
        F.try_element_at(F.filter("own.section", lambda s: s.isNotNull() & (s != "")), F.lit(-1)).alias("section_hint"),
    )
    return made.select(
        keys.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "page_start", "page_end", "chunk_index", "text",
        T.token_estimate(F.col("text")).alias("token_estimate"), "section_hint",
        T.citation_label(F.col("doc.hearing_date"), F.col("doc.source_type"), F.col("doc.title"), F.col("page_start"), F.col("page_end")).alias("citation_label"),
    )
