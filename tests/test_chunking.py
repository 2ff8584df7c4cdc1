from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.operators import chunking as C


def reference_ranges(sizes, chars, sections, target, most, overlap):
    """The packing rules as a plain loop over block numbers."""
    out, held = [], []
    for i, n in enumerate(sizes):
        last = sections[held[-1]] if held else None
        changed = last is not None and sections[i] is not None and sections[i] != last
        if held and (sum(sizes[j] for j in held) + n > most or (changed and sum(sizes[j] for j in held) >= max(16, target // 4))):
            out.append((held[0], held[-1]))
            back, total = [], 0
            if overlap > 0 and not (sections[i] and last and sections[i] != last):
                for j in reversed(held):
                    if total >= overlap * 4 or sections[j] != last:
                        break
                    back.insert(0, j)
                    total += chars[j]
            held = back
        held.append(i)
        if sum(sizes[j] for j in held) >= target:
            out.append((held[0], held[-1]))
            held = []
    return out + ([(held[0], held[-1])] if held else [])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from([None, "A", "B"])), max_size=14), st.integers(10, 80), st.integers(0, 30), st.integers(0, 12))
def test_packing_matches_a_plain_loop(spark, blocks, target, more, overlap):
    sizes, sections = [b[0] for b in blocks], [b[1] for b in blocks]
    chars = [4 * n for n in sizes]
    row = spark.createDataFrame([(sizes, chars, sections)], "s array<int>, c array<int>, x array<string>")
    found = row.select(C.packed(F.col("s"), F.col("c"), F.col("x"), target, target + more, overlap).alias("r")).first().r
    assert [(r["from"], r["to"]) for r in found] == reference_ranges(sizes, chars, sections, target, target + more, overlap)


def test_paragraphs(spark):
    text = "EXECUTIVE SUMMARY\r\nThis is a line of the first paragraph\nthat goes on.\n\n \nPage 3\n17\n\nshort\n1. An item line\nafter the item there is more text here"
    found = spark.range(1).select(C.paragraphs_of(F.lit(text)).alias("p")).first().p
    assert found == ["EXECUTIVE SUMMARY", "This is a line of the first paragraph that goes on.", "1. An item line", "after the item there is more text here"]


def test_large_blocks_are_packed_by_words(spark):
    found = spark.range(1).select(C.pieces_of(F.lit("aaaa bbbb cccc " + "d" * 30), 3).alias("p")).first().p
    assert found == ["aaaa bbbb", "cccc", "d" * 30]


PAGE = "BACKGROUND\n\n" + "Words about the site and its past owners go on. " * 4 + "\n\nPROJECT DESCRIPTION\n\n" + "The project adds homes over shops on the corner. " * 4


def pages(spark, *texts, quality="good"):
    rows = [("d", "staff_report", "Report", date(2024, 5, 2), n, t, quality) for n, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "document_id string, source_type string, title string, hearing_date date, page_number int, text string, extraction_quality string")


def test_chunks_are_cited_and_sectioned(spark):
    rows = C.chunks_of(pages(spark, PAGE, "Carried over from the page before, this paragraph goes on at length."), 60, 90, 10).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].chunk_id == "chunk-d-0000"
    assert rows[0].citation_label == "May 2, 2024 Report - p. 1" and rows[0].section_hint == "Background"
    assert rows[-1].section_hint == "Project Description" and rows[-1].page_end == 2
    assert all("\n" not in r.text and r.token_estimate == max(1, len(r.text) // 4) for r in rows)


def test_every_block_is_in_some_chunk(spark):
    own = pages(spark, PAGE, PAGE)
    texts = " ".join(r.text for r in C.chunks_of(own, 60, 90, 10).collect())
    assert all(r.text in texts for r in C.blocks_of(own, 90).collect())


def test_poor_and_blank_pages_give_nothing(spark):
    assert C.chunks_of(pages(spark, "few words", " \n ", quality="poor")).collect() == []
    assert C.chunks_of(pages(spark, PAGE).limit(0)).collect() == []


def test_packing_takes_linear_time(spark):
    import time

    def seconds(make):
        began = time.perf_counter()
        make().collect()
        return time.perf_counter() - began

    blocks = spark.range(1).select(*[F.expr(f"transform(sequence(1, 100000), i -> {x})").alias(c) for c, x in (("s", "int(20 + i % 37)"), ("c", "int(80 + i % 7)"), ("x", "string(floor(i / 11) % 3)"))])
    row = blocks.first()
    assert [tuple(r) for r in blocks.select(C.packed(F.col("s"), F.col("c"), F.col("x"), 100, 120, 12).alias("r")).first().r] == reference_ranges(row.s, row.c, row.x, 100, 120, 12)
    assert seconds(lambda: blocks.select(C.packed(F.col("s"), F.col("c"), F.col("x"), 100, 120, 12))) < 30
    words = spark.range(1).select(F.expr("array_join(transform(sequence(1, 1000000), i -> string(i)), ' ')").alias("t"))
    assert seconds(lambda: words.select(F.size(C.pieces_of(F.col("t"), 100)))) < 60
    lines = spark.range(1).select(F.expr("array_join(transform(sequence(1, 20000), i -> if(i % 2 = 0, 'SOME HEADING:', 'a line of text that flows on')), '\n')").alias("t"))
    assert seconds(lambda: lines.select(F.size(C.paragraphs_of(F.col("t"))))) < 30
