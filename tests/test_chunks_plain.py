"""Both chunk queries over their whole tables against a row-by-row version in plain Python."""

import re
from pathlib import Path

import pytest
import regex

from evidentia.functions.text import KNOWN_SECTIONS
from evidentia.plans import catalogue

from .test_chunking import reference_ranges

DATA = Path("/root/testdata/sf0.001")


def clean(text):
    return re.sub(r"\s+", " ", text).strip(" ")


def lines(text):
    return re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text)


def estimate(text):
    return max(1, len(text) // 4)


def item_line(line):
    return bool(re.match(r"\s*\d+[A-Za-z]?\.\s+", line))


def heading(line):
    text = line.strip(" ")
    if not text or len(text) > 90 or text.endswith("."):
        return False
    letters, capitals = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    return text.endswith(":") or (0 < len(re.findall("[A-Za-z0-9][A-Za-z0-9-]+", text)) <= 10 and letters > 0 and capitals >= 0.75 * letters)


def alone(line):
    return heading(line) or item_line(line)


def titled(text):
    return regex.sub(r"\p{L}+", lambda m: m[0][0].upper() + m[0][1:].lower(), text)


def paragraphs(text):
    for part in re.split(r"\n\s*\n", re.sub("\r\n?", "\n", text)):
        out, flow = [], []
        for line in filter(None, map(clean, lines(part))):
            if re.search(r"(?i)^\s*page\s+\d+\s*$|^\s*\d+\s*$", line):
                continue
            if alone(line):
                out, flow = out + [" ".join(flow)] + [line], []
            else:
                flow.append(line)
        yield from (p for p in [*out, " ".join(flow)] if p and (estimate(p) >= 8 or alone(p)))


def hint(paragraph):
    first = clean(lines(paragraph)[0])
    bare = first.strip(":")
    if item_line(first):
        case = re.search(r"\b20\d{2}-\d{6}[A-Z0-9-]*\b", first)
        return "Agenda Item " + first.split(".")[0].strip() + (f" - {case[0]}" if case else "")
    known = {s.lower(): s for s in KNOWN_SECTIONS}
    if bare.lower() in known:
        return known[bare.lower()]
    if heading(bare):
        return titled(bare) if bare.upper() == bare != bare.lower() else bare
    return None


def pieces(text, most):
    if estimate(text) <= most:
        return [text]
    out, size = [[]], 0
    for word in text.split():
        if out[-1] and size + len(word) + 1 > 4 * most:
            out, size = [*out, []], 0
        out[-1].append(word)
        size += len(word) + 1
    return [" ".join(words) for words in out]


def plain_chunks(pages, target, most, overlap):
    """(chunk_id, document_id, pages, index, text, tokens, section, label) of pages
    (document_id, source_type, title, date text, page_number, text), good ones all."""
    out = []
    for document in {p[0] for p in pages}:
        own = sorted((p for p in pages if p[0] == document), key=lambda p: p[4])
        kind, title, day = own[0][1:4]
        section = {"staff_report": "Staff Report", "agenda": "Agenda"}.get(kind, "Correspondence")
        blocks = []
        for *_, number, text in own:
            for paragraph in paragraphs(text or ""):
                section = hint(paragraph) or section
                blocks += [(number, piece, section) for piece in pieces(paragraph, most)]
        ranges = reference_ranges([estimate(b[1]) for b in blocks], [len(b[1]) for b in blocks], [b[2] for b in blocks], target, most, overlap)
        for n, (a, b) in enumerate(ranges):
            held = blocks[a : b + 1]
            first, last = held[0][0], held[-1][0]
            text = clean("\n\n".join(x[1] for x in held))
            where = f"p. {first}" if first == last else f"pp. {first}-{last}"
            out.append((f"chunk-{document}-{n:04d}", document, first, last, n, text, estimate(text), held[-1][2], f"{day} {title or titled(kind.replace('_', ' '))} - {where}"))
    return sorted(out)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_chunk_queries_match_plain_python(spark):
    docs = [("%d" % r.doc_id, "agenda", r.source, "Undated", 1, (r.text or "").replace("\n", "\n\n")) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, catalogue.chunk_overlap(spark, str(DATA)).collect())) == plain_chunks(docs, 100, 120, 20)
    turns = [
        ("%d" % r.conv_id, "correspondence_pre_hearing" if r.conv_id % 3 else "staff_report", None, "May 2, 2024", r.turn + 1, ("Public Comment:\n\n" if r.turn % 2 else "EXECUTIVE SUMMARY\n\n") + (r.text or ""))
        for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    ]
    assert sorted(map(tuple, catalogue.chunk_sections(spark, str(DATA)).collect())) == plain_chunks(turns, 60, 90, 10)
