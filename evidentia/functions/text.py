"""Text functions from Column to Column. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Patterns of a term, of the line that opens an agenda item, and of a case number.
TERM = r"[a-z0-9][a-z0-9-]{1,}"
ITEM_LINE = r"(?U)^[\s\x1c-\x1f]*\d+[A-Za-z]?\.[\s\x1c-\x1f]+"
CASE_NUMBER = r"\b20\d{2}-\d{6}[A-Z0-9-]*\b"

#: Synonyms that a query or an embedding adds to a term.
SYNONYMS = {
    "appeal": ("challenge", "objection"),
    "approval": ("approve", "authorization", "entitlement"),
    "delay": ("continuance", "continued", "postpone", "postponed"),
    "housing": ("dwelling", "residential", "unit", "units", "apartment"),
    "opposition": ("concern", "concerns", "objection", "comment", "neighbor"),
    "parking": ("garage", "vehicle", "vehicles", "car", "cars"),
    "project": ("proposal", "development"),
    "transit": ("muni", "bus", "rail", "station"),
}

#: Headings of staff reports.
KNOWN_SECTIONS = (
    "Agenda Item",
    "Background",
    "CEQA",
    "Executive Summary",
    "Issues and Other Considerations",
    "Planning Code Compliance",
    "Preliminary Recommendation",
    "Project Description",
    "Public Comment",
    "Recommendation",
    "Required Commission Action",
    "Site Description",
    "Staff Analysis",
    "Staff Report",
)


def clean_text(text: Column) -> Column:
    """Runs of white space (no-break spaces too) become one space; trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_ENDS)


def clean_lines(text: Column) -> Column:
    """Every line cleaned, empty ones dropped, joined by newlines."""
    return F.array_join(F.filter(F.transform(lines_of(text), clean_text), lambda x: x != ""), "\n")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def stem(term: Column) -> Column:
    """-ies becomes -y, and a final s goes, from words of more than four letters."""
    long = F.length(term) > 4
    return F.when(long & term.endswith("ies"), F.concat(term.substr(F.lit(1), F.length(term) - 3), F.lit("y"))).when(long & term.endswith("s"), term.substr(F.lit(1), F.length(term) - 1)).otherwise(term)


def words_of(text: Column) -> Column:
    """Terms before stemming, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def terms_of(text: Column) -> Column:
    """Stemmed terms in order, with repeats."""
    return F.filter(F.transform(words_of(text), stem), lambda x: F.length(x) > 1)


def plain_stem(word: str) -> str:
    """``stem`` of one word, for a query's few words."""
    if len(word) <= 4:
        return word
    return f"{word[:-3]}y" if word.endswith("ies") else word.removesuffix("s")


def forms_of(term: str) -> list[str]:
    """The words whose stem is ``term``."""
    return [w for w in dict.fromkeys((term, f"{term}s", f"{term[:-1]}ies")) if plain_stem(w) == term]


def expanded(terms: Column, synonyms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Each term followed by its synonyms, which are not stemmed."""
    known = SYNONYMS if synonyms is None else synonyms
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(table[t], F.array().cast("array<string>")))))


def query_terms(query: str, synonyms: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The expanded terms of a query, computed once on the driver."""
    import re

    known, out = SYNONYMS if synonyms is None else synonyms, []
    for word in re.findall(TERM, query.lower()):
        word = plain_stem(word)
        if len(word) > 1:
            out += [word, *known.get(word, ())]
    return out


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def snippet(text: Column, size: int = 260) -> Column:
    flat = clean_text(text)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 3)), F.lit("...")))


def csv_list(text: Column) -> Column:
    """Trimmed parts between commas; null when there is none."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(text: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))), "")


def is_item_line(line: Column) -> Column:
    return line.rlike(ITEM_LINE)


def is_low_value(line: Column) -> Column:
    """A page mark, or digits alone."""
    return line.rlike(r"(?Ui)^\s*page\s+\d+\s*$|^\s*\d+\s*$")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_heading(line: Column) -> Column:
    """At most 90 characters; ends in a colon, or up to ten words of which three quarters are capitals."""
    text = F.trim(line)
    words = F.regexp_count(text, F.lit("[A-Za-z0-9][A-Za-z0-9-]{1,}"))
    letters, capitals = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.when((text == "") | (F.length(text) > 90) | text.endswith("."), False).when(text.endswith(":"), True).otherwise((words > 0) & (words <= 10) & (letters > 0) & (capitals >= 0.75 * letters))


def section_hint(text: Column) -> Column:
    """The section that a paragraph opens, or null."""
    first = clean_text(F.get(lines_of(text), F.lit(0)))
    bare = F.regexp_replace(first, "^:+|:+$", "")
    case = blank_to_null(F.regexp_extract(first, CASE_NUMBER, 0))
    item = F.concat_ws(" - ", F.concat(F.lit("Agenda Item "), F.trim(F.substring_index(first, ".", 1))), case)
    known = F.create_map(*[x for s in KNOWN_SECTIONS for x in (F.lit(s.lower()), F.lit(s))])[F.lower(bare)]
    return F.when(is_item_line(first), item).when(known.isNotNull(), known).when(is_heading(bare), F.when(is_upper(bare), title_case(bare)).otherwise(bare))


def type_label(source_type: Column) -> Column:
    return title_case(F.replace(source_type, F.lit("_"), F.lit(" ")))


def first_section(source_type: Column) -> Column:
    """The section before any heading."""
    return (
        F.when(source_type == "staff_report", "Staff Report").when(source_type == "agenda", "Agenda")
        .when(source_type.startswith("correspondence"), "Correspondence").otherwise(blank_to_null(type_label(source_type)))
    )


def citation_label(day: Column, source_type: Column, title: Column, first: Column, last: Column) -> Column:
    date = F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit("Undated"))
    pages = F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))
    return F.concat(date, F.lit(" "), F.coalesce(blank_to_null(title), type_label(source_type)), F.lit(" - "), pages)


def content_hash(text: Column) -> Column:
    return F.sha2(clean_text(text), 256)


def quality_of(chars: Column) -> Column:
    """good from 500 characters, medium from 100, else poor."""
    return F.when(chars >= 500, "good").when(chars >= 100, "medium").otherwise("poor")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    shrunk = F.length(F.replace(text, F.lit(term), F.lit("")))
    return ((F.length(text) - shrunk) / len(term)).cast("bigint")
