"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``://`` schemes, plus-signs, digits and
cue words of identifiers. A deterministic local parser then expands each anchor to a candidate and
validates its boundaries: e-mail, dotted network address, card number (Luhn), phone number, and
beyond these base kinds ``login`` (user:password@host of a URL) and ``account`` (an IBAN whose
check digits hold, or a number of 6 to 18 digits after a cue word). Work per text is linear in its
length.

Spans are code points with exclusive ends, leftmost and non-overlapping within a kind. Spans of
different kinds may overlap; ``redact`` merges what overlaps into one mask of the first kind.

Edge cases: null is the empty text (no spans; ``redact`` keeps null); repeated rows are treated row
by row; an empty table gives an empty one; other columns are carried by ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow, slices, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
#: Cue words of account numbers.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[A-Za-z0-9._~%+-]+:[^\s/@:]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|#|:|=|is))*\s*([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9A-Za-z])", re.IGNORECASE | re.ASCII)
IBAN = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|#|:|=|is))*\s*([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{2,4}){3,8})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in ("@", "://", "+", *"0123456789"):
        found.add_word(sign, "0" if sign.isdigit() else sign)
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for at in anchors:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and at >= end and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end


def _addresses(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    skip = 0
    for at in anchors:
        if at < skip:
            continue
        if m := ADDRESS.match(text, at):
            skip = m.end()
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                yield m.span()
        else:
            skip = DIGITS.match(text, at).end()  # no later digit of this run can do better


def _cards(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    skip = 0
    for at in anchors:
        if at >= skip and (m := CARD.match(text, at)):
            skip = m.end()
            if skip - at <= 2 * 19:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    yield m.span()


def _phones(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    skip = 0
    for at in anchors:
        if at >= skip and (m := PHONE.match(text, at)):
            skip = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield m.span()


def _logins(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    for at in anchors:
        if m := LOGIN.match(text, at + 3):
            yield m.span()


def _iban(value: str) -> bool:
    plain = value.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _accounts(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for at in anchors:
        if at < end:
            continue
        found = m.span(1) if (m := IBAN.match(text, at)) and _iban(m[1]) else None
        found = found or ((m := NUMBER.match(text, at)) and m.span(1))
        if found and found[0] >= end:
            end = found[1]
            yield found


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind of KINDS, by start."""
    anchors: dict[str, list[int]] = {"@": [], "://": [], "+": [], "0": [], "cue": []}
    for last, what in _automaton().iter(text):
        anchors[what].append(last - 2 if what == "://" else last + 1 if what == "cue" else last)
    return {
        "email": list(_emails(text, anchors["@"])),
        "ip": list(_addresses(text, anchors["0"])),
        "card": list(_cards(text, anchors["0"])),
        "phone": list(_phones(text, anchors["+"])),
        "login": list(_logins(text, anchors["://"])),
        "account": list(_accounts(text, anchors["cue"])),
    }


def masked(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each run of overlapping spans replaced by <KIND> of the first."""
    parts, upto = [], 0
    for start, stop, kind in sorted((a, -b, k) for k, v in found.items() for a, b in v):
        if start >= upto:
            parts += [text[upto:start], f"<{kind.upper()}>"]
        upto = max(upto, -stop)
    return "".join(parts) + text[upto:]


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans as text, and how many these are."""
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            spans = [find_spans(t) for t in texts_of(batch.column(1))]
            digests = [hashlib.sha256(_joined(x, BASE).encode()).hexdigest() for x in spans]
            counts = [pa.array([len(x[k]) for x in spans], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_joined(x, KINDS) for x in spans], pa.string()), pa.array([sum(map(len, x.values())) for x in spans], pa.int64())], names=names)

    kept = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
    return in_arrow(kept, found, schema)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in ``text_col`` masked; null stays null."""
    names, at = df.columns, df.columns.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 4 << 20):
            texts = [t if t is None else masked(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=names)

    return in_arrow(df, cleaned, df.schema)
