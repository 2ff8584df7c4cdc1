"""Media columns: signature sniffing over binary payloads.

An Aho-Corasick automaton locates the magic bytes of known formats, and the marks that end some of
them, in one pass; a validator of each format then confirms structure and lengths at every hit. The
ends are looked up among the marks found, so no hit searches the bytes again. The valid item at offset 0 gives the true
type (a wrong declared type is corrected), and valid items elsewhere that are not inside an
accepted one are carved as embedded media. Text is stored losslessly as the samples of a mono 8-bit
WAV file by ``store_text``.

Edge cases: null is the empty text, whose payload is 64 zero bytes; bytes that no validator accepts
have type ``application/octet-stream``; repeated rows give equal results; an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow, slices

RATE = 8000
#: Magic bytes, with the offset inside the file where they stand.
MAGIC = {
    "audio/wav": (b"RIFF", 0),
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/gif": (b"GIF8", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/bmp": (b"BM", 0),
    "application/pdf": (b"%PDF-", 0),
    "audio/flac": (b"fLaC", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "application/zip": (b"PK\x03\x04", 0),
}


#: Marks inside or at the end of a file.
MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06", b"\xff\xd9")
Places = dict[bytes, list[int]]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magic, at) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) + at))
    for mark in MARKS:
        found.add_word(mark.decode("latin-1"), (mark, len(mark)))
    found.make_automaton()
    return found


def _next(places: Places, mark: bytes, at: int) -> int:
    """Where the mark stands first from ``at`` on, or -1."""
    own = places[mark]
    i = bisect_left(own, at)
    return own[i] if i < len(own) else -1


def _wav(data: bytes, at: int, places: Places) -> int:
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 44:
        return 0
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    end, pos, seen = at + size, at + 12, set()
    if end > len(data):
        return 0
    while pos + 8 <= end:
        seen.add(data[pos : pos + 4])
        length = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + length + (length & 1)
    return size if pos == end and {b"fmt ", b"data"} <= seen else 0


def _png(data: bytes, at: int, places: Places) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, pos)
        stop = pos + 12 + length
        if stop > len(data) or (first and kind != b"IHDR"):
            return 0
        if zlib.crc32(data[pos + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return 0
        if kind == b"IEND":
            return stop - at
        pos, first = stop, False
    return 0


def _gif(data: bytes, at: int, places: Places) -> int:
    if data[at : at + 6] not in (b"GIF87a", b"GIF89a") or len(data) < at + 14:
        return 0
    flags = data[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(data):
        tag = data[pos]
        if tag == 0x3B:
            return pos + 1 - at
        if tag == 0x21:
            pos += 2
        elif tag == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return 0
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return 0


def _jpeg(data: bytes, at: int, places: Places) -> int:
    pos = at + 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xD9:
            return pos + 2 - at
        length = struct.unpack_from(">H", data, pos + 2)[0]
        if length < 2:
            return 0
        pos += 2 + length
        if marker == 0xDA:
            stop = _next(places, b"\xff\xd9", pos)
            return stop + 2 - at if stop >= 0 else 0
    return 0


def _bmp(data: bytes, at: int, places: Places) -> int:
    if len(data) < at + 26:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    right = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start < size <= len(data) - at
    return size if right else 0


def _pdf(data: bytes, at: int, places: Places) -> int:
    stop = _next(places, b"%%EOF", at)
    start = _next(places, b"startxref", at)
    return stop + 5 - at if 0 <= start <= stop - 9 and data[at + 5 : at + 6].isdigit() else 0


def _flac(data: bytes, at: int, places: Places) -> int:
    right = len(data) >= at + 42 and data[at + 4] & 0x7F == 0 and int.from_bytes(data[at + 5 : at + 8], "big") == 34
    return len(data) - at if right else 0


def _gzip(data: bytes, at: int, places: Places) -> int:
    unpack = zlib.decompressobj(31)
    rest = memoryview(data)[at:]
    try:
        while rest and not unpack.eof:  # a bounded piece of output at a time
            unpack.decompress(rest, 1 << 16)
            rest = unpack.unconsumed_tail
    except zlib.error:
        return 0
    return len(data) - at - len(unpack.unused_data) if unpack.eof else 0


def _zip(data: bytes, at: int, places: Places) -> int:
    stop = _next(places, b"PK\x05\x06", at)
    if stop < 0 or stop + 22 > len(data):
        return 0
    size, offset = struct.unpack_from("<II", data, stop + 12)
    comment = struct.unpack_from("<H", data, stop + 20)[0]
    return stop + 22 + comment - at if at + offset + size == stop and stop + 22 + comment <= len(data) else 0


VALID = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp,
    "application/pdf": _pdf, "audio/flac": _flac, "application/gzip": _gzip, "application/zip": _zip,
}


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of each valid item by start; only the item at offset 0 may hold others."""
    hits: list[tuple[str, int]] = []
    places: Places = {mark: [] for mark in MARKS}
    for last, (what, back) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - back
        if what in places:
            places[what].append(at)
        else:
            hits.append((what, at))
    found, upto = [], 0
    for kind, at in hits:
        if at >= upto and (size := VALID[kind](data, at, places)):
            found.append((kind, at, size))
            upto = at + size if at else 0  # what stands at the start carries the others
    return found


def as_wav(payload: bytes) -> bytes:
    """A mono file of 8-bit samples, which are the payload's bytes (of even number)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(stored: bytes) -> bytes:
    """The bytes of the data chunk of a valid WAV file."""
    pos = 12
    while stored[pos : pos + 4] != b"data":
        length = struct.unpack_from("<I", stored, pos + 4)[0]
        pos += 8 + length + (length & 1)
    return stored[pos + 8 : pos + 8 + struct.unpack_from("<I", stored, pos + 4)[0]]


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


STORED = "n_bytes bigint, media binary"


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """Per row: ``id_col``, n_bytes and the text's padded UTF-8 as a WAV file in ``media``."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([as_wav(padded(x, unit)) for x in raw], pa.binary())],
                names=[id_col, "n_bytes", "media"],
            )

    kept = df.select(id_col, F.encode(F.col(text_col).cast("string"), "UTF-8").alias("__raw"))
    return in_arrow(kept, stored, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {STORED}")


def describe_media(df: DataFrame, keep: list[str], media_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """``keep`` columns and what sniffing finds in a binary column.

    media_type: the confirmed type at offset 0, which overrides ``declared_col``; retyped: whether
    it differs from the declared type; embedded: carved items as type:start:length; payload
    columns (payload_bytes, payload_sha256, tail_crc32) are read back from WAV samples, and are
    those of the stored bytes for any other type; feature: type, samples' mean, and energy.
    """
    names = ["media_bytes", "media_sha256", "media_type", "retyped", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def row(data: bytes, declared: str | None) -> tuple:
        items = sniff(data)
        kind = items[0][0] if items and items[0][1] == 0 else "application/octet-stream"
        carved = [f"{k}:{at}:{n}" for k, at, n in items if at > 0]
        payload = samples(data) if kind == "audio/wav" else data
        counts = _levels(payload)
        mean = sum(i * n for i, n in enumerate(counts)) / max(1, len(payload))
        power = sum((i - 128) ** 2 * n for i, n in enumerate(counts)) / max(1, len(payload))
        feature = f"{kind};n={len(payload)};mean={mean:.4f};power={power:.4f};embedded={len(carved)}"
        return (len(data), hashlib.sha256(data).hexdigest(), kind, declared is not None and declared != kind, carved, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in slices(batches, n, 4 << 20):
            media, declared = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            made = list(zip(*(row(m or b"", d) for m, d in zip(media, declared, strict=True)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=[*keep, *names])

    chosen = df.select(*keep, F.col(media_col).alias("__media"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("__declared"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    made = "media_bytes bigint, media_sha256 string, media_type string, retyped boolean, embedded array<string>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
    return in_arrow(chosen, described, f"{schema}, {made}")


def _levels(payload: bytes) -> list[int]:
    import numpy as np

    return np.bincount(np.frombuffer(payload, np.uint8), minlength=256).tolist()
