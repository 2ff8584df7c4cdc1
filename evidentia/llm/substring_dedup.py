"""Substring dedup with difference-cover anchors.

A word is removed if a window of ``width`` consecutive words that covers it also starts in a
document with a smaller id. Two equal windows at positions i and j share an aligned anchor: for a
difference cover D modulo v some shift s < v brings both i + s and j + s into D, so it is enough to
hash the anchors of width - v + 1 words that start at cover positions.

1. Documents are gathered into blocks. Each block's anchors are sent, one entry for each distinct
   hash, to buckets by hash; a bucket answers each block with the anchors that other blocks hold.
2. Anchors shared between documents extend to the windows around them. A block sends the full hash
   of each such window (64 bits and the bucket's own bits) with its smallest document id, and
   resolves repeats inside the block itself; a bucket answers where another block has a smaller id.
3. Each block drops the covered words.

What is shuffled is packed arrays, at most one entry for each block and distinct hash: a passage
held by a third of all documents sends as many entries as there are blocks. No pairs are made. Rows
sent are at most the entries, and the product of blocks and buckets; a bucket's entries are settled
by one sort.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Edge cases: a null text has no words;
documents of fewer than ``width`` words lose nothing; a document is never divided, so one text longer
than a block makes a block of its own, which its task must hold; rows of equal id never remove each other's
words; a null id counts as larger than all others; an empty table gives an empty one; only the named
columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow
from evidentia.llm.packed import pack, steps, unpack, unsteps
from evidentia.llm.tables import discard, stored, stored_apart

#: Difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BLOCK_BYTES = 12 << 20
#: Text for which a bucket stands; in a corpus of more than 4,096 such buckets it grows, to 16 times as much at most.
BUCKET_BYTES = 4 << 20
#: Answered entries that a task gathers before it sends them, one row for each block.
GATHERED = 1_000_000
LAST = np.iinfo(np.int64).max


class WordHashes(dict):
    """64-bit hash by word; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 250_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(base) + hashes[j : j + n]
    return mixed(out)


def cover_of(width: int) -> tuple[int, tuple[int, ...]]:
    period = max(v for v in COVERS if v <= (width + 1) // 2)
    return period, COVERS[period]


class Block:
    """Word hashes of consecutive documents, with document numbers and positions."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], known: WordHashes):
        hashes = [known.of(t.split()) for t in texts]
        self.ids, self.sizes = ids, np.array([len(h) for h in hashes], np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(hashes)), self.sizes)
        self.start = np.cumsum(self.sizes) - self.sizes

    def inside(self, size: int) -> np.ndarray:
        """Places where a run of ``size`` words stays in its document."""
        left = np.repeat(self.start + self.sizes, self.sizes) - np.arange(len(self.hashes))
        return left >= size

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        period, cover = cover_of(width)
        size = width - period + 1
        aligned = np.isin((np.arange(len(self.hashes)) - np.repeat(self.start, self.sizes)) % period, cover)
        places = np.flatnonzero(aligned & self.inside(size))
        return rolled(self.hashes, size, 0x9E3779B97F4A7C15)[places], places

    def grouped(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by (key, id), number of each one's group, and the groups' first in that order."""
        order = np.lexsort((self.ids[self.doc[places]], keys))
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        return order, np.cumsum(new) - 1, np.flatnonzero(new)

    def shared_here(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, group, first, whether a group's key is held by more than one document here)."""
        order, group, first = self.grouped(keys, places)
        docs = self.doc[places[order]]
        several = np.zeros(len(first), bool)
        np.logical_or.at(several, group, docs != docs[first][group])
        return order, group, first, several


def _decoded(ids: bytes, sizes: bytes, texts: bytes, length: int) -> tuple[np.ndarray, list[bytes]]:
    raw = pa.Codec("zstd").decompress(texts, length, asbytes=True) if length else b""
    cuts = np.concatenate([[0], np.cumsum(unpack(sizes, np.int64))]).tolist()
    return unpack(ids, np.int64), [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


BLOCKS = "block bigint, bucket int, ids binary, rows binary, sizes binary, texts binary, length bigint, keys binary, places binary, extra binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "sizes", "texts")), ("length", pa.int64()), *((c, pa.binary()) for c in ("keys", "places", "extra"))])
FOUND_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "places", "extra"))])
FOUND = "block bigint, bucket int, keys binary, places binary, extra binary"


def _by_bucket(block: int, buckets: np.ndarray, keys: np.ndarray, places: np.ndarray, extra: np.ndarray) -> Iterator[dict]:
    """One row for each bucket that gets any; places rise within it."""
    if not len(keys):
        return
    order = np.lexsort((places, buckets))
    cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        yield {"block": block, "bucket": int(buckets[own[0]]), "keys": pack(keys[own]), "places": steps(places[own]), "extra": pack(extra[own])}


def _anchor_rows(width: int, n_buckets: int, block_bytes: int):
    """From (id, text) to blocks: one row with the documents, and rows of anchor entries by bucket."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for ids, texts in gathered(batches):
            number = uuid.uuid4().int >> 65
            order = np.array([LAST if i is None else i for i in ids], np.int64)
            raw = b"".join(texts)
            head = {"block": number, "bucket": -1, "ids": pack(order), "rows": pack(np.array([i is None for i in ids], np.uint8)), "sizes": pack(np.array([len(t) for t in texts], np.int64)), "texts": pa.Codec("zstd", 3).compress(raw, asbytes=True) if raw else b"", "length": len(raw)}
            yield _batch([head], BLOCK_SCHEMA)
            block = Block(order, texts, known)
            keys, places = block.anchors(width)
            by, _, first, several = block.shared_here(keys, places)
            own = by[first]
            parts = (keys[own] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
            made = list(_by_bucket(number, parts.astype(np.int64), keys[own].astype(np.uint32), places[own], several.astype(np.uint8)))
            for a in range(0, len(made), 500):
                yield _batch(made[a : a + 500], BLOCK_SCHEMA)

    return rows


def _answers(decide):
    """From rows of entries, sorted by bucket, to (block, places): ``decide`` picks a bucket's entries. The
    picked entries of many buckets are gathered, so that a block gets few rows from a task."""
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary())])

    def settle(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        keys, places, extra = zip(*(decide.read(*r[1:]) for r in rows), strict=True)
        chosen = np.flatnonzero(decide.choose(np.concatenate(keys), np.concatenate(extra)))
        owner = np.repeat(np.array([r[0] for r in rows], np.int64), [len(k) for k in keys])
        return owner[chosen], np.concatenate(places)[chosen]

    def by_block(gathered: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        owner, place = (np.concatenate(x) for x in zip(*gathered, strict=True))
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        out = [{"block": int(o[0]), "places": steps(p)} for o, p in zip(np.split(owner, cuts), np.split(place, cuts), strict=True) if len(o)]
        for a in range(0, len(out), 500):
            yield _batch(out[a : a + 500], schema)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in (1, 0, 2, 3, 4)), strict=True):
                if bucket != now and held:
                    gathered.append(settle(held))
                    held = []
                    if sum(len(o) for o, _ in gathered) > GATHERED:
                        yield from by_block(gathered)
                        gathered = []
                now = bucket
                held.append(tuple(row))
        if held:
            gathered.append(settle(held))
        if gathered:
            yield from by_block(gathered)

    return answered


class _Shared:
    """Anchors that another block holds too, or that are shared inside another block."""

    @staticmethod
    def read(keys: bytes, places: bytes, extra: bytes):
        return unpack(keys, np.uint32), unsteps(places), unpack(extra, np.uint8)

    @staticmethod
    def choose(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
        _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
        return (count[group] > 1) & (several == 0)


class _Larger:
    """Windows of which another block has a smaller document id."""

    @staticmethod
    def read(keys: bytes, places: bytes, extra: bytes):
        return unpack(keys, np.uint64), unsteps(places), unpack(extra, np.int64)

    @staticmethod
    def choose(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        _, group = np.unique(keys, return_inverse=True)
        least = np.full(group.max() + 1, LAST)
        np.minimum.at(least, group, ids)
        return ids > least[group]


def _window_rows(width: int, n_buckets: int):
    """From blocks with answers to the words removed inside the block, and window entries by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        period, _ = cover_of(width)
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _decoded(row["ids"], row["sizes"], row["texts"], row["length"])
                block = Block(ids, texts, known)
                keys, places = block.anchors(width)
                by, group, first, several = block.shared_here(keys, places)
                answered = np.zeros(len(block.hashes), bool)
                for part in row["answers"] or []:
                    answered[unsteps(part)] = True
                several |= answered[places[by[first]]]
                near = np.zeros(len(block.hashes) + period + 1, np.int64)
                near[places[by][several[group]] + 1] = 1
                near = np.cumsum(near)
                start = np.arange(len(block.hashes))
                wide = np.flatnonzero(block.inside(width) & (near[start + period] > near[start]))
                full = rolled(block.hashes, width, 0x9E3779B97F4A7C15)[wide]
                order, group, first = block.grouped(full, wide)
                own = ids[block.doc[wide[order]]]
                smallest = own == own[first][group]
                removed = np.zeros(len(block.hashes), np.uint8)
                removed[wide[order][~smallest]] = 1
                yield _batch([{"block": row["block"], "bucket": -1, "keys": None, "places": pa.Codec("zstd", 1).compress(np.packbits(removed).tobytes(), asbytes=True), "extra": len(removed).to_bytes(8, "little")}], FOUND_SCHEMA)
                kept = order[smallest]
                other = rolled(block.hashes, width, 0xC2B2AE3D27D4EB4F)[wide[kept]] >> np.uint64(32)
                made = list(_by_bucket(row["block"], (other * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64), full[kept], wide[kept], own[smallest]))
                for a in range(0, len(made), 500):
                    yield _batch(made[a : a + 500], FOUND_SCHEMA)

    return rows


def _kept_rows(width: int, id_col: str, id_type: str):
    """From blocks with removed windows to documents without the covered words."""
    schema = pa.schema([(id_col, {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(id_type, pa.int64())), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _decoded(row["ids"], row["sizes"], row["texts"], row["length"])
                null = unpack(row["rows"], np.uint8)
                total = int.from_bytes(row["extra"], "little")
                bits = pa.Codec("zstd").decompress(row["removed"], (total + 7) // 8, asbytes=True) if total else b""
                starts = np.unpackbits(np.frombuffer(bits, np.uint8), count=total)
                for part in row["answers"] or []:
                    starts[unsteps(part)] = 1
                depth = np.zeros(total + width + 1, np.int32)
                depth[:total] += starts
                depth[width : total + width] -= starts
                gone = np.cumsum(depth)[:total] > 0
                out, at = [], 0
                for i, text in enumerate(texts):
                    words = text.split()
                    own = gone[at : at + len(words)]
                    at += len(words)
                    n = int(own.sum())
                    if n:
                        words = [words[k] for k in np.flatnonzero(~own).tolist()]
                    out.append({id_col: None if null[i] else int(ids[i]), "n_words": len(own), "n_removed": n, "text": b" ".join(words).decode()})
                    if len(out) >= 500:
                        yield _batch(out, schema)
                        out = []
                if out:
                    yield _batch(out, schema)

    return rows


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Per row: ``id_col`` (an integer column), n_words, n_removed and the kept words as ``text``."""
    id_type = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("raw"))
    total = own.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n_buckets = 16 + total // min(max(bucket_bytes, total // 4096), 16 * bucket_bytes)
    anchors, blocks = stored_apart(in_arrow(own, _anchor_rows(width, n_buckets, block_bytes), BLOCKS), F.col("bucket") == -1)
    documents = blocks.select("block", "ids", "rows", "sizes", "texts", "length")

    def answers(entries: DataFrame, decide) -> DataFrame:
        dealt = entries.where("bucket >= 0").select("block", "bucket", "keys", "places", "extra").repartition("bucket").sortWithinPartitions("bucket")
        return in_arrow(dealt, _answers(decide), "block bigint, places binary").groupBy("block").agg(F.collect_list("places").alias("answers"))

    found = stored(in_arrow(documents.join(answers(anchors, _Shared), "block", "left"), _window_rows(width, n_buckets), FOUND))
    discard(anchors)
    removed = found.where("bucket = -1").select("block", F.col("places").alias("removed"), "extra")
    last = stored(answers(found, _Larger).join(removed, "block", "right"))
    discard(found)
    return in_arrow(documents.join(last, "block"), _kept_rows(width, id_col, id_type), f"`{id_col}` {id_type}, n_words bigint, n_removed bigint, text string")
