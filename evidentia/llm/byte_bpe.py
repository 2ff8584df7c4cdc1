"""Byte-level BPE encoding and decoding by folding ranked merges.

A text is cut by the vocabulary's pattern into words. Each distinct word of a batch is folded once:
starting from its single bytes, the adjacent pair whose concatenation has the lowest rank is merged
until no pair has a rank; results are kept per worker in a table of bounded size. A document's ids
are the ids of its words in order, and decoding concatenates the binary pieces of the ids.

``encode_words`` is the same fold as a Spark higher-order function over byte arrays with a literal
rank map, for columns of distinct words; README gives the figures why whole corpora take the Arrow
form.

Edge cases: null is the empty text (no ids); repeated rows are encoded row by row; words of any
length take n log n steps; an empty table gives an empty one; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow, slices, texts_of

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHORT = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece, from a file of lines with a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the word's own rank if it has one, else its ranked merges."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks)
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of (rank, place) and linked neighbours."""
    n = len(word)
    stop = list(range(1, n + 1))  # end of the part that starts at i, or 0 if it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = stop[i]
        if not mid or mid >= n or stop[mid] != end:
            continue
        stop[i], stop[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : stop[end]])) is not None:
                heapq.heappush(heap, (r, i, stop[end]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return ids


class _Words(dict):
    """(ids, decoded bytes) by word, folded when first met; emptied when it holds ``most`` words."""

    def __init__(self, path: str, most: int = 200_000):
        self.ranks, self.most = load_ranks(path), most
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}

    def __missing__(self, word: str) -> tuple[str, int, bytes]:
        if len(self) >= self.most:
            self.clear()
        ids = fold(word.encode(), self.ranks)
        self[word] = found = (" ".join(map(str, ids)), len(ids), decode(ids, self.pieces))
        return found


def decode(ids: list[int], pieces: dict[int, bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids])


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


@lru_cache(maxsize=2)
def _cutter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def encode_text(text: str, path: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    known = _words(path)
    return [int(i) for w in _cutter(pattern)(text) for i in known[w][0].split(" ")]


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, ranks: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Per row: ``id_col``, the columns of ``carry``, token_ids array<int> and decoded binary (made from the ids)."""
    columns = [id_col, *(carry or [])]
    k = len(columns)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = _words(ranks), _cutter(pattern)
        for batch in slices(batches, k, 2 << 20):
            ids, texts = [], []
            for text in texts_of(batch.column(k)):
                found = [known[w] for w in cut(text)]
                ids.append([int(i) for x in found for i in x[0].split(" ")])
                texts.append(b"".join([x[2] for x in found]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.binary())], names=[*columns, "token_ids", "decoded"])

    kept = df.select(*columns, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return in_arrow(kept, encoded, f"{schema}, token_ids array<int>, decoded binary")


def encoding_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Per row: ``id_col``, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = _words(ranks), _cutter(pattern)
        for batch in slices(batches, 1, 2 << 20):
            counts, ids, texts = [], [], []
            for text in texts_of(batch.column(1)):
                found = [known[w] for w in cut(text)]
                counts.append(sum([x[1] for x in found]))
                ids.append(hashlib.sha256(" ".join([x[0] for x in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=names)

    kept = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return in_arrow(kept, digested, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_words(df: DataFrame, word_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """Adds token_ids to a column of (distinct) words by Spark's higher-order functions alone.

    The rank map is a literal: an array of buckets by crc32 of the piece, each a list of
    (hex piece, rank). The fold merges the lowest ranked pair once in each of length - 1 steps.
    For vocabularies of a fixed size only, as the literal is part of the plan.
    """
    import json
    import zlib

    size = max(16, len(ranks) // 2)
    buckets: list[list] = [[] for _ in range(size)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % size].append({"p": piece.hex().upper(), "r": rank})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<p:string,r:int>>>")

    def rank(piece):
        return F.get(F.transform(F.filter(F.get(table, F.pmod(F.crc32(F.unhex(piece)), F.lit(size)).cast("int")), lambda x: x["p"] == piece), lambda x: x["r"]), F.lit(0))

    code = F.hex(F.encode(F.col(word_col), "UTF-8"))
    singles = F.transform(F.sequence(F.lit(0), F.greatest((F.length(code) / 2).cast("int") - 1, F.lit(0))), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))

    def merge(parts, _):
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.struct(F.coalesce(rank(F.concat(F.get(parts, i), F.coalesce(F.get(parts, i + 1), F.lit("")))), F.lit(2**31 - 1)).alias("r"), i.alias("i")))
        low = F.array_min(pairs)
        joined = F.concat(F.slice(parts, F.lit(1), low["i"]), F.array(F.concat(F.get(parts, low["i"]), F.get(parts, low["i"] + 1))), F.slice(parts, low["i"] + 3, F.size(parts)))
        return F.when((F.size(parts) > 1) & (low["r"] < 2**31 - 1), joined).otherwise(parts)

    parts = F.when(rank(code).isNotNull(), F.array(code)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest((F.length(code) / 2).cast("int"), F.lit(2))), singles, merge))
    return df.withColumn("token_ids", F.when(F.length(code) == 0, F.array().cast("array<int>")).otherwise(F.transform(parts, rank)))
