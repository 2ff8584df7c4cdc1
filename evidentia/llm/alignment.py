"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte.

1. The texts of an Arrow batch are encoded by both tokenizers and laid end to end, each at its byte
   offset. One ``bincount`` each gives the ends of A's and of B's tokens; a text is cut where both end.
   Prefix sums over the bytes, taken at the documents' ends, give tokens and groups of each document;
   between neighbouring ends lies exactly one pair of overlapping tokens, a link.
2. Documents are gathered into blocks. A block's row keeps each document's links as packed numbers of
   the block's distinct id pairs, and sends every distinct pair once, with its number of links.
3. Pairs are counted over all blocks, the highest count of each B id is found, and each block gets
   back the counts of its own pairs, from which its documents' sums are made.

What is shuffled is a row for each block and distinct pair in it (a pair that a third of all links
are has as many rows as there are blocks), and the blocks' packed links once.

A is a byte-level BPE of ``tokenizers``, B a SentencePiece model, which puts a space before a text as
is done here for A. Long texts are cut at single spaces between characters that are neither white
space nor B's word mark; no token of either crosses them. Texts of Latin-1 characters are encoded by
the same merges in ``tiktoken``, if the file's ids follow its merges; all others by ``tokenizers``.

Edge cases: null, empty, and a text whose tokens' joined bytes are not a space and the text (as where
it holds B's word mark) have no tokens: zeros, and an empty digest. Repeated rows and ids count row by
row. A text longer than a block makes a block of its own, which its task must hold. An empty table
gives an empty one; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import by_bytes, in_arrow, slices, texts_of
from evidentia.llm.packed import pack, unpack
from evidentia.llm.tables import stored
from evidentia.llm.token_counts import MARK, split_safely

MODEL_A, MODEL_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: UTF-8 bytes of text in a block, in a call of a tokenizer, and in a part of a long text.
BLOCK_BYTES, BATCH_BYTES, PART = 12 << 20, 1 << 20, 1 << 15


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest counted up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """Bytes, their number, and decimal ids followed by either separator, by token id."""

    def __init__(self, pieces: dict[int, bytes], last: str):
        size = max(pieces) + 1
        self.pieces = [pieces.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.inner = np.array([f"{i}," for i in range(size)], object)
        self.closing = np.array([f"{i}{last}" for i in range(size)], object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


def _by_ranks(path: str):
    """A tiktoken encoding of a byte-level file, if its ids follow its merges and it cuts words by the public pattern; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    model, letters = own["model"], byte_letters()
    ids, first = model["vocab"], own.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    follows = all(ids.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and all(ids.get(c, 256) < 256 for c in letters)
    plain = own.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not model.get("ignore_merges")
    if not (follows and plain):
        return None
    ranks = {bytes(letters[c] for c in piece): i for piece, i in ids.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str):
    """(A, B, function of texts to A's ids, function of texts to B's ids, whether texts may be cut)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    letters = byte_letters()
    special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
    side_a = _Side({i: t.encode() if i in special else bytes(letters[c] for c in t) for t, i in a.get_vocab().items()}, "|")
    ranked = _by_ranks(path_a)

    def encode_a(texts: list[str]) -> list[list[int]]:
        out = [ranked.encode_ordinary(t) if ranked and _latin(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, a.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    size = b.get_piece_size()
    names = [b.id_to_piece(i) for i in range(size)]
    side_b = _Side({i: bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)}, ";")
    safe = ranked is not None and b.normalize("a  b éÅﬁ") == "▁a▁▁b▁éÅﬁ" and not any(re.search(f"[^{MARK}]{MARK}", t) for t in names)
    return side_a, side_b, encode_a, lambda texts: b.encode(texts, num_threads=1), safe


class Aligned:
    """A batch of texts, laid end to end: counts and digests by document, and the links' id pairs with their documents."""

    def __init__(self, texts: list[str], path_a: str, path_b: str):
        side_a, side_b, encode_a, encode_b, safe = _sides(path_a, path_b)
        parts = [split_safely(t, PART) if safe else [t] for t in texts]
        sizes = [len(p) if t else 0 for p, t in zip(parts, texts, strict=True)]
        flat = [p for own, n in zip(parts, sizes, strict=True) for p in own[:n]]
        tokens = zip(encode_a([" " + p for p in flat]), encode_b(flat), flat, strict=True)
        ids_a, ids_b, used = [], [], []
        for n in sizes:
            own = [next(tokens) for _ in range(n)]
            same = all(side_a.joined(a) == side_b.joined(b) == b" " + p.encode() for a, b, p in own)
            ids_a += [a for a, _, _ in own] if same else []
            ids_b += [b for _, b, _ in own] if same else []
            used.append(sum(len(p.encode()) + 1 for _, _, p in own) if same else 0)
        a = np.fromiter(chain.from_iterable(ids_a), np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        total = sum(used)
        stop = np.cumsum(used, dtype=np.int64)
        start = stop - used
        ends_a, ends_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
        at_a, at_b = np.bincount(ends_a, minlength=total + 1).astype(bool), np.bincount(ends_b, minlength=total + 1).astype(bool)
        cut = at_a & at_b
        upto_a, upto_b, groups = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(cut)
        self.n_a, self.n_b, self.n_groups = (x[stop] - x[start] for x in (upto_a, upto_b, groups))
        ends = np.flatnonzero(at_a | at_b)
        self.pairs = a[upto_a[ends] - at_a[ends]] * len(side_b.pieces) + b[upto_b[ends] - at_b[ends]]
        self.owner = np.searchsorted(stop, ends)
        self.n_links = np.bincount(self.owner, minlength=len(texts))
        self.texts = self._groups(side_a, side_b, a, b, ends_a, ends_b, cut, upto_a, upto_b, groups, self.n_a + self.n_b)

    @staticmethod
    def _groups(side_a, side_b, a, b, ends_a, ends_b, cut, upto_a, upto_b, groups, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: a group's A ids, then its B ids."""
        cuts = np.flatnonzero(cut)
        before_b = np.concatenate([[0], upto_b[cuts]])
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = cut[ends_a], cut[ends_b]
        out[np.arange(len(a)) + before_b[groups[ends_a] - last_a]] = np.where(last_a, side_a.closing[a], side_a.inner[a])
        out[np.arange(len(b)) + upto_a[cuts][groups[ends_b] - last_b]] = np.where(last_b, side_b.closing[b], side_b.inner[b])
        out, stop = out.tolist(), np.cumsum(sizes).tolist()
        return ["".join(out[i - n : i])[:-1] for i, n in zip(stop, sizes.tolist(), strict=True)]


class _Block:
    """Documents and links gathered for a row of the table of blocks."""

    def __init__(self):
        self.ids, self.facts, self.texts, self.pairs, self.owner, self.docs, self.bytes = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, found: Aligned, texts: list[str], size: int) -> None:
        self.ids.append(ids)
        self.facts.append(np.stack([found.n_a, found.n_b, found.n_groups, found.n_links]))
        self.texts += texts
        self.pairs.append(found.pairs.astype(np.uint32 if found.pairs.max(initial=0) < 1 << 32 else np.int64))
        self.owner.append(found.owner + self.docs)
        self.docs += len(ids)
        self.bytes += size

    def row(self, number: int, names: list[str]) -> pa.RecordBatch:
        codes, pairs = pd.factorize(np.concatenate(self.pairs))
        counts = np.bincount(codes, minlength=len(pairs))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = np.concatenate(self.owner).astype(np.int64) << 32 | place[codes]
        keys.sort()
        links = keys & 0xFFFFFFFF
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] >> 32) != (keys[:-1] >> 32)
        rises = np.where(first, links, np.diff(links, prepend=0)).astype(np.uint32)
        facts = np.concatenate(self.facts, axis=1)
        ids = pa.concat_arrays(self.ids)
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        binary = lambda values: pa.array([pack(values) if len(values) else b""], pa.binary())
        columns = [pa.array([number], pa.int64()), whole(ids), whole(pa.array(self.texts, pa.string()))]
        columns += [binary(x) for x in (*facts.astype(np.int64), rises, pairs[order].astype(np.int64), counts[order].astype(np.uint32))]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return unpack(data, kind) if data else np.zeros(0, kind)


NAMES = ["block", "ids", "groups", "n_a", "n_b", "n_groups", "n_links", "rises", "pairs", "counts"]


def blocks_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B, digests: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The table of blocks, written to the shared folder: a row has its documents' ids, counts and groups (their
    SHA-256 with ``digests``), its distinct pairs with their links, and the documents' links as rises of pair numbers."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in slices(batches, 1, BATCH_BYTES):
            texts = texts_of(batch.column(1))
            found = Aligned(texts, model_a, model_b)
            size = sum(map(len, texts))
            if block.docs and block.bytes + size > block_bytes:
                yield block.row(task << 32 | number, NAMES)
                number, block = number + 1, _Block()
            out = found.texts if not digests else [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.texts]
            block.add(batch.column(0), found, out, size)
        if block.docs:
            yield block.row(task << 32 | number, NAMES)

    kept = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()
    return stored(in_arrow(kept, gathered, f"block bigint, ids array<{kind}>, groups array<string>, n_a binary, n_b binary, n_groups binary, n_links binary, rises binary, pairs binary, counts binary"))


def pairs_of(blocks: DataFrame) -> DataFrame:
    """(pair, block, links): the distinct pairs of each block."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, counts = _numbers(pairs, np.int64), _numbers(counts, np.uint32).astype(np.int64)
                for a, b in by_bytes([1] * len(pairs), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[a:b]), pa.array(np.full(b - a, number)), pa.array(counts[a:b])], names=["pair", "block", "links"])

    return in_arrow(blocks.select("block", "pairs", "counts"), unpacked, "pair bigint, block bigint, links bigint")


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, links, best): links of each pair over all blocks, and whether no pair of its B id has more."""
    counted = pairs.groupBy("pair").agg(F.sum("links").alias("links")).withColumn("b", F.col("pair") % size_b)
    most = counted.groupBy("b").agg(F.max("links").alias("__most"))
    return counted.join(most, "b").select("pair", "links", (F.col("links") == F.col("__most")).alias("best"))


def alignments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B, digests: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256 (without ``digests``: groups)."""
    blocks = blocks_of(df, id_col, text_col, model_a, model_b, digests, block_bytes)
    pairs = pairs_of(blocks)
    size_b = len(_sides(model_a, model_b)[1].pieces)
    answers = pairs.select("pair", "block").join(pair_counts(pairs, size_b), "pair").select("block", "pair", "links", "best")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digests else "groups"]

    def summed(block: pa.Table, answer: pa.Table) -> pa.Table:
        block, answer = block.to_batches(), answer.combine_chunks()
        row = next(b for b in block if b.num_rows)
        col = {n: row.column(i) for i, n in enumerate(NAMES[:-1])}
        n_a, n_b, n_groups, n_links = (unpack(col[n][0].as_py(), np.int64) for n in NAMES[3:7])
        key, links, best = (answer.column(n).to_numpy() for n in ("pair", "links", "best"))
        order = np.argsort(key)
        pairs = _numbers(col["pairs"][0].as_py(), np.int64)
        at = order[np.searchsorted(key, pairs, sorter=order)]
        links, best = links[at].astype(np.int64), best[at].astype(np.int64)
        rises = np.cumsum(_numbers(col["rises"][0].as_py(), np.uint32).astype(np.int64))
        stop = np.cumsum(n_links)
        before = np.concatenate([[0], rises])[stop - n_links]
        code = rises - np.repeat(before, n_links)
        upto = lambda x: (c := np.concatenate([[0], np.cumsum(x[code])]))[stop] - c[stop - n_links]
        columns = [col["ids"].flatten(), *map(pa.array, (n_a, n_b, n_groups, n_links, upto(best), upto(links))), col["groups"].flatten()]
        return pa.table(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, {names[-1]} string"
    return blocks.select(*NAMES[:-1]).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, schema)
