"""Language-model scores by a probabilistic suffix tree over words.

1. Documents are gathered into blocks, written once: each keeps its distinct words' hashes and its texts as
   packed numbers of them. Word counts give the root: c is a word's count, N all, V distinct ones, and
   P(x) = (c + 0.1) / (N + 0.1 (V + 1)). Every text ends with an end symbol.
2. A context of one to ``depth`` words is a candidate if it stands in at least ``p_min`` of all positions
   (and ``least`` times), so there are at most 1 / p_min of each length, whatever the corpus. For
   candidates all next symbols are counted, level by level, as rows for each block and distinct gram.
3. A context's distribution discounts each count by one and gives what that leaves to its longest
   retained suffix: P(x|s) = max(c - 1, 0) / n + (d / n) P(x|suffix), of n occurrences and d distinct next
   symbols. It is retained by a divergence test: n times the Kullback-Leibler divergence from its suffix
   must pay log(N) / 2 for each next symbol that it gives a probability of its own.
4. To score, the longest retained suffix of what stands before a word is its state. A block asks for
   its distinct words and its grams of retained contexts once, and gets back their values.

Only retained contexts are sent to all tasks (at most 1 / p_min of a length); counts and
probabilities of symbols grow with the corpus and are joined. A word or gram that is a third of all tokens sends a row for each block.

Tokens are lower-cased (A-Z) maximal runs of bytes other than 0x20 and 0x09-0x0D, told apart by 64-bit
hashes. Edge cases: null is the empty text, of the end symbol alone; a null id counts as the empty
string when documents are held out; repeated rows and ids count row by row; without any training
document every token has probability 1; a text longer than a block makes a block of its own, which
its task must hold; an empty table gives an empty one; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import by_bytes, in_arrow
from evidentia.llm.packed import pack, unpack
from evidentia.llm.substring_dedup import WordHashes, mixed
from evidentia.llm.tables import discard, stored, tidy

BLOCK_BYTES = 8 << 20
ADDED = 0.1
END = b""
ROWS = 200_000


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is one of the rising keys, at which place)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass(frozen=True)
class Contexts:
    """Retained contexts of one length: hashes in rising order, how often each stands, and the share that it leaves to its suffix."""

    keys: np.ndarray
    counts: np.ndarray
    left: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is retained, the places of those)."""
        there, at = _among(self.keys, wanted)
        return there, at[there]


@dataclass(frozen=True)
class SuffixTree:
    """levels[k] has the retained contexts of k + 1 words; ``counts`` (key, n) has the words, and the grams that
    retained contexts have seen twice."""

    tokens: int
    distinct: int
    levels: tuple[Contexts, ...]
    counts: DataFrame

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return unpack(data, kind) if data else np.zeros(0, kind)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([pack(values) if len(values) else b""], pa.binary())


class Tokens:
    """A block's words as hashes, one document after another, each closed by the end symbol."""

    def __init__(self, sizes: bytes, codes: bytes, hashes: bytes):
        self.sizes = _numbers(sizes, np.int64)
        self.distinct = _numbers(hashes, np.uint64)
        self.codes = _numbers(codes, np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def grams(self, depth: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each length of context from one: the hashes of the contexts before all words, and those of what ends in
        each word, from that context and the word down to the word alone. Contexts that would begin in another document are 0."""
        words = self.distinct[self.codes]
        hashes, inside = [words], np.ones(len(words), bool)
        for length in range(1, depth + 1):
            before = np.zeros(len(words), np.uint64)
            before[1:] = hashes[0][:-1]
            at = self.starts[self.sizes >= length] + length - 1
            inside[at] = False
            before[~inside] = 0
            hashes.insert(0, mixed(before * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(length)))
            yield before, hashes


def held_out_of(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _named(task: int, number: int) -> int:
    """A number below 2^31, so that it and a place in the block fit a long."""
    if number >= 2048 or task >= 1 << 20:
        raise ValueError("at most 2,048 blocks in a task and 1,048,576 tasks: read the table in more or fewer partitions")
    return task << 11 | number


def blocks_of(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The table of blocks: ids, which are held out, and packed: sizes, word numbers, words' hashes and training counts."""
    names = ["block", "ids", "held", "sizes", "codes", "hashes", "counts"]

    def row(number: int, ids: list[pa.Array], held: list[pa.Array], texts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        out = pa.concat_arrays(held)
        codes, distinct = pd.factorize(np.concatenate(texts))
        learned = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), sizes)
        counts = np.bincount(codes[learned], minlength=len(distinct)).astype(np.uint32)
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), whole(pa.concat_arrays(ids)), whole(out), *map(_binary, (sizes, codes.astype(np.uint32), distinct, counts))], names=names)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = WordHashes(), WordHashes().of([END])
        task, number, ids, flags, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(2)).fill_null(0).to_pylist()
            for a, b in by_bytes(lengths, 1 << 20):
                if texts and size + sum(lengths[a:b]) > block_bytes:
                    yield row(_named(task, number), ids, flags, texts)
                    number, ids, flags, texts, size = number + 1, [], [], [], 0
                own = batch.slice(a, b - a)
                ids.append(own.column(0))
                flags.append(own.column(1))
                texts += [np.concatenate([known.of(t.lower().split() if t else []), end]) for t in own.column(2).to_pylist()]
                size += sum(lengths[a:b])
        if texts:
            yield row(_named(task, number), ids, flags, texts)

    kept = df.select(F.col(id_col), F.coalesce(held, F.lit(False)).alias("__held"), F.col(text_col).cast("string").cast("binary").alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()
    return stored(in_arrow(kept, gathered, f"block bigint, ids array<{kind}>, held array<boolean>, sizes binary, codes binary, hashes binary, counts binary"))


def _rows(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
    for a in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + ROWS]) for c in columns], names=names)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(key, n): how often each word stands in the training documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, counts = _numbers(hashes, np.uint64), _numbers(counts, np.uint32).astype(np.int64)
                yield from _rows([hashes[counts > 0], counts[counts > 0]], ["key", "n"])

    return in_arrow(blocks.select("hashes", "counts"), counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def gram_counts(blocks: DataFrame, candidates: np.ndarray, length: int) -> DataFrame:
    """(context, k<length>, ..., k0, n, times): what follows the candidate contexts of ``length`` words in training documents.
    k<j> is the gram of the last j words of the context and the next symbol, so k0 is the symbol. What a context has seen
    once is one row without keys, of ``times`` symbols."""
    names = ["context", *[f"k{j}" for j in range(length, -1, -1)], "n"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, codes, hashes, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Tokens(sizes, codes, hashes)
                learned = np.repeat(~np.array(held, bool), own.sizes)
                *_, (before, keys) = own.grams(length)
                kept = np.flatnonzero(_among(candidates, before)[0] & learned)
                codes, distinct = pd.factorize(keys[0][kept])
                first = np.zeros(len(distinct), np.int64)
                first[codes[::-1]] = kept[::-1]
                yield from _rows([before[first], *[k[first] for k in keys], np.bincount(codes, minlength=len(distinct))], names)

    rows = in_arrow(blocks.select("sizes", "codes", "hashes", "held"), found, ", ".join(f"{n} bigint" for n in names))
    counted = rows.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    keys = [F.when(F.col("n") > 1, F.col(k)).alias(k) for k in names[1:-1]]
    return counted.groupBy("context", *keys, "n").agg(F.count("*").alias("times"))


def fit(blocks: DataFrame, depth: int = 2, p_min: float = 1e-4, least: int = 16) -> SuffixTree:
    """The tree of the blocks' training documents."""
    with tidy(blocks.sparkSession):
        return _fit(blocks, depth, p_min, least)


def _fit(blocks: DataFrame, depth: int, p_min: float, least: int) -> SuffixTree:
    spark = blocks.sparkSession
    words = stored(word_counts(blocks))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, need, price = tokens + ADDED * (distinct + 1), max(least, math.ceil(p_min * tokens)), math.log(max(tokens, 2)) / 2
    frequent = {r.key: None for r in words.where(F.col("n") >= need).collect()}
    levels, models = [], [words]
    shares: list[dict[int, float]] = []  # of each length: what a retained context leaves to its suffix
    suffixes: list[dict[int, int]] = []  # of each length: the context without its first word
    for length in range(1, depth + 1):
        candidates = np.sort(np.array(list(frequent), np.int64).view(np.uint64))
        suffixes.append(frequent)
        if not len(candidates):
            break
        grams = stored(gram_counts(blocks, candidates, length))
        sizes = {r.context: (r.n, r.d) for r in grams.groupBy("context").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum("times").alias("d")).collect()}
        facts = [(c, n, d / n, *_left(c, length, shares, suffixes)) for c, (n, d) in sizes.items()]
        lefts = [f"__left{j}" for j in range(length - 1, 0, -1)]
        facts = spark.createDataFrame(facts, "context bigint, __n bigint, __own double" + "".join(f", {c} double" for c in lefts))
        p = F.col("__p0")
        seen = grams.where("n > 1").join(words.select(F.col("key").alias("k0"), ((F.col("n") + ADDED) / total).alias("__p0")), "k0")
        seen = seen.join(F.broadcast(facts), "context")  # 1 / p_min rows at most
        for j in range(1, length):
            seen = seen.join(models[j].select(F.col("key").alias(f"k{j}"), F.col("p").alias(f"__p{j}")), f"k{j}", "left")
            p = F.when(F.col(f"__left{j}").isNull(), p).otherwise(F.coalesce(F.col(f"__p{j}"), F.col(f"__left{j}") * p))
        seen = stored(seen.select("context", F.col(f"k{length}").alias("key"), "n", p.alias("before"), ((F.col("n") - 1) / F.col("__n") + F.col("__own") * p).alias("p")))
        gains = seen.groupBy("context").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("before"))).alias("gain"), F.sum("before").alias("covered"), F.count("*").alias("entries"))
        kept = {}
        for r in gains.collect():
            n, d = sizes[r.context]
            left = d / n
            if n * (r.gain + left * math.log(left) * max(0.0, 1 - r.covered)) >= price * r.entries:
                kept[r.context] = left
        shares.append(kept)
        keys = np.array(list(kept), np.int64).view(np.uint64)
        order = np.argsort(keys)
        levels.append(Contexts(keys[order], np.array([sizes[c][0] for c in kept], np.float64)[order], np.array(list(kept.values()), np.float64)[order]))
        retained = spark.createDataFrame([(k,) for k in kept], "context bigint")
        models.append(stored(seen.join(F.broadcast(retained), "context", "left_semi").select("key", "n", "p")))
        frequent = {r.key: r.suffix for r in grams.where(F.col("n") >= need).select(F.col(f"k{length}").alias("key"), F.col(f"k{length - 1}").alias("suffix")).collect()} if length < depth else {}
        discard(grams, seen)
    counts = words
    for own in models[1:]:
        counts = counts.unionByName(own.select("key", "n"))
    return SuffixTree(tokens, distinct, tuple(levels), counts)


def _left(context: int, length: int, shares: list[dict[int, float]], suffixes: list[dict[int, int]]) -> list[float | None]:
    """What the context's shorter suffixes leave to theirs, the longest first; null for those that are not retained."""
    out = []
    for j in range(length - 1, 0, -1):
        context = suffixes[j][context]
        out.append(shares[j - 1].get(context))
    return out


def _wanted(own: Tokens, levels: tuple[Contexts, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of context: which words have a retained one, its place, the grams' numbers, and the distinct grams."""
    for level, (before, grams) in zip(levels, own.grams(len(levels)), strict=True):
        there, at = level.find(before)
        yield there, at, *pd.factorize(grams[0][there])


def asked(blocks: DataFrame, levels: tuple[Contexts, ...]) -> DataFrame:
    """(key, at): the distinct words of each block, and its grams of retained contexts; ``at`` is the block's number, and
    the place in this order in the low 32 bits."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, codes, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Tokens(sizes, codes, hashes)
                at = block << 32
                for part in (own.distinct, *(found for *_, found in _wanted(own, levels))):
                    yield from _rows([part, np.arange(at, at + len(part))], ["key", "at"])
                    at += len(part)

    return in_arrow(blocks.select("block", "sizes", "codes", "hashes"), keys, "key bigint, at bigint")


def score(blocks: DataFrame, tree: SuffixTree, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Per document of the blocks: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    levels, total, tokens = tree.levels, tree.total, tree.tokens
    with tidy(blocks.sparkSession):
        answers = stored(asked(blocks, levels).join(tree.counts.hint("shuffle_hash"), "key").select("at", "n"))

    def scored(block: pa.Table, answer: pa.Table) -> pa.Table:
        col = {n: block.column(n).combine_chunks() for n in block.column_names}
        own = Tokens(*(col[n][0].as_py() for n in ("sizes", "codes", "hashes")))
        places, found = answer.column("at").to_numpy() & 0xFFFFFFFF, answer.column("n").to_numpy()

        def counts(start: int, size: int) -> np.ndarray:
            out, inside = np.zeros(size, np.int64), (places >= start) & (places < start + size)
            out[places[inside] - start] = found[inside]
            return out

        known = counts(0, len(own.distinct))[own.codes]
        owner, start = np.repeat(np.arange(len(own.sizes)), own.sizes), len(own.distinct)
        base = (known + ADDED) / total
        p = base.copy()
        for level, (there, at, code, grams) in zip(levels, _wanted(own, levels), strict=True):
            own_count = np.maximum(counts(start, len(grams)) - 1, 0)[code]
            p[there] = own_count / level.counts[at] + level.left[at] * p[there]
            start += len(grams)
        sums = lambda x: np.bincount(owner, x, len(own.sizes))
        columns = [col["ids"].flatten(), col["held"].flatten(), own.sizes, sums(known > 0).astype(np.int64), np.full(len(own.sizes), tokens), sums(np.log10(base)), sums(np.log10(p))]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    answers = answers.withColumn("block", F.shiftright("at", 32)).groupBy("block")
    return blocks.select("block", "ids", "held", "sizes", "codes", "hashes").groupBy("block").cogroup(answers).applyInArrow(scored, schema)


def suffix_tree_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = 2, p_min: float = 1e-4, least: int = 16, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all documents by the tree of those whose crc32(id) is not a multiple of ``folds``."""
    blocks = blocks_of(df, held_out_of(id_col, folds), id_col, text_col, block_bytes)
    return score(blocks, fit(blocks, depth, p_min, least), id_col, df.schema[id_col].dataType.simpleString())
