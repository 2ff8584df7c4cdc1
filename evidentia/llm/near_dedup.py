"""Near-duplicate detection by improved consistent weighted sampling (Ioffe 2010).

Texts are bags of shingles of ``SIZE`` words (runs outside ASCII punctuation and white space,
lower-cased). A shingle weighs its frequency times the mean idf of its words; idf is counted over
all documents in a fixed number of hashed slots, and scaled to 1..2, so that in a large group of
copies, whose shared shingles are frequent by that alone, they keep their weight.

1. Texts with the same words are one node, told apart by a digest of the words and numbered as the
   table of nodes is written; ids may repeat or be null. A class is named by its smallest id.
2. Each node gets 64 consistent weighted samples, in 16 bands of 4. Each occurrence of a shingle is
   an element of its own, which weighs its idf: the weighted similarity of these sets is the same,
   and no few elements carry most of a set. A text of much weight draws its samples from 64 bins of
   its elements, a lighter one from 16, 4 or 1 bins with 4, 16 or 64 draws from each; near a limit
   between these schemes, texts get the samples of both sides. A text with repeated shingles gets
   the bands of its distinct shingles too, for pairs that are similar by these alone.
3. Nodes that share a band are candidates. A bucket of up to ``PAIRS`` nodes gives all its pairs. A
   larger one gives pairs with its ``leaders`` most central nodes alone; step 5 finds what these
   miss. Buckets over ``salt_above`` nodes are split, and the most central nodes of the parts meet in
   the whole bucket; step 5 takes all parts as one bucket, however few they are.
4. Pairs are verified: their weighted, or else their plain, Jaccard similarity is at least the
   threshold. Connected components of the verified links, by alternating large and small stars, are
   classes.
5. Large buckets that overlap make a group. Its nodes outside the group's largest class are compared
   exactly with all its nodes, over inverted lists in tiles of ``tile_rows`` times ``tile_rows``; only
   links between classes leave a tile, and join classes as in step 4.

Edge cases: ids are integers. Texts without words (null and empty too) are alone in their class; a
text of fewer than ``SIZE`` words is one shingle; equal rows fall into one class; different texts of
one id are different nodes, and may fall into different classes; a null id counts as larger than all
others, and a class of null ids alone has a null name; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow, slices
from evidentia.llm.substring_dedup import WordHashes, mixed, rolled
from evidentia.llm.tables import discard, stored

SIZE = 5
SLOTS = 1 << 18
SAMPLES, ROWS = 64, 4
PAIRS = 16
#: (least weight of all elements, each of which weighs 1 to 2; bins); samples a bin: SAMPLES // bins.
SCHEMES = ((1, 1), (48, 4), (192, 16), (768, 64))
OVERLAP = 0.75
BASE = 0x9E3779B97F4A7C15
_BREAKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BREAKS).split()


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by slot of their words; slot -1: all documents."""
    known, total, n = WordHashes(), np.zeros(SLOTS, np.int64), 0
    for batch in slices(batches, 0, 2 << 20):
        for text in batch.column(0).to_pylist():
            total[np.unique(known.of(words_of(text or "")) % np.uint64(SLOTS)).astype(np.int64)] += 1
            n += 1
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *slots.tolist()], pa.int32()), pa.array([n, *total[slots].tolist()], pa.int64())], names=["slot", "n"])


def slot_idf(texts: DataFrame) -> np.ndarray:
    """idf by slot, in 1..2. The table has SLOTS numbers whatever the corpus."""
    found = in_arrow(texts, _slot_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    documents = float(n[slot < 0].sum())
    counts = np.zeros(SLOTS)
    counts[slot[slot >= 0]] = n[slot >= 0]
    return (1 + np.log((documents + 1) / (counts + 1)) / np.log(documents + 2)).astype(np.float32)


def shingles_of(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their frequencies, and their idf in 255ths above 1."""
    size = min(SIZE, len(hashes))
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    keys, at, counts = np.unique(rolled(hashes, size, BASE), return_index=True, return_counts=True)
    sums = np.concatenate([[0.0], np.cumsum(idf[(hashes % np.uint64(SLOTS)).astype(np.int64)], dtype=np.float64)])
    mean = (sums[size:] - sums[:-size])[at] / size
    return keys, counts, np.clip(np.rint((mean - 1) * 255), 0, 255).astype(np.uint8)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float64) + 0.5) / 4294967296.0


def samples(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Consistent weighted samples of all documents at once: (document, position of sample) and hash.

    ``keys`` are grouped by ``doc``. A bin without shingles has no sample.
    """
    half = np.uint64(32)
    bin_of = (mixed(keys ^ np.uint64(0xA5A5A5A5)) % np.uint64(bins)).astype(np.int64)
    cell = doc * bins + bin_of
    order = np.argsort(cell, kind="stable")
    cell, keys, logs = cell[order], keys[order], np.log(weights[order])
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    group = np.cumsum(np.diff(cell, prepend=-1) != 0) - 1
    places, found = [], []
    draws = SAMPLES // bins
    for k in range(draws):
        a, b, c = (mixed(keys + np.uint64((BASE * (3 * k + j + 1)) & 0xFFFFFFFFFFFFFFFF)) for j in range(3))
        r = -np.log(_uniform(a >> half) * _uniform(a & np.uint64(0xFFFFFFFF)))
        gamma = -np.log(_uniform(b >> half) * _uniform(b & np.uint64(0xFFFFFFFF)))
        beta = _uniform(c >> half)
        t = np.floor(logs / r + beta)
        score = np.log(gamma) - r * (t - beta) - r
        least = np.minimum.reduceat(score, first)
        best = np.flatnonzero(score == least[group])
        best = best[np.unique(group[best], return_index=True)[1]]
        found.append(mixed(keys[best] ^ mixed(t[best].astype(np.int64).view(np.uint64) + np.uint64(k))))
        places.append((cell[best] // bins) * SAMPLES + (cell[best] % bins) * draws + k)
    return np.concatenate(places), np.concatenate(found)


def occurrences(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each occurrence of each shingle, the first one's being the shingle's, and its place in ``keys``."""
    at = np.repeat(np.arange(len(keys)), counts)
    nth = (np.arange(len(at)) - (np.cumsum(counts) - counts)[at]).astype(np.uint64)
    return np.where(nth == 0, keys[at], mixed(keys[at] + mixed(nth))), at


def bands_of(shingled: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[list[int]]:
    """Band hashes of each document; a band of empty bins alone is left out."""
    sets, owners = [], []
    for d, (keys, counts, q) in enumerate(shingled):
        weights = 1 + q / 255
        sets.append((keys, weights))
        owners.append(d)
        if len(keys) and counts.max() > 1:
            own, at = occurrences(keys, counts)
            sets.append((own, weights[at]))
            owners.append(d)
    out: list[dict[int, None]] = [{} for _ in shingled]
    sizes = np.array([len(s[0]) for s in sets])
    totals = np.array([s[1].sum() for s in sets])
    for i, (least, bins) in enumerate(SCHEMES):
        most = SCHEMES[i + 1][0] / OVERLAP if i + 1 < len(SCHEMES) else np.inf
        chosen = np.flatnonzero((totals >= least * (OVERLAP if i else 1)) & (totals < most))
        for a in range(0, len(chosen), 300):
            part = chosen[a : a + 300]
            keys = np.concatenate([sets[d][0] for d in part])
            weights = np.concatenate([sets[d][1] for d in part])
            doc = np.repeat(np.arange(len(part)), sizes[part])
            places, found = samples(keys, weights, doc, bins)
            table = np.zeros(len(part) * SAMPLES, np.uint64)
            table[places] = found
            table = table.reshape(len(part), SAMPLES // ROWS, ROWS)
            band = np.zeros(table.shape[:2], np.uint64)
            for row in range(ROWS):
                band = band * np.uint64(BASE) + table[:, :, row]
            band = mixed(band + np.arange(SAMPLES // ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(bins)).view(np.int64)
            held = table.any(axis=2)
            for d, own, use in zip(part.tolist(), band, held, strict=True):
                out[owners[d]].update(dict.fromkeys(own[use].tolist()))
    return [list(found) for found in out]


def digest_of(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def packed_vector(keys: np.ndarray, counts: np.ndarray, q: np.ndarray) -> bytes:
    """Number of shingles, bytes of a count (2 or 4), then hashes, counts and idf."""
    wide = 4 if len(counts) and counts.max() > 65535 else 2
    return len(keys).to_bytes(4, "little") + bytes([wide]) + (keys >> np.uint64(32)).astype("<u4").tobytes() + counts.astype(f"<u{wide}").tobytes() + q.tobytes()


def _signatures(idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 2, 2 << 20):
            words = [words_of(t or "") for t in batch.column(2).to_pylist()]
            bands = bands_of([shingles_of(known.of(w), idf) for w in words])
            digests = pa.array(map(digest_of, words), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_key", "same", "bands"])

    return rows


def _vectors(idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 0, 2 << 20):
            words = [words_of(t or "") for t in batch.column(0).to_pylist()]
            made = [packed_vector(*shingles_of(known.of(w), idf)) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, words), pa.binary()), pa.array(made, pa.binary())], names=["same", "vector"])

    return rows


def _read_vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide = int.from_bytes(data[:4], "little"), data[4]
    keys = np.frombuffer(data, "<u4", n, 5)
    return keys, np.frombuffer(data, f"<u{wide}", n, 5 + 4 * n) * (1 + np.frombuffer(data, np.uint8, n, 5 + (4 + wide) * n) / 255)


def similarity(a: bytes, b: bytes) -> float:
    """The larger of the weighted and the plain Jaccard similarity."""
    (ka, wa), (kb, wb) = _read_vector(a), _read_vector(b)
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka
    both, n = float(np.minimum(wa[same], wb[at[same]]).sum()), int(same.sum())
    return max(both / (float(wa.sum()) + float(wb.sum()) - both), n / (len(ka) + len(kb) - n))


def _similar(threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [similarity(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kept = pa.array([s >= threshold - 1e-9 for s in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(kept)

    return rows


PAIR_SCHEMA = pa.schema([(c, pa.int64()) for c in ("a", "b", "head")])


def _pairs(leaders: int):
    """From (key, id, split), sorted so that a bucket's most central nodes come first, to candidate
    pairs (a, b). In large buckets, and in those of any size that belong to a split key, the pair of each
    node with the most central one names the latter as ``head``: it says that the node is a member."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held, large, parted = None, [], False, False

        def meet(new: int, others: list[int], member: bool) -> None:
            out.extend((min(x, new), max(x, new), x if member and n == 0 else None) for n, x in enumerate(others))

        def close() -> None:
            if not large:
                for n, x in enumerate(held):
                    meet(x, held[:n], parted)

        for batch in batches:
            for k, i, split in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key:
                    close()
                    key, held, large, parted = k, [], False, split
                if large:
                    meet(i, held, True)
                    continue
                held.append(i)
                if len(held) > PAIRS:
                    large = True
                    for n, x in enumerate(held):
                        meet(x, held[: min(n, leaders)], True)
                    del held[leaders:]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=PAIR_SCHEMA)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=PAIR_SCHEMA)

    return rows


def _tiles(threshold: float):
    """Links between components inside a tile: rows (tile, side, component, vector) sorted by tile and
    side; those of side 0 are held as inverted lists, those of side 1 run past them one by one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, lists = None, [], None
        found: set[tuple[int, int]] = set()

        def built():
            parts = [_read_vector(v) for _, v in held]
            sizes = np.array([len(k) for k, _ in parts])
            keys, weights, owner = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts]), np.repeat(np.arange(len(parts)), sizes)
            order = np.argsort(keys, kind="stable")
            return np.array([c for c, _ in held]), sizes, np.bincount(owner, weights, len(parts)), keys[order], weights[order], owner[order]

        def passed(component: int, vector: bytes) -> None:
            components_, sizes, totals, keys, weights, owner = lists
            own, own_weights = _read_vector(vector)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], np.minimum(weights[at], np.repeat(own_weights, n)), len(sizes))
            count = np.bincount(owner[at], minlength=len(sizes))
            sims = np.maximum(both / (totals + own_weights.sum() - both), count / (sizes + len(own) - count))
            found.update((min(x, component), max(x, component)) for x in set(components_[sims >= threshold - 1e-9].tolist()) if x != component)

        def links() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found.clear()

        for batch in batches:
            for t, side, component, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != tile:
                    yield from links()
                    tile, held, lists = t, [], None
                if side == 0:
                    held.append((component, vector))
                elif held:
                    lists = lists or built()
                    passed(component, vector)
        yield from links()

    return rows


def _rest(members: DataFrame, classes: DataFrame, vectors: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """(a, b): links between components that leaders missed. Large buckets that overlap make a group;
    its nodes outside the group's largest component are compared exactly with all its nodes, in tiles."""
    groups = components(members.select(F.col("a").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "group")
    placed = stored(groups.join(classes, "id", "left").select("group", "id", F.coalesce("component", "id").alias("component")))
    sizes = placed.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("component", "n").alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_odd")).where("n_odd > 0")
    own = placed.join(main, "group").select("group", "id", "component", (F.col("component") != F.col("main")).alias("odd"), F.ceil(F.col("n_odd") / tile_rows).cast("int").alias("left"), F.ceil(F.col("n") / tile_rows).cast("int").alias("right"))

    def dealt(rows: DataFrame, side: int, mine: str, others: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(mine)).alias("block")
        spread = rows.select("group", "id", "component", block, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))
        pair = ("block", "other") if side == 0 else ("other", "block")
        return spread.select(F.xxhash64("group", *[F.col(c).cast("bigint") for c in pair]).alias("tile"), F.lit(side).alias("side"), "component", "id")

    tiles = dealt(own.where("odd"), 0, "left", "right").union(dealt(own, 1, "right", "left")).join(vectors, "id")
    dealt_out = tiles.select("tile", "side", "component", "vector").repartition("tile").sortWithinPartitions("tile", "side")
    return in_arrow(dealt_out, _tiles(threshold), "a bigint, b bigint")


def _beside(links: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v) with the m of its u. Adaptive execution splits a hub only in a join whose sides both come
    straight from an exchange; dealt by u, ``least`` would come from the aggregate that made it. So the
    join is by the complement of u, for which both sides are dealt anew."""
    return links.join(least.select(F.bitwise_not("u").alias("key"), "m"), F.bitwise_not("u") == F.col("key")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(id, component), stored: the smallest id that links (a, b) lead to, for every id that has a link.

    Alternating large and small stars; it ends when a round leaves as many links as it found, with the
    same fingerprint. A hub's links meet in joins alone, which adaptive execution splits (``_beside``).
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    seen = now.agg(*mark).first()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(_beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _beside(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(now, large)
        now, found = after, after.agg(*mark).first()
        if found == seen:
            break
        seen = found
    made = stored(now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").union(now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))))
    discard(now)
    return made


def _salted(keys: DataFrame, salt_above: int) -> DataFrame:
    """(key, central, id, split) with very large keys split; the most central node of each part stays under the whole key."""
    large = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > salt_above))
    if large.isEmpty():
        return keys.select("key", "central", "id", F.lit(False).alias("split"))
    split = keys.join(large, "key").select("key", F.xxhash64("key", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / salt_above))).alias("part"), "central", "id")
    heads = split.groupBy("key", "part").agg(F.max(F.struct("central", "id")).alias("h")).select("key", "h.central", "h.id")
    return keys.join(large, "key", "left_anti").select("key", "central", "id", F.lit(False).alias("split")).union(split.select("part", "central", "id", F.lit(True)).union(heads.select("*", F.lit(True))))


def _buckets(bands: DataFrame) -> DataFrame:
    """(key, central, id) of bands that several nodes share. A node is the more central, the larger its
    buckets are: in a group of edited copies the original shares most bands with most copies."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return bands.join(sizes, "key").select("key", F.sum("n").over(Window.partitionBy("id")).alias("central"), "id")


def _vectors_of(docs: DataFrame, wanted: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, vector) of the nodes ``wanted`` (id, same, first)."""
    # a shuffle at any size: the texts that are wanted grow with the corpus
    texts = docs.join(wanted.select(F.col("first").alias("id")).distinct().hint("merge"), "id", "left_semi").select("text")
    if not wanted.where("first is null").isEmpty():
        texts = texts.union(docs.where("id is null").select("text"))
    made = in_arrow(texts, _vectors(idf), "same binary, vector binary").dropDuplicates(["same"])
    return made.join(wanted.select("id", "same").hint("merge"), "same").select("id", "vector")


def near_duplicate_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, leaders: int = 4, salt_above: int = 20_000, tile_rows: int = 1000
) -> DataFrame:
    """Per row: ``id_col``, text_key (of the text, by ``text_key``), class_id (the smallest id of its class) and
    keep: true for one text of each class, at its smallest id (in all rows that are equal)."""
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    idf = slot_idf(docs.select("text"))
    own = stored(in_arrow(docs, _signatures(idf), "id bigint, text_key binary, same binary, bands array<bigint>"))
    grouped = own.where("same is not null").groupBy("same").agg(F.min("id").alias("first"), F.first("bands").alias("bands"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("id"), "same", "first", "bands"))
    buckets = stored(_buckets(nodes.select(F.explode("bands").alias("key"), "id")))
    keys = _salted(buckets, salt_above)
    dealt = keys.select("key", "id", "central", "split").repartition("key").sortWithinPartitions("key", F.desc("central"), "id").select("key", "id", "split")
    found = stored(in_arrow(dealt, _pairs(leaders), "a bigint, b bigint, head bigint"))
    pairs = stored(found.select("a", "b").distinct())

    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = stored(_vectors_of(docs.select("id", "text"), nodes.select("id", "same", "first").join(met, "id"), idf))
    left = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a")
    both = left.join(vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b").select("a", "b", "va", "vb")
    links = stored(in_arrow(both, _similar(threshold), "a bigint, b bigint"))
    classes = components(links)
    members = found.where("head is not null").select(F.when(F.col("a") == F.col("head"), F.col("b")).otherwise(F.col("a")).alias("a"), "head").distinct()
    if not members.isEmpty():
        rest = stored(_rest(members, classes, vectors, threshold, tile_rows).distinct())
        first_classes, classes = classes, components(rest.union(classes.select("id", "component")))
        discard(rest, first_classes)
    discard(buckets, found, pairs, vectors, links)

    least = F.struct(F.col("first").isNull().alias("none"), "first", "id")
    heads = classes.join(nodes.select("id", "first"), "id").groupBy("component").agg(F.min(least).alias("head"))
    linked = classes.join(heads, "component").select("id", "head")
    named = nodes.select("id", "same", "first").join(linked, "id", "left")
    named = named.select("same", "first", F.when(F.col("head").isNull(), F.col("first")).otherwise(F.col("head.first")).alias("class"), F.coalesce(F.col("head.id") == F.col("id"), F.lit(True)).alias("heads"))
    known = own.where("same is not null").select("id", "text_key", "same").join(named, "same").select("id", "text_key", "class", (F.col("heads") & F.col("id").eqNullSafe(F.col("first"))).alias("keep"))
    every = known.union(own.where("same is null").select("id", "text_key", F.col("id").alias("class"), F.lit(True)))
    return every.select(F.col("id").cast(id_type).alias(id_col), "text_key", F.col("class").cast(id_type).alias("class_id"), "keep")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: ``id_col`` and class_id, the smallest id of its class. ``how``: as in ``near_duplicate_rows``."""
    return near_duplicate_rows(df, id_col, text_col, **how).select(id_col, "class_id")


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stand for their class, with all their columns. A row goes if another text,
    or the same one at a smaller id, stands for its class; of equal (id, text) one row stays."""
    found = stored(near_duplicate_rows(df, id_col, text_col, **how))
    row = found.select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), "keep")
    marked = df.withColumn("__own", text_key(F.col(text_col).cast("string")))
    same_row = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    kept = marked.join(row.where("not keep").select("__id", "__key").distinct(), same_row, "left_anti")
    twice = stored(row.where("keep and __key is not null").groupBy("__id", "__key").count().where("count > 1").select("__id", "__key"))
    if not twice.isEmpty():
        again = kept.join(twice, same_row, "left_semi").dropDuplicates([id_col, "__own"])
        kept = kept.join(twice, same_row, "left_anti").union(again)
    return kept.select(*df.columns)


def text_key(text: Column) -> Column:
    """Digest of a text; null for null."""
    return F.unhex(F.md5(text))
