"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

1. One pass counts the corpus occurrences of the benchmark's terms.
2. The two rarest terms of each benchmark window are its pivots. A second pass stores the postings
   (text, term, position) of all pivot terms, and each document's number of words, as a table.
3. A posting of a pivot that stands at ``ipos`` in an item lies on the diagonal position - ipos.
   Lists adjusted by that offset are intersected by grouping on (text, item, diagonal): a window is a
   candidate where both its pivots lie on one diagonal.
4. Candidates are confirmed word for word in the texts that hold any, once for each distinct text.
5. The same postings, as lists by (text, term), answer proximity: where the two pivots of a window
   stand within ``reach`` words of each other in any order, its items are near.

Copies of a text share its digest, so whatever their number they are confirmed once. Shuffled rows
are the postings of rare terms. Small sides are broadcast only when counted to be at most
``broadcast_rows`` and ``BROADCAST_BYTES``; else the joins shuffle.

Words are maximal runs of 0-9, a-z and characters from U+0080 after lower-casing A-Z.

Edge cases: a null or empty text has no words and no hits; a null item id counts as the empty
string; items without words are ignored; items of fewer than ``width`` words are one window;
repeated documents or items are joined by content; either table may be empty; only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.tables import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = " "  # a term that no word equals: its posting holds the number of words
BROADCAST_BYTES = 16 << 20


#: The same breaks in a text that is not yet lower-cased.
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words_of(text: Column) -> Column:
    """The words before lower-casing, which leaves their places as they are."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), RAW_BREAKS), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case. ``lower`` does that to an ASCII word, and faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), "")


def text_key(text: Column) -> Column:
    """Digest of the text; null and the empty text share one, as neither has words."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it is counted to have ``most`` rows and BROADCAST_BYTES at most."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    facts = df.agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
    return F.broadcast(df) if facts["n"] <= most and facts["size"] <= BROADCAST_BYTES else df


def _bound(value: Column, made) -> Column:
    """``made`` of a lambda variable that holds ``value``, so that it is computed once however often it is used."""
    return F.transform(F.array(value), made)[0]


def item_windows(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item, ids, a, phrase): windows of each distinct item text, which starts at word ``a``."""
    own = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return (
        own.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .select(F.md5(F.array_join("words", " ")).alias("item"), "ids", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("a"))
        .select("item", "ids", "a", F.slice("words", F.col("a") + 1, width).alias("phrase"))
    )


def corpus_counts(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n): occurrences in the corpus of each of ``terms``."""
    words = docs.select(F.explode(raw_words_of(F.col(text_col))).alias("word"))
    return words.select(lowered(F.col("word")).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def with_pivots(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with the item positions and terms of their two rarest."""
    placed = windows.select("item", "a", F.posexplode("phrase").alias("at", "term"))
    ranked = (
        placed.join(counts, "term", "left").groupBy("item", "a")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("a") + F.col("at")).alias("ipos"), "term"))).alias("rare"))
        .where(F.col("rare")[0]["n"] > 0)
    )
    return ranked.select("item", "a", F.slice("rare", 1, 2).alias("pivots")).join(windows, ["item", "a"])


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, term, at) for the given terms and, with term END, each document's number of words."""
    own = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text"), F.concat(raw_words_of(F.col(text_col)), F.array(F.lit(END))).alias("words"))
    placed = own.select("id", "text", F.posexplode("words").alias("at", "word"))
    return placed.select("id", "text", lowered(F.col("word")).alias("term"), "at").join(terms, "term").select("id", "text", "term", "at")


def phrase_matches(index: DataFrame, docs: DataFrame, windows: DataFrame, text_col: str, broadcast_rows: int) -> DataFrame:
    """(text, hits array<struct<at,size,item>>): occurrences of whole windows, by distinct text."""
    pivots = windows.select("item", F.size("phrase").alias("n"), F.explode("pivots").alias("p")).select("item", F.col("p.term").alias("term"), F.col("p.ipos").alias("ipos"), (F.col("n") == 1).alias("alone")).distinct()
    diagonals = (
        index.where(F.col("term") != END).join(_small(pivots, broadcast_rows), "term")
        .groupBy("text", "item", (F.col("at") - F.col("ipos")).alias("diagonal"))
        .agg(F.collect_set("ipos").alias("held"), F.max("alone").alias("alone"))
        .where((F.size("held") > 1) | F.col("alone"))
    )
    wanted = F.forall("pivots", lambda p: F.array_contains("held", p["ipos"]))
    candidates = (
        diagonals.join(_small(windows, broadcast_rows), "item").where(wanted & (F.col("diagonal") + F.col("a") >= 0))
        .groupBy("text").agg(F.collect_list(F.struct((F.col("diagonal") + F.col("a")).alias("at"), "item", "phrase")).alias("found"))
    )
    candidates = stored(candidates)
    texts = docs.select(text_key(F.col(text_col)).alias("text"), F.col(text_col).cast("string").alias("__raw"))
    held = texts.join(_small(candidates.select("text"), broadcast_rows), "text", "left_semi").dropDuplicates(["text"])
    exact = _bound(words_of(F.col("__raw")), lambda words: F.filter("found", lambda f: F.slice(words, f["at"] + 1, F.size(f["phrase"])) == f["phrase"]))
    return (
        held.join(_small(candidates, broadcast_rows), "text")
        .select("text", F.transform(exact, lambda f: F.struct(f["at"].alias("at"), F.size(f["phrase"]).alias("size"), f["item"].alias("item"))).alias("hits"))
        .where(F.size("hits") > 0)
    )


def near_matches(index: DataFrame, windows: DataFrame, reach: int, broadcast_rows: int) -> DataFrame:
    """(text, item): the pivots of a window of the item stand within ``reach`` words of each other in the text."""
    pairs = windows.where(F.size("pivots") == 2).select("item", F.col("pivots")[0]["term"].alias("term"), F.col("pivots")[1]["term"].alias("other")).distinct()
    lists = index.where(F.col("term") != END).groupBy("text", "term").agg(F.collect_set("at").alias("places"))
    first = lists.join(_small(pairs, broadcast_rows), "term").select("text", "item", "other", F.col("term") == F.col("other"), F.col("places").alias("own"))
    first = first.toDF("text", "item", "other", "same", "own")
    met = first.join(lists.select("text", F.col("term").alias("other"), F.col("places").alias("others")), ["text", "other"])

    def marked(places: str, mark: int) -> Column:
        return F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(mark).alias("of")))

    # the nearest two places of different lists are neighbours in their common order
    line = F.array_sort(F.when(F.col("same"), marked("own", 0)).otherwise(F.concat(marked("own", 0), marked("others", 1))))
    close = _bound(line, lambda x: F.exists(F.sequence(F.lit(1), F.size(x) - 1), lambda i: (F.get(x, i)["at"] - F.get(x, i - 1)["at"] <= reach) & (F.col("same") | (F.get(x, i)["of"] != F.get(x, i - 1)["of"]))))
    several = F.when(F.col("same"), F.size("own") > 1).otherwise(F.lit(True))
    return met.where(several).where(close).select("text", "item").distinct()


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans struct<at,size>."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def add(done, s):
        stop = (s["at"] + s["size"]).cast("bigint")
        return F.struct((done["n"] + F.greatest(F.lit(0), stop - F.greatest(done["upto"], s["at"].cast("bigint")))).alias("n"), F.greatest(done["upto"], stop).alias("upto"))

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def _indexed(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(windows with their pivots, postings of the pivot terms), stored."""
    every = stored(item_windows(items, width, item_col, item_text_col))
    terms = _small(every.select(F.explode("phrase").alias("term")).distinct(), broadcast_rows)
    windows = stored(with_pivots(every, corpus_counts(docs, terms, text_col)))
    discard(every)
    chosen = windows.select(F.explode("pivots.term").alias("term")).union(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    return windows, stored(postings(docs, _small(chosen, broadcast_rows), id_col, text_col))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    reach: int = 20,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """Per document row: ``id_col``, n_words, n_hit, n_items, items (ids), contaminated, spans, and n_near:
    distinct item texts that are near by proximity, exact ones included."""
    windows, index = _indexed(docs, items, id_col, text_col, item_col, item_text_col, width, broadcast_rows)
    ids = windows.select("item", F.explode("ids").alias("own")).distinct()
    hits = stored(phrase_matches(index, docs, windows, text_col, broadcast_rows))
    named = (
        hits.select("text", F.explode(F.array_distinct("hits.item")).alias("item")).join(_small(ids, broadcast_rows), "item")
        .groupBy("text").agg(F.array_sort(F.collect_set("own")).alias("items"))
    )
    found = hits.select("text", F.array_sort(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["size"].alias("size")))).alias("spans")).join(named, "text")
    near = near_matches(index, windows, reach, broadcast_rows).groupBy("text").agg(F.count("*").alias("n_near"))
    # stored, so that the join below reads shuffled rows alone and adaptive execution can split the copies of one text
    marks = stored(found.join(near, "text", "full"))
    own = index.where(F.col("term") == END).select("id", "text", F.col("at").cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return own.join(_small(marks, broadcast_rows), "text", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("spans").isNull(), F.lit(0)).otherwise(covered(F.col("spans"))).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("spans").isNotNull().alias("contaminated"),
        "spans",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of the items. Rows go by
    their text, so ids may be null or repeat."""
    windows, index = _indexed(docs, items, id_col, text_col, item_col, item_text_col, width, broadcast_rows)
    gone = stored(phrase_matches(index, docs, windows, text_col, broadcast_rows).select(F.col("text").alias("__key")))
    marked = docs.withColumn("__own", text_key(F.col(text_col)))
    return marked.join(_small(gone, broadcast_rows), F.col("__own") == F.col("__key"), "left_anti").select(*docs.columns)
