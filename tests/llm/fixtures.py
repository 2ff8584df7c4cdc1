"""A small table of documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta river stone light house green paper under above never always little large window garden".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(400)) for _ in range(n))


LONG = prose(1, 60)
NEAR = " ".join(w if i not in (20, 50) else "changed" for i, w in enumerate(LONG.split()))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, NEAR, "en"), (4, prose(2, 40), "fr"), (5, prose(2, 40) + " " + prose(3, 30), "fr"), (6, None, "en"), (7, "", None),
    (8, "  \n\t ", "de"), (9, prose(4, 5000), "de"), (10, "x" * 3000, "de"), (11, "one two", "en"), (11, "one two", "en"), (None, LONG, None), (12, "Ünïcödé ☃ 𝒳   \x1c end", "fr"),
    (13, prose(5, 20) + "\n" + prose(6, 20), "es"),
]


def documents(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id bigint, text string, lang string")
    extra = {c: F.lit(c) for c in ("id", "key", "term", "words", "spans", "n_words", "block", "media", "token_ids", "keep", "host", "source")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("bigint"))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
