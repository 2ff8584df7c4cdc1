"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches handed to the tokenizer hold about ``batch_bytes`` of text each, and a text longer than
``split_bytes`` is cut at safe boundaries first, so memory does not follow the longest text.

A safe boundary of a SentencePiece model is one single space between two characters that are not
white space: no piece of the vocabulary holds its word mark after another character (checked when
the model is loaded), so no merge crosses it, and the mark that the library puts before each text
stands for the space that the cut removes. For ``tokenizers`` files there is no cut that is safe for
every kind of model, so whole texts are encoded.

Edge cases: null counts as the empty text (0 bytes, 0 tokens); repeated rows and ids are counted
row by row; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import by_bytes, in_arrow, texts_of

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
SAFE = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")


@lru_cache(maxsize=4)
def _encoder(path: str):
    """(function from texts to token counts, whether texts may be cut at SAFE)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)], False
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    plain = model.normalize("a  b éÅﬁ") == "▁a▁▁b▁éÅﬁ"
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], plain and not crossing


def split_safely(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters whose token counts add up to the count of ``text``."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def _counts(texts: list[str], path: str, batch_bytes: int, split_bytes: int) -> np.ndarray:
    encode, divisible = _encoder(path)
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = split_safely(text, split_bytes) if divisible and len(text) > split_bytes else [text]
        parts += own
        owner += [i] * len(own)
    counts = np.zeros(len(texts), dtype=np.int64)
    for a, b in by_bytes([len(p) if p.isascii() else len(p.encode()) for p in parts], batch_bytes):
        np.add.at(counts, owner[a:b], encode(parts[a:b]))
    return counts


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = DEFAULT_MODEL,
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    split_bytes: int = 1 << 15,
) -> DataFrame:
    """Per row: ``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            tokens = np.zeros(batch.num_rows, dtype=np.int64)
            for a, b in by_bytes(size.to_pylist(), 4 * batch_bytes):
                tokens[a:b] = _counts(texts_of(batch.column(1).slice(a, b - a)), model, batch_bytes, split_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens)], names=[id_col, "n_bytes", "n_tokens"])

    kept = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return in_arrow(kept, lengths, schema).withColumn("over_limit", F.col("n_tokens") > limit)
