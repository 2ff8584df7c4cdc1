"""Embedding providers. A provider turns a text column into vectors inside Spark tasks.

Terms are hashed once for each distinct term of a batch. Local hashing needs no service; the other
providers need optional libraries or a network and fail with a clear message without them.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import expanded, query_terms, terms_of
from evidentia.session import small_batches


class EmbeddingProvider(Protocol):
    provider_name: str
    model_name: str
    dimensions: int

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame: ...

    def embed_query(self, query: str) -> list[float]: ...


def place(term: str, dimensions: int) -> tuple[int, float]:
    """Slot and sign of a term, from eight bytes of its BLAKE2b digest."""
    digest = hashlib.blake2b(term.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dimensions, -1.0 if digest[4] & 1 else 1.0


def summed(terms: Iterable[str], dimensions: int, known: dict | None = None) -> list[float]:
    known = {} if known is None else known
    vector = [0.0] * dimensions
    for term in terms:
        slot, sign = known.get(term) or known.setdefault(term, place(term, dimensions))
        vector[slot] += sign
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else vector


class LocalHash:
    """Signed feature hashing of expanded terms, of unit length; the zero vector without terms."""

    provider_name = "local_hash"

    def __init__(self, model_name: str = "local-hash-v1", dimensions: int = 384):
        self.model_name, self.dimensions = model_name, dimensions

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        size = self.dimensions

        @F.pandas_udf("array<float>")
        def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict = {}
            for terms in parts:
                made = []
                for t in terms:
                    if len(known) > 200_000:
                        known.clear()
                    made.append(np.array(summed(t, size, known), np.float32))
                yield pd.Series(made, dtype="object")

        small_batches(df.sparkSession)
        return df.withColumn(out_col, hashed(expanded(terms_of(F.coalesce(F.col(text_col), F.lit(""))))))

    def embed_query(self, query: str) -> list[float]:
        return summed(query_terms(query), self.dimensions)


class _Remote:
    """A provider whose ``vectors`` runs on lists of texts, one batch of Arrow rows at a time."""

    batch_size = 32

    def vectors(self, texts: list[str], kind: str) -> list[list[float]]:
        raise NotImplementedError

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        own, size = self, self.batch_size

        @F.pandas_udf("array<float>")
        def called(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                plain = ["" if t is None else t for t in texts]
                made = [v for a in range(0, len(plain), size) for v in own.vectors(plain[a : a + size], "document")]
                yield pd.Series(made, dtype="object")

        small_batches(df.sparkSession)
        return df.withColumn(out_col, called(F.col(text_col)))

    def embed_query(self, query: str) -> list[float]:
        return self.vectors([query], "query")[0]


def unit(vector: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in vector))
    return [float(x / norm) if norm else 0.0 for x in vector]


class SentenceTransformer(_Remote):
    """A local model of the optional library, loaded once in each worker."""

    provider_name = "sentence_transformers"

    def __init__(self, model_name: str, dimensions: int | None = None):
        self.model_name = model_name
        self.dimensions = dimensions or self._model().get_sentence_embedding_dimension()

    def _model(self):
        try:
            from sentence_transformers import SentenceTransformer as Loaded
        except ImportError as e:
            raise RuntimeError("the sentence_transformers library is not installed") from e
        if "_loaded" not in _MODELS.setdefault(self.model_name, {}):
            _MODELS[self.model_name]["_loaded"] = Loaded(self.model_name)
        return _MODELS[self.model_name]["_loaded"]

    def vectors(self, texts: list[str], kind: str) -> list[list[float]]:
        return self._model().encode(texts, normalize_embeddings=True).tolist()


_MODELS: dict[str, dict] = {}


def _posted(url: str, body: dict, headers: dict[str, str]) -> dict:
    import json
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urlopen(request, timeout=60) as reply:
        return json.load(reply)


class OpenAIService(_Remote):
    provider_name = "openai"

    def __init__(self, key: str, model_name: str, dimensions: int | None = None):
        self.key, self.model_name, self.dimensions, self.sized = key, model_name, dimensions or 1536, bool(dimensions)

    def vectors(self, texts: list[str], kind: str) -> list[list[float]]:
        body = {"model": self.model_name, "input": texts} | ({"dimensions": self.dimensions} if self.sized else {})
        found = _posted("https://api.openai.com/v1/embeddings", body, {"Authorization": f"Bearer {self.key}"})["data"]
        return [unit(x["embedding"]) for x in sorted(found, key=lambda x: x["index"])]


class GoogleService(_Remote):
    provider_name = "google"

    def __init__(self, key: str, model_name: str, dimensions: int | None = None):
        self.key, self.model_name, self.dimensions = key, model_name, dimensions or 768

    def vectors(self, texts: list[str], kind: str) -> list[list[float]]:
        url = f"https://generativelanguage.googleapis.com/v1beta/models/{self.model_name}:embedContent"
        task = "RETRIEVAL_QUERY" if kind == "query" else "RETRIEVAL_DOCUMENT"
        bodies = [{"content": {"parts": [{"text": t}]}, "taskType": task, "outputDimensionality": self.dimensions} for t in texts]
        return [unit(_posted(url, b, {"x-goog-api-key": self.key})["embedding"]["values"][: self.dimensions]) for b in bodies]


def provider_for(name: str, model: str = "local-hash-v1", dimensions: int = 384, keys: dict[str, str] | None = None) -> EmbeddingProvider:
    """A provider by name or alias. Keys come from ``keys`` or the environment."""
    keys = keys or {}
    kind = name.lower().replace("-", "_")
    size = dimensions if dimensions > 0 else None
    if kind in ("local_hash", "hash"):
        return LocalHash(model, dimensions)
    if kind in ("sentence_transformers", "sentence_transformer", "local"):
        return SentenceTransformer(model, size)
    for names, variable, made in ((("openai",), "OPENAI_API_KEY", OpenAIService), (("google", "gemini"), "GOOGLE_API_KEY", GoogleService)):
        if kind in names:
            key = keys.get(names[0]) or os.environ.get(variable)
            if not key:
                raise RuntimeError(f"{variable} is required for provider {name}")
            return made(key, model, size)
    raise RuntimeError(f"unknown embedding provider: {name}")


def pending(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, limit: int | None = None) -> DataFrame:
    """Chunks without an embedding by this model; with a limit, the first in order of document and chunk."""
    done = embeddings.where((F.col("embedding_provider") == provider) & (F.col("embedding_model") == model)).select("chunk_id")
    left = chunks.join(done, "chunk_id", "left_anti")
    return left if limit is None else left.orderBy("document_id", "chunk_index").limit(limit)


def embedded_rows(chunks: DataFrame, provider: EmbeddingProvider, now) -> DataFrame:
    """Rows of the embeddings table for these chunks."""
    return provider.embed(chunks.select("chunk_id", "text"), "text", "embedding").select(
        "chunk_id", F.lit(provider.provider_name).alias("embedding_provider"), F.lit(provider.model_name).alias("embedding_model"),
        F.size("embedding").alias("embedding_dim"), "embedding", F.lit(now).cast("timestamp_ntz").alias("embedded_at"),
    )


def md5_place(term, dimensions: int):
    """(slot, sign) by MD5 with built-in functions alone, for engines that must agree without UDFs."""
    digest = F.md5(term)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dimensions), F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def md5_embedding(df: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    """(id, slot, value): the non-zero entries of unit vectors."""
    terms = df.select(id_col, F.explode(terms_of(F.col(text_col))).alias("term"))
    slot, sign = md5_place(F.col("term"), dimensions)
    sums = terms.select(id_col, slot.alias("slot"), sign.alias("sign")).groupBy(id_col, "slot").agg(F.sum("sign").alias("v")).where("v <> 0")
    norms = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, id_col).select(id_col, "slot", (F.col("v") / F.col("norm")).alias("value"))
