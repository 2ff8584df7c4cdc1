"""The corpus pipeline: five stages over ``documents``, each of which reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import byte_bpe, decontaminate, near_dedup, pii, quality
from evidentia.llm.tables import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No stage is SQL from end to end; tests/llm/test_pipeline.py has cases planted for each.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality and toxic ones; texts without words (null, empty) count as of low
    quality. Rows are judged one by one, so repeated rows stay or go together."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: of the text that has the smallest id in it, at
    that id. Documents are told apart by id and text, so texts of one id are judged by their own classes.
    Null texts and texts without words are no duplicates; of rows with equal id and text one stays."""
    return near_dedup.one_of_each_class(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any ten-word window, or a whole shorter item, of the benchmark, by their
    text whatever their id. A null or empty text holds none; repeated rows stay or go together."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text. Null texts stay null, with a null n_chars."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to. A null text counts as empty."""
    made = byte_bpe.encode_documents(docs, carry=["source", "lang"])
    return made.select("doc_id", "source", "lang", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("personal_data", without_personal_data),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
