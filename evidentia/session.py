"""Sessions and settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


def session(name: str = "evidentia", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() write where spark.checkpoint.dir says. Where that is unset, a new temporary
    folder serves, which only a local session may use."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(found or tempfile.mkdtemp(prefix="evidentia-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path where all machines can read and write: under spark.checkpoint.dir."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of up to 4 MB instead of 10,000 rows, however long these are. The setting stays in the session, as a
    plan reads it when it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def setting(name: str, default: str, legacy: str | None = None) -> str:
    """An environment variable by its name, else its older name; empty counts as unset."""
    return os.environ.get(name) or (os.environ.get(legacy) if legacy else None) or default


@dataclass(frozen=True)
class Settings:
    """EVIDENTIA_<NAME>, or the older EVIDENCE_<NAME>, in the environment overrides a default."""

    base: str = "evidence"
    chunk_target: int = 1000
    chunk_max: int = 1200
    chunk_overlap: int = 120
    provider: str = "local_hash"
    model: str = "local-hash-v1"
    dimensions: int = 384

    @classmethod
    def from_environment(cls) -> Settings:
        own = cls()
        return cls(**{k: type(v)(setting(f"EVIDENTIA_{k.upper()}", str(v), f"EVIDENCE_{k.upper()}")) for k, v in vars(own).items()})
