"""Incremental ingest: each micro-batch of a stream is one keyed change of a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.sources import store as S
from evidentia.sources.store import Store


def in_file_order(rows: DataFrame) -> DataFrame:
    """Adds ``file_order`` to rows of a Parquet source: their file's time of change, its path, and their place in it. Spark deals
    files to tasks by their size, so no place in a batch tells which row came last."""
    meta = F.col("_metadata")
    return rows.select("*", F.struct(meta["file_modification_time"].alias("time"), meta["file_path"].alias("path"), meta["row_index"].alias("row")).alias("file_order"))


def stream_upserts(store: Store, table: str, rows: DataFrame, checkpoint: str, columns: list[str] | None = None, order: Column | None = None) -> StreamingQuery:
    """Upserts a stream's rows by the table's key until the stream's present input is used up. Of a key's
    rows in a batch the last by ``order`` wins; without one, ``rows`` come from Parquet files, and the last row of
    the latest file wins. A batch that is run again after a failure changes nothing, as its rows replace themselves."""
    keys = S.KEYS[table]
    placed = in_file_order(rows) if order is None else rows.withColumn("file_order", order)

    def apply(batch: DataFrame, _: int) -> None:
        with store.staged(S.last_of(batch, keys, F.col("file_order")).drop("file_order")) as once:
            store.upsert(table, once, columns)

    return placed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
