"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new temporary folder, which only a local session may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evidentia-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_apart(df: DataFrame, apart: Column) -> tuple[DataFrame, DataFrame]:
    """As ``stored``, in one pass over ``df``: the rows where ``apart`` is not true, and those where it is, as two
    tables that can be discarded by themselves."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evidentia-{uuid.uuid4().hex}"
    df.withColumn("__apart", F.coalesce(apart, F.lit(False)).cast("int")).write.partitionBy("__apart").parquet(path)

    def table(side: int) -> DataFrame:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/__apart={side}")
        if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return spark.createDataFrame([], df.schema)
        return spark.read.schema(df.schema).parquet(f"{path}/__apart={side}")

    return table(0), table(1)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/evidentia-" not in file:
                raise ValueError(f"not written here: {file}")
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes a query's shuffle files once it has ended, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
