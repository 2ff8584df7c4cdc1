"""Tables as files dealt by a hash of an owner column, changed bucket by bucket.

A version is a small JSON file ``v<number>`` that names the folder of each bucket. A change reads the
buckets of the owners that it is about, writes their next state into a new folder, checks it there,
and then makes the next version's file, in which all other buckets keep their folders. Readers take
one version's file and see all of a change or nothing of it; a second writer of the same version is
refused. Folders that no kept version names go with ``vacuum``.

Rows of a bucket are in one file, or several of ``rows_in_file`` or one of each part, sorted by ``sort`` with Bloom filters
on ``bloom``, so that a lookup by owner reads one bucket and of it the row groups that may hold the key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"
#: Rows that have this column are dealt by it already, and rows of one part are of one bucket.
PART = "__part"


class BucketedTable:
    """``buckets`` holds for the first version; later ones keep its number until ``write`` is given another."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, owner: str, buckets: int = 64, sort: tuple[str, ...] = (), bloom: tuple[str, ...] = (), rows_in_file: int = 0):
        self.spark, self.path, self.schema, self.owner, self.first, self.sort, self.bloom, self.rows_in_file = spark, path.rstrip("/"), schema, owner, buckets, sort, bloom, rows_in_file

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def versions(self) -> list[int]:
        """Versions that were written and checked."""
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return []
        found = [(s.getPath().getName(), s) for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n, s in found if n[0] == "v" and n[1:].isdigit() and s.isFile() and s.getLen())

    def manifest(self, version: int) -> dict:
        """{"buckets": number, "folders": {bucket: folder}, "facts": {...}}; a bucket without rows has no folder."""
        fs, where = self._fs(f"{self.path}/v{version}")
        stream = fs.open(where)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _latest(self) -> tuple[int, dict]:
        found = self.versions()
        return (found[-1], self.manifest(found[-1])) if found else (0, {"buckets": self.first, "folders": {}, "facts": {}})

    def bucket_of(self, owner: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(owner.cast(self.schema[self.owner].dataType)), F.lit(buckets)).cast("int")

    def dealt(self, df: DataFrame, parts: int) -> DataFrame:
        """Adds PART: each bucket in ``parts`` parts, so that what follows, and the write, take a part at a time and shuffle no more."""
        n = self._latest()[1]["buckets"] * parts
        return df.withColumn(PART, self.bucket_of(F.col(self.owner), n)).repartition(n, PART)

    def _paths(self, manifest: dict, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = None if buckets is None else {str(b) for b in buckets}
        return [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if wanted is None or b in wanted]

    def _of(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        paths = self._paths(manifest, buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(self._latest()[1])

    def facts(self) -> dict:
        return self._latest()[1]["facts"]

    def buckets(self) -> int:
        return self._latest()[1]["buckets"]

    def lookup(self, owners: list) -> DataFrame:
        """The rows of a few owners, from their buckets alone."""
        _, manifest = self._latest()
        asked = self.spark.createDataFrame([(o,) for o in owners], f"owner {self.schema[self.owner].dataType.simpleString()}")
        return self._of(manifest, self._buckets(asked, "owner", manifest)).where(F.col(self.owner).isin(*owners))

    def _buckets(self, owners: DataFrame, column: str, manifest: dict) -> list[int]:
        """At most as many as the table has."""
        return sorted(r[0] for r in owners.select(self.bucket_of(F.col(column), manifest["buckets"])).distinct().collect())

    def _written(self, df: DataFrame, buckets: int) -> dict[str, str]:
        """Writes rows into a new folder; the folder by bucket."""
        folder = f"data-{uuid.uuid4().hex}"
        own = df.select([F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(BUCKET, self.bucket_of(F.col(self.owner), buckets))
        out = (own if PART in df.columns else own.repartition(BUCKET)).sortWithinPartitions(BUCKET, *self.sort).write.partitionBy(BUCKET)
        for c in self.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (out.option("maxRecordsPerFile", self.rows_in_file) if self.rows_in_file else out).parquet(f"{self.path}/{folder}")
        fs, where = self._fs(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return {n.partition("=")[2]: folder for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, version: int, manifest: dict, made: dict[str, str], check: Callable[[DataFrame], str] | None) -> int:
        broken = check(self._of({"folders": made})) if check else ""
        if broken:
            for folder in set(made.values()):
                fs, where = self._fs(f"{self.path}/{folder}")
                fs.delete(where, True)
            raise ValueError(broken)
        fs, where = self._fs(f"{self.path}/v{version}")
        stream = fs.create(where, False)  # refuses a version that another writer made meanwhile
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return version

    def write(self, df: DataFrame, check: Callable[[DataFrame], str] | None = None, buckets: int | None = None, facts: dict | None = None) -> int:
        """The next version, of these rows alone. ``check`` returns what is wrong with new rows, else an empty text.
        ``facts`` are kept beside the folders, and stay through changes."""
        version, before = self._latest()
        buckets = buckets or before["buckets"]
        made = self._written(df, buckets)
        return self._commit(version + 1, {"buckets": buckets, "folders": made, "facts": before["facts"] if facts is None else facts}, made, check)

    def change(self, owners: DataFrame, next_state: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], str] | None = None) -> int:
        """The next version, in which the buckets of ``owners`` hold what ``next_state`` makes of their rows; it gets all rows
        of these buckets, and must give back rows of these buckets only. Without owners there is no new version."""
        version, before = self._latest()
        touched = self._buckets(owners, self.owner, before)
        if not touched:
            return version
        made = self._written(next_state(self._of(before, touched)), before["buckets"])
        strange = set(made) - {str(b) for b in touched}

        def checked(rows: DataFrame) -> str:
            return f"rows of buckets {sorted(strange)}, which the change is not about" if strange else check(rows) if check else ""

        kept = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        return self._commit(version + 1, before | {"folders": kept | made}, made, checked)

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all versions but the last ``keep``, and deletes the buckets that none of these names."""
        versions = self.versions()
        kept = {p for v in versions[-keep:] for p in self._paths(self.manifest(v))}
        old = {p for v in versions[:-keep] for p in self._paths(self.manifest(v))}
        for path in [*(old - kept), *(f"{self.path}/v{v}" for v in versions[:-keep])]:
            fs, where = self._fs(path)
            fs.delete(where, True)
