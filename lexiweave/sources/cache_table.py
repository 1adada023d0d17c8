"""A translation cache that many jobs share: a versioned table with conditional merges.

Layout of the folder: ``data/<name>`` holds the entries of one version as
Parquet (key, t, scope, ts), ``log/<number>`` names the version's data, the
cache's generation and the last flush of each writer. A version exists once its
log entry does, and a log entry is put in place by a rename that fails where
there is one already: of two writers that read the same version one commits,
the other reads anew and merges again. A writer that dies before the rename
leaves data that nothing names; the version before it stays as it was.

The folder has to be on a file system whose renames are atomic, such as HDFS,
and reachable from driver and executors.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.operators import cache as ca

SCHEMA = "key string, t string, scope string, ts timestamp"
COLUMNS = ("key", "t", "scope", "ts")


class Files:
    """The few calls of the cluster's file system that a table needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file under a name that is not taken yet; False where it is."""
        made = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(made), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(made), self.path(name), how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(self.path(made), False)
            return False


@dataclass(frozen=True)
class Version:
    number: int = 0
    data: str = ""
    generation: int = 0
    flushes: dict = field(default_factory=dict)


class CacheTable:
    """Entries by key, as of the newest version; ``most`` bounds how many of the newest are kept (None: all)."""

    def __init__(self, spark: SparkSession, folder: str, most: int | None = None):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        self.files = Files(spark, folder)

    def version(self) -> Version:
        numbers = [int(x) for x in self.files.names(f"{self.folder}/log") if x.isdigit()]
        if not numbers:
            return Version()
        return Version(number=max(numbers), **json.loads(self.files.read(f"{self.folder}/log/{max(numbers):020d}")))

    def read(self, version: Version | None = None) -> DataFrame:
        """The entries of a version (the newest): key, t, scope, ts; every key once."""
        at = version or self.version()
        if not at.data:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/data/{at.data}")

    def written(self, rows: DataFrame) -> str:
        """Entries put next to the versions; nothing names them yet."""
        name = uuid.uuid4().hex
        rows.select(*COLUMNS).write.parquet(f"{self.folder}/data/{name}")
        return name

    def committed(self, base: Version, data: str, generation: int, flushes: dict) -> bool:
        """Swap the pointer from base to data, unless another writer did so first."""
        entry = json.dumps({"data": data, "generation": generation, "flushes": flushes})
        return self.files.put_new(f"{self.folder}/log/{base.number + 1:020d}", entry)

    def merge(self, new: DataFrame, generation: int | None = None, flush: tuple[str, int] | None = None, tries: int = 20) -> Version | None:
        """Take in rows (key, t, scope, ts), the newest of each key counts; the version that holds them.

        None where the cache has moved on from the generation that the writer
        began in: what it made is void then. A flush (writer, number) that is in
        already is not taken in twice, so it can be tried again after a failure
        whose outcome is unknown.
        """
        for _ in range(tries):
            base = self.version()
            if generation is not None and generation != base.generation:
                return None
            if flush and base.flushes.get(flush[0], -1) >= flush[1]:
                return base
            rows = ca.upserted(self.read(base), new.select(*COLUMNS))
            data = self.written(ca.trimmed(rows, self.most) if self.most else rows)
            if self.committed(base, data, base.generation, base.flushes | ({flush[0]: flush[1]} if flush else {})):
                return self.version()
        raise RuntimeError(f"{tries} other writers came first")

    def clear(self) -> Version:
        """No entries, and a new generation, so that writers under way don't bring old ones back."""
        while True:
            base = self.version()
            if self.committed(base, "", base.generation + 1, base.flushes):
                return self.version()


def flushing(table: CacheTable, writer: str):
    """For foreachBatch: every micro-batch is merged once, also where the query tries it again."""

    def run(batch: DataFrame, number: int) -> None:
        table.merge(batch, flush=(writer, number))

    return run
