"""A table as numbered snapshots with compare-and-set: a commit names the snapshot that it was made from, and fails if
another one was committed since.

A snapshot is a Parquet folder, and its commit a small file named by its number, which the file system lets be created
once, as HDFS and a local folder do; object stores need a client with conditional puts. Readers take the largest committed
number, never a snapshot half written: a commit file still without its content does not count. A writer that dies between
the two leaves its number taken, and writers to come end in Conflict until that empty file is removed. A writer that loses
leaves a folder that nothing refers to. The folder has to be one that all executors see."""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer committed the next number first."""


class Snapshots:
    """A table in `folder`. Numbers start at 0; `version` is None before the first."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def version(self) -> int | None:
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return None
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit() and s.getLen() > 0]
        return max(numbers, default=None)

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot, the last one unless a number is given."""
        n = self.version if version is None else version
        if n is None:
            raise ValueError(f"{self.folder} has no snapshot")
        name = self.spark.read.text(f"{self.folder}/commits/{n:020d}").first()["value"]
        return self.spark.read.parquet(f"{self.folder}/data/{name}")

    def commit(self, rows: DataFrame, base: int | None) -> int:
        """Writes rows as the snapshot after `base`, None for the first; Conflict if that number is taken."""
        number = 0 if base is None else base + 1
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        at = self._path(f"{self.folder}/commits/{number:020d}")
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or self._fs.exists(at):
                raise Conflict(number) from None
            raise
        out.write(bytearray(name, "ascii"))
        out.close()
        return number

    def update(self, change, attempts: int = 5) -> int | None:
        """Commits change(last snapshot or None), made again from the newer snapshot after each conflict; nothing, and None,
        where change returns None."""
        for _ in range(attempts):
            base = self.version
            rows = change(None if base is None else self.read(base))
            if rows is None:
                return None
            try:
                return self.commit(rows, base)
            except Conflict:
                continue
        raise Conflict(f"{attempts} attempts on {self.folder}")
