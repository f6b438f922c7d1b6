"""Lineage cuts: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch that removes a query's shuffle files as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_spaces: list[list["Scratch"]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that ``setCheckpointDir`` named.

    In local mode, where one machine does all, a temporary folder stands in for it; on a cluster that is an error, since executors
    would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="latticework-")
    return _own[app]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written by operators within the block are deleted at its end; use or save their results inside.

    Without it they stay until the driver ends, because a lazy result may read them.
    """
    _spaces.append([])
    try:
        yield
    finally:
        for scratch in _spaces.pop():
            scratch.clear()


class Scratch:
    """Tables of one job in the shared folder, so a lost executor costs a reread and no recomputation.

    ``put`` writes a frame and returns it read back; ``drop`` deletes those that are no longer needed. The rest goes at
    the end of a ``temporary`` block, or when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self._tables: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0
        if _spaces:
            _spaces[-1].append(self)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if self._n == 1:
            fs, p = self._files(self.root)
            fs.deleteOnExit(p)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(back)] = back, path
        return back

    def drop(self, df: DataFrame) -> None:
        _, path = self._tables.pop(id(df), (None, None))
        if path is not None:
            fs, p = self._files(path)
            fs.delete(p, True)

    def clear(self) -> None:
        """Deletes all tables that are left."""
        self._tables.clear()
        fs, p = self._files(self.root)
        fs.delete(p, True)
