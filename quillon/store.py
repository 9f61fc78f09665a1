"""Where intermediate tables go, and how they are written and read back.

Iterative operators cut their lineage by writing a table and reading it again. On a
cluster the tables go to the folder named in ``spark.checkpoint.dir``, which all
machines share. A session on ``local`` without that setting gets a temporary folder.
What is still there when the session's JVM ends is deleted then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
        return _LOCAL[app]
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


class Stages:
    """A set of intermediate tables of one operator call.

    ``keep(df, name)`` writes ``df`` and returns the table that was written.
    ``drop(name)`` removes one that is no longer read.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        path, files = self._file("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``by``: columns with few values, of which a reader skips those that it does not ask for."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._file(name)
            files.delete(path, True)

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
