"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it back. The folder is the one the cluster
names in ``spark.checkpoint.dir``; only where that is unset (tests, a single machine) is a local one made.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, chosen once. Where none is set, only a master on this machine may have its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spanloom.local.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spanloom.local.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables this process has made; for when the results built on them have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the shuffle files of queries that are over. It only sees which these are when garbage is
    collected here and in the driver, which without memory in demand may be long after a later query needs the disk. Files of the
    last query may stay until the next time."""
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """Names, writes, re-reads and drops the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _made.append(self.root)

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Writes ``df`` and reads it back with the same schema; returns it with its path."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        return self.read(df.schema, path), path

    def read(self, schema, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def save_by(self, df: DataFrame, column: str) -> dict[str, str]:
        """Writes ``df`` with one folder per value of ``column``; returns the folders that came out, by value."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in p.getFileSystem(conf).listStatus(p) if s.isDirectory()]
        return {n.partition("=")[2]: f"{path}/{n}" for n in names if n.startswith(f"{column}=")}

    def drop(self, *paths: str) -> None:
        """Removes tables no plan reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
