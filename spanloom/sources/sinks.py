"""Writes that can be repeated: whole traces replaced, rows appended once, rejected rows set aside.

A table of derived rows is a folder partitioned by a bucket of the trace id. A batch rewrites the buckets of the traces it
changed and no other (dynamic partition overwrite), so a batch that runs twice leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucketed(df: DataFrame, key: str = "trace_id", buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_traces(new: DataFrame, changed: DataFrame, path: str, key: str = "trace_id", buckets: int = BUCKETS) -> None:
    """Replaces all stored rows of the traces in ``changed`` by those of ``new``; traces without new rows lose theirs."""
    spark = new.sparkSession
    rows = bucketed(new, key, buckets)
    if exists(spark, path):
        touched = bucketed(changed.select(key).distinct(), key, buckets)
        old = spark.read.schema(rows.schema).parquet(path)
        keep = old.join(touched.select("bucket").distinct(), "bucket", "left_semi").join(touched.select(key), key, "left_anti").select(*rows.columns)
        # what is read is also what is overwritten, so it's staged first
        from spanloom.store import Workspace

        rows, _ = Workspace(spark, "replace").save(keep.unionByName(rows))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_once(new: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key isn't stored yet, one per key."""
    spark = new.sparkSession
    rows = new.dropDuplicates(key)
    if exists(spark, path):
        rows = rows.join(spark.read.schema(new.schema).parquet(path).select(*key), key, "left_anti").select(*new.columns)
    rows.write.mode("append").parquet(path)


def set_aside(rejected: DataFrame, path: str) -> None:
    """Dead letters: the row as JSON, with the reason."""
    rejected.select("reason", F.to_json(F.struct(*[c for c in rejected.columns if c != "reason"])).alias("row"), F.current_timestamp().alias("rejected_at")).write.mode("append").json(path)
