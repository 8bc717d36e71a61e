"""Sinks: reprocessing replaces what it reprocessed, facts are appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "doc_bucket"


def with_bucket(df: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def replace_keys(new: DataFrame, keys: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Makes `new` the rows of all `keys` in a bucketed table, whatever rows they had; keys without new rows lose theirs.

    Only the buckets of the keys are read.  Their other rows and the new ones are written to a staging folder first, since a table cannot
    be overwritten while it is read, and then take the place of the touched buckets (dynamic partition overwrite).  A bucket that ends up
    empty is deleted.
    """
    spark = new.sparkSession
    touched = with_bucket(keys.select(key).distinct(), key, buckets)
    parts = [r[BUCKET] for r in touched.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
    if not parts:
        return
    fresh = with_bucket(new, key, buckets)
    if exists(spark, path):
        old = spark.read.schema(fresh.schema).parquet(path).where(F.col(BUCKET).isin(parts))
        kept = old.join(touched.select(key), key, "left_anti")
        rows = kept.select(*fresh.columns).unionByName(fresh)
    else:
        rows = fresh
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    rows.write.partitionBy(BUCKET).parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    filled = {r[BUCKET] for r in staged.select(BUCKET).distinct().collect()}
    for part in set(parts) - filled:
        _delete(spark, f"{path}/{BUCKET}={part}")
    _delete(spark, staging)


def drop_keys(keys: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Takes all rows of the keys out of a bucketed table, which may be missing or empty."""
    spark = keys.sparkSession
    if exists(spark, path):
        fs, where = _files(spark, path)
        if any(f.getPath().getName().startswith(f"{BUCKET}=") for f in fs.listStatus(where)):
            replace_keys(spark.read.parquet(path).drop(BUCKET).where("false"), keys, path, key, buckets)


def append_facts(df: DataFrame, path: str, time: str = "created_at") -> None:
    df.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document to a line."""
    reports.select("report").write.mode("overwrite").text(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)
