"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII white space: what separates words in every operator here.
SPACE_BYTES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a new temporary one only in local mode (tests), never on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back: cuts lineage, survives lost executors, and keeps columns prunable."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what `materialise` has written, once nothing is to be worked out from it again."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def known_id(documents: DataFrame) -> Column:
    """doc_id, numbers or strings, with a value of its type instead of null: joins as a key beside a flag for the null."""
    kind = documents.schema["doc_id"].dataType
    return F.coalesce(F.col("doc_id"), F.lit("" if isinstance(kind, StringType) else 0).cast(kind))


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops the columns that an operator is about to add: an input column with an output's name is replaced."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])
