"""Scoring payloads in JSON: {requirements, claims} or a flat list whose items are either or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, requirement_id string, text string, criticality int, necessity string, weight double, met boolean, match_type string, evidence_spans array<string>, corroboration double, integrity_factor double, confidence double, rationale string, adjacency_note string"
WHOLE = f"requirements array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, claims array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, payload): one file for each run, numbered by the hash of its name."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.xxhash64("file").alias("run_id"), F.col("value").alias("payload"))


def parse(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads (run_id, payload) to requirements and claims; an item of a flat list with `criticality` or `necessity` is a requirement, one with `met` or `match_type` a claim."""
    own = F.from_json("payload", WHOLE)
    flat = F.from_json("payload", f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")
    is_list = F.trim("payload").startswith("[")
    rows = payloads.select("run_id", F.when(is_list, flat).alias("flat"), F.when(~is_list, own).alias("own"))
    asked = F.coalesce(F.filter("flat", lambda x: x["criticality"].isNotNull() | x["necessity"].isNotNull() | (x["met"].isNull() & x["match_type"].isNull())), F.col("own.requirements"))
    told = F.coalesce(F.filter("flat", lambda x: x["met"].isNotNull() | x["match_type"].isNotNull()), F.col("own.claims"))

    def key(i: Column) -> Column:
        return F.coalesce("x.id", "x.requirement_id", F.concat(F.lit("req-"), i))

    requirements = rows.select("run_id", F.posexplode(asked).alias("i", "x")).select(
        "run_id", F.col("i").alias("ordinal"), key(F.col("i")).alias("requirement_id"), "x.text", F.lit("hard_skill").alias("kind"),
        F.coalesce("x.criticality", F.lit(2)).alias("criticality"), F.coalesce(F.lower("x.necessity"), F.lit("required")).alias("necessity"), F.col("x.weight").cast("decimal(6,4)").alias("weight"),
    )
    claims = rows.select("run_id", F.posexplode(told).alias("i", "x")).select(
        "run_id", F.col("i").alias("pos"), F.coalesce("x.requirement_id", "x.id", F.concat(F.lit("req-"), F.col("i"))).alias("requirement_id"), F.coalesce("x.met", F.lit(False)).alias("met"),
        F.coalesce(F.lower("x.match_type"), F.lit("none")).alias("match_type"), F.coalesce("x.evidence_spans", F.array().cast("array<string>")).alias("evidence_spans"),
        F.col("x.corroboration").cast("decimal(6,4)").alias("corroboration"), F.col("x.integrity_factor").cast("decimal(6,4)").alias("integrity_factor"),
        F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("x.rationale", F.lit("")).alias("rationale"), "x.adjacency_note",
    )
    return requirements, claims


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256) of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
