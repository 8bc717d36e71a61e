"""Which of several equal things is kept, and what a new request does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_hash(df: DataFrame, keys: list[str], order: list[str], salts: int = 32) -> DataFrame:
    """Adds `is_duplicate` and `duplicate_of` (the first row's id, which is the last column of `order`).  Rows with a null key are no duplicates.

    Rows are dealt out once, by key and salt, so a text that half of the rows have is spread over many tasks.  Each of them finds its first
    row, the firsts of a key (at most `salts`) are compared, and the result goes back to each key and salt.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [*keys, "salt"]
    rows = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts))).repartition(n, *parts)
    # no filter on the keys here: both sides of the join read one exchange, and null keys find no partner
    firsts = rows.groupBy(*parts).agg(F.min(F.struct(*order)).alias("own"))
    told = firsts.withColumn("first", F.min("own").over(Window.partitionBy(*keys))).drop("own")
    rows = rows.join(told, parts, "left")
    duplicate = F.coalesce(F.struct(*order) != F.col("first"), F.lit(False))
    return rows.withColumns({"is_duplicate": duplicate, "duplicate_of": F.when(duplicate, F.col(f"first.{order[-1]}"))}).drop("first", "salt")


RUN_KEY = ["resume_id", "job_id", "prompt_version_id", "scoring_version"]


def run_keys(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds action, run_id, reused and duplicate to match requests: a live or finished run is returned, a failed one is queued again, else one is made."""
    known = existing.groupBy(*RUN_KEY).agg(F.max_by(F.struct("run_id", "state"), F.struct("created_at", "run_id")).alias("e")).select(*RUN_KEY, F.col("e.run_id").alias("run_id"), F.col("e.state").alias("state"))
    rows = requests.join(known, RUN_KEY, "left")
    action = F.when(F.col("run_id").isNull(), "create").when(F.col("state") == "failed", "requeue").otherwise("return")
    return rows.withColumns({"action": action, "reused": F.col("run_id").isNotNull(), "duplicate": F.coalesce(F.col("state") != "failed", F.lit(False))}).drop("state")


def new_only(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(stored.select(*keys), keys, "left_anti")


def state_changes(events: DataFrame, order: list[str], key: str = "run_id") -> DataFrame:
    """Events at which the state differs from the one before."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(~F.col("state").eqNullSafe(F.col("before"))).drop("before")


def stages(events: DataFrame, order: list[str]) -> DataFrame:
    """The feed of a run: a row for each stage shown (a positive delta shows `canary` before `complete`), nothing after the first final state."""
    along = Window.partitionBy("run_id").orderBy(*order)
    final = F.col("state").isin("completed", "failed").cast("int")
    open_ = state_changes(events, order).withColumn("ended", F.coalesce(F.sum(final).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("ended = 0")
    return open_.withColumn("stage", F.explode(stage_names(F.col("state"), F.col("impact_delta")))).withColumn("failure_code", F.when(F.col("stage") == "failed", F.coalesce("failure_code", F.lit("matching_failed")))).drop("ended")


def stage_names(state: Column, delta: Column) -> Column:
    return (
        F.when(state == "queued", F.array(F.lit("queued")))
        .when(state == "processing", F.array(F.lit("scoring")))
        .when((state == "completed") & (delta > 0), F.array(F.lit("canary"), F.lit("complete")))
        .when(state == "completed", F.array(F.lit("complete")))
        .otherwise(F.array(F.lit("failed")))
    )
