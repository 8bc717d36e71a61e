"""Registered queries that run as Structured Streaming jobs over the driver's tables until all of it is read; batch twins are their oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.adapters import Tables
from ..streaming import feeds, limits
from .common import Plan
from .operations import CHANGES, STATES
from .oracle import sql

PLAN = Plan()
query = PLAN.query
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession) -> str:
    """A new folder where the cluster's executors share files; a temporary one only in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith(("spark:", "yarn", "k8s", "local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-stream-')}/stream-{uuid.uuid4().hex}"


def source(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(t.read(name).schema).option("pathGlobFilter", f"{name}.parquet" if not _is_folder(t, name) else "*.parquet").parquet(f"{t.sf_dir}/{name}.parquet" if _is_folder(t, name) else t.sf_dir)


def _is_folder(t: Tables, name: str) -> bool:
    jvm = t.spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{name}.parquet")
    return path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/out")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    running = writer.start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


STAGES = """select run_id, event_id, stage, case when stage = 'failed' then coalesce(failure_code, 'matching_failed') end as failure_code from (select *, unnest(case state when 'queued' then ['queued'] when 'processing' then ['scoring'] when 'failed' then ['failed'] else case when impact_delta > 0 then ['canary', 'complete'] else ['complete'] end end) as stage
    from (select *, coalesce(sum((state in ('completed', 'failed'))::int) over (partition by run_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as ended from changes) where ended = 0)"""


@query(sql(STAGES, states=STATES, changes=CHANGES))
def run_feed_stream(t):
    return finished(feeds.lifecycle(t.state_events(source(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))), late="0 seconds"))


@query(sql("select distinct doc_id % 5 as user_id, sha256(text) as sha256 from documents where doc_id % 3 > 0 and not exists (select 1 from documents d where d.doc_id % 3 = 0 and d.doc_id % 5 = documents.doc_id % 5 and d.text = documents.text)"))
def new_upload_stream(t):
    sent = lambda df: df.select((F.col("doc_id") % 5).alias("user_id"), F.sha2("text", 256).alias("sha256"), F.timestamp_seconds(F.col("doc_id")).alias("created_at"), "doc_id")
    stored = sent(t.read("documents")).where("doc_id % 3 = 0").select("user_id", "sha256").distinct()
    return finished(feeds.new_uploads(sent(source(t, "documents")).where("doc_id % 3 > 0"), stored, late="3650 days").select("user_id", "sha256"))


@query(sql("select time_bucket(interval 1 hour, ts) as start, event_type as purpose, 'm' || user_id % 2 as model, count(*) as n, sum(event_id % 100)::bigint as input_tokens from events group by all"))
def call_window_stream(t):
    calls = source(t, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("purpose"), F.concat(F.lit("m"), F.col("user_id") % 2).alias("model"), (F.col("event_id") % 100).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    return finished(feeds.call_windows(calls), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "purpose", "model", "n", "input_tokens")


# --- usage limits -----------------------------------------------------------------------------------------------------------------

#: Few users, so that production limits are reached; the global one is lower.
LIMITS = metrics.Limits(global_spend=60_000)
ATTEMPTS = """select event_id, ts, epoch_us(ts) as moment, epoch_us(ts) // 86400000000 as today, user_id % 2 as user_id, case when event_type in ('view', 'signup') then 'run' when event_type = 'click' then 'job' else 'call' end as kind, (event_id % 97 * 10)::bigint as cost from events"""
COUNTED_ATTEMPTS = """select *, count(*) filter (kind = 'run') over (partition by user_id order by moment range between 3600000000 preceding and current row) as runs_last_hour,
    count(*) filter (kind = 'run') over (partition by user_id, today order by moment range between unbounded preceding and current row) as runs_today,
    count(*) filter (kind = 'job') over (partition by user_id, today order by moment range between unbounded preceding and current row) as jobs_today,
    coalesce(sum(cost) filter (kind = 'call') over (partition by user_id, today order by moment range between unbounded preceding and 1 preceding), 0)::bigint as spent_before from attempts"""
CLOSED = """select today, min(minute) as last, arg_min(spent, minute)::bigint as spent from (select today, minute, sum(cost) over (partition by today order by minute) as spent from (select today, moment // 60000000 as minute, sum(cost) as cost from attempts where kind = 'call' group by all))
    where spent >= 60000 group by today"""
TOLD = "case when kind = 'run' and runs_last_hour > 10 then 'hour' when kind = 'run' and runs_today > 50 then 'day' when kind = 'job' and jobs_today > 20 then 'jobs' when kind = 'call' and spent_before >= 20000 then 'spend'"
LIMIT_PARTS = {"attempts": ATTEMPTS, "counted": COUNTED_ATTEMPTS}


def attempts(t: Tables, events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "signup"), "run").when(F.col("event_type") == "click", "job").otherwise("call")
    return events.select((F.col("user_id") % 2).alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("created_at"), kind.alias("kind"), (F.col("event_id") % 97 * 10).alias("cost"))


@query(sql(f"select user_id, event_id, kind, runs_last_hour, runs_today, jobs_today, spent_before, {TOLD} when kind = 'call' and moment // 60000000 > last then 'global' end as limited_by from counted left join closed using (today)", **LIMIT_PARTS, closed=CLOSED))
def usage_decisions(t):
    """All limits over the attempts at once."""
    return metrics.usage_decisions(attempts(t, t.read("events")), LIMITS).select("user_id", "event_id", "kind", "runs_last_hour", "runs_today", "jobs_today", "spent_before", "limited_by")


@query(sql(f"select user_id, event_id, kind, runs_last_hour, runs_today, jobs_today, spent_before, {TOLD} end as limited_by from counted", **LIMIT_PARTS))
def usage_decision_stream(t):
    """A user's limits, decided by state as the attempts come."""
    return finished(limits.decisions(attempts(t, source(t, "events")), LIMITS, late="0 seconds"))


@query(sql("select today as day, (timestamp '1970-01-01' + to_minutes((last + 1)::int)) as closed_at, spent from closed", attempts=ATTEMPTS, closed=CLOSED))
def global_limit_stream(t):
    """From when on a day is closed, since all users together have spent its limit."""
    return finished(limits.closings(attempts(t, source(t, "events")), LIMITS, late="0 seconds")).withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz"))
