"""Structured Streaming forms of what happens live: run feeds, ingestion, re-uploads, call windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..sources.sinks import drop_keys, replace_keys


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t()) for n, t in fields.items()])


FEED = _struct(run_id=LongType, event_id=LongType, stage=StringType, failure_code=StringType)
LAST = _struct(state=StringType, ended=BooleanType)
EVENT = _struct(ts=LongType, event_id=LongType, state=StringType, impact_delta=DoubleType, failure_code=StringType)


class Lifecycle(StatefulProcessor):
    """Remembers a run's last state; events wait for the watermark, so that they are told in order."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else (None, False)
        if known[1]:
            return
        for part in rows:
            for r in part.itertuples(index=False):
                delta = None if pd.isna(r.impact_delta) else float(r.impact_delta)
                self.waiting.appendValue((int(pd.Timestamp(r.ts).value // 1000), int(r.event_id), r.state, delta, r.failure_code))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        yield from self._tell(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._tell(key, timerValues.getCurrentWatermarkInMs())
        if self.waiting.exists() and list(self.waiting.get()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)

    def _tell(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in events if e[0] // 1000 <= watermark_ms]
        state, ended = self.last.get() if self.last.exists() else (None, False)
        out = []
        for _, event_id, now, delta, code in due:
            if ended or now == state:
                continue
            state, ended = now, now in ("completed", "failed")
            stages = {"queued": ["queued"], "processing": ["scoring"], "failed": ["failed"]}.get(now, ["canary", "complete"] if delta is not None and delta > 0 else ["complete"])
            out += [(key[0], event_id, s, (code or "matching_failed") if s == "failed" else None) for s in stages]
        if due:
            self.last.update((state, ended))
            rest = [] if ended else events[len(due) :]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if out:
            yield pd.DataFrame(out, columns=FEED.fieldNames())

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, late: str = "10 minutes", timeout_ms: int = 300_000) -> DataFrame:
    """The feed of every run: the stage names of its state changes up to the first final one.  Needs the RocksDB state store."""
    return events.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(Lifecycle(timeout_ms), outputStructType=FEED, outputMode="Append", timeMode="EventTime")


class BrokenDetector(RuntimeError):
    """More documents fail than a fault of documents explains."""


def isolated(batch: DataFrame, detect: Callable[[DataFrame], DataFrame], folder: str, key: str, most: int, code_of: Callable[[Exception], str]) -> tuple[DataFrame | None, list[tuple]]:
    """What detect finds in a batch, and (key, failure_code) of the documents at which it breaks.

    The whole batch is tried first.  Where it breaks, both halves of its keys (by a bit of their hash) are tried, and so on down to single
    documents, so one poisoned document costs a logarithm of tries and the others are all kept.  Each try is written to the folder, since
    a plan breaks only when it runs.  Beyond `most` failures it is the detector that is broken, and its error is raised.
    """
    spark, found, failed = batch.sparkSession, None, []
    parts = [(0, 0)]
    while parts:
        bits, rest = parts.pop()
        part = batch.where(F.pmod(F.xxhash64(key), F.lit(1 << bits)) == rest)
        path = f"{folder}/try-{bits}-{rest}"
        try:
            made = detect(part)
            made.write.mode("overwrite").parquet(path)
            kept = spark.read.schema(made.schema).parquet(path)
            found = kept if found is None else found.unionByName(kept)
        except Exception as error:
            keys = [r[0] for r in part.select(key).distinct().limit(2).collect()]
            if len(keys) > 1 and bits < 60:
                parts += [(bits + 1, rest), (bits + 1, rest + (1 << bits))]
                continue
            failed.append((keys[0], code_of(error)))
            if len(failed) > most:
                raise BrokenDetector(f"more than {most} documents of a batch fail") from error
    return found, failed


def guarded(read: Callable[[dict], list[dict]], schema: StructType, key: str = "doc_id", code_of: Callable[[Exception], str] = lambda error: "extraction_failed") -> Callable[[DataFrame], DataFrame]:
    """A detector for `ingest` from a function of one document's row, whose error is the document's own: it is caught where it happens and told
    as the document's failure_code, so all of a batch is done in one pass however many documents break."""
    out = StructType([*schema.fields, StructField("failure_code", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for row in b.to_pylist():
                try:
                    told += [{**x, "failure_code": None} for x in read(row)]
                except Exception as error:  # noqa: BLE001
                    told.append({key: row[key], "failure_code": code_of(error)})
            if told:
                yield pa.RecordBatch.from_pylist(told, schema=to_arrow_schema(out))

    return lambda batch: batch.mapInArrow(run, out)


def ingest(
    spans: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    rejects: str | None = None,
    check: Callable[[DataFrame], DataFrame] | None = None,
    key: str = "doc_id",
    most: int = 100,
    code_of: Callable[[Exception], str] = lambda error: "extraction_failed",
):
    """Runs detectors over each batch of whole documents and replaces their findings; a rerun of a batch gives the same table.

    With a table of rejects, documents that `check` refuses (key, failure_code) or at which detect breaks go there and lose what was stored
    of them; the rest of the batch is stored, and a document that later succeeds leaves the rejects.  A detector that tells its own failures
    (`guarded`) sends them to the rejects too, any number of them.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        keys = batch.select(key)
        if rejects is None:
            replace_keys(detect(batch), keys, path, key)
        else:
            schema = StructType([batch.schema[key], StructField("failure_code", StringType())])
            refused = batch.sparkSession.createDataFrame([], schema) if check is None else check(batch).select(key, "failure_code").distinct()
            found, failed = isolated(batch.join(refused, key, "left_anti"), detect, f"{checkpoint}-tries/{number}", key, most, code_of)
            told = refused.unionByName(batch.sparkSession.createDataFrame(failed, schema))
            if found is not None and "failure_code" in found.columns:
                own = found.where("failure_code is not null").select(key, "failure_code").distinct()
                told, found = told.unionByName(own), found.join(own, key, "left_anti").drop("failure_code")
            replace_keys(told, keys, rejects, key)
            if found is None:  # nothing succeeded: what was stored goes
                drop_keys(keys, path, key)
            else:
                replace_keys(found, keys, path, key)
        batch.unpersist()

    return spans.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def new_uploads(uploads: DataFrame, stored: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads that are neither repeated in the stream nor stored already."""
    first = uploads.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["user_id", "sha256"])
    return first.join(stored.select("user_id", "sha256"), ["user_id", "sha256"], "left_anti")


def call_windows(calls: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls by tumbling window, purpose and model; what comes later than the watermark is dropped."""
    grouped = calls.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "purpose", "model")
    return grouped.agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).select("w.start", "w.end", "purpose", "model", "n", "input_tokens", "output_tokens")


def usage_limits(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Attempts of each user by minute: (start, user_id, n).  The sliding hour follows from them (`sliding_hours`), so no attempt is held sixty times."""
    return runs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 minute").alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "user_id", "n")


def sliding_hours(minutes: DataFrame, size: int = 60) -> DataFrame:
    """(end, user_id, n) of each user's sliding hour that moves by the minute, where it holds something, from counts by minute.

    A minute's count comes with the hour that ends after it and goes `size` minutes later; between two such changes the sum stays, so the
    rows of a stretch are made where it is found.  A user's blocks of `size` minutes are windows of their own: what an earlier block leaves
    comes in with the minutes of that block.
    """
    block = lambda m: F.floor(m / size)
    own = minutes.select("user_id", (F.unix_seconds("start") / 60).cast("long").alias("m"), "n")
    both = own.select("user_id", "m", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).withColumn("block", block(F.col("m")) + F.col("later"))
    # in its own block a minute comes (from m on), in the next it is there from the beginning and goes
    begin = F.col("block") * size
    change = F.when(F.col("later") == 0, F.array(F.struct(F.col("m").alias("at"), F.col("n").alias("change")))).otherwise(
        F.array(F.struct(begin.alias("at"), F.col("n").alias("change")), F.struct((F.col("m") + size).alias("at"), (-F.col("n")).alias("change")))
    )
    steps = both.select("user_id", "block", F.inline(change)).groupBy("user_id", "block", "at").agg(F.sum("change").alias("change"))
    along = Window.partitionBy("user_id", "block").orderBy("at")
    told = steps.withColumns({"n": F.sum("change").over(along), "until": F.coalesce(F.lead("at").over(along), (F.col("block") + 1) * size)})
    ends = told.where((F.col("n") > 0) & (F.col("until") > F.col("at"))).withColumn("e", F.explode(F.sequence("at", F.col("until") - 1)))
    return ends.select(F.timestamp_seconds((F.col("e") + 1) * 60).alias("end"), "user_id", "n")
