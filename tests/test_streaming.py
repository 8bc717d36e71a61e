import datetime as dt

from palimpsest.operators import dedup, detectors
from palimpsest.sources import sinks
from palimpsest.streaming import feeds

T0 = dt.datetime(2024, 1, 1)
EVENTS = "run_id long, event_id long, ts timestamp, state string, impact_delta double, failure_code string"
ROWS = [(1, 1, 0, "queued"), (1, 2, 1, "processing"), (1, 3, 2, "processing"), (1, 4, 3, "completed"), (1, 5, 4, "failed"), (2, 6, 5, "queued"), (2, 7, 6, "failed"), (3, 8, 7, "processing")]


def events(spark):
    return spark.createDataFrame([(r, e, T0 + dt.timedelta(minutes=m), s, 2.0 if s == "completed" else None, None) for r, e, m, s in ROWS], EVENTS)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_feed_equals_its_batch_twin(spark, tmp_path):
    # the last file moves the watermark past all others
    end = spark.createDataFrame([(99, 99, T0 + dt.timedelta(days=1), "queued", None, None)], EVENTS)
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.run_id, r.event_id, r.stage, r.failure_code) for r in drain(feeds.lifecycle(stream), "feed") if r.run_id != 99}
    twin = {(r.run_id, r.event_id, r.stage, r.failure_code) for r in dedup.stages(events(spark), ["ts", "event_id"]).collect()}
    assert got == twin and (1, 4, "canary", None) in got and (2, 7, "failed", "matching_failed") in got


def test_windows_and_uploads(spark, tmp_path):
    calls = spark.createDataFrame([(T0 + dt.timedelta(minutes=30 * i), "p", "m", 10, 1) for i in range(6)], "created_at timestamp, purpose string, model string, input_tokens long, output_tokens long")
    calls.write.parquet(str(tmp_path / "calls"))
    got = drain(feeds.call_windows(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))), "calls", "complete")
    assert sorted(r.n for r in got) == [2, 2, 2]
    ups = spark.createDataFrame([(T0, 1, "a"), (T0, 1, "a"), (T0, 1, "b"), (T0, 2, "a")], "created_at timestamp, user_id long, sha256 string")
    ups.write.parquet(str(tmp_path / "ups"))
    stored = spark.createDataFrame([(1, "b")], "user_id long, sha256 string")
    got = drain(feeds.new_uploads(spark.readStream.schema(ups.schema).parquet(str(tmp_path / "ups")), stored), "ups")
    assert sorted((r.user_id, r.sha256) for r in got) == [(1, "a"), (2, "a")]


def test_replacing_keeps_the_rest_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, v string")
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    sinks.replace_keys(table((1, "a"), (2, "b"), (3, "c")), keys(1, 2, 3), path, buckets=2)
    for _ in range(2):
        sinks.replace_keys(table((2, "B"), (2, "BB")), keys(2, 3), path, buckets=2)
        assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (2, "BB")]


def test_ingestion_stream(spark, tmp_path):
    from test_detectors import span, tables

    rows = spark.createDataFrame([span(0), span(1, font_size=1.0)], tables(spark, []).spans.schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "spans"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "spans"))
    detect = lambda b: detectors.micro_type(detectors.PageTables(b, None, None))
    q = feeds.ingest(stream, detect, str(tmp_path / "findings"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.detector_id for r in spark.read.parquet(str(tmp_path / "findings")).collect()] == ["D3"]
