"""Operators whose point is how they scale: containment, vocabularies, first of equals, limits by state, rejects."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import containment, dedup, metrics, skills
from palimpsest.streaming import feeds, limits

from test_streaming import drain

T0 = dt.datetime(2024, 1, 1)


def said(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


# --- containment ------------------------------------------------------------------------------------------------------------------


def test_copies_share_anchors(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(containment, "CHUNK", 64)  # blocks end inside quotes
    for _ in range(200):
        quote = said(rng, 12, "ab")[:60]
        if len(quote) < containment.LEAST:
            continue
        before = said(rng, rng.randint(0, 60), "ab")
        own = set(zip(*(x.tolist() for x in containment.anchors(quote))))
        whole = set(zip(*(x.tolist() for x in containment.anchors(before + quote + said(rng, 9, "ab")))))
        assert own and {(h, p + len(before)) for h, p in own} <= whole
    assert len(containment.anchors("x" * (containment.LEAST - 1))[0]) == 0 and len(containment.anchors("x" * containment.LEAST)[0]) == 1


def test_contained_quotes_by_brute_force(spark):
    rng = random.Random(2)
    quotes = [said(rng, 14) for _ in range(30)] + ["z" * 45, "é" * 41, "short", None, "", "the same beginning of forty letters or so " + "a", "the same beginning of forty letters or so " + "b"]
    texts = []
    for k in range(120):
        held = [said(rng, rng.randint(0, 40))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            held.insert(rng.randint(0, len(held)), (rng.choice(quotes) or "").replace(" ", rng.choice([" ", "  ", "\n "])))
        texts.append((k % 90 or None, " ".join(held)))
    texts += [(500, None), (501, ""), (502, "z" * 3000), (502, "z" * 45), (503, "é" * 40)]
    q = spark.createDataFrame([(k, x) for k, x in enumerate(quotes + [quotes[0]])], "template_id int, body string")
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {(r.template_id, r.n_documents, r.first_doc) for r in metrics.quote_leaks(q, d).collect()}
    flat = lambda x: " ".join((x or "").split())
    want = set()
    for k, x in enumerate(quotes + [quotes[0]]):
        # rows without an id are found but no document
        inside = {i for i, t in texts if len(flat(x)) >= 40 and flat(x) in flat(t)} - {None}
        if inside:
            want.add((k, len(inside), min(inside)))
    assert got == want and len(want) > 15


# --- vocabulary -------------------------------------------------------------------------------------------------------------------


def test_large_vocabulary_with_a_hot_word(spark):
    rng = random.Random(3)
    names = [f"w{k}" for k in range(3000)]
    spans = [(k, f"s{k}", 1, k, f"The {rng.choice(names)} of {rng.choice(names)} {rng.choice(names)}, c++ now" if k % 3 else "the the") for k in range(1500)]
    aliases = [("THE", "the"), ("OF", "of"), ("C++", "c++"), ("+", "++"), ("NEVER", "the never")] + [(f"N{k}", f"{rng.choice(names)} {rng.choice(names)}") for k in range(20_000)] + [(f"O{k}", f"of {n}") for k, n in enumerate(names)] + [(f"P{k}", f"w{k}") for k in range(0, 3000, 3)]
    table = spark.createDataFrame(spans, "doc_id long, span_id string, page int, seqno int, text string").repartition(4)
    vocab = spark.createDataFrame(aliases, "canonical string, alias string")
    for shares in (64, 1):
        got = {(r.span_id, r.canonical) for r in skills.match_vocabulary(table, vocab, shares).collect()}
        by_alias = {}
        for c, a in aliases:
            by_alias.setdefault(a, []).append(c)
        want = set()
        for *_, no, text in spans:
            words = text.lower().replace(",", "").split()
            runs = set(words) | {" ".join(p) for p in zip(words, words[1:])}
            if "," in text:  # the comma parts the last word from what follows
                runs.discard(" ".join(words[4:6]))
            want |= {(f"s{no}", c) for r in runs for c in by_alias.get(r, [])}
        assert {x for x in got if x[1] != "+"} == want
    # the hot word's rows are dealt out: no key and salt holds over twice an even share
    low = table.select("doc_id", "span_id", F.lower("text").alias("low"))
    counts = skills.word_counts(low, vocab.select(F.explode(F.split("alias", " ")).alias("word")).distinct())
    assert counts.where("word = 'the'").first().n == 1500


# --- first of equals --------------------------------------------------------------------------------------------------------------


def test_half_of_all_texts_equal(spark):
    rows = [(k, "hot" if k % 2 else f"t{k % 700}", k % 5) for k in range(4000)] + [(9000, None, 1), (9001, None, 0)]
    df = spark.createDataFrame(rows, "id long, sha string, at long")
    told = dedup.first_by_hash(df, ["sha"], ["at", "id"])
    got = {r.id: (r.is_duplicate, r.duplicate_of) for r in told.collect()}
    first = {}
    for i, s, at in rows:
        first[s] = min(first.get(s, (at, i)), (at, i))
    assert got == {i: (False, None) if s is None or first[s] == (at, i) else (True, first[s][1]) for i, s, at in rows}
    # one exchange of the rows, by key and salt, and tasks are even
    salted = df.withColumn("salt", F.pmod(F.xxhash64("at", "id"), F.lit(32))).repartition(8, "sha", "salt").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in salted.collect()) < 3 * len(rows) / 8


# --- limits -----------------------------------------------------------------------------------------------------------------------

ATTEMPT = "user_id long, event_id long, created_at timestamp, kind string, cost long"


@pytest.fixture(scope="module")
def attempts(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, T0 + dt.timedelta(seconds=rng.choice([60, 7, 1]) * rng.randint(0, 5000)), rng.choice(["run", "run", "job", "call"]), rng.randint(0, 900)) for k in range(900)]
    rows += [(4, 5000 + k, T0 + dt.timedelta(hours=5), "run", 0) for k in range(12)] + [(4, 6000, T0 + dt.timedelta(hours=6), "run", 0), (4, 6001, T0 + dt.timedelta(hours=6, microseconds=1), "run", 0), (4, 6002, T0 + dt.timedelta(days=4), "job", 0)]
    return spark.createDataFrame(rows, ATTEMPT)


def brute_limits(rows, most):
    out = {}
    for u, e, at, kind, _ in rows:
        mine = [r for r in rows if r[0] == u]
        same_day = [r for r in mine if r[2].date() == at.date()]
        hour = sum(r[3] == "run" and at - dt.timedelta(hours=1) <= r[2] <= at for r in mine)
        runs, jobs = (sum(r[3] == k and r[2] <= at for r in same_day) for k in ("run", "job"))
        spent = sum(r[4] for r in same_day if r[3] == "call" and r[2] < at)
        out[e] = (hour, runs, jobs, spent, most.told(kind, hour, runs, jobs, spent))
    return out


def test_limits_by_state_equal_their_batch_twin_and_brute_force(spark, attempts, tmp_path):
    most = metrics.Limits(hour=10, day=50, jobs=20, spend=20_000, global_spend=40_000)
    want = brute_limits([tuple(r) for r in attempts.collect()], most)
    assert {x[-1] for x in want.values()} == {None, "hour", "day", "jobs", "spend"}
    batch = {r.event_id: r for r in metrics.usage_decisions(attempts, most).collect()}
    assert {e: (r.runs_last_hour, r.runs_today, r.jobs_today, r.spent_before) for e, r in batch.items()} == {e: x[:4] for e, x in want.items()}
    assert all(r.limited_by == want[e][4] for e, r in batch.items() if not r.closed or want[e][4])
    assert all(r.limited_by in ("global", "spend") for r in batch.values() if r.closed) and any(r.closed for r in batch.values())
    # in several files, in order of time, so that state is carried from batch to batch
    for k in range(4):
        cut = attempts.where((F.floor(F.unix_seconds("created_at") / 43_200) - F.floor(F.lit(int(T0.timestamp())) / 43_200)).cast("int") == k) if k < 3 else attempts.where(F.unix_seconds("created_at") >= int(T0.timestamp()) + 3 * 43_200)
        cut.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = {r.event_id: (r.runs_last_hour, r.runs_today, r.jobs_today, r.spent_before, r.limited_by) for r in drain(limits.decisions(stream, most, late="1 second"), "decisions")}
    assert told == {e: x for e, x in want.items() if e in told} and len(told) >= len(want) - 1  # the last attempt waits for the watermark
    days = {r.day: r.closed_at for r in drain(limits.closings(stream, most, late="1 second"), "closings")}
    first = min(r.created_at for r in batch.values() if r.closed)
    assert days and min(days.values()) <= first


# --- rejects ----------------------------------------------------------------------------------------------------------------------


def test_poisoned_documents_are_rejected_and_the_rest_stored(spark, tmp_path):
    rows = [(d, s, "bad" if d in (3, 77) and s == 1 else "" if d == 5 else "fine") for d in range(100) for s in range(3)]
    spark.createDataFrame(rows, "doc_id long, seqno int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, seqno int, text string").parquet(str(tmp_path / "in"))
    detect = lambda b: b.select("doc_id", F.when(F.col("text") == "bad", F.raise_error(F.lit("poison"))).otherwise(F.col("seqno")).alias("seqno"))
    check = lambda b: b.groupBy("doc_id").agg(F.max("text").alias("t")).where("t = ''").select("doc_id", F.lit("invalid_input").alias("failure_code"))
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    for k in range(2):
        feeds.ingest(stream, detect, out, str(tmp_path / f"c{k}"), rejects, check).trigger(availableNow=True).start().awaitTermination()
        assert sorted((r.doc_id, r.failure_code) for r in spark.read.parquet(rejects).collect()) == [(3, "extraction_failed"), (5, "invalid_input"), (77, "extraction_failed")]
        assert sorted((r.doc_id, r.seqno) for r in spark.read.parquet(out).collect()) == [(d, s) for d in range(100) for s in range(3) if d not in (3, 5, 77)]
    # a document that later succeeds leaves the rejects
    mended = lambda b: b.select("doc_id", "seqno")
    feeds.ingest(stream, mended, out, str(tmp_path / "c3"), rejects).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("doc_id long, failure_code string").parquet(rejects).count() == 0 and spark.read.parquet(out).count() == 300
    # all documents of a batch refused: nothing stays of them, and the empty tables can be written again
    all_bad = lambda b: b.select("doc_id", F.lit("invalid_input").alias("failure_code"))
    for k, one in enumerate((all_bad, None)):
        feeds.ingest(stream, mended, out, str(tmp_path / f"c{5 + k}"), rejects, one).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.schema("doc_id long, seqno int").parquet(out).count() == 300 * k
    with pytest.raises(Exception, match="more than 1 documents"):
        feeds.ingest(stream, detect, out, str(tmp_path / "c4"), rejects, most=1).trigger(availableNow=True).start().awaitTermination()


# --- growth -----------------------------------------------------------------------------------------------------------------------


def test_hour_sums_have_no_sliding_frame(spark, attempts):
    plan = metrics.usage_decisions(attempts)._jdf.queryExecution().optimizedPlan().toString()
    assert "-3600000000" not in plan and "hour" in plan


def test_a_busy_day_in_one_step():
    import time

    import numpy as np

    due = np.zeros(200_000, limits.ATTEMPT)
    due["at"], due["kind"], due["cost"] = np.sort(np.arange(200_000) // 3 * 300_000), np.arange(200_000) % 3, 5
    began = time.perf_counter()
    out = list(limits.UsageState(metrics.Limits())._tell((1, 0), due, np.array([-1], np.int64), 0, 0, 0))
    assert time.perf_counter() - began < 20 and sum(map(len, out)) == 200_000
    last = out[-1].iloc[-1]
    assert last.runs_today == 66_667 and last.jobs_today == 66_667 and last.spent_before == 66_666 * 5 and last.runs_last_hour == 12_001


def test_any_number_of_broken_documents_in_one_pass(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    def read(row):
        if row["doc_id"] % 2:
            raise ValueError("unreadable")
        return [{"doc_id": row["doc_id"], "n": row["n"]}] * 2

    spark.range(600).selectExpr("id as doc_id", "id * 3 as n").coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, n long").parquet(str(tmp_path / "in"))
    detect = feeds.guarded(read, StructType([StructField("doc_id", LongType()), StructField("n", LongType())]))
    feeds.ingest(stream, detect, str(tmp_path / "out"), str(tmp_path / "c"), str(tmp_path / "rejects")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "rejects")).where("failure_code = 'extraction_failed'").collect()) == list(range(1, 600, 2))
    assert sorted((r.doc_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted([(d, 3 * d) for d in range(0, 600, 2)] * 2)


def test_sliding_hours_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(T0 + dt.timedelta(minutes=m), u, rng.randint(1, 4)) for u in (1, 2) for m in rng.sample(range(400), 12)] + [(T0 + dt.timedelta(minutes=m), 3, 1) for m in (0, 59, 60, 61, 119, 120, 500)]
    got = {(r.end, r.user_id): r.n for r in feeds.sliding_hours(spark.createDataFrame(rows, "start timestamp, user_id long, n long")).collect()}
    want = {}
    for at, u, n in rows:
        for k in range(1, 61):
            end = at + dt.timedelta(minutes=k)
            want[end, u] = want.get((end, u), 0) + n
    assert got == want


def test_small_and_large_vocabularies_agree(spark):
    table = spark.createDataFrame([(k, f"s{k}", 1, k, "The end of the day, w%d and c++" % (k % 7)) for k in range(50)], "doc_id long, span_id string, page int, seqno int, text string")
    vocab = spark.createDataFrame([("THE", "the"), ("DAY", "of the day"), ("W", "w3"), ("W", "w4"), ("NO", "of day")], "canonical string, alias string")
    told = [sorted(map(tuple, skills.match_vocabulary(table, vocab, small=n).collect())) for n in (0, 100)]
    assert told[0] == told[1] and {x[4] for x in told[0]} == {"THE", "DAY", "W"}
    # texts are dealt out by no word
    plan = skills.match_vocabulary(table, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 1


def test_extraction_quality_loses_no_pair(spark):
    rng = random.Random(9)
    said_ = lambda: " ".join(rng.sample(["a1", "b2", "c3", "d4", "e5", "f6"], rng.randint(1, 6)))
    truth, told = ([(j, k, said_(), "required", 1) for j in range(25) for k in range(5)] for _ in range(2))
    schema = "job_id int, ordinal int, text string, necessity string, criticality int"
    for least in (0.34, 0.5, 2 / 3, 0.9, 1.0):
        got = {r.job_id: r.matched for r in metrics.extraction_quality(spark.createDataFrame(truth, schema), spark.createDataFrame(told, schema), least).collect()}
        for j in range(25):
            t, s = ([(k, set(x.split())) for i, k, x, *_ in rows if i == j] for rows in (truth, told))
            near = [(len(a & b) / len(a | b), x, y) for x, a in t for y, b in s if a & b and len(a & b) / len(a | b) >= least]
            best = lambda own, other: {p[own]: min((-q[0], q[other]) for q in near if q[own] == p[own])[1] for p in near}
            of_t, of_s = best(1, 2), best(2, 1)
            assert got[j] == sum(of_s[y] == x for x, y in of_t.items())
