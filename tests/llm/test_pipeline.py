"""The pipeline's stages against what is planted in a small corpus."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import near_copies, queries

from .conftest import DOCS, words


def test_pipeline_on_planted_rows(spark, tmp_path):
    rng = random.Random(21)
    item = words(rng, 40, "klmnopqrst")
    rows = [(i, words(rng, 150), "en", f"s{i % 3}", 0) for i in range(300)]
    copies = [(1000 + i, rows[i][1] + ("" if i % 2 else " !"), "en", "s0", 0) for i in range(40)]
    leaks = [(2000 + i, words(rng, 60) + " " + item + " " + words(rng, 60), "en", "s1", 0) for i in range(20)]
    toxic = [(3000 + i, words(rng, 50) + " vile " + words(rng, 50), "en", "s2", 0) for i in range(60)]
    spark.createDataFrame(rows + copies + leaks + toxic, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:200]] + [(t[0], 1, 1) for t in toxic[:40]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "sharding" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert left["toxicity"] == {r[0] for r in rows + copies + leaks}
    assert left["near_duplicates"] >= {r[0] for r in rows + leaks} and not left["near_duplicates"] & {c[0] for c in copies[1::2]}
    assert left["decontamination"] == left["near_duplicates"] - {x[0] for x in leaks}
    assert left["sharding"] == left["mixing"] <= left["decontamination"]
    assert {"shard", "slot"} <= set(docs.columns)


def test_names():
    names = list(queries.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_near_duplicate_stage_removes_edited_copies(spark):
    """Against brute force over five-word shingles: copies with a few words changed go, looser ones and unrelated documents stay."""
    rng = random.Random(33)

    def edited(text, n):
        ws = text.split()
        for at in rng.sample(range(len(ws)), n):
            ws[at] = "edited"
        return " ".join(ws)

    def shingles(text):
        ws = text.split()
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}

    base = [(i, words(rng, 200), "en", "s0", 0) for i in range(60)]
    copies = [(1000 + 10 * i + k, edited(base[i][1], k), "en", "s0", 0) for i in range(60) for k in (1, 2, 3, 8, 20)]
    many = [(5000 + k, edited(base[0][1], 2), "en", "s0", 0) for k in range(60)]
    rows = base + copies + many
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    close = {d: [e for e in sets if e != d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])] for d in sets}
    assert kept >= {d for d in sets if not close[d]} | {b[0] for b in base}
    assert not any(e in kept for d in kept for e in close[d])
    assert not kept & ({c[0] for c in copies if c[0] % 10 in (1, 2, 3)} | {m[0] for m in many})


def test_near_duplicate_stage_on_odd_rows(spark, odd, none, clashing):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, odd, "")
    assert kept.columns == odd.columns
    # 1, 2, 11 and the row without an id are near copies of 0; 3 (null), 4 and 5 have no words; another text has the id 3
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 3, 6, 7, 8, 9, 10, 12]
    assert stage(spark, none, "").count() == 0 and stage(spark, clashing, "").columns == clashing.columns


def test_parities_bound_the_symmetric_difference():
    """By brute force over random sets that share from none to all of their hashes, of all lengths."""
    rng = np.random.default_rng(8)
    told = 0
    for size in (0, 1, 5, 60, 400, 3000):
        for share in (0.0, 0.3, 0.6, 0.8, 0.9, 1.0):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            keep = int(size * share)
            b = np.concatenate([a[:keep], rng.integers(0, 2**63, size - keep, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            bits = [near_copies.parities(x).view(np.uint64) for x in (a, b)]
            differing = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert differing <= len(np.setxor1d(a, b))
            told += 9 * differing > len(a) + len(b)
    assert told >= 9  # most pairs of shares under 0.8 are told apart


def test_sets_that_may_be_similar(spark):
    """The bound as a column keeps every similar pair of edited texts and leaves out unlike ones."""
    rng = random.Random(14)
    base = words(rng, 300).split()
    texts = [" ".join(words(rng, 1) if rng.random() < rate else w for w in base) for rate in (0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2, 0.5, 1) for _ in range(6)]
    own = [near_copies.shingle_set(near_copies.shingle_hashes(t.encode(), 5)) for t in texts]
    rows = spark.createDataFrame([(i, len(s), near_copies.parities(s).tolist()) for i, s in enumerate(own)], "i int, size int, odd array<long>")
    other = rows.select(F.col("i").alias("j"), F.struct("size", "odd").alias("head"))
    maybe = {(r.i, r.j) for r in rows.join(other, F.col("i") < F.col("j")).where(near_copies._may_be_similar("head.size", "head.odd")).select("i", "j").collect()}
    close = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if near_copies.similar(own[i], own[j])}
    assert close and close <= maybe and len(maybe) < 3 * len(close)


def test_near_duplicate_stage_with_string_ids(spark, odd):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    named = odd.withColumn("doc_id", F.format_string("d%02d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "dnull", F.col("doc_id")))
    kept = [r.doc_id for r in stage(spark, named, "").collect()]
    assert sorted(kept) == [f"d{k:02}" for k in (0, 3, 3, 6, 7, 8, 9, 10, 12)]
    nameless = stage(spark, odd.withColumn("doc_id", F.lit(None).cast("long")), "").collect()
    assert len(nameless) == 9 and all(r.doc_id is None for r in nameless)
