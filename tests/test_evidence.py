from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import claims, dedup, gates, metrics, overlap, packets, requirements, scoring, views
from palimpsest.schemas import DDL, names


def spans(spark):
    rows = []
    for no, y in enumerate((100.0, 150.0, 700.0)):
        base = dict.fromkeys(names("spans")) | dict(doc_id=1, span_id=f"s{no}", span_no=no, page=1, seqno=no, x0=50.0, y0=y, x1=300.0, y1=y + 20, text=f"line {no}", font_size=10.0, render_mode=0, opacity=1.0)
        rows.append(tuple(base[c] for c in names("spans")))
    return spark.createDataFrame(rows, DDL["spans"])


def findings(spark, severity=None):
    rows = [] if severity is None else [(1, "f1", "D2", "", severity, 1.0, 1, 45.0, 695.0, 305.0, 725.0, "", "")]
    return spark.createDataFrame(rows, DDL["findings"])


def asked(spark):
    rows = [(9, i, f"r{i}", f"req {i}", "hard_skill", c, n, None) for i, (c, n) in enumerate([(3, "required"), (2, "preferred"), (3, "required")])]
    return spark.createDataFrame(rows, DDL["requirements"])


def raw(spark, rows):
    return spark.createDataFrame([(9, 1, i, k, met, kind, cited, 0.9, "why", note) for i, (k, met, kind, cited, note) in enumerate(rows)], DDL["raw_claims"])


BASE = [("r0", True, "direct", ["s2"], None), ("r1", True, "adjacent", ["s1", " s1 ", ""], "close"), ("r2", False, "none", [], None)]


def score(spark, rows, severity=None):
    built, evidence, found = claims.build(asked(spark), raw(spark, rows), spans(spark), findings(spark, severity))
    s = scoring.summarize(scoring.score_rows(asked(spark), claims.for_scoring(built))).first()
    return {r.requirement_id: r for r in built.collect()}, s, evidence, found


def test_clean_evidence(spark):
    by, s, evidence, _ = score(spark, BASE)
    assert (s.score, s.unmet_required_count) == (D("40.9"), 1)
    assert by["r0"].primary_span_id == "s2" and by["r1"].corroboration == D("0.8000") and evidence.count() == 2


def test_high_finding_takes_the_credit(spark):
    by, s, _, found = score(spark, BASE[:1] + [("r1", False, "none", [], None), BASE[2]], "high")
    assert (s.score, s.score_if_trusted, s.impact_delta, s.unmet_required_count) == (D("0.0"), D("35.3"), D("35.3"), 2)
    assert by["r0"].met and found.count() == 1


def test_suspicious_finding_takes_half(spark):
    by, *_ = score(spark, BASE, "suspicious")
    assert (by["r0"].evidence_quality, by["r0"].contribution) == (D("0.4000"), D("1.2000"))


@pytest.mark.parametrize(
    "claim,reason",
    [
        (("r0", True, "direct", ["s2", "nowhere"], None), "invalid_citation"),
        (("r0", True, "adjacent", ["s2"], " "), "missing_adjacency_note"),
        (("r0", True, "direct", [], None), "met_without_evidence"),
    ],
)
def test_refused_claims(spark, claim, reason):
    by, _, evidence, _ = score(spark, [claim])
    assert (by["r0"].met, by["r0"].reason, by["r1"].reason) == (False, reason, "no_claim") and evidence.count() == 0


def test_coercion(spark):
    rows = ['{"requirement_id": "a", "met": true, "match_type": " DIRECT ", "confidence": 7}', '{"requirement_id": "b", "match_type": "none", "confidence": "high"}', '{"requirement_id": "c", "match_type": "maybe"}', "no json"]
    good, bad = claims.coerce(spark.createDataFrame([(r,) for r in rows], "payload string"))
    assert [(r.match_type, r.confidence) for r in good.orderBy("requirement_id").collect()] == [("direct", 1.0), ("none", 1.0)]
    assert bad.count() == 2


def test_provenance(spark):
    text = "Wanted for the night shift:\n* has kept Kubernetes clusters alive\n* reads Go with ease"
    at = lambda quote: (text.index(quote), text.index(quote) + len(quote), quote)
    jobs = spark.createDataFrame([(1, text)], "job_id long, normalized_text string")
    rows = [(1, 0, " k8s ", "hard_skill", "required", 3, *at("Kubernetes clusters")), (1, 1, "x", "hard_skill", "required", 9, 0, 12, "something"), (1, 2, "go", " Hard_Skill", "PREFERRED", 0, *at("reads Go")), (1, 3, "y", "hard_skill", "required", 1, 50, 999, "z")]
    good, bad = requirements.validate(spark.createDataFrame(rows, DDL["extracted"]), jobs)
    # the weight of a preferred requirement of criticality 1 is 0.4
    assert [(r.ordinal, r.text, r.weight) for r in good.orderBy("ordinal").collect()] == [(1, "k8s", D("3.0000")), (2, "go", D("0.4000"))]
    assert {r.pos: r.reject_code for r in bad.collect()} == {1: "mismatch", 3: "bounds"}


def test_normalization(spark):
    rows = [(1, 1, None, "", "a​b‮\r\nc\r\n\r\n\r\n\r\nd  "), (1, 2, None, "", "   "), (1, 3, None, "", "ﬁne\n\nWe are an Equal Opportunity Employer.\nx\n\nBenefits:\n- a\n- b"), (1, 4, None, "", "w " * 9000)]
    out = {r.job_id: r for r in requirements.normalize_job_text(spark.createDataFrame(rows, DDL["job_texts"])).collect()}
    assert (out[1].normalized_text, out[1].zero_width_count, out[1].bidi_count) == ("ab\nc\n\nd", 1, 1)
    assert (out[2].reject_code, out[4].reject_code) == ("invalid_input", "token_limit_exceeded")
    text = out[3].normalized_text
    assert text.startswith("fine") and [(b.category, text[b.start : b.end].strip()) for b in out[3].boilerplate] == [("equal_opportunity", "We are an Equal Opportunity Employer.\nx"), ("benefits", "Benefits:\n- a\n- b")]


def test_dedup_and_runs(spark):
    rows = spark.createDataFrame([(1, "a", 2, 20), (1, "a", 1, 10), (2, "a", 3, 30), (1, None, 4, 40)], "user_id long, sha256 string, created_at long, id long")
    got = {r.id: r.duplicate_of for r in dedup.first_by_hash(rows, ["user_id", "sha256"], ["created_at", "id"]).collect()}
    assert got == {10: None, 20: 10, 30: None, 40: None}
    old = spark.createDataFrame([(1, 1, 1, "v1", 100, "failed", 1), (2, 1, 1, "v1", 200, "completed", 1)], "resume_id long, job_id long, prompt_version_id long, scoring_version string, run_id long, state string, created_at long")
    new = spark.createDataFrame([(i, 1, 1, "v1") for i in (1, 2, 3)], "resume_id long, job_id long, prompt_version_id long, scoring_version string")
    assert {r.resume_id: (r.action, r.reused, r.duplicate) for r in dedup.run_keys(new, old).collect()} == {1: ("requeue", True, False), 2: ("return", True, True), 3: ("create", False, False)}


def test_pages_of_a_list(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(7)], "run_id long, created_at long")
    seen, cursor = [], None
    while True:
        rows = sorted(views.page(df, 3, cursor).collect(), key=lambda r: (-r.created_at, -r.run_id))
        seen += [r.run_id for r in rows]
        if not rows or rows[0].next_key is None:
            break
        assert rows[-1].run_id == rows[0].next_key
        cursor = (rows[-1].created_at, rows[-1].run_id)
    assert seen == [6, 5, 4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        views.page(df, 0)


def test_admission_and_privacy(spark):
    rows = spark.createDataFrame([(0, 1), (10, 0), (99, 1), (10, 50), (10, 3), (10, None)], "size long, pages int")
    assert [r[0] for r in rows.select(gates.admission(F.col("size"), F.col("pages"), 50)).collect()] == ["invalid_pdf", "invalid_pdf", "file_too_large", "page_limit_exceeded", None, "invalid_pdf"]
    rows = spark.createDataFrame([("disabled", True, "a", "2024-01-01"), ("fixtures_only", True, None, None), ("fixtures_only", False, "a", "2024-01-01"), ("production", False, "a", "2024-01-01"), ("production", False, " ", "2024-01-01"), ("production", False, "a", "2022-01-01"), ("production", False, "a", "x"), ("odd", True, "a", "2024-01-01"), (None, True, "a", None)], "m string, f boolean, a string, v string")
    codes = [r[0] for r in rows.select(gates.privacy(F.col("m"), F.col("f"), F.col("a"), F.col("v"), F.lit("2024-06-01").cast("date"))).collect()]
    assert codes == ["llm_disabled", None, "privacy_gate", None, "privacy_gate", "privacy_gate", "privacy_gate", "privacy_gate", "llm_disabled"]


def test_batches(spark):
    df = spark.createDataFrame([(1, i) for i in range(25)] + [(2, i) for i in range(26)], "run_id long, ordinal int")
    got = {(r.run_id, r.batch_no): r["count"] for r in packets.batch_numbers(df).groupBy("run_id", "batch_no").count().collect()}
    assert got == {(1, 0): 25, (2, 0): 20, (2, 1): 6}


def test_agreement_and_intervals(spark):
    rows = spark.createDataFrame([(1, 1)] * 40 + [(0, 0)] * 30 + [(1, 0)] * 20 + [(0, 1)] * 10, "a int, b int")
    r = metrics.kappa(rows, "a", "b").first()
    assert r.kappa == pytest.approx(0.4) and r.weighted_kappa == pytest.approx(0.4)
    for n, top in ((12, 0.243), (73, 0.050), (200, 0.019)):
        high = spark.range(n).groupBy().agg(F.count("*").alias("n")).select(metrics.wilson(F.lit(0), F.col("n"))[1]).first()[0]
        assert high == pytest.approx(top, abs=0.001)


def test_extraction_quality_and_locators(spark):
    truth = spark.createDataFrame([(1, 0, "python in production", "required", 3), (1, 1, "sql", "preferred", 1)], "job_id long, ordinal int, text string, necessity string, criticality int")
    said = spark.createDataFrame([(1, 0, "Python, in production!", "required", 1), (1, 1, "kubernetes", "required", 1)], truth.schema)
    r = metrics.extraction_quality(truth, said).first()
    assert (r.matched, r.precision, r.recall, r.necessity_accuracy, r.criticality_within_one) == (1, 0.5, 0.5, 1.0, 0.0)
    where = spark.createDataFrame([("a", 1, 1, "LINE 2.", 0), ("b", 1, 1, "line 9", 0)], "locator_id string, doc_id long, page int, quote string, occurrence int")
    found, lost = metrics.resolve_locators(where, spans(spark))
    assert [r.span_id for r in found.collect()] == ["s2"] and [r.locator_id for r in lost.collect()] == ["b"]


def test_overlap_is_by_half_of_the_span(spark):
    links = overlap.span_findings(spans(spark), findings(spark, "HIGH")).collect()
    assert [(r.span_id, r.severity) for r in links] == [("s2", "high")]
