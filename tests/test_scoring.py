from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import costs, gaps, scoring
from palimpsest.schemas import DDL
from palimpsest.sources import payload

R = [("R1", 3, "required"), ("R2", 2, "required"), ("R3", 2, "required"), ("R4", 3, "required"), ("R5", 2, "preferred"), ("R6", 1, "preferred")]
C = [("R1", "direct", 3, "1"), ("R2", "direct", 1, "1"), ("R3", "direct", 2, "1"), ("R4", "direct", 1, "0"), ("R5", "adjacent", 1, "1")]


def requirements(spark, rows=R, run=1):
    return spark.createDataFrame([(run, i, k, f"skill {k}", "hard_skill", c, n, None) for i, (k, c, n) in enumerate(rows)], DDL["requirements"])


def claims(spark, rows=C, run=1, order=1):
    made = [(run, i, k, m != "none", m, [f"s{j}" for j in range(n)], None, D(g), 1.0, "", None) for i, (k, m, n, g) in enumerate(rows)]
    return spark.createDataFrame(made[::order], DDL["claims"])


def test_worked_example(spark):
    rows = scoring.score_rows(requirements(spark), claims(spark))
    assert {r.requirement_id: r.contribution for r in rows.collect()} == {"R1": D("3.0000"), "R2": D("1.6000"), "R3": D("1.8000"), "R4": D("0.0000"), "R5": D("0.3840"), "R6": D("0.0000")}
    s = scoring.summarize(rows).first()
    assert (s.total_weight, s.total_contribution, s.total_contribution_if_trusted) == (D("11.2000"), D("6.7840"), D("9.1840"))
    assert (s.score, s.score_if_trusted, s.impact_delta, s.unmet_required_count, s.requirement_count) == (D("60.6"), D("82.0"), D("21.4"), 1, 6)


def test_order_and_partitioning_do_not_matter(spark):
    a = scoring.summarize(scoring.score_rows(requirements(spark), claims(spark))).collect()
    b = scoring.summarize(scoring.score_rows(requirements(spark).repartition(7), claims(spark, order=-1).repartition(5))).collect()
    assert a == b


def test_last_claim_wins_and_unknown_values(spark):
    twice = claims(spark, [("R1", "direct", 3, "1"), ("R1", "none", 0, "1")])
    rows = scoring.score_rows(requirements(spark, [("R1", 3, "required"), ("R2", 2, "odd")]), twice)
    by = {r.requirement_id: r for r in rows.collect()}
    assert by["R1"].contribution == 0 and by["R1"].is_required_unmet
    assert by["R2"].weight == D("2.0000") and not by["R2"].is_required_unmet


def test_no_requirements(spark):
    assert scoring.summarize(scoring.score_rows(requirements(spark, []), claims(spark))).count() == 0


@pytest.mark.parametrize("n,expected", [(0, "0"), (1, "0.8"), (2, "0.9"), (3, "1"), (4, "1"), (10, "1")])
def test_corroboration(spark, n, expected):
    assert spark.range(1).select(scoring.corroboration(F.lit(n))).first()[0] == D(expected)


def test_suspicious_half_credit(spark):
    s = scoring.summarize(scoring.score_rows(requirements(spark, [("R1", 3, "required")]), claims(spark, [("R1", "direct", 3, "0.5")]))).first()
    assert (s.score, s.score_if_trusted, s.impact_delta) == (D("50.0"), D("100.0"), D("50.0"))


GAP_R = [("P", 3, "required"), ("K", 2, "required"), ("A", 2, "preferred")]
GAP_C = [("P", "direct", 1, "1"), ("A", "adjacent", 1, "1")]


def test_gaps_and_projection_equal_a_full_rescore(spark):
    rows = scoring.score_rows(requirements(spark, GAP_R), claims(spark, GAP_C))
    found = gaps.items(rows).orderBy(F.desc("points_available")).collect()
    assert [(g.requirement_id, g.category, g.points_available) for g in found] == [("K", "missing", D("2.0000")), ("A", "partial", D("0.4160"))]
    for g in found:
        clean = [c for c in GAP_C if c[0] != g.requirement_id] + [(g.requirement_id, "direct", 1, "1")]
        again = scoring.summarize(scoring.score_rows(requirements(spark, GAP_R), claims(spark, clean))).first().score
        assert g.projected_score == again
    combos = gaps.combinations(gaps.candidates(gaps.items(rows))).collect()
    assert len(combos) == 1 and combos[0].projected_score == D("80.0")


def test_unverifiable_gap(spark):
    g = gaps.items(scoring.score_rows(requirements(spark, [("R", 3, "required")]), claims(spark, [("R", "direct", 1, "0")]))).first()
    assert (g.category, g.points_available, g.projected_score) == ("unverifiable", D("3.0000"), D("80.0"))


def test_payloads_in_both_shapes(spark):
    nested = '{"requirements": [{"id": "a", "criticality": 3}, {"criticality": 1, "necessity": "preferred"}], "claims": [{"requirement_id": "a", "met": true, "match_type": "direct", "evidence_spans": ["x"]}]}'
    flat = '[{"id": "a", "criticality": 3, "met": true, "match_type": "direct", "evidence_spans": ["x"]}, {"necessity": "preferred", "criticality": 1}]'
    requirements_, claims_ = payload.parse(spark.createDataFrame([(1, nested), (2, flat)], "run_id long, payload string"))
    scores = {r.run_id: r.score for r in scoring.summarize(scoring.score_rows(requirements_, claims_)).collect()}
    assert scores == {1: D("70.6"), 2: D("70.6")}


def test_call_costs(spark):
    rows = spark.createDataFrame([("primary", 2000, 1000, 500, 0), ("other", 2000, 1000, 500, 0), ("fallback", 100, 10, 0, 0)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    assert [r.cost for r in costs.call_cost(rows).collect()] == [D("0.0141"), D("0.0141"), D("0.0008")]
    assert costs.call_cost(rows, "us").first().cost == D("0.0155")
