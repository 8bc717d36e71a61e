"""Runs as one pass: labels by the short way, scores of ticked sets, one exchange of a run's rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.functions import text as tx
from palimpsest.operators import gaps, scoring

from test_scoring import GAP_C, GAP_R, claims, requirements

SMALL = "/root/testdata/sf0.001"


def test_plain_labels_are_those_of_the_long_way(spark, monkeypatch):
    said = ["ECONOMY hot bolt", "5+ years experience with large blue ring box", "a", "x  y", " lead and tail ", "knowledge of SQL", "it's b2b", "eleven Extraordinarily Long Words together here now", "", None, "experience in", "Zürich bank"]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    short = [r[0] for r in rows.select(tx.skill_label(F.col("t"))).collect()]
    monkeypatch.setattr(tx, "PLAIN_WORDS", "^(?!)")
    assert short == [r[0] for r in rows.select(tx.skill_label(F.col("t"))).collect()] and short[0] == "Economy Hot Bolt"


def test_scores_of_ticked_sets(spark):
    rows = scoring.score_rows(requirements(spark, GAP_R), claims(spark, GAP_C))
    runs, cands = gaps.of_runs(rows), gaps.candidates(gaps.items(rows))
    told = {tuple(r.skills): r.projected_score for r in gaps.combinations(cands).collect()} | {(r.skill,): r.projected_score for r in cands.collect()}
    base = scoring.summarize(rows).first()
    some = list(told) + [("none of them",), (*next(iter(told)), "none of them"), ()]
    asked = spark.createDataFrame([(base.run_id, list(s)) for s in some] + [(-1, ["x"])], "run_id long, skills array<string>")
    got = {(r.run_id, tuple(r.skills)): r.score for r in gaps.combination_score(asked, runs).collect()}
    assert got == {(base.run_id, s): told.get(s, base.score) for s in some} | {(-1, ("x",)): None}
    one = runs.first()
    assert [g.requirement_id for g in one.gaps] == [r.requirement_id for r in gaps.items(rows).orderBy(F.desc("points_available"), "ordinal").collect()]
    assert [(c.rank, c.skill, c.projected_score) for c in one.candidates] == [(r["rank"], r.skill, r.projected_score) for r in cands.orderBy("rank").collect()]


@pytest.mark.parametrize("name,most", [("gap_selection", 3), ("gap_view", 3), ("gap_candidates", 3), ("gap_combinations", 3), ("match_score", 3), ("build_claims", 9), ("claim_details", 9), ("match_view", 10), ("verified_match_score", 9)])
def test_rows_of_a_run_move_once(spark, name, most):
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= most


@pytest.mark.parametrize("name", ["text_dedup", "quote_leaks", "extraction_delta_exact"])
def test_texts_are_not_worked_out_again_by_filters(spark, name):
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.match(r"[\s:+|-]*Filter ", line)]
    assert filters and not [f for f in filters if re.search(r"regexp_replace\(|replace\(|sha2\(", f)]
