"""What a run lacks, what closing it would earn, and what the score would be.

The projected score is linear: each contribution is rounded before it is added, so exchanging some of them for clean evidence needs no
rescoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decimals import dec, dec4
from ..functions.text import let, skill_label
from .scoring import rounded_score, summarize

CLEAN_QUALITY = "0.8000"


def category(match_type: Column, satisfaction: Column, integrity: Column) -> Column:
    return F.when((satisfaction > 0) & (integrity < 1), "unverifiable").when(F.lower(match_type) == "adjacent", "partial").otherwise("missing")


def points_available(weight: Column, satisfaction: Column, quality: Column) -> Column:
    return dec4(F.greatest(weight * (1 - satisfaction * quality), F.lit(0).cast("decimal(18,12)")))


def clean_gain() -> Column:
    """What a requirement adds to the run's contribution when it gets clean, direct evidence."""
    return dec4(F.col("weight") * dec(CLEAN_QUALITY)) - F.col("contribution")


def with_totals(scored: DataFrame) -> DataFrame:
    """Rows beside their run's sums, from one exchange by run."""
    run = Window.partitionBy("run_id")
    rows = scored.withColumns({"total_weight": F.sum("weight").over(run), "total_contribution": F.sum("contribution").over(run)})
    return rows.withColumn("base_score", rounded_score(F.col("total_contribution"), F.col("total_weight")))


def _told(scored: DataFrame) -> DataFrame:
    """All rows with what is told of a gap, and `is_gap`."""
    gap = (F.col("contribution") == 0) | (F.col("satisfaction") < 1) | (F.col("integrity_factor") < 1)
    return with_totals(scored).select(
        "run_id", "requirement_id", "ordinal", skill_label(F.col("text")).alias("skill"),
        category(F.col("match_type"), F.col("satisfaction"), F.col("integrity_factor")).alias("category"),
        F.coalesce(F.nullif(F.col("text"), F.lit("")), F.concat(F.lit("Requirement "), "requirement_id")).alias("requirement_text"),
        "necessity", "criticality", "weight", "satisfaction", "evidence_quality", "contribution",
        points_available(F.col("weight"), F.col("satisfaction"), F.col("evidence_quality")).alias("points_available"),
        clean_gain().alias("gain"), "total_weight", "total_contribution", "base_score",
        rounded_score(F.col("total_contribution") + clean_gain(), F.col("total_weight")).alias("projected_score"), F.coalesce(gap, F.lit(False)).alias("is_gap"),
    )


def items(scored: DataFrame) -> DataFrame:
    """A row for each gap: category, points, label, and the score with this requirement clean."""
    return _told(scored).where("is_gap").drop("is_gap")


def _ranked(rows: DataFrame, apart: list[str]) -> DataFrame:
    """Adds `of_skill` (1 for the best gap of a skill), the skill's sums and requirements, and `rank` among the best; rows that differ in `apart` have no part in one another."""
    order = [F.desc("points_available"), F.asc("ordinal")]
    members = Window.partitionBy("run_id", *apart, "skill")
    first = rows.withColumn("of_skill", F.row_number().over(members.orderBy(*order)))
    return first.withColumns({
        "skill_points": F.sum("points_available").over(members),
        "skill_gain": F.sum("gain").over(members),
        "requirement_ids": F.transform(F.array_sort(F.collect_list(F.struct((-F.col("points_available")).alias("p"), "ordinal", "requirement_id")).over(members)), lambda s: s["requirement_id"]),
    }).withColumn("is_best", F.col("of_skill") == 1)


def _rank(rows: DataFrame, apart: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", *apart).orderBy(F.desc("points_available"), F.asc("ordinal"))))


def _with_skill(total: Column, weight: Column) -> Column:
    return rounded_score(total + F.col("skill_gain"), weight)


def candidates(gap_items: DataFrame, k: int = 5) -> DataFrame:
    """The k skills of a run with most to gain: ranked by their best gap, its category, the points of all their gaps together."""
    ranked = _rank(_ranked(gap_items, []).where("is_best"), []).where(F.col("rank") <= k)
    return ranked.select(
        "run_id", "rank", "skill", "category", "requirement_ids", F.col("skill_points").cast("decimal(8,4)").alias("points_available"),
        "skill_gain", "total_weight", "total_contribution", _with_skill(F.col("total_contribution"), F.col("total_weight")).alias("projected_score"),
    )


def of_runs(scored: DataFrame, k: int = 5) -> DataFrame:
    """A row for each run, without gaps too: score, total_weight, total_contribution, `gaps` (best first) and `candidates` (by rank, at most k), from one pass over its rows."""
    rows = _rank(_ranked(_told(scored), ["is_gap"]), ["is_gap", "is_best"])
    gap = F.struct((-F.col("points_available")).alias("p"), "ordinal", "requirement_id", "skill", "category", "projected_score")
    best = F.struct("rank", "skill", "category", F.col("skill_points").cast("decimal(8,4)").alias("points_available"), _with_skill(F.col("total_contribution"), F.col("total_weight")).alias("projected_score"), "skill_gain")
    return rows.groupBy("run_id").agg(
        F.first("base_score").alias("score"), F.first("total_weight").alias("total_weight"), F.first("total_contribution").alias("total_contribution"),
        F.array_sort(F.collect_list(F.when(F.col("is_gap"), gap))).alias("gaps"),
        F.array_sort(F.collect_list(F.when(F.col("is_gap") & F.col("is_best") & (F.col("rank") <= k), best))).alias("candidates"),
    )


def _masks(size: Column) -> Column:
    """Sets of two or more of a number of things, as bits."""
    return F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), size) - 1), lambda m: F.bit_count(m) >= 2)


def _chosen(things: Column, mask: Column) -> Column:
    return F.filter(things, lambda x, i: F.getbit(mask, i) == 1)


def _gain(chosen: Column) -> Column:
    return F.aggregate(chosen, F.lit(0).cast("decimal(20,4)"), lambda a, x: (a + x["skill_gain"]).cast("decimal(20,4)"))


def combinations_of(candidates: Column, contribution: Column, weight: Column) -> Column:
    """The sets of two or more of one run's candidates, as an array."""

    def told(mask: Column, chosen: Column) -> Column:
        return F.struct(mask.alias("mask"), F.array_sort(F.transform(chosen, lambda x: x["skill"])).alias("skills"), rounded_score(contribution + _gain(chosen), weight).alias("projected_score"))

    return F.when(F.size(candidates) > 1, F.transform(_masks(F.size(candidates)), lambda m: let(_chosen(candidates, m), lambda c: told(m, c))))


def combinations(gap_candidates: DataFrame) -> DataFrame:
    """Every set of two or more of a run's candidates (at most 26) with its projected score, skills sorted."""
    runs = gap_candidates.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "skill", "skill_gain", "requirement_ids"))).alias("c"), F.first("total_weight").alias("total_weight"), F.first("total_contribution").alias("total_contribution")
    )
    masks = runs.withColumn("mask", F.explode(F.expr("sequence(1, shiftleft(1, size(c)) - 1)"))).where("bit_count(mask) >= 2")
    chosen = masks.withColumn("c", _chosen(F.col("c"), F.col("mask")))
    return chosen.select(
        "run_id", "mask", F.array_sort(F.transform("c", lambda x: x["skill"])).alias("skills"),
        F.array_distinct(F.flatten(F.transform("c", lambda x: x["requirement_ids"]))).alias("requirement_ids"),
        rounded_score(F.col("total_contribution") + _gain(F.col("c")), F.col("total_weight")).alias("projected_score"),
    )


def project(scored: DataFrame, clean: DataFrame) -> DataFrame:
    """The score of each run if the requirements in clean (run_id, requirement_id) had clean, direct evidence."""
    chosen = scored.join(clean.select("run_id", "requirement_id").distinct(), ["run_id", "requirement_id"], "left_semi")
    gain = chosen.groupBy("run_id").agg(F.sum(clean_gain()).alias("gain"))
    totals = summarize(scored).join(gain, "run_id", "left")
    score = rounded_score(F.col("total_contribution") + F.coalesce("gain", F.lit(0).cast("decimal(18,4)")), F.col("total_weight"))
    return totals.select("run_id", F.col("score").alias("base_score"), score.alias("projected_score"))


def shown_score(skills: Column) -> Column:
    """Beside the columns of `of_runs`: the score shown for a set of ticked skills, which are candidates of the run; the base score if one of them is none.

    A set's score follows from its candidates' gains, so no other set is worked out.
    """
    key = F.array_distinct(skills)
    chosen = F.filter("candidates", lambda c: F.array_contains(key, c["skill"]))
    known = (F.size(key) > 0) & (F.size(chosen) == F.size(key))
    return F.when(known, rounded_score(F.col("total_contribution") + _gain(chosen), F.col("total_weight"))).otherwise(F.col("score"))


def combination_score(selections: DataFrame, runs: DataFrame) -> DataFrame:
    """selections (run_id, skills) with the score shown for each, from the runs (`of_runs`)."""
    rows = selections.join(runs.select("run_id", "score", "total_weight", "total_contribution", "candidates"), "run_id", "left")
    return rows.select("run_id", "skills", shown_score(F.col("skills")).alias("score"))
