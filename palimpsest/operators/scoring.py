"""Reconstructible decimal match scores with an integrity discount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decimals import dec, dec4, quantize

KEY = ["run_id", "requirement_id"]
NECESSITY_FACTOR = {"required": "1.0", "preferred": "0.4"}
SATISFACTION = {"direct": "1.0000", "adjacent": "0.6000"}


def requirement_weight(criticality: Column, necessity: Column) -> Column:
    """criticality times 1 for required, 0.4 for preferred, 1 for anything unknown."""
    return dec4(criticality.cast("decimal(4,0)") * F.when(F.lower(necessity) == "preferred", dec("0.4", "decimal(2,1)")).otherwise(dec("1.0", "decimal(2,1)")))


def corroboration(distinct_spans: Column) -> Column:
    """min(1, 0.8 + 0.1 (n - 1)) over n different spans; 0 without any."""
    grown = dec("0.8", "decimal(2,1)") + dec("0.1", "decimal(2,1)") * (distinct_spans.cast("decimal(9,0)") - 1)
    return F.when(distinct_spans <= 0, dec("0")).otherwise(dec4(F.least(grown, dec("1.0", "decimal(14,1)"))))


def last_of_each(claims: DataFrame) -> DataFrame:
    """The last claim of each requirement wins."""
    rest = [c for c in claims.columns if c not in ("run_id", "requirement_id")]
    return claims.groupBy("run_id", "requirement_id").agg(F.max_by(F.struct(*rest), "pos").alias("c")).select("run_id", "requirement_id", "c.*")


def beside(requirements: DataFrame, claims: DataFrame, told: list[str]) -> DataFrame:
    """Every requirement with `claim`, a struct of what is told by its last claim, or null.

    Both kinds of rows are dealt out by run together, once, and meet in a window of their requirement; whatever follows by run moves no more.
    """
    rest = [c for c in requirements.columns if c not in KEY]
    asked = requirements.select(*KEY, F.struct(*rest).alias("asked"))
    # no filter here, so that both sides of tables with a common source read one exchange; without a key nothing meets
    keyed = F.col("run_id").isNotNull() & F.col("requirement_id").isNotNull()
    said = claims.select(*KEY, "pos", F.when(keyed, F.struct(*told)).alias("claim"))
    both = asked.unionByName(said, allowMissingColumns=True).repartition("run_id")
    rows = both.withColumn("claim", F.max_by("claim", "pos").over(Window.partitionBy(*KEY))).where("asked is not null")
    return rows.select(*KEY, *[F.col("asked")[c].alias(c) for c in rest], "claim")


def score_rows(requirements: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each requirement with every factor of its contribution, each rounded as it would be stored."""
    told = ["met", "match_type", "evidence_spans", "corroboration", "integrity_factor"]
    rows = beside(requirements, claims, told).select("*", *[F.col("claim")[c].alias(c) for c in told])
    necessity = F.lower("necessity")
    kind = F.lower("match_type")
    counts = F.coalesce(F.col("met"), F.lit(False)) & F.coalesce(kind != "none", F.lit(False))
    zero, one = dec("0"), dec("1")
    satisfaction = F.when(~counts, zero).when(kind == "direct", dec("1")).when(kind == "adjacent", dec("0.6")).otherwise(zero)
    rows = rows.select(
        "run_id", "requirement_id", "ordinal", "text", "criticality", necessity.alias("necessity"),
        F.coalesce(F.col("weight").cast("decimal(6,4)"), requirement_weight(F.col("criticality"), F.col("necessity"))).alias("weight"),
        F.coalesce("met", F.lit(False)).alias("met"),
        F.when(counts, kind).otherwise(F.lit("none")).alias("match_type"),
        satisfaction.alias("satisfaction"),
        F.when(counts, F.coalesce(F.col("corroboration").cast("decimal(6,4)"), corroboration(F.size(F.array_distinct("evidence_spans"))))).otherwise(zero).alias("corroboration"),
        F.when(counts, F.coalesce(F.col("integrity_factor").cast("decimal(6,4)"), one)).otherwise(one).alias("integrity_factor"),
        counts.alias("counts"),
    )
    quality = F.when(F.col("counts"), dec4(F.col("corroboration") * F.col("integrity_factor"))).otherwise(zero)
    rows = rows.withColumn("evidence_quality", quality)
    earned = lambda q: dec4(F.col("weight") * F.col("satisfaction") * F.col(q))
    rows = rows.withColumns({"contribution": earned("evidence_quality"), "contribution_if_trusted": earned("corroboration")})
    return rows.withColumn("is_required_unmet", (F.col("necessity") == "required") & (F.col("contribution") == 0)).drop("counts")


def rounded_score(contribution: Column, weight: Column) -> Column:
    """100 * contribution / weight to one place, halves to even; 0 without weight."""
    return F.when(weight == 0, dec("0", "decimal(5,1)")).otherwise(quantize(100 * contribution / weight, 1).cast("decimal(5,1)"))


def summarize(scored: DataFrame) -> DataFrame:
    """One row for each run; the delta is that of the rounded scores."""
    sums = scored.groupBy("run_id").agg(
        F.count("*").alias("requirement_count"),
        F.count_if("is_required_unmet").alias("unmet_required_count"),
        F.sum("weight").alias("total_weight"),
        F.sum("contribution").alias("total_contribution"),
        F.sum("contribution_if_trusted").alias("total_contribution_if_trusted"),
    )
    scores = sums.withColumns({
        "score": rounded_score(F.col("total_contribution"), F.col("total_weight")),
        "score_if_trusted": rounded_score(F.col("total_contribution_if_trusted"), F.col("total_weight")),
    })
    return scores.withColumn("impact_delta", (F.col("score_if_trusted") - F.col("score")).cast("decimal(5,1)"))


def reconstruct(match_runs: DataFrame, scored: DataFrame) -> DataFrame:
    """Runs whose stored score differs from the one their rows give."""
    again = summarize(scored).select("run_id", F.col("score").alias("score_again"), F.col("score_if_trusted").alias("trusted_again"))
    both = match_runs.select("run_id", "score", "score_if_trusted").join(again, "run_id")
    return both.where((F.col("score") != F.col("score_again")) | (F.col("score_if_trusted") != F.col("trusted_again")))
