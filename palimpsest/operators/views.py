"""Read models: lists and details as one row for each thing shown.  Children are aggregated before they are joined, so rows never fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gaps


def page(df: DataFrame, limit: int, cursor: tuple | None = None, time: str = "created_at", key: str = "run_id", where: Column | None = None) -> DataFrame:
    """One page of a list, newest first, by keyset: rows before the cursor (time, key); next_key is set on all rows if there are more."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    rows = df if where is None else df.where(where)
    if cursor is not None:
        at, k = F.lit(cursor[0]).cast(df.schema[time].dataType), F.lit(cursor[1])
        rows = rows.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < k)))
    top = rows.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)
    got = top.agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(key).alias("k"))), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("got"))
    shown = top.crossJoin(F.broadcast(got))  # limit + 1 rows and one
    last = F.element_at(F.col("got"), F.least(F.size("got"), F.lit(limit)))
    out = shown.withColumn("next_key", F.when(F.size("got") > limit, last["k"])).where((F.col(time) > last["t"]) | ((F.col(time) == last["t"]) & (F.col(key) >= last["k"])))
    return out.drop("got")


def _array(order: list[str], *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))


def resume_view(resumes: DataFrame, pages: DataFrame, findings: DataFrame, skills: DataFrame) -> DataFrame:
    """A document with its pages, findings by severity, skills, and whether there is evidence to show."""
    per_page = pages.groupBy("doc_id").agg(_array(["page"], "page").alias("pages"))
    counts = findings.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "suspicious", "info")])
    terms = skills.groupBy("doc_id").agg(F.count("*").alias("skill_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = resumes.join(per_page, "doc_id", "left").join(counts, "doc_id", "left").join(terms, "doc_id", "left")
    return rows.select(*resumes.columns, F.transform("pages", lambda p: p["page"]).alias("pages"), zero("high"), zero("suspicious"), zero("info"), zero("skill_count"), F.col("pages").isNotNull().alias("has_evidence"))


def skill_view(skills: DataFrame, evidence: DataFrame) -> DataFrame:
    spans = evidence.groupBy("doc_id", "canonical").agg(_array(["page", "seqno"], "span_id", "is_flagged").alias("evidence"))
    return skills.select("doc_id", "canonical", "support_count", "flagged_support_count", "confidence", "source").join(spans, ["doc_id", "canonical"])


def job_view(jobs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Jobs with their requirements in order; one still on its way is `not_ready`."""
    own = requirements.groupBy("job_id").agg(_array(["ordinal"], "text", "kind", "necessity", "criticality").alias("requirements"), F.count("*").alias("requirement_count"))
    status = F.when(F.col("state").isin("received", "queued", "processing"), "not_ready").otherwise("ready")
    return jobs.join(own, "job_id", "left").withColumns({"requirement_count": F.coalesce("requirement_count", F.lit(0)), "status": status})


def match_view(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Runs with their built claims in requirement order; each claim's evidence has its primary span first."""
    told = claims.groupBy("run_id").agg(_array(["ordinal"], "requirement_id", "met", "match_type", "contribution", "primary_span_id", "all_evidence_spans").alias("claims"))
    return runs.join(told, "run_id", "left")


def claim_details(claims: DataFrame) -> DataFrame:
    """Built claims beside their requirements, decimals as doubles, defaults filled in; bbox is null unless all four sides are known."""
    own = [F.coalesce(c, F.lit(d)).alias(n) for c, n, d in (("requirement_kind", "kind", "hard_skill"), ("necessity", "necessity", "required"), ("criticality", "criticality", 2))]
    box = F.col("primary_bbox")
    factors = ["satisfaction", "corroboration", "integrity_factor", "evidence_quality", "weight_applied", "contribution", "confidence"]
    return claims.select(
        "run_id", "requirement_id", *own, "met", "match_type", "primary_span_id", *[F.col(c).cast("double").alias(c) for c in factors],
        "primary_page", F.when(~F.exists(box, lambda x: x.isNull()), box).alias("bbox"),
    )


def gap_view(scored: DataFrame, k: int = 5) -> DataFrame:
    """All that is known about a run's gaps in one row: its score, gaps, candidates, and the sets of candidates (`gaps.combinations`)."""
    runs = gaps.of_runs(scored, k)
    return runs.select("run_id", "score", "gaps", "candidates", gaps.combinations_of(F.col("candidates"), F.col("total_contribution"), F.col("total_weight")).alias("combinations"))


def necessity_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("run_id", "necessity").agg(F.count("*").alias("n"), F.count_if("met").alias("n_met"))


def dashboard(runs: DataFrame) -> DataFrame:
    """Per user: analysed and in progress."""
    return runs.groupBy("user_id").agg(F.count_if(F.col("state") == "completed").alias("analysed"), F.count_if(F.col("state").isin("received", "queued", "processing")).alias("in_progress"), F.count("*").alias("total"))


def object_keys(doc_id: Column, page_number: Column) -> tuple[Column, Column, Column]:
    return F.concat(F.lit("resumes/"), doc_id, F.lit("/original.pdf")), F.concat(F.lit("jobs/"), doc_id, F.lit("/original.pdf")), F.format_string("resumes/%s/pages/%04d.png", doc_id.cast("string"), page_number)


def extraction_summary(pages: DataFrame) -> DataFrame:
    """Per document: pages, how the text was got, and whether any page could be rendered."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.when(F.bool_or("ocr_available"), "text_layer+ocr").otherwise("text_layer").alias("method"), F.bool_or("ocr_available").alias("any_render"))
