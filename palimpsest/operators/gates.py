"""Rules that admit rows or say why not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_BYTES, MAX_PAGES = 20 * 1024 * 1024, 40


def admission(size: Column, page_count: Column, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES) -> Column:
    """Why an upload is refused, or null; the order of the rules matters."""
    return (
        F.when(size.isNull() | (size == 0), "invalid_pdf")
        .when(size > max_bytes, "file_too_large")
        .when(page_count.isNull() | (page_count < 1), "invalid_pdf")
        .when(page_count > max_pages, "page_limit_exceeded")
    )


def privacy(mode: Column, is_fixture: Column, attestation: Column, verified_at: Column, today: Column) -> Column:
    """Why a row may not go to a model, or null."""
    own, date = F.lower(F.trim(F.coalesce(mode, F.lit("disabled")))), F.try_to_date(F.trim(verified_at), "yyyy-MM-dd")
    age = F.datediff(today, date)
    return (
        F.when(own.isin("", "disabled"), "llm_disabled")
        .when((own == "fixtures_only") & ~F.coalesce(is_fixture, F.lit(False)), "privacy_gate")
        .when((own == "production") & (tx.is_blank(attestation) | date.isNull() | ~F.coalesce(age.between(0, 365), F.lit(False))), "privacy_gate")
        .when(~own.isin("fixtures_only", "production"), "privacy_gate")
    )


def readiness(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame, requirements: DataFrame, spans: DataFrame) -> DataFrame:
    """pairs (run_id, resume_id, job_id) with failure_code: the first reason in order, or null if the run can start."""
    done = lambda df, key, name: df.groupBy(key).agg(F.max(F.col("state")).alias(name))
    some = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    rows = (
        pairs.join(done(resumes, "resume_id", "resume_state"), "resume_id", "left").join(done(jobs, "job_id", "job_state"), "job_id", "left")
        .join(some(requirements, "job_id", "n_requirements"), "job_id", "left").join(some(spans, "resume_id", "n_spans"), "resume_id", "left")
    )
    is_not = lambda c, v: ~F.coalesce(F.col(c) == v, F.lit(False))
    code = (
        F.when(is_not("resume_state", "completed"), "resume_not_ready").when(is_not("job_state", "completed"), "job_not_ready")
        .when(F.coalesce("n_requirements", F.lit(0)) == 0, "no_requirements").when(F.coalesce("n_spans", F.lit(0)) == 0, "no_evidence")
    )
    return rows.select("run_id", "resume_id", "job_id", code.alias("failure_code"))


UUID = r"(?i)^\{?(urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def file_name(name: Column, default: str = "document.pdf") -> Column:
    """The last part of a path, 255 characters at most."""
    base = F.substring_index(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    return F.coalesce(F.nullif(F.substring(tx.strip(base), 1, 255), F.lit("")), F.lit(default))


def clean_intake(df: DataFrame) -> DataFrame:
    """Intake records (id, text, file, is_fixture, resume_id): blanks to null, booleans and names read, reject_code where a rule is broken."""
    blank_to_null = lambda c: F.nullif(tx.strip(F.col(c)), F.lit(""))
    rows = df.withColumns({"text": blank_to_null("text"), "file": blank_to_null("file"), "is_fixture": F.coalesce(F.lower(tx.strip(F.col("is_fixture"))).isin("true", "1", "yes"), F.lit(False))})
    code = F.when(~F.coalesce(F.col("resume_id").rlike(UUID), F.lit(False)), "invalid_input").when(F.col("text").isNull() == F.col("file").isNull(), "invalid_input")
    return rows.withColumns({"reject_code": code, "file": F.when(F.col("file").isNotNull(), file_name(F.col("file")))})


def violations(name: str, df: DataFrame, rules: dict[str, Column], unique: list[list[str]]) -> DataFrame:
    """Rows that break a rule and keys that occur more than once: (table_name, rule, key, n)."""
    first = df.columns[0]
    broken = [df.where(~F.coalesce(r, F.lit(True))).select(F.lit(name).alias("table_name"), F.lit(k).alias("rule"), F.col(first).cast("string").alias("key"), F.lit(1).cast("long").alias("n")) for k, r in rules.items()]
    twice = [
        df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("table_name"), F.lit("unique " + ",".join(keys)).alias("rule"), F.concat_ws("/", *keys).alias("key"), "n")
        for keys in unique
    ]
    return reduce(DataFrame.unionByName, broken + twice)


def owned(df: DataFrame, user_id) -> DataFrame:
    """What a user does not own is as if it were not there."""
    return df.where(F.col("user_id") == user_id)
