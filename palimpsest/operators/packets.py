"""The messages that a downstream model job would read: evidence and requirements in batches, in delimited blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def batch_numbers(requirements: DataFrame, limit: int = 25, batch: int = 20) -> DataFrame:
    """Adds batch_no from 0: one batch up to `limit` requirements, else chunks of `batch`."""
    counts = requirements.groupBy("run_id").agg(F.count("*").alias("n_in_run"))
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal"))
    rows = requirements.withColumn("at", at).join(counts, "run_id")
    return rows.withColumn("batch_no", F.when(F.col("n_in_run") <= limit, 0).otherwise(F.floor((F.col("at") - 1) / batch)).cast("int")).drop("at", "n_in_run")


def _joined(order: list[str], line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda s: s["line"]), "\n")


def evidence_block(spans: DataFrame) -> DataFrame:
    rows = spans.withColumn("shown", tx.strip(F.col("text"))).where("shown <> ''")
    line = F.concat(F.lit("["), "span_id", F.lit("] (Page "), "page", F.lit("): "), "shown")
    return rows.groupBy("doc_id").agg(_joined(["page", "seqno"], line).alias("evidence"))


def requirement_block(batched: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), "requirement_id", F.lit("] (kind="), "kind", F.lit(", necessity="), "necessity", F.lit(", criticality="), "criticality", F.lit("): "), tx.strip(F.col("text")))
    return batched.groupBy("run_id", "batch_no").agg(_joined(["ordinal"], line).alias("asked"), F.count("*").alias("n_requirements"))


def assemble(runs: DataFrame, spans: DataFrame, requirements: DataFrame, skills: DataFrame | None = None, nonce: Column | None = None, limit: int = 25, batch: int = 20) -> DataFrame:
    """runs (run_id, doc_id): a message for each run and batch."""
    asked = requirement_block(batch_numbers(requirements, limit, batch)).join(runs.select("run_id", "doc_id"), "run_id")
    rows = asked.join(evidence_block(spans), "doc_id", "left")
    mark = F.substring(F.sha2(F.concat_ws("/", "run_id", "batch_no"), 256), 1, 16) if nonce is None else nonce
    if skills is not None:
        terms = skills.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("canonical")), ", ").alias("terms"))
        rows = rows.join(terms, "doc_id", "left")
    else:
        rows = rows.withColumn("terms", F.lit(None).cast("string"))
    block = lambda tag, body: F.concat(F.lit(f'<{tag} nonce="'), mark, F.lit('">\n'), body, F.lit(f"\n</{tag}>\n"))
    terms = F.when(F.coalesce(F.col("terms"), F.lit("")) != "", F.concat(F.lit("\n<terms_mentioned>\n"), "terms", F.lit("\n</terms_mentioned>\n"))).otherwise("")
    ask = "\nEvaluate the resume against each requirement above. For each requirement, determine if it is met, the match type, and cite the supporting span IDs from the resume."
    message = F.concat(block("untrusted_resume", F.coalesce("evidence", F.lit(""))), terms, F.lit("\n"), block("untrusted_requirements", F.col("asked")), F.lit(ask))
    return rows.select("run_id", "batch_no", "doc_id", "n_requirements", message.alias("message"))


def first_narrative(batches: DataFrame) -> DataFrame:
    """(run_id, narrative): the first that is not blank."""
    return batches.where(~tx.is_blank(F.col("narrative"))).groupBy("run_id").agg(F.min_by("narrative", "batch_no").alias("narrative"))
