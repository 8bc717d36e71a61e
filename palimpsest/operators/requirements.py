"""Extracted requirements: coercion, provenance, ordinals, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .scoring import requirement_weight

KINDS = ("hard_skill", "soft_skill", "experience", "credential")
NECESSITIES = ("required", "preferred")


def check_provenance(extracted: DataFrame, job_texts: DataFrame) -> DataFrame:
    """Adds `reject_code`: `bounds` unless 0 <= start < end <= length, `mismatch` unless the quote stands there."""
    rows = extracted.join(job_texts.select("job_id", F.col("normalized_text").alias("job_text")), "job_id")
    inside = (F.col("evidence_start") >= 0) & (F.col("evidence_start") < F.col("evidence_end")) & (F.col("evidence_end") <= F.char_length("job_text"))
    there = F.substring("job_text", F.col("evidence_start") + 1, F.col("evidence_end") - F.col("evidence_start")) == F.col("evidence_quote")
    return rows.withColumn("reject_code", F.when(~F.coalesce(inside, F.lit(False)), "bounds").when(~F.coalesce(there, F.lit(False)), "mismatch")).drop("job_text")


def validate(extracted: DataFrame, job_texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements numbered from 1 in the order they came, and what was refused."""
    rows = check_provenance(extracted, job_texts)
    kind, necessity = F.lower(tx.strip(F.col("kind"))), F.lower(tx.strip(F.col("necessity")))
    rows = rows.withColumns({"kind": kind, "necessity": necessity})
    bad = F.when(~F.col("kind").isin(*KINDS), "invalid_kind").when(~F.col("necessity").isin(*NECESSITIES), "invalid_necessity")
    rows = rows.withColumn("reject_code", F.coalesce(bad, "reject_code"))
    criticality = F.greatest(F.lit(1), F.least(F.lit(3), F.col("criticality")))
    good = rows.where("reject_code is null").select(
        "job_id", F.row_number().over(Window.partitionBy("job_id").orderBy("pos")).alias("ordinal"), tx.strip(F.col("text")).alias("text"), "kind", "necessity", criticality.alias("criticality"),
        requirement_weight(criticality, F.col("necessity")).alias("weight"), "evidence_start", "evidence_end", "evidence_quote",
    )
    return good, rows.where("reject_code is not null").select("job_id", "pos", "reject_code")


def normalize_job_text(df: DataFrame, column: str = "raw_text", max_tokens: int = 8000) -> DataFrame:
    """Adds normalized_text, sha256, zero_width_count, bidi_count, token_count, boilerplate and reject_code to every row."""
    rows = tx.nfkc_column(df.withColumn("nfkc", F.col(column)), "nfkc")
    nfkc = F.col("nfkc")
    rows = tx.once(rows, zero_width_count=tx.count_of(nfkc, tx.ZERO_WIDTH), bidi_count=tx.count_of(nfkc, tx.BIDI), nfkc=tx.without(nfkc, tx.ZERO_WIDTH + tx.BIDI))
    rows = tx.once(rows, nfkc=F.when(nfkc.contains("\r"), F.regexp_replace(nfkc, r"\r\n?", "\n")).otherwise(nfkc))
    rows = tx.once(rows, normalized_text=tx.strip(F.when(nfkc.contains("\n\n\n"), F.regexp_replace(nfkc, r"\n{3,}", "\n\n")).otherwise(nfkc))).drop("nfkc")
    rows = tx.once(rows, token_count=tx.token_estimate(F.col("normalized_text")))
    reject = F.when(tx.is_blank(F.col(column)) | tx.is_blank(F.col("normalized_text")), "invalid_input").when(F.col("token_count") > max_tokens, "token_limit_exceeded")
    rows = tx.once(rows, reject_code=reject)
    kept = F.col("reject_code").isNull()
    return rows.withColumns({
        "normalized_text": F.when(kept, F.col("normalized_text")), "sha256": F.when(kept, F.sha2("normalized_text", 256)),
        "boilerplate": F.when(kept, tx.boilerplate_spans(F.col("normalized_text"))),
    })
