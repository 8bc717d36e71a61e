"""What model calls cost, and sums of their telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price per million tokens (input, output, cache read, cache write); the first model's rates are those of unknown ones.
RATES = {"primary": ("2.00", "10.00", "0.20", "2.50"), "fallback": ("5.00", "25.00", "0.50", "6.25")}
KINDS = ("input", "output", "cache_read", "cache_write")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *r) for m, r in RATES.items()], "model string, " + ", ".join(f"{k}_rate string" for k in KINDS)).select("model", *[F.col(f"{k}_rate").cast("decimal(8,2)").alias(f"{k}_rate") for k in KINDS])


def call_cost(calls: DataFrame, geo: str | None = None) -> DataFrame:
    """Adds cost: tokens times rates over a million, a tenth more in `us`, halves up to four places.  A short fixed price list needs no join."""

    def rate(k: int) -> Column:
        out = None
        for m, r in RATES.items():
            out = (F if out is None else out).when(F.col("model") == m, F.lit(r[k]).cast("decimal(8,2)"))
        return out.otherwise(F.lit(next(iter(RATES.values()))[k]).cast("decimal(8,2)"))

    micros = sum((F.coalesce(F.col(f"{k}_tokens"), F.lit(0)).cast("decimal(12,0)") * rate(i) for i, k in enumerate(KINDS[1:], 1)), F.coalesce("input_tokens", F.lit(0)).cast("decimal(12,0)") * rate(0))
    micros = micros.cast("decimal(24,2)") * F.lit("1.1" if geo == "us" else "1.0").cast("decimal(2,1)")
    return calls.withColumn("cost", F.round(micros / F.lit(1_000_000).cast("decimal(7,0)"), 4).cast("decimal(10,4)"))


def run_totals(costed: DataFrame) -> DataFrame:
    return costed.groupBy("run_id").agg(
        F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bround(F.sum("cost"), 4).cast("decimal(12,4)").alias("cost"), F.sum("latency_ms").alias("latency_ms")
    )
