"""Mixing sources to target weights by Poisson replication.

A source with n rows and weight share s has the mean repetition rate  s * total / n.  Each document draws its count by inverting the
Poisson distribution of that rate at a uniform number hashed from (seed, doc_id, text), so any run on any cluster draws alike.  Each
document is exploded by its count and the copies are shuffled globally by another hash.

Texts move once, in that last shuffle.  The table of rates is written down first and measured: up to `BROADCAST_NUMBERS` numbers it is
broadcast (8 bytes each); a larger one is repeated `SALTS` times and joined by (source, salt), so that no source meets in one task.

Defined results: a null source is a source of its own; rows without a target weight get rate 0 where weights are given; null doc_ids
draw by their text; the very same row twice draws the same count twice; an empty table gives an empty result; extra columns pass
through, and an input column with an output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, replace_columns

ADDED = ["rate", "copies", "copy_no", "mix_key"]
BROADCAST_NUMBERS, SALTS = 500_000, 64


def uniform(seed: int, *columns: str) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def repetition_rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None) -> DataFrame:
    """(source, n, rate).  weights: target weight by source; without them sources get their row count to the power `temperature`."""
    counts = documents.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        counts = counts.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0))
    sums = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * (F.col("all_n") if total is None else F.lit(float(total))) / F.col("n")
    return counts.join(F.broadcast(sums)).select("source", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # one row beside each


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds cdf: P(count <= k) for k = 0, 1, ... until the rest is below what 52 bits can tell apart."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    # terms through logarithms, since exp(-rate) is zero for large rates; the sum runs from the first term upwards
    log_term = F.aggregate(
        F.sequence(F.lit(1), last),
        F.array(-F.col("rate")),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.log("rate") - F.log(k.cast("double")))),
    )
    cdf = F.aggregate(log_term, F.array(F.lit(0.0)), lambda acc, l: F.concat(acc, F.array(F.element_at(acc, -1) + F.exp(l))))
    return rates.withColumn("cdf", F.when(F.col("rate") > 0, F.slice(cdf, 2, 2**31 - 1)).otherwise(F.array(F.lit(1.0))))


def _named(documents: DataFrame) -> list[str]:
    """What tells rows apart: rows without an id by their texts."""
    return ["doc_id", *(["text"] if "text" in documents.columns else [])]


def with_rates(documents: DataFrame, table: DataFrame, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """documents beside their source's row of the table."""
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if (table.agg(F.sum(F.size("cdf") + 4)).first()[0] or 0) <= broadcast_numbers:
        return documents.join(F.broadcast(table), same)
    repeated = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = documents.withColumn("own_salt", F.pmod(F.xxhash64(*_named(documents)), F.lit(SALTS)).cast("int"))
    return salted.join(repeated.hint("merge"), same & (F.col("own_salt") == F.col("mix_salt"))).drop("own_salt", "mix_salt")


def mix(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """documents' rows, each as often as drawn, in random places and order, with rate, copies, copy_no (from 0) and mix_key (the order)."""
    documents = replace_columns(documents, ADDED)
    table = materialise(poisson_table(repetition_rates(documents, weights, temperature, total)).withColumnRenamed("source", "mix_source").drop("n"))
    drawn = with_rates(documents, table).withColumn("u", uniform(seed, *_named(documents)))
    drawn = drawn.withColumn("copies", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).drop("cdf", "u", "mix_source")
    copied = drawn.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copied = copied.withColumn("mix_key", F.xxhash64(F.lit(seed), *_named(documents), "copy_no"))
    n = [partitions] if partitions else []
    return copied.repartition(*n, "mix_key").sortWithinPartitions("mix_key", "copy_no")
