"""Spans lying in the rectangles of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import dec
from ..functions.geometry import Box

SPAN, FOUND = Box.of("x0", "y0", "x1", "y1"), Box.of("fx0", "fy0", "fx1", "fy1")


def span_findings(spans: DataFrame, findings: DataFrame, floor: float = 0.5, severities: list[str] | None = None) -> DataFrame:
    """(doc_id, span_id, finding_id, severity): findings of the same page that hold at least `floor` of a span's area.

    An equi-join on the page with the geometry as residual; one huge page is split by AQE's skew join.
    """
    chosen = findings if severities is None else findings.where(F.col("severity").isin(severities))
    found = chosen.select("doc_id", "page", "finding_id", F.lower("severity").alias("severity"), *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])
    both = spans.select("doc_id", "page", "span_id", "x0", "y0", "x1", "y1").join(found, ["doc_id", "page"])
    return both.where(SPAN.contained_fraction(FOUND) >= floor).select("doc_id", "span_id", "finding_id", "severity")


def integrity_factor(links: DataFrame, keys: list[str]) -> DataFrame:
    """The worst severity over the links of a key: 0 for high, one half for suspicious, else 1; and the findings."""
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "suspicious", 1).otherwise(0)
    worst = links.groupBy(*keys).agg(F.max(rank).alias("worst"), F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))
    factor = F.when(F.col("worst") == 2, dec("0")).when(F.col("worst") == 1, dec("0.5")).otherwise(dec("1"))
    return worst.select(*keys, factor.alias("integrity_factor"), "finding_ids")
