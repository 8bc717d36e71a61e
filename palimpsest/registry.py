"""All registered queries of the screening engine and their oracles."""

from __future__ import annotations

from .plans import documents, evidence, files, operations, scores, streams, texts

PLANS = [scores.PLAN, documents.PLAN, evidence.PLAN, texts.PLAN, operations.PLAN, streams.PLAN, files.PLAN]


def queries() -> dict:
    return {name: f for plan in PLANS for name, f in plan.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.oracle.items()}
