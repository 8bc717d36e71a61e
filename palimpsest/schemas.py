"""The tables that operators take and return.  Nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql.types import StructType

BOX = "x0 double, y0 double, x1 double, y1 double"
DDL = {
    "spans": f"doc_id long, span_id string, span_no int, page int, seqno int, {BOX}, text string, font string, font_size double, r double, g double, b double, render_mode int, opacity double, char_boxes array<struct<x0:double,y0:double,x1:double,y1:double>>",
    "pages": "doc_id long, page int, cx0 double, cy0 double, cx1 double, cy1 double, rotation int, ocr_available boolean",
    "images": "doc_id long, page int, seqno int, ix0 double, iy0 double, ix1 double, iy1 double",
    "lines": f"doc_id long, page int, line_no int, {BOX}, text string",
    "ocr_words": "doc_id long, page int, block int, par int, line int, word_no int, left int, top int, width int, height int, conf double, text string",
    "ocr_lines": "doc_id long, page int, line_no int, text string",
    "findings": f"doc_id long, finding_id string, detector_id string, detector_name string, severity string, confidence double, page int, {BOX}, excerpt string, rationale string",
    "vocabulary": "canonical string, alias string",
    "job_texts": "user_id long, job_id long, created_at timestamp, source string, raw_text string",
    "extracted": "job_id long, pos int, text string, kind string, necessity string, criticality int, evidence_start int, evidence_end int, evidence_quote string",
    "requirements": "run_id long, ordinal int, requirement_id string, text string, kind string, criticality int, necessity string, weight decimal(6,4)",
    "raw_claims": "run_id long, doc_id long, pos int, requirement_id string, met boolean, match_type string, evidence_spans array<string>, confidence double, rationale string, adjacency_note string",
    "claims": "run_id long, pos int, requirement_id string, met boolean, match_type string, evidence_spans array<string>, corroboration decimal(6,4), integrity_factor decimal(6,4), confidence double, rationale string, adjacency_note string",
    "match_runs": "run_id long, user_id long, resume_id long, job_id long, prompt_version_id long, scoring_version string, state string, score decimal(5,2), score_if_trusted decimal(5,2), impact_delta decimal(5,2), created_at timestamp",
    "call_facts": "call_id long, user_id long, purpose string, run_id long, job_id long, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, latency_ms long, outcome string, attempt int, created_at timestamp",
    "state_events": "run_id long, event_id long, ts timestamp, state string, impact_delta double, failure_code string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def names(name: str) -> list[str]:
    """The columns of a table; needs no session."""
    flat = re.sub(r"<[^>]*>", "", DDL[name])
    return [column.split()[0] for column in re.sub(r"\([^)]*\)", "", flat).split(",")]
