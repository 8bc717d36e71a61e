"""Registered queries over evidence: overlap, skills, citations, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decimals import milli
from ..operators import claims, overlap, scoring, skills
from .common import Plan, doubles
from .documents import GROWN, grown_findings
from .oracle import sql, tenths

PLAN = Plan()
query = PLAN.query

LINKS = """select s.doc_id, s.span_id, finding_id, severity from spans s join grown f on s.doc_id = f.doc_id and s.page = f.page
    where greatest(0, least(x1, fx1) - greatest(x0, fx0)) * greatest(0, least(y1, fy1) - greatest(y0, fy0)) / ((x1 - x0) * (y1 - y0)) >= 0.5"""
LINK_PARTS = {"grown": GROWN, "links": LINKS}


@query(sql("select * from links", "spans", **LINK_PARTS))
def span_finding_overlap(t):
    return overlap.span_findings(t.spans(), grown_findings(t))


@query(sql("select doc_id, span_id, case max(case severity when 'high' then 2 when 'suspicious' then 1 else 0 end) when 2 then 0.0 when 1 then 0.5 else 1.0 end::double as integrity_factor, count(distinct finding_id)::int as n_findings from links group by all", "spans", **LINK_PARTS))
def integrity_factor(t):
    out = overlap.integrity_factor(overlap.span_findings(t.spans(), grown_findings(t)), ["doc_id", "span_id"])
    return doubles(out.withColumn("n_findings", F.size("finding_ids")).drop("finding_ids"), "integrity_factor")


# No lookaround here, so texts get blanks at both ends and the neighbours are consumed.
def _has(alias: str) -> str:
    return f"regexp_matches(' ' || lower(text) || ' ', '[^\\p{{L}}\\p{{N}}_]{alias}[^\\p{{L}}\\p{{N}}_]')"


HITS = " union all ".join(f"select doc_id, span_id, page, seqno, '{c}' as canonical from spans where {' or '.join(_has(a) for a in aliases)}" for c, aliases in skills.CORPUS_TERMS.items())


@query(sql("select * from hits", "spans", hits=HITS))
def skill_matches(t):
    return skills.match_terms(t.spans(), skills.CORPUS_TERMS)


@query(sql("select * from hits", "spans", hits=HITS))
def skill_matches_by_join(t):
    return skills.match_vocabulary(t.spans(), t.vocabulary())


SKILLS = """select doc_id, canonical, n as support_count, f as flagged_support_count, ids as span_ids,
    round(case when f = 0 then round_even(least(0.6 + 0.1 * (n - 1), 0.9), 3) when f = n then 0.15 else round_even(least(0.6 + 0.1 * (n - 1), 0.9) * ((n - f) / n), 3) end * 1000)::int as conf_milli
    from (select doc_id, canonical, count(*) as n, count(*) filter (flagged) as f, string_agg(span_id, ',' order by page, seqno) as ids
          from (select h.*, exists (select 1 from links l where l.span_id = h.span_id) as flagged from hits h) group by all)"""


@query(sql(SKILLS, "spans", **LINK_PARTS, hits=HITS))
def skill_confidence(t):
    found, _ = skills.match(t.spans(), grown_findings(t), skills.CORPUS_TERMS)
    return found.select("doc_id", "canonical", "support_count", "flagged_support_count", F.array_join("span_ids", ",").alias("span_ids"), milli(F.col("confidence")).alias("conf_milli"))


# --- claims -----------------------------------------------------------------------------------------------------------------------

RAW = """select r.run_id, r.requirement_id, r.ordinal, r.l_partkey, r.l_suppkey, r.w, o_custkey % (select count(*) from documents) as doc_id, (l_partkey % 101) / 100.0 as confidence,
    case l_suppkey % 5 when 0 then 'none' when 1 then 'adjacent' else 'direct' end as kind, l_suppkey % 5 = 1 and l_partkey % 7 = 0 as note_missing
    from reqs r join orders on r.run_id = o_orderkey where l_suppkey % 11 <> 7"""
CITED = """select run_id, requirement_id, doc_id, span_id, min(k)::int as cite_pos from (
    select run_id, requirement_id, doc_id, k, doc_id || '-' || case k when 0 then l_partkey % 12 when 1 then l_suppkey % 40 else l_partkey % 5 end as span_id from (select *, unnest(range(l_suppkey % 3 + 1)) as k from raw)) group by all"""
CITE_PARTS = {"raw": RAW, "cited": CITED}


@query(sql("select * from cited c where exists (select 1 from spans s where s.span_id = c.span_id)", "spans", "reqs", **CITE_PARTS))
def citation_valid(t):
    return claims.valid_citations(t.raw_claims(), t.spans()).select("run_id", "requirement_id", "doc_id", "span_id", "cite_pos")


@query(sql("select * from cited c where not exists (select 1 from spans s where s.span_id = c.span_id)", "spans", "reqs", **CITE_PARTS))
def citation_invalid(t):
    return claims.invalid_citations(t.raw_claims(), t.spans()).select("run_id", "requirement_id", "doc_id", "span_id", "cite_pos")


JUDGED = """select q.run_id, q.requirement_id, q.ordinal, q.necessity, q.w, r.requirement_id is not null as has_claim, r.kind, r.confidence, coalesce(nv, 0) as nv, coalesce(ni, 0) as ni, prim, coalesce(worst, 0) as worst,
    case when r.requirement_id is null then 'no_claim' when note_missing then 'missing_adjacency_note' when coalesce(ni, 0) > 0 then 'invalid_citation' when r.kind <> 'none' and coalesce(nv, 0) = 0 then 'met_without_evidence' end as reason
    from reqs q left join raw r on q.requirement_id = r.requirement_id
    left join (select requirement_id, count(*) filter (known) as nv, count(*) filter (not known) as ni, arg_min(span_id, cite_pos) filter (known) as prim from (select c.*, s.span_id is not null as known from cited c left join spans s on c.span_id = s.span_id) group by all) v on v.requirement_id = q.requirement_id
    left join (select requirement_id, max(case severity when 'high' then 2 when 'suspicious' then 1 else 0 end) as worst from cited c join links l on l.span_id = c.span_id group by all) i on i.requirement_id = q.requirement_id"""
BUILT = """select *, case when met and kind = 'direct' then 10000 when met then 6000 else 0 end::bigint as s, case when met then least(10000, 7000 + 1000 * nv) else 0 end::bigint as c, case when not met or worst = 0 then 10000 when worst = 1 then 5000 else 0 end::bigint as g
    from (select *, reason is null and kind <> 'none' as met from judged)"""
BUILT_PARTS = LINK_PARTS | CITE_PARTS | {"judged": JUDGED, "built": BUILT}


def _built(t):
    return claims.build(t.requirements(texts=False), t.raw_claims(), t.spans(), grown_findings(t))


@query(sql("""select run_id, requirement_id, met, case when met then kind else 'none' end as match_type, s / 10000.0 as satisfaction, c / 10000.0 as corroboration, g / 10000.0 as integrity_factor, w / 10000.0 as weight_applied,
    case when has_claim then round(confidence * 10000)::int else 10000 end as conf_4, case when met then prim end as primary_span_id, reason is not null as rejected, reason, c * g // 10000 / 10000.0 as evidence_quality, w * s * (c * g // 10000) // 100000000 / 10000.0 as contribution from built""", "spans", "reqs", **BUILT_PARTS))
def build_claims(t):
    out, _, _ = _built(t)
    out = out.withColumn("conf_4", F.round(F.col("confidence") * 10000).cast("int")).drop("confidence", "ordinal", "requirement_kind", "necessity", "criticality", "rationale", "adjacency_note", "primary_page", "primary_bbox", "all_evidence_spans")
    return doubles(out, "satisfaction", "corroboration", "integrity_factor", "weight_applied", "evidence_quality", "contribution")


@query(sql("select c.run_id, c.requirement_id, c.span_id, c.cite_pos from cited c join built b on b.requirement_id = c.requirement_id and b.met join spans s on s.span_id = c.span_id", "spans", "reqs", **BUILT_PARTS))
def claim_evidence(t):
    return _built(t)[1].drop("doc_id")


@query(sql("select distinct c.run_id, c.requirement_id, l.finding_id from cited c join built b on b.requirement_id = c.requirement_id and b.met join links l on l.span_id = c.span_id", "spans", "reqs", **BUILT_PARTS))
def claim_findings(t):
    return _built(t)[2]


@query(sql("select run_id, count(*) filter (reason is null) as accepted, count(*) filter (reason is not null) as rejected from built group by run_id", "spans", "reqs", **BUILT_PARTS))
def claim_rejections(t):
    return claims.outcome_counts(_built(t)[0])


@query(sql(f"select run_id, {tenths('k', 'w')} / 10.0 as score, unmet as unmet_required_count from (select run_id, sum(w)::bigint as w, sum(w * s * (c * g // 10000) // 100000000)::bigint as k, count(*) filter (necessity = 'required' and w * s * (c * g // 10000) // 100000000 = 0) as unmet from built group by run_id)", "spans", "reqs", **BUILT_PARTS))
def verified_match_score(t):
    """Scores over claims that were checked against their evidence."""
    return doubles(scoring.summarize(claims.as_scored(_built(t)[0])).select("run_id", "score", "unmet_required_count"), "score")


@query(sql("""select requirement_id, kind as match_type, confidence from raw where l_partkey % 10 > 1""", "reqs", raw=RAW.replace("(l_partkey % 101) / 100.0 as confidence", "case l_partkey % 10 when 2 then 1.0 when 3 then 0.0 when 4 then 1.0 else (l_partkey % 101) / 100.0 end as confidence")))
def coerce_claims(t):
    """Claims read from model output: letter case and numbers out of range are mended, what breaks the schema is refused."""
    rows = t.raw_claims().join(t.run_lines().select("requirement_id", "l_partkey"), "requirement_id")
    k = F.col("l_partkey") % 10
    number = F.when(k == 2, F.lit('"high"')).when(k == 3, F.lit("-4")).when(k == 4, F.lit('"7"')).otherwise(F.col("confidence").cast("string"))
    kind = F.when(k == 1, F.lit("perhaps")).when(k == 5, F.concat(F.lit(" "), F.upper("match_type"))).otherwise(F.col("match_type"))
    payload = F.when(k == 0, F.lit('{"requirement_id": ')).otherwise(F.concat(F.lit('{"requirement_id": "'), "requirement_id", F.lit('", "met": true, "match_type": "'), kind, F.lit('", "confidence": '), number, F.lit(', "evidence_spans": ["a"]}')))
    good, _ = claims.coerce(rows.select("run_id", payload.alias("payload")))
    return good.select("requirement_id", "match_type", "confidence")
