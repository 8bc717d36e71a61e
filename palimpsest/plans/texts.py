"""Registered queries over job texts and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, requirements
from .common import Plan, doubles
from .oracle import sql

PLAN = Plan()
query = PLAN.query

RAW = r"""select doc_id % 50 as user_id, doc_id as job_id, timestamp '2024-01-01 00:00:00' + to_minutes(doc_id::int) as created_at,
    case when doc_id % 10 = 1 then replace(text, chr(10), chr(13) || chr(10)) when doc_id % 10 = 2 then text || chr(10) || chr(10) || chr(10) || chr(10) || 'End.'
         when doc_id % 10 = 3 then text || chr(10) || 'We are an equal opportunity employer.' when doc_id % 10 = 4 then 'a' || chr(8203) || 'b' || chr(8238) || 'c ' || text
         when doc_id % 100 = 5 then ' ' || chr(10) || ' ' else text end as raw_text from documents"""
NORMAL = r"""select *, trim(regexp_replace(regexp_replace(replace(replace(raw_text, chr(8203), ''), chr(8238), ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as t,
    length(raw_text) - length(replace(raw_text, chr(8203), '')) as zw, length(raw_text) - length(replace(raw_text, chr(8238), '')) as bd from raw"""
TOKENS = r"greatest((length(t) + 3) // 4, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')))"
JUDGED = f"select *, {TOKENS} as tokens, case when t = '' then 'invalid_input' when {TOKENS} > 8000 then 'token_limit_exceeded' end as reject_code from normal"
PARTS = {"raw": RAW, "normal": NORMAL, "judged": JUDGED}


def normalized(t):
    return requirements.normalize_job_text(t.job_texts())


@query(sql("select job_id, case when reject_code is null then sha256(t) end as sha256, zw as zero_width_count, bd as bidi_count, tokens as token_count, reject_code from judged", **PARTS))
def normalize_text(t):
    out = normalized(t).select("job_id", "sha256", "zero_width_count", "bidi_count", "token_count", "reject_code")
    return out.withColumns({c: F.col(c).cast("long") for c in ("zero_width_count", "bidi_count", "token_count")})


@query(sql(r"select doc_id, case when text = '' then 0 else greatest((length(text) + 3) // 4, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) end as tokens from documents"))
def token_estimate(t):
    return t.read("documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(sql("select job_id, (length(t) - 37)::int as start, length(t)::int as \"end\", 'equal_opportunity' as category from judged where reject_code is null and contains(t, 'We are an equal opportunity employer.')", **PARTS))
def boilerplate_spans(t):
    return normalized(t).select("job_id", F.explode("boilerplate").alias("b")).select("job_id", "b.start", "b.end", "b.category")


@query(sql("""select job_id, is_dup as is_duplicate, case when is_dup then first end as duplicate_of from (
    select job_id, sha256(t) as sha, first_value(job_id) over w as first, row_number() over w > 1 as is_dup from judged where reject_code is null window w as (partition by user_id % 5, sha256(t) order by created_at, job_id))""", **PARTS))
def text_dedup(t):
    rows = tx.once(normalized(t).where("reject_code is null"), sha256=F.col("sha256")).withColumn("user_id", F.col("user_id") % 5)
    return dedup.first_by_hash(rows, ["user_id", "sha256"], ["created_at", "job_id"]).select("job_id", "is_duplicate", "duplicate_of")


EXTRACTED = """select doc_id as job_id, i as pos, i * 5 as s, case when i % 9 = 8 then length(text) + 5 else i * 5 + 20 end as e, case when i % 4 = 3 then 'somewhere else' else substr(text, i * 5 + 1, 20) end as quote, text as job_text,
    case when i % 3 = 0 then 'preferred' else 'required' end as necessity, case when i % 2 = 0 then 'hard_skill' else 'soft_skill' end as kind, least(3, greatest(1, i - 2))::int as criticality
    from (select *, unnest(range(12))::int as i from documents where n_chars >= 60)"""
CHECKED = "select *, case when not (s >= 0 and s < e and e <= length(job_text)) then 'bounds' when substr(job_text, s + 1, e - s) <> quote then 'mismatch' end as reject_code from extracted"
EX_PARTS = {"extracted": EXTRACTED, "checked": CHECKED}


def _texts(t):
    return t.read("documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("normalized_text"))


@query(sql("select job_id, pos, reject_code from checked", **EX_PARTS))
def provenance_check(t):
    return requirements.check_provenance(t.extracted(), _texts(t)).select("job_id", "pos", "reject_code")


@query(sql("select job_id, (row_number() over (partition by job_id order by pos))::int as ordinal, 'need ' || pos as text, kind, necessity, criticality, criticality * case necessity when 'required' then 1.0 else 0.4 end::double as weight, s as evidence_start, e as evidence_end from checked where reject_code is null", **EX_PARTS))
def requirement_ordinals(t):
    good, _ = requirements.validate(t.extracted(), _texts(t))
    return doubles(good.drop("evidence_quote"), "weight")


@query(sql("select job_id, count(*) filter (reject_code is null) as accepted, count(*) filter (reject_code = 'bounds') as bounds, count(*) filter (reject_code = 'mismatch') as mismatch from checked group by job_id", **EX_PARTS))
def provenance_counts(t):
    rows = requirements.check_provenance(t.extracted(), _texts(t))
    return rows.groupBy("job_id").agg(F.count_if(F.col("reject_code").isNull()).alias("accepted"), F.count_if(F.col("reject_code") == "bounds").alias("bounds"), F.count_if(F.col("reject_code") == "mismatch").alias("mismatch"))


@query(sql("select doc_id, sha256(case when length(one) > 400 then substr(one, 1, 399) || '…' else one end) as excerpt_sha from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as one from documents)"))
def text_excerpt(t):
    return t.read("documents").select("doc_id", F.sha2(tx.excerpt(F.col("text")), 256).alias("excerpt_sha"))


@query(sql("select l_orderkey || '-' || l_linenumber || '-' || l_partkey as line_key, array_to_string(list_transform(string_split(p_type || ' ' || p_name, ' ')[1:4], lambda x: upper(x[1]) || lower(x[2:])), ' ') as label from lineitem join part on l_partkey = p_partkey"))
def skill_labels(t):
    rows = t.read("lineitem").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    lead = F.when(F.col("l_partkey") % 3 == 0, F.lit("Strong understanding of ")).when(F.col("l_partkey") % 3 == 1, F.lit("3 years of experience in ")).otherwise(F.lit(" "))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line_key"), tx.skill_label(F.concat(lead, "p_type", F.lit(" "), "p_name", F.lit(", or (similar)"))).alias("label"))
