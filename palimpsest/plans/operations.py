"""Registered queries over runs, calls and events: gates, lists, views, telemetry, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.decimals import milli
from ..functions.geometry import hex_colour
from ..operators import claims, costs, dedup, gaps, gates, metrics, packets, scoring, skills, views
from .common import Plan, doubles
from .documents import ALL_PARTS, COUNTED, PLACED_ALL, grown_findings, without_d6
from .evidence import BUILT_PARTS, HITS, LINK_PARTS, SKILLS
from .oracle import sql, tenths
from .scores import CANDIDATE_PARTS, scored

PLAN = Plan()
query = PLAN.query

RUNS = """select o_orderkey as run_id, o_custkey as user_id, o_custkey % 200 as resume_id, o_orderkey % 500 as job_id, o_orderkey % 2 as prompt_version_id, 'v1' as scoring_version,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'processing' end as state, o_orderdate as created_at from orders"""
CALLS = """select requirement_id as call_id, o_custkey as user_id, case when l_partkey % 4 = 0 then 'extraction' else 'matching' end as purpose, run_id, case l_suppkey % 3 when 0 then 'primary' when 1 then 'fallback' else 'unknown' end as model,
    (l_quantity * 100)::bigint as input_tokens, l_partkey % 900 as output_tokens, l_partkey % 70 * 10 as cache_read_tokens, l_suppkey % 50 as cache_write_tokens, l_partkey % 3000 + 20 as latency_ms,
    case when l_partkey % 17 = 0 then 'refused' when l_partkey % 13 = 0 then 'error' else 'ok' end as outcome, (l_suppkey % 2 + 1)::int as attempt, o_orderdate as created_at from run_lines join orders on l_orderkey = o_orderkey"""
# in hundredths of a millionth of the price unit
PRICED = """select *, (case when model = 'fallback' then input_tokens * 500 + output_tokens * 2500 + cache_read_tokens * 50 + cache_write_tokens * 625
    else input_tokens * 200 + output_tokens * 1000 + cache_read_tokens * 20 + cache_write_tokens * 250 end)::bigint as m from calls"""
COSTED = "select *, (m + 5000) // 10000 as cost4 from priced"
CALL_PARTS = {"calls": CALLS, "priced": PRICED, "costed": COSTED}


def costed(t):
    return costs.call_cost(t.call_facts())


@query(sql("select call_id, model, cost4 / 10000.0 as cost, (m * 11 + 50000) // 100000 / 10000.0 as cost_us from costed", "run_lines", **CALL_PARTS))
def call_cost(t):
    us = costs.call_cost(t.call_facts(), "us").select("call_id", F.col("cost").alias("cost_us"))
    return doubles(costed(t).select("call_id", "model", "cost").join(us, "call_id"), "cost", "cost_us")


@query(sql("select run_id, count(*) as n_calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cost4)::bigint / 10000.0 as cost, sum(latency_ms)::bigint as latency_ms from costed group by run_id", "run_lines", **CALL_PARTS))
def run_telemetry(t):
    return doubles(costs.run_totals(costed(t)), "cost")


@query(sql("""select purpose, model, count(*) as n_calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cost4)::bigint / 10000.0 as spend, round(sum(cache_read_tokens) / (sum(cache_read_tokens) + sum(input_tokens)), 9) as cache_share,
    round(avg((outcome = 'refused')::int), 9) as refusal_rate, round(avg((attempt > 1)::int), 9) as retry_rate, quantile_cont(latency_ms, 0.5) as latency_p50, quantile_cont(latency_ms, 0.95) as latency_p95 from costed group by rollup (purpose, model)""", "run_lines", **CALL_PARTS))
def call_rollups(t):
    out = doubles(metrics.call_rollups(costed(t)), "spend")
    return out.withColumns({c: F.round(c, 9) for c in ("cache_share", "refusal_rate", "retry_rate")})


@query(sql("select user_id, created_at::date as day, sum(cost4)::bigint / 10000.0 as spend, count(*) as n_calls, sum(cost4) > 20000 as over, sum(cost4) >= 16000 as near from costed group by all", "run_lines", **CALL_PARTS))
def daily_spend(t):
    return doubles(metrics.daily_spend(costed(t)), "spend")


@query(sql("select run_id, user_id, count(*) over (partition by user_id order by created_at range between interval 1 hour preceding and current row) as runs_last_hour, count(*) over (partition by user_id, created_at::date order by created_at range between unbounded preceding and current row) as runs_today, null::varchar as limited_by from runs", runs=RUNS))
def usage_windows(t):
    return metrics.usage_windows(t.match_runs()).select("run_id", "user_id", "runs_last_hour", "runs_today", "limited_by")


@query(sql("select run_id, user_id, state, created_at, (select run_id from (select * from runs order by created_at desc, run_id desc limit 20) order by created_at, run_id limit 1) as next_key from (select * from runs order by created_at desc, run_id desc limit 20)", runs=RUNS))
def run_page(t):
    return views.page(t.match_runs(), 20).select("run_id", "user_id", "state", "created_at", "next_key")


@query(sql("select run_id, created_at from runs where resume_id < 100 and created_at <= timestamp '1998-01-01' and (created_at < timestamp '1998-01-01' or run_id < 5000) order by created_at desc, run_id desc limit 50", runs=RUNS))
def run_page_after(t):
    import datetime

    return views.page(t.match_runs(), 50, (datetime.datetime(1998, 1, 1), 5000), where=F.col("resume_id") < 100).select("run_id", "created_at")


LATEST = "select resume_id, job_id, prompt_version_id, scoring_version, arg_max(run_id, created_at::varchar || lpad(run_id::varchar, 12, '0')) as run_id, arg_max(state, created_at::varchar || lpad(run_id::varchar, 12, '0')) as state from runs where run_id % 3 > 0 group by all"


@query(sql("""select r.run_id as request_id, case when l.run_id is null then 'create' when l.state = 'failed' then 'requeue' else 'return' end as action, l.run_id, l.run_id is not null as reused, coalesce(l.state <> 'failed', false) as duplicate
    from runs r left join latest l using (resume_id, job_id, prompt_version_id, scoring_version) where r.run_id % 3 = 0""", runs=RUNS, latest=LATEST))
def run_dedup(t):
    runs = t.match_runs()
    asked = runs.where("run_id % 3 = 0").select(F.col("run_id").alias("request_id"), *dedup.RUN_KEY)
    return dedup.run_keys(asked, runs.where("run_id % 3 > 0")).select("request_id", "action", "run_id", "reused", "duplicate")


@query(sql("select run_id, user_id from runs where user_id = 7", runs=RUNS))
def tenant_runs(t):
    return gates.owned(t.match_runs(), 7).select("run_id", "user_id")


@query(sql("""select run_id, r.resume_id, r.job_id, case when r.resume_id % 11 = 0 then 'resume_not_ready' when r.job_id % 13 = 0 then 'job_not_ready' when not exists (select 1 from lineitem where l_orderkey = r.job_id) then 'no_requirements'
    when not exists (select 1 from documents where doc_id = r.resume_id and trim(replace(text, chr(10), ' ')) <> '') then 'no_evidence' end as failure_code from runs r""", runs=RUNS))
def readiness(t):
    docs = t.read("documents").select(F.col("doc_id").alias("resume_id"))
    resumes = docs.withColumn("state", F.when(F.col("resume_id") % 11 == 0, "processing").otherwise("completed"))
    jobs = t.match_runs().select("job_id").distinct().withColumn("state", F.when(F.col("job_id") % 13 == 0, "queued").otherwise("completed"))
    asked = t.requirements().select(F.col("run_id").alias("job_id"))
    return gates.readiness(t.match_runs().select("run_id", "resume_id", "job_id"), resumes, jobs, asked, t.spans().select(F.col("doc_id").alias("resume_id")))


@query(sql("""select run_id, case run_id % 5 when 0 then 'llm_disabled' when 1 then case when run_id % 3 = 0 then null else 'privacy_gate' end when 2 then case when run_id % 7 = 0 then 'privacy_gate' when date_diff('day', created_at::date, date '1998-12-31') between 0 and 365 then null else 'privacy_gate' end
    when 3 then 'privacy_gate' else 'privacy_gate' end as reject_code from runs""", runs=RUNS))
def privacy_gate(t):
    runs = t.match_runs()
    k = F.col("run_id") % 5
    mode = F.when(k == 0, "disabled").when(k == 1, " FIXTURES_only").when(k == 2, "production").when(k == 3, "production").otherwise("other")
    when = F.when(k == 3, F.lit("not a date")).otherwise(F.date_format("created_at", "yyyy-MM-dd"))
    code = gates.privacy(mode, F.col("run_id") % 3 == 0, F.when(F.col("run_id") % 7 == 0, " ").otherwise("att-1"), when, F.lit("1998-12-31").cast("date"))
    return runs.select("run_id", code.alias("reject_code"))


@query(sql("""select doc_id, sha256(text) as sha256, strlen(text) as byte_size, (doc_id % 45)::int as page_count, case when strlen(text) = 0 then 'invalid_pdf' when strlen(text) > 10000 then 'file_too_large' when doc_id % 45 < 1 then 'invalid_pdf' when doc_id % 45 > 40 then 'page_limit_exceeded' end as reject_code from documents"""))
def admission(t):
    size, pages = F.octet_length("text"), (F.col("doc_id") % 45).cast("int")
    return t.read("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), size.cast("long").alias("byte_size"), pages.alias("page_count"), gates.admission(size, pages, max_bytes=10_000).alias("reject_code"))


@query(sql("""select c_custkey as id, case when c_custkey % 4 = 0 then null else c_name end as text, case when c_custkey % 4 <> 2 then null when c_custkey % 8 = 2 then 'a.pdf' else 'document.pdf' end as file, c_custkey % 3 = 0 as is_fixture,
    case when c_custkey % 7 = 0 then 'invalid_input' when c_custkey % 4 in (0, 2) then 'invalid_input' end as reject_code from customer"""))
def intake_cleaning(t):
    k = F.col("c_custkey")
    path = F.when(k % 4 != 2, F.lit("  ")).when(k % 8 == 2, F.lit("C:\\docs\\a.pdf")).otherwise(F.lit("docs/"))
    rows = t.read("customer").select(
        k.alias("id"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "c_name")).alias("text"), path.alias("file"), F.when(k % 3 == 0, F.lit(" YES ")).otherwise("no").alias("is_fixture"),
        F.when(k % 7 == 0, F.lit("not-an-id")).otherwise(F.lit("0123abcd-0000-4000-8000-0123456789ab")).alias("resume_id"),
    )
    return gates.clean_intake(rows).drop("resume_id")


@query(sql("""select 'lineitem' as table_name, 'quantity' as rule, l_orderkey::varchar as key, 1::bigint as n from lineitem where not l_quantity < 50 union all
    select 'lineitem', 'unique l_orderkey,l_linenumber', l_orderkey || '/' || l_linenumber, count(*) from lineitem group by l_orderkey, l_linenumber having count(*) > 1"""))
def constraint_violations(t):
    return gates.violations("lineitem", t.read("lineitem"), {"quantity": F.col("l_quantity") < 50}, [["l_orderkey", "l_linenumber"]])


@query(sql("""select run_id, batch_no, count(*) as n_requirements from (select run_id, (case when count(*) over (partition by run_id) <= 4 then 0 else (row_number() over (partition by run_id order by ordinal) - 1) // 3 end)::int as batch_no from reqs) group by all""", "reqs"))
def requirement_batches(t):
    return packets.batch_numbers(t.requirements(), 4, 3).groupBy("run_id", "batch_no").agg(F.count("*").alias("n_requirements"))


EVID = "select doc_id, string_agg('[' || span_id || '] (Page ' || page || '): ' || trim(text), chr(10) order by page, seqno) as evidence from spans group by doc_id"
ASKED = "select run_id, batch_no, string_agg('[' || requirement_id || '] (kind=hard_skill, necessity=' || necessity || ', criticality=' || criticality || '): ' || trim(text), chr(10) order by ordinal) as asked from (select *, (case when count(*) over (partition by run_id) <= 4 then 0 else (row_number() over (partition by run_id order by ordinal) - 1) // 3 end)::int as batch_no from reqs) group by all"
PACKET = """'<untrusted_resume nonce="n">' || chr(10) || coalesce(evidence, '') || chr(10) || '</untrusted_resume>' || chr(10) || case when coalesce(terms, '') <> '' then chr(10) || '<terms_mentioned>' || chr(10) || terms || chr(10) || '</terms_mentioned>' || chr(10) else '' end || chr(10) ||
    '<untrusted_requirements nonce="n">' || chr(10) || asked || chr(10) || '</untrusted_requirements>' || chr(10) || chr(10) || 'Evaluate the resume against each requirement above. For each requirement, determine if it is met, the match type, and cite the supporting span IDs from the resume.'"""


@query(sql(f"select run_id, batch_no, doc_id, sha256({PACKET}) as message_sha from asks join (select o_orderkey as run_id, o_custkey % 200 as doc_id from orders) using (run_id) left join evid using (doc_id) left join (select doc_id, string_agg(distinct canonical, ', ' order by canonical) as terms from hits group by doc_id) using (doc_id)", "spans", "reqs", hits=HITS, evid=EVID, asks=ASKED))
def evidence_packets(t):
    runs = t.match_runs().select("run_id", F.col("resume_id").alias("doc_id"))
    found = skills.match_terms(t.spans(), skills.CORPUS_TERMS)
    out = packets.assemble(runs, t.spans(), t.requirements(), found, F.lit("n"), 4, 3)
    return out.select("run_id", "batch_no", "doc_id", F.sha2("message", 256).alias("message_sha"))


@query(sql("select run_id, arg_min(v, b) as narrative from (select l_orderkey as run_id, l_linenumber as b, case when min(l_partkey) % 3 = 0 then null else 'n' || min(l_partkey) end as v from lineitem group by all) where v is not null group by run_id"))
def first_narrative(t):
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("batch_no")).agg(F.min("l_partkey").alias("k"))
    return packets.first_narrative(rows.select("run_id", "batch_no", F.when(F.col("k") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("n"), "k")).alias("narrative")))


# --- views ------------------------------------------------------------------------------------------------------------------------


@query(sql("""select d.doc_id, n_chars, (select string_agg(page, ',' order by page) from pages p where p.doc_id = d.doc_id) as pages, coalesce(high, 0) as high, coalesce(suspicious, 0) as suspicious, coalesce(info, 0) as info, coalesce(n, 0) as skill_count, exists (select 1 from pages p where p.doc_id = d.doc_id) as has_evidence
    from documents d left join (select doc_id, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'suspicious') as suspicious, count(*) filter (severity = 'info') as info from counted group by doc_id) using (doc_id) left join (select doc_id, count(distinct canonical) as n from hits group by doc_id) using (doc_id)""", *PLACED_ALL, **ALL_PARTS, counted=COUNTED, hits=HITS))
def resume_view(t):
    found, _ = skills.match(t.spans(), grown_findings(t), skills.CORPUS_TERMS)
    out = views.resume_view(t.read("documents").select("doc_id", "n_chars"), t.pages(), without_d6(t), found)
    return out.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(sql(f"select s.doc_id, s.canonical, support_count, conf_milli, span_ids as evidence from ({SKILLS}) s", "spans", **LINK_PARTS, hits=HITS))
def skill_view(t):
    found, evidence = skills.match(t.spans(), grown_findings(t), skills.CORPUS_TERMS)
    out = views.skill_view(found, evidence)
    return out.select("doc_id", "canonical", "support_count", milli(F.col("confidence")).alias("conf_milli"), F.array_join(F.transform("evidence", lambda e: e["span_id"]), ",").alias("evidence"))


@query(sql("""select job_id, status, coalesce(n, 0) as requirement_count, texts as requirements from (select distinct job_id, case when job_id % 13 = 0 then 'not_ready' else 'ready' end as status from runs) left join (select run_id as job_id, count(*) as n, string_agg(text, '|' order by ordinal) as texts from reqs group by run_id) using (job_id)""", "reqs", runs=RUNS))
def job_view(t):
    jobs = t.match_runs().select("job_id").distinct().withColumn("state", F.when(F.col("job_id") % 13 == 0, "queued").otherwise("completed"))
    out = views.job_view(jobs, t.requirements().withColumnRenamed("run_id", "job_id"))
    return out.select("job_id", "status", "requirement_count", F.array_join(F.transform("requirements", lambda r: r["text"]), "|").alias("requirements"))


@query(sql("""select r.run_id, state, string_agg(requirement_id || ':' || coalesce(spans, ''), '|' order by ordinal) as claims from runs r left join (
    select b.run_id, b.requirement_id, b.ordinal, string_agg(c.span_id, ',' order by c.cite_pos) as spans from built b left join (select c.* from cited c join spans s on s.span_id = c.span_id) c on c.requirement_id = b.requirement_id and b.met group by all) x on x.run_id = r.run_id group by all""", "spans", "reqs", **BUILT_PARTS, runs=RUNS))
def match_view(t):
    built, _, _ = claims.build(t.requirements(texts=False), t.raw_claims(), t.spans(), grown_findings(t))
    out = views.match_view(t.match_runs().select("run_id", "state"), built)
    return out.select("run_id", "state", F.array_join(F.transform("claims", lambda c: F.concat(c["requirement_id"], F.lit(":"), F.array_join(c["all_evidence_spans"], ","))), "|").alias("claims"))


@query(sql(f"""select run_id, {tenths('tk', 'tw')} / 10.0 as score, coalesce(n, 0)::int as n_gaps, first_gap, coalesce(nc, 0)::int as n_candidates, (case when coalesce(nc, 0) < 2 then 0 else (1 << nc) - 1 - nc end)::int as n_combinations
    from totals left join (select run_id, count(*) as n, arg_min(requirement_id, (100000 - points) * 1000 + ordinal) as first_gap from items group by run_id) using (run_id) left join (select run_id, count(*) as nc from cands group by run_id) using (run_id)""", "totals", **CANDIDATE_PARTS))
def gap_view(t):
    out = views.gap_view(scored(t, texts=True))
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast(out.schema[c].dataType))), F.lit(0))
    return doubles(out.select("run_id", "score", size("gaps").alias("n_gaps"), F.get("gaps", F.lit(0))["requirement_id"].alias("first_gap"), size("candidates").alias("n_candidates"), size("combinations").alias("n_combinations")), "score")


@query(sql("select run_id, necessity, count(*) as n, count(*) filter (counts) as n_met from scored group by all", "scored"))
def necessity_counts(t):
    return views.necessity_counts(scored(t))


@query(sql("select user_id, count(*) filter (state = 'completed') as analysed, count(*) filter (state = 'processing') as in_progress, count(*) as total from runs group by user_id", runs=RUNS))
def dashboard_counts(t):
    return views.dashboard(t.match_runs())


@query(sql("select distinct doc_id, page, 'resumes/' || doc_id || '/original.pdf' as resume_key, 'jobs/' || doc_id || '/original.pdf' as job_key, printf('resumes/%d/pages/%04d.png', doc_id, page) as page_key from pages", "pages"))
def object_keys(t):
    resume, job, image = views.object_keys(F.col("doc_id"), F.col("page"))
    return t.pages().select("doc_id", "page", resume.alias("resume_key"), job.alias("job_key"), image.alias("page_key"))


@query(sql("select doc_id, count(*) as page_count, 'text_layer+ocr' as method, true as any_render from pages group by doc_id", "pages"))
def extraction_summary(t):
    return views.extraction_summary(t.pages())


@query(sql("select span_id, case when grey = 1 then '#ffffff' when grey = 0.85 then '#d9d9d9' else '#000000' end as colour from spans", "spans"))
def span_colours(t):
    return t.spans().select("span_id", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


# --- events -----------------------------------------------------------------------------------------------------------------------

STATES = """select user_id as run_id, event_id, ts, case when event_type = 'signup' then 'queued' when event_type in ('view', 'click') then 'processing' when event_type = 'purchase' then 'completed' else 'failed' end as state,
    case when event_type = 'purchase' and event_id % 2 = 0 then value end as impact_delta, case when event_id % 3 = 0 then 'model_error' end as failure_code from events"""
CHANGES = "select * exclude (before) from (select *, lag(state) over (partition by run_id order by ts, event_id) as before from states) where state is distinct from before"


@query(sql("select run_id, event_id, state from changes", states=STATES, changes=CHANGES))
def state_changes(t):
    return dedup.state_changes(t.state_events(), ["ts", "event_id"]).select("run_id", "event_id", "state")


@query(sql("""select run_id, event_id, stage, case when stage = 'failed' then coalesce(failure_code, 'matching_failed') end as failure_code from (select *, unnest(case state when 'queued' then ['queued'] when 'processing' then ['scoring'] when 'failed' then ['failed'] else case when impact_delta > 0 then ['canary', 'complete'] else ['complete'] end end) as stage
    from (select *, coalesce(sum((state in ('completed', 'failed'))::int) over (partition by run_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as ended from changes) where ended = 0)""", states=STATES, changes=CHANGES))
def run_stages(t):
    return dedup.stages(t.state_events(), ["ts", "event_id"]).select("run_id", "event_id", "stage", "failure_code")


@query(sql("select time_bucket(interval 1 hour, ts) as window_start, event_type as purpose, count(*) as n, round(sum(value), 4) as total from events group by all"))
def call_windows(t):
    out = t.read("events").groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("purpose")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "purpose", "n", "total")


# --- evaluation -------------------------------------------------------------------------------------------------------------------


@query(sql("""select quality, n, k as successes, round(greatest(0, (k / n + z2 / (2 * n)) / (1 + z2 / n) - 1.959963984540054 / (1 + z2 / n) * sqrt(k / n * (1 - k / n) / n + z2 / (4.0 * n * n))), 9) as low, round(least(1, (k / n + z2 / (2 * n)) / (1 + z2 / n) + 1.959963984540054 / (1 + z2 / n) * sqrt(k / n * (1 - k / n) / n + z2 / (4.0 * n * n))), 9) as high
    from (select quality, count(*) as n, count(*) filter (toxic = 1) as k, 1.959963984540054 ** 2 as z2 from labels group by quality)"""))
def wilson_interval(t):
    out = metrics.rates(t.read("labels"), ["quality"], F.col("toxic") == 1)
    return out.select("quality", "n", "successes", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


RATED = "select doc_id, quality as a, case when doc_id % 9 = 0 then 1 - quality else quality end as b from labels"


@query(sql("""select n, round((po - pe) / (1 - pe), 9) as kappa, round((po - pe) / (1 - pe), 9) as weighted_kappa from (select count(*) as n, avg((a = b)::int) as po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) as pe from rated)""", rated=RATED))
def kappa(t):
    rated = t.read("labels").select(F.col("quality").alias("a"), F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b"))
    return metrics.kappa(rated, "a", "b").withColumns({c: F.round(c, 9) for c in ("kappa", "weighted_kappa")})


@query(sql("select bin, n, round(m, 9) as mean_score, round(o, 9) as observed, round(n / (select count(*) from labels) * abs(m - o), 9) as error_part from (select (doc_id % 100 // 10)::int as bin, count(*) as n, avg(doc_id % 100 / 100.0) as m, avg(quality) as o from labels group by 1)"))
def calibration(t):
    rows = t.read("labels").select((F.col("doc_id") % 100 / 100.0).alias("score"), F.col("quality"))
    return metrics.calibration(rows.withColumn("score", F.col("score") + 1e-9), "score", "quality").withColumns({c: F.round(c, 6) for c in ("mean_score", "observed", "error_part")})


PLAN.oracle["calibration"] = PLAN.oracle["calibration"].replace(", 9)", ", 6)")


@query(sql("select tp, fp, fn, tn, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall from (select count(*) filter (a = 1 and b = 1) as tp, count(*) filter (a = 0 and b = 1) as fp, count(*) filter (a = 1 and b = 0) as fn, count(*) filter (a = 0 and b = 0) as tn from rated)", rated=RATED))
def confusion(t):
    said = F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")) == 1
    out = metrics.confusion(t.read("labels"), [], F.col("quality") == 1, said)
    return out.select("tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(sql("select doc_id, case when list_reduce(list_prepend(0::bigint, list_transform(string_split(sha256(doc_id || 'split-v1'), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::bigint)), lambda a, c: (a * 16 + c) % 100) < 30 then 'test' else 'train' end as split from documents"))
def split_assignment(t):
    return metrics.assign_split(t.read("documents").select("doc_id"), "doc_id")


@query(sql("select span_id || '?' as locator_id, span_id, (k - 1)::int as occurrence from (select *, row_number() over (partition by doc_id, page, n order by seqno) as k from (select *, replace(lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), 'ß', 'ss') as n from spans))", "spans"))
def locator_resolution(t):
    """Every span by its quote in capitals, and which of the page's equal quotes it is."""
    spans = t.spans()
    along = Window.partitionBy("doc_id", "page", "norm").orderBy("seqno")
    told = spans.withColumn("norm", tx.comparison_form(F.col("text"))).withColumn("occurrence", F.row_number().over(along) - 1)
    asked = told.select(F.concat("span_id", F.lit("?")).alias("locator_id"), "doc_id", "page", F.upper("text").alias("quote"), "occurrence")
    found, _ = metrics.resolve_locators(asked, spans)
    return found.select("locator_id", "span_id", "occurrence")


@query(sql("select span_id, tokens_so_far, tokens_so_far <= 300 as kept from (select span_id, (sum(greatest((length(text) + 3) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))) over (partition by doc_id order by page, seqno rows between unbounded preceding and current row))::bigint as tokens_so_far from spans)", "spans"))
def evidence_truncation(t):
    return metrics.truncate_evidence(t.spans(), 300).select("span_id", "tokens_so_far", "kept")


@query(sql("select run_id, prompt_version_id <> 1 as is_stale from runs", runs=RUNS))
def stale_runs(t):
    current = t.match_runs().agg(F.max("prompt_version_id").alias("prompt_version_id"), F.max("scoring_version").alias("scoring_version"))
    return metrics.stale_runs(t.match_runs(), current).select("run_id", "is_stale")


@query(sql("select count(*) as n_pairs, round(avg(abs(a - b)), 6) as mean_difference, round(max(abs(a - b)), 6) as largest_difference from (select run_id, sum(kt) * 100.0 / sum(w) as a, sum(k) * 100.0 / sum(w) as b from scored group by run_id)", "scored"))
def score_robustness(t):
    rows = scoring.summarize(scored(t))
    score = lambda c, v: rows.select(F.col("run_id").alias("pair_id"), F.lit(v).alias("variant"), (F.col(c).cast("double") * 100 / F.col("total_weight").cast("double")).alias("score"))
    out = metrics.robustness(score("total_contribution_if_trusted", "clean").unionByName(score("total_contribution", "injected")))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_difference", "largest_difference")})


@query(sql("select user_id as pair_id, count(*) as n, round(stddev_samp(value), 6) as sd, count(distinct event_type) as n_judgements from events group by user_id"))
def score_stability(t):
    rows = t.read("events").select(F.col("user_id").alias("pair_id"), F.col("event_id").alias("attempt"), F.col("value").alias("score"), F.col("event_type").alias("judgement"))
    return metrics.stability(rows).withColumn("sd", F.round("sd", 6))


@query(sql("""select b.run_id, b.requirement_id, 'hard_skill' as kind, b.necessity, r.criticality, met, case when met then kind else 'none' end as match_type, c / 10000.0 as corroboration, w * s * (c * g // 10000) // 100000000 / 10000.0 as contribution, p.page as primary_page,
    case when p.page is null then null else p.x0 || '/' || p.y0 || '/' || p.x1 || '/' || p.y1 end as bbox from built b join (select requirement_id, criticality from reqs) r using (requirement_id) left join spans p on b.met and p.span_id = b.prim""", "spans", "reqs", **BUILT_PARTS))
def claim_details(t):
    built, _, _ = claims.build(t.requirements(texts=False), t.raw_claims(), t.spans(), grown_findings(t))
    out = views.claim_details(built)
    return out.select("run_id", "requirement_id", "kind", "necessity", "criticality", "met", "match_type", "corroboration", "contribution", "primary_page", F.array_join(F.col("bbox").cast("array<string>"), "/").alias("bbox"))


@query(sql("""select item_id as template_id, count(distinct doc_id) as n_documents, min(doc_id) as first_doc from (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as quote from benchmark) b
    join (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as whole from documents) d on contains(whole, quote) where length(quote) >= 40 group by item_id"""))
def quote_leaks(t):
    """Benchmark items that documents contain, all against all."""
    return metrics.quote_leaks(t.read("benchmark").select(F.col("item_id").alias("template_id"), F.col("text").alias("body")), t.read("documents"))


@query(sql("select metric, before, after, after - before as change, coalesce(after - before < -0.02, true) as regressed from (select event_type as metric, (count(*) filter (event_id % 2 = 0))::double as before, (count(*) filter (event_id % 2 = 1))::double as after from events group by event_type)"))
def delta_gate(t):
    half = lambda k: t.read("events").where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return metrics.delta_gate(half(0), half(1))


@query(sql("select user_id, event_id, list_has_all(['view', 'click'], kinds) as known, len(kinds) / 5.0 as jaccard from (select user_id, min(event_id) as event_id, list(distinct event_type) as kinds from events group by user_id)"))
def set_agreement(t):
    """How alike the set of a user's event types and the full set are."""
    kinds = t.read("events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.collect_set("event_type").alias("kinds"))
    rows = kinds.withColumn("every", F.array(*[F.lit(k) for k in ("signup", "view", "click", "purchase", "error")]))
    known = F.size(F.array_except("kinds", F.array(F.lit("view"), F.lit("click")))) == 0
    return rows.select("user_id", "event_id", known.alias("known"), metrics.jaccard(rows, "kinds", "every").alias("jaccard"))


@query(sql("select job_id, n_truth, n_said, matched, round(matched / n_said, 9) as precision, round(matched / n_truth, 9) as recall from (select l_orderkey as job_id, count(*) as n_truth, count(*) filter (l_linenumber % 3 > 0) as n_said, count(*) filter (l_linenumber % 3 > 0) as matched from (select distinct l_orderkey, l_linenumber from lineitem) group by l_orderkey) where n_said > 0"))
def extraction_quality(t):
    """Requirements found again by their words: every third is left out of what is said."""
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ordinal")).distinct()
    named = rows.select("job_id", "ordinal", F.concat(F.lit("skill number w"), "ordinal", F.lit(" of v"), "ordinal", F.lit(" and u"), "ordinal").alias("text"), F.lit("required").alias("necessity"), F.lit(2).alias("criticality"))
    out = metrics.extraction_quality(named, named.where("ordinal % 3 > 0"), least=0.9)
    return out.where("n_said > 0").select("job_id", "n_truth", "n_said", "matched", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))
