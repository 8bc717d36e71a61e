"""Registered queries over positioned text: detectors, pages, OCR alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.decimals import milli
from ..functions.geometry import Box
from ..operators import alignment, detectors
from ..sources.adapters import Tables
from .common import Plan
from .oracle import sql

PLAN = Plan()
query = PLAN.query


def page_tables(t: Tables) -> detectors.PageTables:
    return detectors.PageTables(t.spans(), t.pages(), t.images(), t.lines(), t.ocr_lines())


def _findings(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", "finding_id", "detector_id", "severity", milli(F.col("confidence")).alias("conf_milli"), "page", "x0", "y0", "x1", "y1", "excerpt", *more)


def _rows(detector: str, severity: str, milli_: str, excerpt: str = "trim(regexp_replace(text, '\\s+', ' ', 'g'))", source: str = "spans", where: str = "true", suffix: str = "", place: str = "span_no", more: str = "") -> str:
    return f"""select doc_id, doc_id || '/{detector}{suffix}/' || page || '/' || {place} as finding_id, '{detector}' as detector_id, {severity} as severity, {milli_}::int as conf_milli, page, x0, y0, x1, y1,
        {excerpt} as excerpt{more} from {source} where {where}"""


CUT = "case when length({t}) > 400 then substr({t}, 1, 399) || '…' else {t} end"
ONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
EXCERPT = CUT.format(t=ONE)

# A page is a scan's text layer if nine tenths of it are invisible and an image covers half of it.
VISIBILITY = """select p.doc_id, p.page, n_spans, n_invisible, coalesce(covered, 0.0) as covered, n_invisible / n_spans >= 0.9 and coalesce(covered, 0) / (612.0 * 792.0) >= 0.5 as is_scan
    from (select doc_id, page, count(*) as n_spans, count(*) filter (render_mode = 3) as n_invisible from spans group by all) p
    left join (select doc_id, page, max(greatest(0, least(ix1, 612) - greatest(ix0, 0)) * greatest(0, least(iy1, 792) - greatest(iy0, 0))) as covered from images group by all) i on p.doc_id = i.doc_id and p.page = i.page"""
D1 = (
    _rows("D1", "'high'", "950", EXCERPT, "(select s.* from spans s join vis v on s.doc_id = v.doc_id and s.page = v.page where render_mode = 3 and not is_scan)")
    + " union all "
    + _rows("D1", "'info'", "800", CUT.format(t=ONE), "(select v.doc_id, v.page, 0.0::double as x0, 0.0::double as y0, 612.0::double as x1, 792.0::double as y1, 0 as span_no, string_agg(text, chr(10) order by seqno) as text from vis v join spans s on s.doc_id = v.doc_id and s.page = v.page where is_scan and n_invisible > 0 group by all)", place="'page'")
)
LUM = "(case when v <= 0.04045 then v / 12.92 else pow((v + 0.055) / 1.055, 2.4) end)"
RATIO = f"select *, 1.05 / ((0.2126 * {LUM} + 0.7152 * {LUM} + 0.0722 * {LUM}) + 0.05) as ratio from (select *, grey * opacity + (1.0 - opacity) as v from spans) where render_mode <> 3"
D2 = _rows("D2", "case when ratio < 1.1 then 'high' else 'suspicious' end", "round(round_even(least(1.0, 0.5 + 0.5 * (1.6 - ratio) / 0.6), 3) * 1000)", EXCERPT, f"({RATIO})", "ratio < 1.6")
D3 = _rows("D3", "case when font_size < 2 then 'high' else 'suspicious' end", "round(round_even(least(1.0, 0.5 + 0.5 * ((4.0 - font_size) / 4.0)), 3) * 1000)", EXCERPT, "spans", "render_mode <> 3 and font_size < 4")
VISIBLE = "select *, case when (x1 - x0) * (y1 - y0) > 0 then greatest(0, least(x1, 612) - greatest(x0, 0)) * greatest(0, least(y1, 792) - greatest(y0, 0)) / ((x1 - x0) * (y1 - y0)) else 0 end as visible from spans"
D4 = _rows("D4", "case when visible = 0 then 'high' else 'suspicious' end", "round(round_even(least(1.0, 0.6 + 0.4 * (1.0 - visible)), 3) * 1000)", EXCERPT, "placed", "visible < 0.5")
COVERED = """select p.* from placed p where visible >= 0.5 and exists (select 1 from images i where i.doc_id = p.doc_id and i.page = p.page and i.seqno > p.seqno
    and greatest(0, least(x1, ix1) - greatest(x0, ix0)) * greatest(0, least(y1, iy1) - greatest(y0, iy0)) / ((x1 - x0) * (y1 - y0)) >= 0.95)"""
D4O = _rows("D4", "'high'", "850", EXCERPT, f"({COVERED})", suffix="o")
SHOWN = "replace(replace({t}, chr(8203), '<U+200B>'), chr(8238), '<U+202E>')"


def _around(first: str, last: str) -> str:
    window = SHOWN.format(t=f"substr(text, greatest({first} - 24, 0) + 1, least({last} + 25, length(text)) - greatest({first} - 24, 0))")
    return f"case when {first} > 24 then '…' else '' end || trim(regexp_replace({window}, '\\s+', ' ', 'g')) || case when {last} + 25 < length(text) then '…' else '' end"


D5Z = _rows("D5", "'suspicious'", "900", _around("1", "1"), "spans", "h % 73 = 0", suffix="z")
D5B = _rows("D5", "'high'", "950", _around("0", "0"), "spans", "h % 73 = 1", suffix="b")
MIXED = r"""select *, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(regexp_replace(w, '[^\p{L}]', '', 'g')) >= 3 and regexp_matches(w, '\p{Latin}') and regexp_matches(w, '[\p{Cyrillic}\p{Greek}]')) as mixed
    from spans where regexp_matches(text, '[\p{Cyrillic}\p{Greek}]')"""
FINDING_PARTS = {"vis": VISIBILITY, "placed": VISIBLE}
ALL_PARTS = FINDING_PARTS | {"mixed_spans": MIXED}
PLACED_ALL = ["spans", "pages", "images"]


@query(sql(D1, *PLACED_ALL, **FINDING_PARTS))
def detect_invisible(t):
    return _findings(detectors.invisible(page_tables(t)))


@query(sql(D2, "spans"))
def detect_low_contrast(t):
    return _findings(detectors.low_contrast(page_tables(t)))


@query(sql(D3, "spans"))
def detect_micro_type(t):
    return _findings(detectors.micro_type(page_tables(t)))


@query(sql(D4, "spans", placed=VISIBLE))
def detect_off_canvas(t):
    return _findings(detectors.off_page(page_tables(t)))


@query(sql(D4O, "spans", "images", placed=VISIBLE))
def detect_occluded(t):
    return _findings(detectors.occluded(page_tables(t)))


@query(sql(D5Z, "spans"))
def detect_zero_width(t):
    return _findings(detectors.zero_width(page_tables(t)))


@query(sql(D5B, "spans"))
def detect_bidi(t):
    return _findings(detectors.bidi_controls(page_tables(t)))


@query(sql("select doc_id, span_no, 'suspicious' as severity, round(least(1.0, 0.5 + 0.1 * len(mixed)) * 1000)::int as conf_milli, array_to_string(mixed[1:4], ', ') as sample, len(mixed) as n_words from mixed_spans where len(mixed) >= 2", "spans", mixed_spans=MIXED))
def detect_confusable(t):
    found = detectors.confusable_words(page_tables(t))
    words = t.spans().select("doc_id", "span_no", detectors.mixed_words(F.col("text")).alias("mixed"))
    told = found.select("doc_id", F.substring_index("finding_id", "/", -1).cast("int").alias("span_no"), "severity", milli(F.col("confidence")).alias("conf_milli")).join(words, ["doc_id", "span_no"])
    return told.select("doc_id", "span_no", "severity", "conf_milli", F.array_join(F.slice("mixed", 1, 4), ", ").alias("sample"), F.size("mixed").cast("long").alias("n_words"))


UNION = " union all ".join(f"({x})" for x in (D1, D2, D3, D4, D4O, D5Z, D5B))


def without_d6(t: Tables) -> DataFrame:
    return detectors.run(page_tables(t), ["D1", "D2", "D3", "D4", "D5"])


COUNTED = f"select doc_id, page, detector_id, severity, y0, finding_id from ({UNION}) union all select doc_id, page, 'D5', 'suspicious', y0, doc_id || '/D5c/' || page || '/' || span_no from mixed_spans where len(mixed) >= 2"


@query(sql("select doc_id, page, detector_id, severity, y0, finding_id, row_number() over (partition by doc_id order by case severity when 'high' then 0 when 'suspicious' then 1 else 2 end, page, y0, detector_id, finding_id)::int as reading_rank from counted", *PLACED_ALL, **ALL_PARTS, counted=COUNTED))
def findings_union(t):
    order = Window.partitionBy("doc_id").orderBy(detectors.severity_rank(F.col("severity")), "page", "y0", "detector_id", "finding_id")
    return without_d6(t).select("doc_id", "page", "detector_id", "severity", "y0", "finding_id", F.row_number().over(order).alias("reading_rank"))


@query(sql("select doc_id, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'suspicious') as suspicious, count(*) filter (severity = 'info') as info from counted group by doc_id", *PLACED_ALL, **ALL_PARTS, counted=COUNTED))
def finding_severity_counts(t):
    return detectors.severity_counts(without_d6(t))


@query(sql("select doc_id, page, string_agg(finding_id, ',' order by y0, detector_id, finding_id) as finding_ids from counted group by doc_id, page", *PLACED_ALL, **ALL_PARTS, counted=COUNTED))
def findings_by_page(t):
    return detectors.by_page(without_d6(t)).withColumn("finding_ids", F.array_join("finding_ids", ","))


@query(sql("select doc_id, count(*) as n_findings, bool_or(severity <> 'info') as alarming, (count(*) filter (severity = 'high'))::int as high from counted group by doc_id", *PLACED_ALL, **ALL_PARTS, counted=COUNTED))
def finding_reports(t):
    told = detectors.reports(without_d6(t)).withColumn("j", F.from_json("report", "document long, findings array<struct<detector_id:string>>, summary struct<high:int,suspicious:int,info:int>"))
    return told.select(F.col("j.document").alias("doc_id"), F.size("j.findings").cast("long").alias("n_findings"), "alarming", F.col("j.summary.high").alias("high"))


@query(sql("select doc_id, page, n_spans, n_invisible, covered, is_scan from vis", *PLACED_ALL, vis=VISIBILITY))
def page_visibility(t):
    out = detectors.page_visibility(t.spans(), t.pages(), t.images())
    return out.select("doc_id", "page", "n_spans", "n_invisible", "covered", "is_scan")


@query(sql("select doc_id, page, sha256(string_agg(text, chr(10) order by seqno)) as page_sha from spans group by all", "spans"))
def page_text(t):
    return detectors.page_text(t.spans()).select("doc_id", "page", F.sha2("page_text", 256).alias("page_sha"))


@query(sql("select doc_id, sha256(string_agg(words, chr(10) || chr(10) order by page)) as document_sha from (select doc_id, page, string_agg(text, ' ' order by seqno) as words from spans group by all) group by doc_id", "spans"))
def document_text(t):
    """Spans joined by blanks within a page, pages by an empty line."""
    pages = t.spans().where(~tx.is_blank(F.col("text"))).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seqno", "text"))), lambda s: s["text"]), " ").alias("words"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "words"))), lambda s: s["words"]), "\n\n")
    return pages.groupBy("doc_id").agg(F.sha2(whole, 256).alias("document_sha"))


@query(sql("select span_id, coalesce(sum(length(text) + 1) over w, 0)::bigint as char_start, (coalesce(sum(length(text) + 1) over w, 0) + length(text))::bigint as char_end from spans window w as (partition by doc_id, page order by seqno rows between unbounded preceding and 1 preceding)", "spans"))
def span_offsets(t):
    before = Window.partitionBy("doc_id", "page").orderBy("seqno").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("long")
    return t.spans().select("span_id", start.alias("char_start"), (start + F.char_length("text")).alias("char_end"))


GROWN = "select doc_id, page, doc_id || '/D3/' || page || '/' || span_no as finding_id, case when font_size < 2 then 'high' else 'suspicious' end as severity, x0 - 2 as fx0, y0 - 2 as fy0, x1 + 2 as fx1, y1 + 2 as fy1 from spans where render_mode <> 3 and font_size < 4"


def grown_findings(t: Tables) -> DataFrame:
    """Micro-type findings with boxes grown by two points, so that they reach their neighbours."""
    found = detectors.micro_type(page_tables(t))
    return found.withColumns({"x0": F.col("x0") - 2, "y0": F.col("y0") - 2, "x1": F.col("x1") + 2, "y1": F.col("y1") + 2})


@query(sql("select span_id, s.page, greatest(0, least(x1, 300) - greatest(x0, 0)) * greatest(0, least(y1, 300) - greatest(y0, 0)) as common, (x1 - x0) * (y1 - y0) as area, least(x0, 0.0) as ux0, greatest(x1, 300.0) as ux1 from spans s", "spans"))
def span_geometry(t):
    box, frame = Box.of("x0", "y0", "x1", "y1"), Box(F.lit(0.0), F.lit(0.0), F.lit(300.0), F.lit(300.0))
    both = box.union(frame)
    return t.spans().select("span_id", "page", box.intersection_area(frame).alias("common"), box.area.alias("area"), both.x0.alias("ux0"), both.x1.alias("ux1"))


# --- OCR --------------------------------------------------------------------------------------------------------------------------

WORDS = "select doc_id, page, line_no, h, unnest(range(len(w)))::int as word_no, unnest(w) as text from (select *, string_split(text, ' ') as w from ocr)"


@query(sql("select doc_id, page, line_no, string_agg(text, ' ' order by word_no) as text from words where text <> '' and 20 + (h + word_no) % 80 >= 30 group by all", "ocr", words=WORDS))
def ocr_lines(t):
    """Confident words put together to lines in reading order."""
    sure = t.ocr_words().where((F.col("conf") >= 30) & ~tx.is_blank(F.col("text")))
    words = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda s: s["text"])
    return sure.groupBy("doc_id", "page", "block", "par", "line").agg(F.array_join(words, " ").alias("text")).select("doc_id", "page", F.col("line").alias("line_no"), "text")


def _norm(col: str) -> str:
    return f"replace(lower(trim(regexp_replace(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), 'ß', 'ss')"


NORMED = f"select doc_id, page, line_no, {_norm('text')} as norm from ocr"
CANDS = """select * from (select doc_id, page, line_no, 1 as width, norm as candidate from normed
    union all select doc_id, page, line_no, 2, case when b is not null then trim(norm || ' ' || b) end from nexts union all select doc_id, page, line_no, 3, case when c is not null then trim(norm || ' ' || b || ' ' || c) end from nexts) where candidate <> ''"""
NEXTS = "select *, lead(norm) over w as b, lead(norm, 2) over w as c from normed window w as (partition by doc_id, page order by line_no)"
OCR_PARTS = {"normed": NORMED, "nexts": NEXTS, "cands": CANDS}


@query(sql("select doc_id, page, line_no, width, candidate from cands", "ocr", **OCR_PARTS))
def ocr_candidates(t):
    return alignment.ocr_candidates(t.ocr_lines()).drop("start")


ALIGNED = f"select s.doc_id, s.page, s.span_no as line_no, {_norm('text')} as norm from spans s where length({_norm('text')}) >= 12 and exists (select 1 from cands c where c.doc_id = s.doc_id and c.page = s.page)"


@query(sql("""select doc_id, page, line_no, exists (select 1 from cands c where c.doc_id = l.doc_id and c.page = l.page and (contains(l.norm, c.candidate) or contains(c.candidate, l.norm)
    or list_has_all(string_split(l.norm, ' '), string_split(c.candidate, ' ')) or list_has_all(string_split(c.candidate, ' '), string_split(l.norm, ' ')))) as aligned from comparable l""", "spans", "ocr", **OCR_PARTS, comparable=ALIGNED))
def extraction_delta_exact(t):
    return alignment.exact_alignment(alignment.comparable_lines(t.lines()), t.ocr_lines()).drop("norm")


@query()
def detect_extraction_delta(t):
    return _findings(detectors.extraction_delta(page_tables(t)))


@query()
def alignment_distribution(t):
    return alignment.score_distribution(alignment.alignment_scores(t.lines(), t.ocr_lines()))


@query(sql(f"select doc_id, page, line_no, {_norm('text')} as norm from (select doc_id, page, span_no as line_no, text from spans)", "spans"))
def comparison_form(t):
    rows = tx.nfkc_column(t.lines(), "text")
    return rows.select("doc_id", "page", "line_no", tx.comparison_form(F.col("text")).alias("norm"))
