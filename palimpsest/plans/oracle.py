"""DuckDB forms of the derived tables, as common table expressions that the oracle queries build on."""

from __future__ import annotations

CTES = {
    "ls": r"""select doc_id, i, line, doc_id * 31 + i * 7 as h from (
        select doc_id, unnest(range(len(a))) as i, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents)) where trim(line) <> ''""",
    "spans": r"""select doc_id, i as span_no, doc_id || '-' || i as span_id, (i // 20 + 1)::int as page, (i % 20 + 1)::int as seqno,
        x0::double as x0, y0::double as y0, (x0 + 5 * least(length(line), 90))::double as x1, (y0 + 12)::double as y1,
        case when h % 73 = 0 then substr(line, 1, 1) || chr(8203) || substr(line, 2) when h % 73 = 1 then chr(8238) || line
             when h % 79 = 0 then replace(replace(line, 'a', chr(1072)), 'e', chr(1077)) else line end as text, line, h,
        case h % 53 when 0 then 1.5 when 1 then 3.0 else 10.0 end::double as font_size,
        case when doc_id % 97 = 5 or h % 61 = 0 then 3 else 0 end as render_mode,
        case h % 59 when 0 then 1.0 when 1 then 0.85 else 0.0 end::double as grey, case when h % 67 = 0 then 0.02 else 1.0 end::double as opacity
        from (select *, case when h % 71 = 1 then 590 else 72 end as x0, 40 + 18 * (i % 20) + case when h % 71 = 0 then 2000 else 0 end as y0 from ls)""",
    "pages": "select distinct doc_id, page, 0.0::double as cx0, 0.0::double as cy0, 612.0::double as cx1, 792.0::double as cy1 from spans",
    "images": """select doc_id, page, 0 as seqno, 0.0::double as ix0, 0.0::double as iy0, 612.0::double as ix1, 600.0::double as iy1 from pages where doc_id % 97 = 5
        union all select doc_id, page, 1000, 60.0, 30.0, 560.0, 120.0 from pages where doc_id % 13 = 0""",
    "ocr": """select doc_id, page, span_no as line_no, h, case when h % 89 = 0 then replace(line, 'o', '0') else line end as text from spans
        where render_mode <> 3 and font_size >= 4 and grey < 0.85 and opacity >= 1 and y0 <= 792""",
    "run_lines": """select *, l_orderkey as run_id, l_orderkey || '-' || ordinal as requirement_id from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
        l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)::int as ordinal from lineitem)""",
    # weights, factors and contributions in ten-thousandths, since decimal division is inexact here
    "reqs": """select run_id, ordinal, requirement_id, case when l_partkey % 3 = 0 then '5+ years experience with ' else '' end || p_type || ' ' || p_name as text,
        (l_partkey % 3 + 1)::int as criticality, case when l_returnflag = 'R' then 'preferred' else 'required' end as necessity,
        ((l_partkey % 3 + 1) * case when l_returnflag = 'R' then 4000 else 10000 end)::bigint as w, l_partkey, l_suppkey, l_discount
        from run_lines left join part on l_partkey = p_partkey""",
    "rows4": """select *, case when not counts then 0 when kind = 'direct' then 10000 else 6000 end::bigint as s,
        case when not counts or n = 0 then 0 else least(10000, 7000 + 1000 * n) end::bigint as c,
        case when not counts then 10000 when l_discount >= 0.09 then 0 when l_discount >= 0.07 then 5000 else 10000 end::bigint as g
        from (select *, case when l_suppkey % 11 = 7 then false else l_suppkey % 5 <> 0 end as counts, l_partkey % 4 as n,
              case when l_suppkey % 5 = 0 or l_suppkey % 11 = 7 then 'none' when l_suppkey % 5 = 1 then 'adjacent' else 'direct' end as kind from reqs)""",
    "scored": "select *, c * g // 10000 as q, w * s * (c * g // 10000) // 100000000 as k, w * s * c // 100000000 as kt from rows4",
    "totals": """select run_id, count(*) as requirement_count, count(*) filter (necessity = 'required' and k = 0) as unmet_required_count, sum(w)::bigint as tw, sum(k)::bigint as tk, sum(kt)::bigint as tkt
        from scored group by run_id""",
}

#: Tenths of 100 * {c} / {w}, halves to even.
TENTHS = "(case when 2 * ((1000 * ({c})) % {w}) > {w} then (1000 * ({c})) // {w} + 1 when 2 * ((1000 * ({c})) % {w}) = {w} then (1000 * ({c})) // {w} + ((1000 * ({c})) // {w}) % 2 else (1000 * ({c})) // {w} end)"


def tenths(contribution: str, weight: str) -> str:
    return TENTHS.format(c=contribution, w=weight)


#: Which table expressions each one builds on.
NEEDS = {
    "ls": [], "spans": ["ls"], "pages": ["spans"], "images": ["pages"], "ocr": ["spans"], "run_lines": [], "reqs": ["run_lines"], "rows4": ["reqs"], "scored": ["rows4"], "totals": ["scored"],
}


def sql(body: str, *names: str, **more: str) -> str:
    """A query over the named table expressions, what they need, and further ones given here."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS[name]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} as materialized ({CTES[n]})" for n in order] + [f"{n} as ({q})" for n, q in more.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
