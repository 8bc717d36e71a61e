"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    digits = f"hex(encode({text}))"
    bit = f"((('0x' || substr({digits}, (i // 8)::int * 2 + 1, 2))::bigint >> (i % 8)) & 1)"
    bits = f"list_transform(range(4 * length({digits})), lambda i: {bit})"
    step = "xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: {step}), 4294967295::bigint)"


TRIE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
),
lengths as (select conv_id, count(*) as n from turns group by conv_id),
ids as (select conv_id, {crc32("conv_id::varchar")} % 4 as h, conv_id - conv_id % 20 as base from lengths),
shifts as (select i.*, least(h, coalesce(n, 0)) as given from ids i left join lengths l on l.conv_id = i.base),
rebuilt as (
  select s.conv_id, t.pos, t.role, t.text from shifts s join turns t on t.conv_id = s.base and t.pos <= s.h
  union all
  select s.conv_id, t.pos - s.h + s.given, t.role, t.text from shifts s join turns t on t.conv_id = s.conv_id and t.pos > s.h
),
paths as (
  select conv_id, 0 as depth, '' as name, 0 as words from ids
  union all
  select conv_id, pos, md5(list(md5(role) || md5(text)) over (partition by conv_id order by pos)::varchar), len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) from rebuilt
),
ends as (
  select depth, name, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
  from (select *, max(depth) over (partition by conv_id) as last from paths) where depth = last group by depth, name
),
nodes as (select depth, name, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from paths group by depth, name),
linked as (select n.*, p.name as above, p.depth as above_depth from nodes n left join paths p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
children as (select above_depth as depth, above as name, count(*) as n_children from linked where above is not null group by 1, 2),
known as (select n.*, coalesce(n_children, 0) as n_children from linked n left join children c using (depth, name)),
subtrees as (
  select p.depth, p.name, sum((k.n_children = 0)::bigint) as n_leaves, sum((k.n_convs - 1) * k.words) as saved_tokens
  from known k join paths p on p.conv_id = k.conv_id and p.depth <= k.depth group by 1, 2
)
select k.conv_id, k.depth::bigint as depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from known k join subtrees s using (depth, name) left join ends e using (depth, name) left join nodes u on u.depth = k.above_depth and u.name = k.above
"""

#: Words at one edit share what is left without one code point, at the same place or as a word of its own.
SPELLING = f"""
with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{5,}}')) as run from documents),
counted as (select doc_id, run, count(*) as n from runs group by 1, 2),
hashed as (select *, {crc32("concat(coalesce(doc_id::varchar, ''), ':', run)")} as h from counted),
cut as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from cut where length(word) >= 5 group by 1 having sum(n) >= 3),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
without as (select word, n, i, left(word, (i - 1)::int) || substr(word, (i + 1)::int) as rest from places),
shorter as (select distinct w.word, v.word as other from without w join words v on v.word = w.rest),
near as (
  select word, other from shorter union all select other, word from shorter union all
  select a.word, b.word from without a join without b on a.i = b.i and a.rest = b.rest and a.word <> b.word
),
best as (select near.word, count(*) as n_near, arg_min(struct_pack(w := other, n := words.n), struct_pack(a := -words.n, b := other)) as top from near join words on words.word = other group by 1),
formed as (
  select word, words.n, coalesce(n_near, 0) as n_near, case when top.n >= 2 * words.n then top.w end as form, case when top.n >= 2 * words.n then top.n end as form_n
  from words left join best using (word)
),
chains(word, top) as (select word, form from formed where form is not null union all select c.word, f.form from chains c join formed f on f.word = c.top where f.form is not null),
ends as (select c.word, c.top as root from chains c join formed f on f.word = c.top where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from formed left join ends using (word)
"""

HOST = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Mass moves over one link a round, as many rounds as 0.85 needs to fall under a thousandth.
URLS = f"""
with recursive rules(verdict, rule) as (values ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
rests as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, html, {HOST.format("rest")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
fitting as (
  select page_id, host, path, r.verdict, r.rule from parts p left join rules r
    on ends_with('.' || host, '.' || split_part(rule, '/', 1)) and starts_with(path, substr(rule, instr(rule, '/')))
),
judged as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from fitting group by all),
targets as (select page_id, host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^"''\\s>/?#]+)', 1), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) as dst from parts where host <> ''),
links as (select src, dst, count(*)::double as weight from targets where src <> dst group by 1, 2),
ways as (
  select 'trust' as way, src as here, dst as there, weight / sum(weight) over (partition by src) as share from links
  union all select 'distrust', dst, src, weight / sum(weight) over (partition by dst) from links
),
shares as (select host, avg((coalesce(verdict, '') = 'allow')::int) as trust, avg((coalesce(verdict, '') = 'block')::int) as distrust from judged where host <> '' group by 1),
seeds as (select 'trust' as way, host, trust as mass from shares where trust >= 0.5 union all select 'distrust', host, distrust from shares where distrust >= 0.5),
series(round, way, host, mass) as (
  select 0, way, host, mass / sum(mass) over (partition by way) from seeds
  union all
  select round + 1, s.way, there, sum(0.85 * s.mass * share) from series s join ways w on w.way = s.way and w.here = s.host where round < 43 group by 1, 2, 3
),
masses as (select way, host, sum(mass) as mass from series group by 1, 2),
scores as (select host, coalesce(sum(mass / total) filter (way = 'trust'), 0) as trust, coalesce(sum(mass / total) filter (way = 'distrust'), 0) as distrust from masses join (select way, sum(mass) as total from masses group by 1) using (way) group by 1),
n as (select count(distinct host) as hosts from (select host from shares union all select dst from links))
select page_id, host, path, rule, coalesce(verdict, case when distrust > trust and distrust * hosts >= 0.1 then 'block' else 'allow' end) as verdict
from judged left join scores using (host), n
"""
