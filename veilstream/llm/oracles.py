"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = rf"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, len(w) as n, array_to_string(w[i : i + 7], ' ') as win
       from (select item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) as i from b where len(w) > 0)),
sizes as (select distinct least(n, 8) as n from bw),
dw as (select rid, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') as win
       from (select rid, w, unnest(range(1, len(w) + 1)) as i from d) x, sizes s where i + s.n - 1 <= len(w)),
hit as (select dw.rid, dw.i, dw.n, bw.item_id from dw join bw on dw.win = bw.win and dw.n = least(bw.n, 8)),
words as (select rid, count(distinct i + o) as n_hit from (select rid, i, unnest(range(0, n)) as o from (select distinct rid, i, n from hit)) group by rid),
items as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from hit group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join words using (rid) left join items using (rid)
"""

OP5 = r"""
with ordered as (select row_number() over () as rid, doc_id, text from documents),
lines as (select rid, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ln from ordered where text is not null),
split as (select rid, doc_id, ln, line, strlen(line) >= 140 as long, regexp_extract_all(line, '(?s).*?[.!?] |.+$') as s from lines),
ended as (select *, list_filter(range(1, len(s) + 1), lambda i: strlen(s[i]) >= 40) as e from split),
parts as (select rid, doc_id, ln, case when not long then [line || chr(10)] when len(e) = 0 then [line, chr(10)]
  else list_transform(range(1, len(e) + 1), lambda k: array_to_string(s[case when k = 1 then 1 else e[k - 1] + 1 end : case when k = len(e) then len(s) else e[k] end], '')) || [chr(10)] end as p from ended),
records as (select rid, doc_id, ln, unnest(p) as record, unnest(range(len(p))) as sub from parts),
masked as (select *, suffix(record, chr(10)) as line, regexp_replace(record, '[^ \t\r\f\n]*(?:[0-9@]|://)[^ \t\r\f\n]*', '<*>', 'g') as m from records),
tokens as (select rid, doc_id, ln, sub, line, list_filter(regexp_split_to_array(m, '[ \t\r\f\n]+'), lambda x: x <> '') as t from masked where regexp_matches(m, '\p{L}')),
counted as (select *, len(t) as n, least(4, len(t) - 1) as f from tokens),
ids as (select rid, doc_id, ln, sub, 0 as kind, n, t as l, cast([] as varchar[]) as r from counted
  union all select rid, doc_id, ln, sub, k + 1, n, t[1 : 1 + (n - 1) * k // f], t[2 + (n - 1) * (k + 1) // f : n] from (select *, unnest(range(0, f)) as k from counted where line and n >= 4)),
found as (select kind, n, l, r, min(doc_id) as first from ids group by 1, 2, 3, 4 having min(doc_id) < max(doc_id)),
drops as (select distinct rid, ln, sub from ids join found using (kind, n, l, r) where doc_id > first),
kept as (select x.rid, string_agg(record, '' order by x.ln, x.sub) filter (where d.rid is null) as text, count(d.rid) as n from records x left join drops d on x.rid = d.rid and x.ln = d.ln and x.sub = d.sub group by 1)
select doc_id, case when o.text is null then null when coalesce(k.n, 0) = 0 then o.text else regexp_replace(coalesce(k.text, ''), '\n\z', '') end as text,
       cast(coalesce(len(string_split(o.text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(k.n, 0) as bigint) as n_dropped
from ordered o left join kept k using (rid)
"""

ORACLES: dict[str, str] = {"op5_line_dedup": OP5, "op10_decontaminate": OP10}
