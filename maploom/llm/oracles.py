"""DuckDB SQL for the operators that SQL can express over the whole tables."""

from __future__ import annotations

_SPACED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMED = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""with d as (select doc_id, {_NAMED.format(_LOWER.format('text'))} as w from documents),
p as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
dw as (select doc_id, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 12 following) as k, count(*) over (partition by doc_id order by i rows between current row and 12 following) as n from p),
b as (select item_id::varchar as item_id, {_NAMED.format(_LOWER.format('text'))} as w from benchmark),
bp as (select item_id, len(w) as size, unnest(w) as word, unnest(range(len(w))) as i from b),
bw as (select item_id, size, i, least(size, 13) as n, string_agg(word, ' ') over (partition by item_id order by i rows between current row and 12 following) as k from bp),
win as (select item_id, n, k from bw where i + n <= size),
hit as (select doc_id, i, item_id, win.n from dw join win on dw.n = 13 and win.n = 13 and dw.k = win.k
 union all select doc_id, i, item_id, win.n from dw join win on win.n < 13 and starts_with(dw.k || ' ', win.k || ' ')),
pos as (select doc_id, count(distinct i + o) as n_hit from (select doc_id, i, unnest(range(n)) as o from hit) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join its using (doc_id)"""

OP4 = f"""with d as (select doc_id, {_SPACED.format('text')} as w from documents),
p as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
win as (select * from (select doc_id, i, string_agg(word, ' ') over w as k, count(*) over w as n from p window w as (partition by doc_id order by i rows between current row and 12 following)) where n = 13),
low as (select k, min(doc_id) as low from win group by 1),
gone as (select distinct doc_id, i + o as i from win join low using (k), range(13) t(o) where low < doc_id),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from p anti join gone using (doc_id, i) group by 1),
cut as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id) left join cut using (doc_id)"""

OP5 = f"""with recursive d as (select doc_id, {_SPACED.format(_LOWER.format('text'))} as w from documents),
p as (select doc_id, len(w) as size, unnest(w) as word, unnest(range(len(w))) as i from d),
g as (select doc_id, size, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 2 following) as k from p),
s as (select distinct doc_id, k from g where i + 3 <= size or (size < 3 and i = 0)),
n as (select doc_id, count(*) as n from s group by 1),
x as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)),
e as (select a, b from l union select b, a from l),
r as (select a as node, b as seen from e union select r.node, e.b from r join e on e.a = r.seen),
c as (select node, min(seen) as low from r group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id from d left join n using (doc_id) left join c on node = d.doc_id"""
