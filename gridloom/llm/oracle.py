"""SQL for DuckDB that must give the rows of the queries which SQL can express on whole tables."""

BLANK = "[^\\x20\\x09-\\x0D]+"
NORMAL = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with d as (select doc_id, regexp_extract_all({LOWER}, '{NORMAL}') as w from documents),
 i as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER}, '{NORMAL}') as w from benchmark where text is not null),
 iw as (select distinct item, least(len(w), 10) as n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') as t from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
 dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw) where len(w) >= n)),
 hit as (select doc_id, item, s, n from dw join iw using (n, t)),
 words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
 items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hit group by doc_id)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 piece as (select doc_id, base, substr(h, 2 * base + 1, 610) as h from (select doc_id, h, unnest(range(0, length(h) // 2 - 49, 256)) as base from d where length(h) >= 100)),
 w as (select doc_id, base + s as s, substr(h, 2 * s + 1, 100) as t from (select doc_id, base, h, unnest(range(0, length(h) // 2 - 49)) as s from piece)),
 f as (select t, min(doc_id) as first from w group by t having count(*) > 1),
 hit as (select w.doc_id, w.s from w join f using (t) where f.first < w.doc_id),
 runs as (select doc_id, min(s) as s, max(s) + 50 as e from (select *, sum(new) over (partition by doc_id order by s) as g from (select *, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as new from hit)) group by doc_id, g),
 kept as (select doc_id, count(*) as n_spans, sum(e - s) as n_removed, list(struct_pack(s := s, e := e) order by s) as r from runs group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(case when r is null then h else array_to_string(list_transform(range(0, len(r) + 1), lambda i: substr(h, case when i = 0 then 1 else 2 * r[i].e + 1 end, (case when i = len(r) then length(h) // 2 else r[i + 1].s end - case when i = 0 then 0 else r[i].e end) * 2)), '') end)) as kept_sha256
from d left join kept using (doc_id)"""

OP5 = f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '{BLANK}'), []) as w from documents),
 win as (select doc_id, s, array_to_string(w[s : s + 19], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
 hit as (select doc_id, s from (select doc_id, s, row_number() over (partition by t order by doc_id, s) as k from win) where k > 1),
 gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from hit),
 g as (select doc_id, count(*) as n_removed, list(p) as ps from gone group by doc_id),
 k as (select doc_id, string_agg(x, ' ' order by p) as kept from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d) anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g using (doc_id) left join k using (doc_id)"""

OP6 = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(encode(coalesce(html, ''))) as x from pages),
 f as (select *, min(page_id) over (partition by b) as first from p),
 bits as (select page_id, string_agg(lpad(bin(strpos('0123456789abcdef', substr(x, i, 1)) - 1), 4, '0'), '' order by i) as s from (select page_id, x, unnest(range(1, 41)) as i from p) group by page_id),
 dig as (select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: case when substr(s, 5 * i + j, 1) = '1' then 1 << (5 - j) else 0 end))::int, 1), '' order by i) as payload_digest from (select page_id, s, unnest(range(0, 32))::int as i from bits) group by page_id)
select page_id, octet_length(b)::bigint as payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from f join dig using (page_id)"""

OP7 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::bigint as score from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

OP10 = f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({LOWER}, '{BLANK}'), []) as w from documents),
 sh as (select distinct doc_id, array_to_string(w[s : s + 3], ' ') as t from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as s from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from sh group by doc_id),
 pair as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
 link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
 reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join link l on l.a = r.b),
 c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from d left join n using (doc_id) join c using (doc_id)"""

ORACLE = {"op1_decontamination": OP1, "op2_suffix_dedup": OP2, "op5_substring_dedup": OP5, "op6_warc": OP6, "op7_exact_topk": OP7, "op10_minhash": OP10}
