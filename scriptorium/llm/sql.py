"""DuckDB twins of the queries that SQL can state over the whole tables.

p6 to p8 have none: byte-pair merges, packing and the detection of cuts are no relational expressions; tests hold
them against other implementations and bounds. p2_neighbours is approximate, and its recall is tested.
"""

from __future__ import annotations

P1_FOUND = r"""
with long as (select id, text from rfc_sections where length(text) > 2000),
lines as (select id, unnest(l) as line, unnest(range(len(l))) as pos from (select id, string_split(text, chr(10)) l from long)),
flagged as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(12)) = '' as blank from lines),
begun as (select *, not blank and coalesce(lag(blank) over (partition by id order by pos), true) as first from flagged),
numbered as (select *, sum(first::int) over (partition by id order by pos) as para from begun),
paras as (select id, para::int as para_no, string_agg(line, chr(10) order by pos) as body from numbered where not blank group by id, para)
select id, 0 as para_no from long
union all select id, para_no from paras where length(trim(body, ' ' || chr(9) || chr(13) || chr(12))) > 2000
"""

P2_FOUND = """
with unit as (select id, embedding::double[] as v from rfc_sections where embedding is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
near as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as c from unit a join unit b on a.id <> b.id),
best as (select *, row_number() over (partition by a order by c desc, b) as r from near where c >= 0.9)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from best where r <= 5
"""

P4_FOUND = """
with words as (select id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from rfc_sections),
shingles as (select distinct id, s from (select id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from words where len(w) >= 3)),
sizes as (select id, count(*) as n from shingles group by id),
met as (select a.id as x, b.id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.id < b.id group by a.id, b.id)
select x as id_a, y as id_b from met join sizes p on p.id = x join sizes q on q.id = y where c >= 0.6 * (p.n + q.n - c)
"""

P5_FOUND = """
with texts as (select id, text from rfc_sections where length(text) >= 200),
windows as (select id, unnest(range(1, length(text) - 198)) as k, text from texts),
spans as (select id, k, hash(substring(text, k, 200)) as h from windows),
shared as (select h from spans group by h having min(id) <> max(id)),
kept as (select s.id, s.k, lead(s.k) over (partition by s.id order by s.k) as next from spans s join shared using (h))
select id, sum(least(coalesce(next - k, 200), 200))::int as shared_chars from kept group by id
"""

SQL: dict[str, str] = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
