"""Shared pieces of the DuckDB twins."""

from __future__ import annotations

from scriptorium.functions.stem import stem_sql
from scriptorium.schema import ERRATA_STATUSES, KEYWORD_PATTERN, STOP_WORDS

CUR = "cur as (select * exclude (rn) from (select *, row_number() over (partition by rfc_number order by indexed_at_utc desc nulls last) rn from indexed_rfcs where rfc_number is not null) where rn = 1)"
FIRST = "first_sec as (select * exclude (rn) from (select *, row_number() over (partition by rfc_number, section order by ordinal nulls last, id) rn from rfc_sections) where rn = 1)"
USABLE = "(embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"
PATH = "case when regexp_matches(section, '^[0-9]{1,9}(\\.[0-9]{1,9})*$') then list_transform(string_split(section, '.'), lambda x: x::int) end"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
KNOWN = ", ".join(f"'{s}'" for s in ERRATA_STATUSES)
KEYWORD = KEYWORD_PATTERN


def lexemes(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: length(x) >= 2 and x not in ({STOP}))"


ERRATA_ORDER = "reported_date desc nulls last, status desc nulls last, section nulls last, original_text nulls last"


def status(column: str) -> str:
    named = f"regexp_replace(trim({column}), '[ -]', '_', 'g')"
    return f"case when lower({named}) in ({KNOWN}) then lower({named}) else {named} end"


ERRATA = f"""errata as (select * exclude (rn) from (select *, row_number() over (partition by errata_id order by {ERRATA_ORDER}) rn
    from (select * replace ({status('status')} as status) from rfc_errata where errata_id is not null)) where rn = 1)"""
QUESTIONS = f"""{CUR},
q as (select rfc_number as query_id, title as query from cur where rfc_number % 20 = 0 and trim(title) <> ''),
qv as (select query_id, query, vector from q left join (
    select rfc_number, embedding as vector from (select rfc_number, embedding, row_number() over (partition by rfc_number order by ordinal nulls last, id) rn
    from rfc_sections where rfc_number % 20 = 0 and {USABLE}) where rn = 1) v on v.rfc_number = q.query_id)"""
def postings(source: str, text: str, name: str = "post") -> str:
    """CTEs of the inverted table of a source, by stems."""
    return f"""{name}_words as (select id, rfc_number, section, unnest({lexemes(text)}) as word from {source}),
{name}_stems as ({stem_sql(f"(select distinct word from {name}_words)")}),
{name} as (select id, rfc_number, section, lexeme, count(*) tf from {name}_words join {name}_stems using (word) group by id, rfc_number, section, lexeme)"""


def matches(source: str = "q", post: str = "post", name: str = "lex") -> str:
    """CTEs of the lexical matches of the questions of a source."""
    return f"""terms as (select distinct query_id, lexeme from ({stem_sql(f"(select query_id, unnest({lexemes('query')}) as word from {source})")})),
needed as (select query_id, count(*) as needed from terms group by query_id),
{name} as (select query_id, id, rfc_number, section, round(sum(ln(1 + tf)), 9) score from terms join needed using (query_id) join {post} using (lexeme)
    group by query_id, id, rfc_number, section, needed having count(*) = needed)"""


POSTINGS = postings("rfc_sections", "text")
LEXICAL = f"{POSTINGS},\n{matches()}"
NEAR = f"""sims as (select query_id, id, rfc_number, section, round(list_cosine_similarity(embedding::double[], vector::double[]), 9) similarity
    from qv cross join rfc_sections where vector is not null and {USABLE})"""
FUSED = """la as (select query_id, id, rank from (select *, row_number() over (partition by query_id order by score desc, id) rank from lex) where rank <= 40),
va as (select query_id, id, rank from (select *, row_number() over (partition by query_id order by similarity desc, id) rank from sims) where rank <= 40),
fused as (select coalesce(la.query_id, va.query_id) query_id, coalesce(la.id, va.id) id, coalesce(la.rank, 0) lexical_rank, coalesce(va.rank, 0) vector_rank,
    round(coalesce(1e0 / (60 + la.rank), 0) + coalesce(1e0 / (60 + va.rank), 0), 9) rrf
    from la full join va on la.query_id = va.query_id and la.id = va.id)"""
EDGES = """edges as (select distinct rfc_number, kind, target from (
    select rfc_number, 'updates' kind, unnest(updates) target from cur union all select rfc_number, 'obsoletes', unnest(obsoletes) from cur) where target is not null)"""
RELATIONS = f"""{EDGES},
rel as (select c.rfc_number,
    list_sort(list_distinct(list_filter(coalesce(updates, []), lambda x: x is not null))) updates, list_sort(list_distinct(list_filter(coalesce(obsoletes, []), lambda x: x is not null))) obsoletes,
    coalesce(u.l, []) updated_by, coalesce(o.l, []) obsoleted_by
    from cur c left join (select target, list(rfc_number order by rfc_number) l from edges where kind = 'updates' group by target) u on u.target = c.rfc_number
    left join (select target, list(rfc_number order by rfc_number) l from edges where kind = 'obsoletes' group by target) o on o.target = c.rfc_number)"""
STATUS = "case when len(obsoleted_by) > 0 then 'obsoleted' when len(updated_by) > 0 then 'updated' when obsoleted_by is not null then 'current' end"
