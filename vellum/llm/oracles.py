"""SQL of those queries that SQL can express, for a check on small tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"select {key} as id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{pattern}'), []) as w from {table}"


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
with d as ({_words("documents", "doc_id", _WORD)}),
b as ({_words("benchmark", "item_id", _WORD)}),
items as (select distinct id as item, least(len(w), 10) as k, array_to_string(w[i:i + 9], ' ') as g from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
spots as (select id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from (select id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from items) where len(w) >= k)),
hits as (select s.id, s.i, s.k, t.item from spots s join items t on t.g = s.g and t.k = s.k),
covered as (select id, count(distinct p) as n from (select id, unnest(range(i, i + k)) as p from hits) group by id),
found as (select id, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct id, cast(item as varchar) as item from hits) group by id)
select d.id as doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n, 0) as bigint) as n_hit, cast(coalesce(f.n, 0) as bigint) as n_items, sha256(coalesce(f.names, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join covered c on c.id = d.id left join found f on f.id = d.id
"""

JACCARD = f"""
with recursive d as ({_words("documents", "doc_id", "[^ " + chr(92) + "x09-" + chr(92) + "x0D]+")}),
s as (select distinct id, array_to_string(w[i:i + 4], ' ') as g from (select id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select id, count(*) as n from s group by id),
pairs as (select a.id as a, b.id as b, count(*) as k from s a join s b on b.g = a.g and a.id <> b.id group by a.id, b.id),
links as (select a, b from pairs join n x on x.id = a join n y on y.id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select id, id as c from d union select l.b, r.c from reach r join links l on l.a = r.id)
select d.id as doc_id, cast(coalesce(max(n.n), 0) as bigint) as n_shingles, min(r.c) as component_id
from d join reach r on r.id = d.id left join n on n.id = d.id group by d.id
"""
