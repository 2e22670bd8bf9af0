"""DuckDB SQL with the same results, for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP8 = rf"""
with quality as (
  select doc_id, max(coalesce(quality, 0) + 1.0::double) as weight
  from labels where doc_id is not null group by doc_id
), drawn as (
  select d.doc_id, source, {WORDS} as size,
    -ln((('0x' || substr(md5('7:' || d.doc_id::varchar), 1, 13))::bigint + 0.5::double) / 2.0::double ** 52)
      / coalesce(weight, 1.0) as key
  from documents d left join quality q on q.doc_id = d.doc_id
), sources as (
  select source, sum(size)::bigint as s from drawn group by source
), weighed as (
  select *, [3, 1, 2][((row_number() over (order by (source is null), encode(source)) - 1) % 3 + 1)::int] as w
  from sources
), ordered as (
  select *, 3 * sum(s) over () - 4 * coalesce(sum(s) over (
      order by s / w, (source is null), encode(source) rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by s / w, (source is null), encode(source)
      rows between current row and unbounded following) as later,
    row_number() over (order by s / w, (source is null), encode(source)) as place
  from weighed
), level as (
  select rest, later, place from ordered where 4 * s * later > rest * w order by place limit 1
), aims as (
  select o.source, o.s, case when l.place is null or o.place < l.place then (2 * o.s)::double
    else (o.w * l.rest)::double / (2 * l.later) end as target
  from ordered o left join level l on true
), summed as (
  select d.doc_id, d.source, size, s, target,
    case when s > 0 then floor(target / s)::bigint else 0 end as epochs,
    sum(size) over (partition by d.source order by key, d.doc_id, size rows unbounded preceding) as until
  from drawn d join aims a on a.source is not distinct from d.source
), chosen as (
  select *, (2 * until - size <= 2 * (target - epochs * s)) and target - epochs * s > 0 as picked
  from summed
)
select doc_id, source, size::bigint as size, s as source_size, target, epochs, picked,
  (size * (epochs + picked::int))::bigint as taken
from chosen
"""

OP1 = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
  select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      (('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::int // (32 ** (3 - i % 4))::int) % 32 + 1]), '')
    as payload_digest
  from payloads
), firsts as (
  select payload_digest, min(page_id) as first_id from named group by all
)
select page_id, payload_bytes::bigint as payload_bytes, n.payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from named n join firsts using (payload_digest)
"""

OP11 = """
with recursive usable as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select a.r as a, b.r as b
  from usable a join usable b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= 0.98
), counts as (
  select a as r, count(*) as n_links from pairs group by a
), reached(a, b) as (
  select r, r from usable
  union
  select reached.a, pairs.b from reached join pairs on reached.b = pairs.a
), grouped as (
  select reached.a as r, min(u.vec_id) as component_id
  from reached join usable u on u.r = reached.b group by reached.a
), linked as (
  select u.vec_id, coalesce(n_links, 0) as n_links, component_id
  from usable u join grouped using (r) left join counts using (r)
), unlinked as (
  select vec_id, 0 as n_links, vec_id as component_id from embeddings
  where not coalesce(vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0, false)
)
select vec_id, n_links::bigint as n_links, component_id, coalesce(vec_id = component_id, true) as kept
from (from linked union all from unlinked)
"""

OP13 = """
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), drawn as (
  select *, len(tokens) as n,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from cut
), parts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90
      then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), texts as (
  select *, array_to_string(tokens[1:x], '') as p, array_to_string(tokens[x + 1:y], '') as m,
    array_to_string(tokens[y + 1:n], '') as s
  from parts
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(p)::bigint end as prefix_chars,
  case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from texts
"""

SQL: dict[str, str] = {
    "op1_warc": OP1,
    "op8_mix_sources": OP8,
    "op11_embedding_duplicates": OP11,
    "op13_fill_in_middle": OP13,
}
