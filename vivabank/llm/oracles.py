"""SQL counterparts of the later operators' queries."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13 = rf"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), words as (
  select id, lang, source, unnest(words) as term from docs
), kept as (
  select lang, term, count(*) as n from words group by all having count(distinct id) >= 30
), counted as (
  select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all
), langs as (
  select lang, sum(n) as total, count(*) as v from kept group by lang
), groups as (
  select g.lang, g.source, coalesce(c.total, 0) as total, coalesce(l.v, 0) as v, l.total as lang_total
  from (select distinct lang, source from docs) g
  left join langs l using (lang) left join (select lang, source, sum(n) as total from counted group by all) c using (lang, source)
), shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v))::bigint as p,
         (1 + (1000000000::hugeint * (k.n + 5)) // (g.lang_total + 5 * g.v))::bigint as q
  from groups g join kept k using (lang) left join counted c using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term group by all
  ) d on d.lang = a.lang and d.source = a.source and d.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, p - q as value from shares where n > 0 and p > q
)
select lang, source, part, item, value,
       (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 50
"""

# The checksum bit by bit: a byte is mixed in, then eight steps follow it.
_CRC32 = """
xor(4294967295, list_reduce(
  list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1),
    lambda i: [ascii((conv_id::varchar)[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: case when x >= 0 then xor(crc, x) when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end))"""

OP11 = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
         {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as said
  from conversations where conv_id is not null
), convs as (
  select conv_id, {_CRC32} % 9 as h from (select distinct conv_id from conversations where conv_id is not null)
), rebuilt as (
  select c.conv_id, list(t.said order by t.own, t.pos) filter (t.said is not null) as turns
  from convs c left join (
    select c.conv_id, 0 as own, t.pos, t.said from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and t.pos < c.h
    union all
    select c.conv_id, 1, t.pos, t.said from convs c join turns t on t.conv_id = c.conv_id and t.pos >= c.h
  ) t using (conv_id) group by c.conv_id
), members as (
  select conv_id, coalesce(turns[:d], []) as prefix, d, d = coalesce(len(turns), 0) as ends
  from (select *, unnest(range(0, coalesce(len(turns), 0) + 1)) as d from rebuilt)
), nodes as (
  select prefix, d, min(conv_id) as conv_id, count(*) as n_convs,
         (count(*) - 1) * coalesce(strlen(prefix[-1].t), 0) as saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from members group by prefix, d
), children as (
  select prefix[:d - 1] as prefix, d - 1 as d, count(*) as n from nodes where d > 0 group by all
), facts as (
  select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c on c.prefix = n.prefix and c.d = n.d
), totals as (
  select above, up, sum((n_children = 0)::bigint) as n_leaves, sum(saved) as saved
  from (select prefix[:up] as above, up, n_children, saved from (select *, unnest(range(0, d + 1)) as up from facts))
  group by all
)
select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs::bigint as n_convs,
       f.n_children::bigint as n_children, t.n_leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, f.ends_sha256
from facts f join totals t on t.above = f.prefix and t.up = f.d
left join nodes p on f.d > 0 and p.d = f.d - 1 and p.prefix = f.prefix[:f.d - 1]
"""
