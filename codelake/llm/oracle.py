"""DuckDB SQL for the queries that SQL can express."""

from codelake.llm import redirects as _r

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP5 = f"""
with doc as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
item as (select coalesce(item_id::varchar, '') as item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as window_text
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item where len(w) > 0)
),
lengths as (select distinct n from windows),
places as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as window_text
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lengths where len(w) >= n)
),
met as (select rid, n, i, item_id from places join windows using (n, window_text)),
hit as (
  select rid, count(distinct p) as n_hit
  from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, n, i from met)) group by rid
),
named as (
  select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct rid, item_id from met) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (rid) left join named using (rid)
"""

OP2 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
escaped as (
  select *, length(text) + len(regexp_extract_all(text, '[<\\[]\\\\*(?:\\|turn\\|>|\\|says\\|>|\\|done\\|>|INST\\]|/INST\\]|s>|/s>|<SYS>>|</SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)'))
    + length(role) + 8 + 8 + 8 as size
  from turns
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size)::bigint as formatted_chars
from escaped group by conv_id
""".replace("\\\\", "\\")

_PART = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::ubigint], flatten(list_transform(string_split(doc_id::varchar, ''),
  lambda x: [ord(x)::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint]))),
  lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384::ubigint)), 4294967295::ubigint)"""

OP12 = f"""
with recursive leaves as (
  select row_number() over () as rid, doc_id, lang, {_LEAF.format(text="text")} as leaf,
    case when coalesce({_CRC}, 0) % 3 = 0 then {_LEAF.format(text=_AZ)} else {_LEAF.format(text="text")} end as presented
  from documents
),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
  from leaves
),
tree as (
  select 0 as level, lang, n, pos, leaf as digest from placed
  union all
  select level + 1, lang, (n + 7) // 8, pos // 8, sha256(string_agg(digest, '' order by pos))
  from tree where n > 1 group by level, lang, n, pos // 8
),
subroots as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from tree where n = 1
),
top as (
  select 0 as level, n, pos, digest from subroots
  union all
  select level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by level, n, pos // 8
),
runs as (select level, lang, pos // 8 as run, list(digest order by pos) as digests from tree where n > 1 group by all),
top_runs as (select level, pos // 8 as run, list(digest order by pos) as digests from top where n > 1 group by all),
inner_fold as (
  select rid, lang, 0 as level, n, pos, presented as node, '' as proof from placed
  union all
  select rid, f.lang, f.level + 1, (n + 7) // 8, pos // 8,
    sha256(array_to_string(list_transform(digests, lambda x, i: case when i = pos % 8 + 1 then node else x end), '')),
    proof || array_to_string(list_filter(digests, lambda x, i: i <> pos % 8 + 1), '')
  from inner_fold f join runs r on f.level = r.level and f.lang is not distinct from r.lang and f.pos // 8 = r.run
  where n > 1
),
outer_fold as (
  select rid, 0 as level, s.n, s.pos, node, proof from inner_fold f join subroots s on f.lang is not distinct from s.lang where f.n = 1
  union all
  select rid, f.level + 1, (n + 7) // 8, pos // 8,
    sha256(array_to_string(list_transform(digests, lambda x, i: case when i = pos % 8 + 1 then node else x end), '')),
    proof || array_to_string(list_filter(digests, lambda x, i: i <> pos % 8 + 1), '')
  from outer_fold f join top_runs r on f.level = r.level and f.pos // 8 = r.run
  where n > 1
),
root as (select digest as root from top where n = 1)
select doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified
from placed p join subroots s on p.lang is not distinct from s.lang join (select * from outer_fold where n = 1) f using (rid), root
"""


def _attribute(name: str) -> str:
    pattern = _r.attribute_pattern(name).replace("'", "''")
    return f"regexp_replace(regexp_extract(tag, '{pattern}', 1), '^[\"'']|[\"'']$', '', 'g')"


def _translated(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _address(url: str) -> str:
    rest = f"split_part(substr({url}, strpos({url}, '://') + 3), '#', 1)"
    host = f"regexp_extract({rest}, '^[^/?]*')"
    return (
        f"case when strpos({url}, '://') > 0 then {_translated(f'substr({url}, 1, strpos({url}, {chr(39)}://{chr(39)}) - 1)')} || '://'"
        f" || {_translated(host)} || substr({rest}, length({host}) + 1) end"
    )


_SITE_HOST = "coalesce(" + _translated("case when strpos({0}, '://') > 0 then regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*') end") + ", '')"
_SITE_PATH = "coalesce(case when strpos({0}, '://') > 0 then regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^?#]*)', 1) end, '')"
_AIM = _r.AIM.replace("'", "''")

OP11 = f"""
with recursive rules(host, path, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
page as (
  select row_number() over () as rid, page_id, url, html, {_SITE_HOST.format("url")} as host, {_SITE_PATH.format("url")} as path,
    {_address("url")} as own
  from pages
),
tags as (
  select rid, url, host, path, unnest(regexp_extract_all(regexp_replace(html, '{_r.COMMENT}', '', 'g'), '{_r.TAG}')) as tag
  from page where regexp_matches(html, '{_r.SIGN}')
),
named as (
  select *, case
    when regexp_matches(tag, '{_r.LINK}')
      then case when list_contains(regexp_split_to_array({_translated(_attribute("rel"))}, '[{_r.SPACE}]+'), 'canonical') then {_attribute("href")} end
    when trim({_translated(_attribute("http-equiv"))}) = 'refresh' then regexp_extract({_attribute("content")}, '{_AIM}', 1) end as raw
  from tags
),
trimmed as (select *, replace(regexp_replace(raw, '^[{_r.SPACE}]+|[{_r.SPACE}]+$', '', 'g'), '&amp;', '&') as link, substr(url, 1, strpos(url, '://') - 1) as scheme from named),
whole as (
  select rid, case
    when link = '' or starts_with(link, '#') then null
    when regexp_matches(link, '{_r.SCHEME}') then case when contains(link, '://') then link end
    when strpos(url, '://') = 0 then null
    when starts_with(link, '//') then scheme || ':' || link
    when starts_with(link, '/') then scheme || '://' || host || link
    when starts_with(link, '?') then scheme || '://' || host || path || link
    else scheme || '://' || host || case when contains(path, '/') then regexp_replace(path, '[^/]*$', '') else '/' end || link end as target
  from trimmed
),
targets as (select rid, {_address("target")} as target from whole where {_address("target")} is not null),
placed as (select p.*, coalesce(own, least) as node from page p left join (select rid, min(target) as least from targets group by rid) using (rid)),
edges as (select distinct node as a, target as b from placed join targets using (rid) where node <> target),
both_ways as (select a, b from edges union select b, a from edges),
nodes as (select node from placed where node is not null union select a from both_ways),
fits as (
  select node, arg_max(r.host || r.path, (length(r.host || r.path), r.verdict = 'allow', length(r.host))) as rule,
    arg_max(r.verdict, (length(r.host || r.path), r.verdict = 'allow', length(r.host))) as verdict
  from (select node, {_SITE_HOST.format("node")} as host, {_SITE_PATH.format("node")} as path from nodes) n
  join rules r on (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)
  group by node
),
blocked as (
  select node from fits where verdict = 'block'
  union select b from blocked join both_ways on node = a
)
select page_id, host, path, case when own is not null then f.rule end as rule,
  coalesce(case when own is not null then f.verdict end, case when b.node is not null then 'block' else 'allow' end) as verdict
from placed p left join fits f using (node) left join blocked b using (node)
"""
