"""Oracle SQL of numbered operators that SQL can express."""

from __future__ import annotations

from .url_filter import ATTRIBUTE, LINK_TAG, LINKING, LOWER, REFRESH, RULES, UNREAD, UPPER


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# op11


def _rest(url: str) -> str:
    return f"substr({url}, instr({url}, '://') + 3)"


def _host(url: str) -> str:
    return f"case when instr({url}, '://') > 0 then translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{UPPER}', '{LOWER}') else '' end"


def _path(url: str) -> str:
    return f"case when instr({url}, '://') > 0 then regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1) else '' end"


def _query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*(\\?[^#]*)', 1)"


def _attribute(name: str) -> str:
    return " || ".join(f"regexp_extract(tag, {_text(ATTRIBUTE.format(name))}, {i})" for i in (1, 2, 3))


_FITTING = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_JUDGED = """(select n.*, r.rule, r.verdict as own from {0} n left join (
  select {1}, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict from {0}, rules
  where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by {1}) r using ({1}))"""

URL_FILTER = f"""with recursive rules(v, h, p) as (values {_FITTING}),
numbered as (select row_number() over () as row, page_id, url, html, {_host('url')} as host, {_path('url')} as path, {_query(_rest('url'))} as query from pages),
named as (select *, case when host <> '' then host || case when path = '' then '/' else path end || query end as node from numbered),
tags as (select host, path, node, unnest(regexp_extract_all(regexp_replace(html, '{UNREAD}', '', 'g'), {_text(LINK_TAG)})) as tag from named where regexp_matches(html, '{LINKING}')),
targets as (select host, path, node, regexp_extract(replace(trim(case when list_contains(regexp_split_to_array(lower(trim({_attribute('rel')})), '\\s+'), 'canonical') then {_attribute('href')}
  when lower(trim({_attribute('http-equiv')})) = 'refresh' then regexp_extract({_attribute('content')}, {_text(REFRESH)}, 1) end), '&amp;', '&'), '^[^#]*') as target from tags),
whole as (select node, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target when starts_with(target, '//') then 'http:' || target
  when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') or host = '' then null when starts_with(target, '/') then 'http://' || host || target
  when starts_with(target, '?') then 'http://' || host || path || target
  when target <> '' then 'http://' || host || regexp_extract(case when path = '' then '/' else path end, '^.*/') || target end as url from targets),
split as (select node, {_host('url')} as host, {_path('url')} as path, {_query(_rest('url'))} as query from whole where url is not null),
dotted as (select node, host, query, case when regexp_matches(path, '/\\.\\.?(/|$)') then array_to_string(list_reduce(list_prepend(list_value(), list_transform(split(path, '/'), lambda s: [s])),
  lambda a, s: case s[1] when '.' then a when '..' then (case when len(a) > 1 then a[1:len(a) - 1] else a end) else a || s end), '/') || case when regexp_matches(path, '/\\.\\.?$') then '/' else '' end else path end as path from split),
links as (select distinct node as a, host || case when path = '' then '/' else path end || query as b from dotted where node is not null and host <> ''),
both_ways as (select a, b from links where a <> b union select b, a from links where a <> b),
reach(a, b) as (select a, a from both_ways union select reach.a, e.b from reach join both_ways e on reach.b = e.a),
members as (select distinct b as node, regexp_extract(b, '^[^/?#]*') as host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) as path from reach),
ruled as {_JUDGED.format('members', 'node')},
taken as (select distinct r.a as node from reach r join ruled x on r.b = x.node where x.own = 'block' and r.a in (select node from ruled where own is null)),
judged as {_JUDGED.format('named', 'row')}
select page_id, host, path, rule, coalesce(own, case when node in (select node from taken) then 'block' else 'allow' end) as verdict from judged"""

# op13


def _fields(text: str = "text") -> str:
    return " || ".join(f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in ("doc_id", "source", "lang", "n_chars", text))


_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in split(cast(doc_id as varchar), '')]),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _levels(prefix: str, group: str, count: int, fanout: int = 16) -> str:
    """prefix0 ... prefix{count}: nodes (group, i, c, d) of each level with the siblings before and after each."""
    out = []
    for k in range(count):
        run = f"over (partition by {group}, i // {fanout} order by i rows between"
        out.append(f"{prefix}{k}s as (select *, coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') as b, coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') as a from {prefix}{k})")
        out.append(f"{prefix}{k + 1} as (select {group}, i // {fanout} as i, any_value((c + {fanout - 1}) // {fanout}) as c, case when any_value(c) > 1 then sha256(string_agg(d, '' order by i)) else any_value(d) end as d from {prefix}{k} group by {group}, i // {fanout})")
    return ",\n".join(out)


def _folds(count: int, leaf: str, prefix: str) -> str:
    """leaf folded with the siblings of count levels."""
    for k in range(count):
        leaf = f"case when {prefix}{k}s.c > 1 then sha256({prefix}{k}s.b || ({leaf}) || {prefix}{k}s.a) else ({leaf}) end"
    return leaf


def _joins(count: int, prefix: str, group: str, place: str, fanout: int = 16) -> str:
    return " ".join(f"join {prefix}{k}s on {prefix}{k}s.{group} is not distinct from {place.split('.')[0]}.{group} and {prefix}{k}s.i = {place} // {fanout**k}" for k in range(count))


_DEPTH, _TOP = 5, 3  # levels of the oracle: up to 16^5 documents a source, 16^3 sources
MANIFEST = f"""with leaves as (select row_number() over (order by source nulls first, doc_id nulls first) as row, doc_id, source, sha256({_fields()}) as d,
  case when {_CRC} % 5 = 0 then sha256({_fields(f"translate(text, '{UPPER}', '{LOWER}')")}) end as own from documents),
n0 as (select *, row_number() over (partition by source order by doc_id nulls first, d, row) - 1 as i, count(*) over (partition by source) as c from leaves),
{_levels('n', 'source', _DEPTH)},
t0 as (select 0 as g, source, row_number() over (order by source nulls first) - 1 as i, count(*) over () as c, d from n{_DEPTH}),
{_levels('t', 'g', _TOP)},
found as (select m.doc_id, m.d as leaf, m.sub as subroot, t{_TOP}.d as root, m.below || {" || ".join(f"t{k}s.b || t{k}s.a" for k in range(_TOP))} as siblings, {_folds(_TOP, 'm.folded', 't')} as folded_root
  from (select n.*, n{_DEPTH}.d as sub, {" || ".join(f"n{k}s.b || n{k}s.a" for k in range(_DEPTH))} as below, {_folds(_DEPTH, 'coalesce(n.own, n.d)', 'n')} as folded
    from n0 n {_joins(_DEPTH, 'n', 'source', 'n.i')} join n{_DEPTH} on n{_DEPTH}.source is not distinct from n.source) m
  join t0 u on u.source is not distinct from m.source {_joins(_TOP, 't', 'g', 'u.i')} join t{_TOP} on true)
select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, folded_root, folded_root = root as verified from found"""
