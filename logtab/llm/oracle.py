"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import string

from logtab.llm.embeddings import THRESHOLD
from logtab.llm.urls import HOST_RULES, PATTERN_RULES, pattern_regex


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lower(expr: str) -> str:
    return f"translate({expr}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def urls() -> str:
    rules = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    fits = {}
    for _, rule in rules:
        name, _, path = rule.partition("/")
        fits[rule] = f"(host = {quoted(name)} or ends_with(host, {quoted('.' + name)})) and starts_with(path, {quoted('/' + path)})"
    rule = "case " + " ".join(f"when {fits[r]} then {quoted(r)}" for _, r in rules) + " end"
    fixed = "case " + " ".join(f"when {fits[r]} then {quoted(v)}" for v, r in rules) + " end"
    hits = {kind: [(p, f"coalesce(regexp_matches(low, {quoted(pattern_regex(p))}), false)") for v, p in PATTERN_RULES if v == kind]
            for kind in ("allow", "block")}
    first = {k: "case " + " ".join(f"when {h} then {quoted(p)}" for p, h in hits[k]) + " end" for k in hits}
    return f"""
with cut as (
  select page_id, {lower('url')} as low,
         coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest
  from pages),
named as (
  select page_id, low, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
judged as (
  select *, {rule} as rule, {fixed} as fixed, {first['allow']} as allowed, {first['block']} as blocked from named)
select page_id, host, path, rule,
       coalesce(fixed, case when allowed is null and blocked is not null then 'block' else 'allow' end) as verdict,
       coalesce(allowed, blocked) as pattern
from judged"""


def chat() -> str:
    return f"""
with turns as (
  select conv_id, replace(coalesce(role, 'unknown'), '<|im_', '<| im_') as who,
         replace(coalesce(text, ''), '<|im_', '<| im_') as said, turn from conversations),
ranked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, who, said) - 1 as n from turns),
speakers as (select distinct conv_id, who as speaker from ranked where who <> 'system'),
openings as (select conv_id, min(n) as upto from ranked where who <> 'system' group by conv_id),
heads as (
  -- every part of 256 turns, and in later ones the system turns that opened the dialogue
  select r.conv_id, r.n, r.who, r.said, n // 256 as part, true as own from ranked r
  union all
  select r.conv_id, r.n, r.who, r.said, p.part, false
  from ranked r join openings o on r.conv_id is not distinct from o.conv_id and r.n < o.upto
  join (select distinct conv_id, n // 256 as part from ranked) p on p.conv_id is not distinct from r.conv_id and r.n // 256 < p.part),
messages as (
  select s.conv_id, p.part, s.speaker, p.n, p.own, p.who = s.speaker as mine, said || '<|im_end|>' as body,
         '<|im_start|>' || case when who = 'system' then 'system' when who = s.speaker then 'assistant'
                                else 'user name=' || who end || chr(10) as head
  from speakers s join heads p on p.conv_id is not distinct from s.conv_id),
placed as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (
      partition by conv_id, part, speaker order by n rows between unbounded preceding and 1 preceding), 0) + length(head) as begins
  from messages)
select conv_id, part::bigint as part, speaker, string_agg(head || body || chr(10), '' order by n) as text,
       coalesce(string_agg(begins::bigint::varchar || ':' || (begins + length(body))::bigint::varchar, ',' order by n) filter (where mine), '') as spans,
       (count(*) filter (where own))::int as n_turns
from placed group by conv_id, part, speaker"""


def embeddings() -> str:
    return f"""
with recursive vectors as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
good as (
  select vec_id, v from vectors
  where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b
    on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) as (
  select vec_id, vec_id from vectors union select r.a, l.b from reach r join links l on r.b = l.a)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, c.component_id,
       vec_id = c.component_id as kept
from vectors join (select a, min(b) as component_id from reach group by a) c on c.a = vec_id"""


def divergence() -> str:
    def share(c: str, n: str) -> str:
        return f"1 + (1000000000::hugeint * ({c} + 5)) // ({n} + 5 * v)"

    return f"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents),
groups as (select distinct lang, source from docs),
words as (select r, lang, source, unnest(regexp_extract_all({lower('text')}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term from docs),
kept as (select lang, term, count(*) as n_lang from words group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v, sum(n_lang) as n_all from kept group by lang),
counts as (select lang, source, term, count(*) as c from words group by lang, source, term),
dense as (
  select g.lang, g.source, k.term, k.n_lang, coalesce(c.c, 0) as c
  from groups g join kept k on g.lang = k.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
summed as (select *, sum(c) over (partition by lang, source) as n from dense),
shares as (
  select lang, source, term, c, {share('c', 'n')} as p, {share('n_lang', 'n_all')} as q from summed join sizes using (lang)),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join apart f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where c > 0 and p > q),
ranked as (
  select lang, source, part, item, value::bigint as value,
         (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
  from parts)
select * from ranked where part = 'pair' or rank <= 50"""


def merkle() -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    def tree(name: str, group: str, rows: str) -> str:
        return f"""
{name}({group}, level, pos, n, digest) as (
  {rows}
  union all
  select {group}, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by pos))
  from {name} where n > 1 group by {group}, level, pos // 3, n),
{name}_runs as (
  select a.{group}, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos), '') as before,
         coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos), '') as after
  from {name} a join {name} b
    on a.{group} is not distinct from b.{group} and a.level = b.level and a.pos // 3 = b.pos // 3
  where a.n > 1 group by a.{group}, a.level, a.pos)"""

    def walk(name: str, of: str, group: str, start: str) -> str:
        return f"""
{name}(r, {group}, level, pos, acc, proof) as (
  {start}
  union all
  select w.r, w.{group}, w.level + 1, w.pos // 3, sha256(s.before || w.acc || s.after), w.proof || s.before || s.after
  from {name} w join {of}_runs s on w.{group} is not distinct from s.{group} and w.level = s.level and w.pos = s.pos)"""

    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bit = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    byte = f"list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {bit})"
    crc = (f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), "
           f"lambda crc, b: {byte}), 4294967295)")
    return f"""
with recursive docs as (
  select row_number() over () as r, doc_id, source, sha256({rest} || {field('text')}) as leaf,
         sha256({rest} || case when coalesce({crc} % 2 = 0, false) then {field("replace(text, chr(10), '')")} else {field('text')} end)
           as candidate
  from documents),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, candidate) - 1 as pos,
         count(*) over (partition by source) as n from docs),
{tree('low', 'source', 'select source, 0, pos, n, leaf from placed')},
tops as (
  select source, digest, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n, 0 as one
  from low where n = 1),
{tree('high', 'one', 'select one, 0, pos, n, digest from tops')},
{walk('inner_walk', 'low', 'source', "select r, source, 0, pos, candidate, '' from placed")},
ends as (
  select w.r, t.pos, t.digest as subroot, w.acc, w.proof, t.one
  from inner_walk w join low l on w.source is not distinct from l.source and w.level = l.level and w.pos = l.pos and l.n = 1
  join tops t on t.source is not distinct from w.source),
{walk('outer_walk', 'high', 'one', 'select r, one, 0, pos, acc, proof from ends')},
root as (select level, digest from high where n = 1)
select d.doc_id, d.leaf, e.subroot, root.digest as root, sha256(w.proof) as proof_sha256, w.acc as folded_root,
       w.acc = root.digest as verified
from outer_walk w join root on w.level = root.level join docs d using (r) join ends e using (r)"""


SQL: dict[str, str] = {"op10_embeddings": embeddings(), "op6_urls": urls(), "op8_chat": chat(), "op12_divergence": divergence(),
                       "op13_merkle": merkle()}
