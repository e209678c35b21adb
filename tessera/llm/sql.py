"""DuckDB SQL for the training-data queries that SQL can express."""

from .decontamination import LEAST, WINDOW
from .sharding import SLOTS
from .token_counts import Unigram

_WORDS7 = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LINES7 = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"

OP7 = rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') as t, {_WORDS7} as ws, {_LINES7} as ls from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
g as (select r, p, w as a, lead(w, 1) over (partition by r order by p) as b, lead(w, 2) over (partition by r order by p) as c from w),
n as (select r, p, count(*) over (partition by r, a, b, c) as k from g where c is not null),
m as (select r, count(distinct q) as n_repeat_words from (select r, unnest([p, p + 1, p + 2]) as q from n where k > 1) group by r),
x as (select d.r, doc_id, t, ls, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
             coalesce(n_repeat_words, 0) as n_repeat_words from d left join m on d.r = m.r),
l as (select r, min(p) as p, l from (select r, unnest(ls) as l, generate_subscripts(ls, 1) as p from x) group by r, l),
k as (select r, sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) as remain from l
      where not (length(l) - length(regexp_replace(l, '[|»›·•]', '', 'g')) >= 3
        or regexp_matches(l, '(?i)\b(cookies?|javascript|terms of (use|service)|privacy policy|all rights reserved|click here|sign in|log in|subscribe|newsletter|lorem ipsum|read more|share this)\b')
        or (not regexp_matches(rtrim(l, ' '), '[.!?…:;。！？][)"»”’]*$') and not regexp_matches(rtrim(l, ' '), '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{3}}[^\x20]'))
        or length(regexp_replace(l, '[\p{{L}}\p{{N}}\x20\x09-\x0D]', '', 'g')) > 0.4 * length(regexp_replace(l, '[ \t\r]', '', 'g'))
        or 2 * (length(rtrim(l, ' ')) - length(replace(rtrim(l, ' '), '!!', '!'))) > len(string_split(rtrim(l, ' '), ' '))) group by r)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(remain, 0) >= 0.5 * word_chars as kept
from x left join k on x.r = k.r
"""


#: Every diagonal on which a document and an item share enough tokens, without masks or hashes.
OP1 = r"""
with d as (select row_number() over () as r, doc_id, TOKENS as t from documents), b as (select row_number() over () as i, item_id, TOKENS as t from benchmark),
dp as (select r, unnest(t) as w, unnest(range(len(t))) as p from d), bp as (select i, len(t) as n, unnest(t) as w, unnest(range(len(t))) as q from b),
s as (select r, i, p - q as s from dp join bp on dp.w = bp.w group by r, i, p - q, n having count(*) >= ceil(LEAST * least(WINDOW, n))),
f as (select doc_id, item_id, s, list_transform(range(len(b.t)), lambda k: case when s + k >= 0 and s + k < len(d.t) and d.t[s + k + 1] = b.t[k + 1] then 1 else 0 end) as f from s join d using (r) join b using (i)),
g as (select doc_id, item_id, s, list_max(list_transform(range(len(f) - least(WINDOW, len(f)) + 1), lambda k: list_sum(f[k + 1:k + least(WINDOW, len(f))]))) as best, list_sum(f) as matched, len(f) as n from f),
o as (select *, row_number() over (partition by doc_id, item_id order by best desc, matched desc, s) as k from g where best >= ceil(LEAST * least(WINDOW, n)))
select doc_id, item_id, cast(best as bigint) as best, cast(matched as bigint) as matched, cast(n as bigint) as n_item, cast(s as bigint) as doc_start from o where k = 1
""".replace("TOKENS", r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')").replace("LEAST", str(LEAST)).replace("WINDOW", str(WINDOW))


def op5() -> str:
    """The dynamic program for each distinct pre-token, place by place, over all pieces that end there."""
    model = Unigram()
    pieces = ", ".join("'" + p.replace("'", "''") + "'" for p in model.score)
    scores = ", ".join(repr(x) for x in model.score.values())
    longest = max(map(len, model.score))
    return rf"""
with recursive vocab as (select unnest([{pieces}]) as piece, unnest([{scores}]::double[]) as p),
doc as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as (select r, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as w from doc),
word as materialized (select distinct w, '▁' || w as f, length(w) + 1 as n from split),
place as (select w, f, n, unnest(range(1, n + 1)) as d from word),
cut as (select w, d, unnest(range(1, least(d, {longest}) + 1)) as k, f from place),
edge as materialized (select w, d, list(struct_pack(k := k, p := p)) as e from (select w, d, k, p from cut join vocab on substring(f, d - k + 1, k) = piece) group by w, d),
step as materialized (select place.w, place.d, n, octet_length(encode(substring(f, place.d, 1))) as b, coalesce(e, []) as e from place left join edge on place.w = edge.w and place.d = edge.d),
go as (
  select w, n, 0 as d, [0.0::double] as best, [0::bigint] as tok from word
  union all
  select w, n, d, list_append(best, x.s), list_append(tok, -x.t) from (
    select go.w, go.n, step.d, best, tok, list_max(list_append(
      list_transform(e, lambda y: struct_pack(s := best[step.d - y.k + 1] + y.p, t := -(tok[step.d - y.k + 1] + 1))),
      struct_pack(s := best[step.d] + b * ({model.byte!r}::double), t := -(tok[step.d] + b)))) as x
    from go join step on go.w = step.w and step.d = go.d + 1) q),
known as (select w, tok[n + 1] as c from go where d = n),
total as (select r, count(*) as n, sum(c) as c from split join known using (w) group by r)
select doc_id, coalesce(n, 0)::bigint as n_pretokens, coalesce(c, 0)::bigint as n_tokens, length(t)::bigint as n_chars from doc left join total using (r)
"""


OP8 = r"""
with recursive doc as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))) end as g from doc),
gram as materialized (select doc_id, len(g) as n, unnest(g) as g from sets),
link as materialized (select a.doc_id as a, b.doc_id as b from gram a join gram b on a.g = b.g and a.doc_id <> b.doc_id
  and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select a as x, b as y from link union select x, b from reach join link on y = a),
least_of as (select x, min(y) as y from reach group by x)
select doc_id, cast(len(g) as bigint) as n_shingles, cast(least(doc_id, coalesce(y, doc_id)) as bigint) as component_id from sets left join least_of on doc_id = x
"""

#: CRC-32 from its polynomial; the map of slots to shards is built slot by slot, the largest first.
OP9 = rf"""
with recursive bit as (select i, i as c, 0 as k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bit where k < 8),
tab as (select list(c order by i) as tab from bit where k = 8),
doc as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
crc as materialized (select r, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint)),
  lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as crc from doc, tab),
row_of as materialized (select doc_id, octet_length(encode(t)) + 1 as size, crc, ('0x' || substr(md5(coalesce(doc_id::varchar, 'text ' || crc)), 1, 8))::bigint % {SLOTS} as v from doc join crc using (r)),
slot_of as materialized (select v, b, row_number() over (order by b desc, v) as k from (select s.v, coalesce(sum(size), 0)::bigint as b from range({SLOTS}) s(v) left join row_of using (v) group by s.v)),
deal as (
  select 0::bigint as k, -1::bigint as v, -1 as shard, list_transform(range(16), lambda i: 0::bigint) as load
  union all
  select s.k, s.v, list_position(load, list_min(load)) - 1, list_transform(load, lambda x, i: case when i = list_position(load, list_min(load)) then x + s.b else x end)
  from deal join slot_of s on s.k = deal.k + 1)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard::int as shard,
  row_number() over (partition by shard order by v, doc_id nulls first, crc, size) - 1 as slot, null::int as grown_shard from row_of join deal using (v)
"""

OP10 = r"""
with doc as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as materialized (select r, i, md5_number(substr(x, 2 * i + 1, 800)) as h from (select r, x, unnest(range(greatest(len(x) // 2 - 399, 0))) as i from doc)),
again as (select r, i from (select r, i, count(*) over (partition by h) as n from win) where n > 1),
run as (select r, i, sum(case when i - j <= 400 then 0 else 1 end) over (partition by r order by i) as k from (select r, i, coalesce(lag(i) over (partition by r order by i), -1000) as j from again)),
span as (select r, min(i) as a, max(i) + 400 as b from run group by r, k),
part as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as before, lead(a) over (partition by r order by a) as next from span),
cut as (select r, sum(b - a) as removed, count(*) as n, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as kept from part join doc using (r) group by r)
select doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from doc left join cut using (r)
"""
