"""SQL of the corpus operators whose results SQL can express, over the same tables."""

from __future__ import annotations

from .op06_line_dedup import MIN_WORDS
from .op07_secrets import KINDS
from .op08_ngram_join import PERCENT, SHINGLE
from .op12_sharding import OVERHEAD, SHARDS
from .op13_prefix_trie import EVERY, HEADS

#: Lines with a word, without white space at their ends, and blocks of lines that just reach the words, forward and back.
LINE_DEDUP = rf"""with kept as (select doc_id, [y for y in [trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) for x in string_split(coalesce(text, ''), chr(10))] if y <> ''] as ls from documents),
numbered as (select doc_id, unnest(ls) as l, unnest(range(len(ls))) as i from kept),
summed as (select doc_id, i, sum(len(regexp_extract_all(l, '[^\s\x0b]+'))) over (partition by doc_id order by i) as upto, sum(len(regexp_extract_all(l, '[^\s\x0b]+'))) over (partition by doc_id order by i) - len(regexp_extract_all(l, '[^\s\x0b]+')) as since from numbered),
spans as (select a.doc_id, a.i as start, min(b.i) - a.i + 1 as n from summed a join summed b on a.doc_id = b.doc_id and b.i between a.i and a.i + {MIN_WORDS} and b.upto - a.since >= {MIN_WORDS} group by a.doc_id, a.i
 union select b.doc_id, max(a.i), b.i - max(a.i) + 1 from summed a join summed b on a.doc_id = b.doc_id and a.i between b.i - {MIN_WORDS} and b.i and b.upto - a.since >= {MIN_WORDS} group by b.doc_id, b.i),
blocks as (select doc_id, start, n, md5(array_to_string(ls[start + 1 : start + n], chr(10))) as block from spans join kept using (doc_id)),
firsts as (select n, block, min(struct_pack(d := doc_id, s := start)) as f from blocks group by n, block having count(*) > 1),
later as (select doc_id, start, start + n as stop, f.d as of, start - f.s as diagonal from blocks join firsts using (n, block) where (doc_id > f.d or (doc_id = f.d and start > f.s)) and not (doc_id = f.d and start < f.s + n)),
chained as (select *, sum(fresh) over (partition by doc_id, of, diagonal order by start, stop rows unbounded preceding) as run from
 (select *, case when start <= max(stop) over (partition by doc_id, of, diagonal order by start, stop rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from later)),
runs as (select doc_id, of, diagonal, min(start) as start, max(stop) as stop from chained group by doc_id, of, diagonal, run),
named as (select doc_id, string_agg(start || '+' || (stop - start) || '@' || of || ':' || (start - diagonal), ',' order by start, stop, of, start - diagonal) as runs from runs group by doc_id),
gone as (select doc_id, count(*) as n_removed, string_agg(i, ',' order by i) as removed from (select distinct doc_id, unnest(range(start, stop)) as i from runs) group by doc_id)
select doc_id, len(ls) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed, coalesce(runs, '') as runs from kept left join gone using (doc_id) left join named using (doc_id)"""

_CASES = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
#: (pattern, group of the value, its least length) of each kind of KINDS.
_SECRETS = (
    ("(" + "|".join(_CASES(w) for w in ("password", "passwd", "secret", "token")) + "|" + _CASES("api") + "_?" + _CASES("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("(AKIA[A-Z0-9]+)", 1, 20),
    ("([0-9a-f]{24,})", 1, 24),
    ("([A-Za-z0-9+/_=-]{20,})", 1, 20),
)
_FOUND = " union all ".join(
    f"select doc_id, owner, {k} as kind, unnest(range(1, len(m) + 1)) as i, m, v, p, {least} as least from (select doc_id, owner, regexp_extract_all(text, '{x}', 0) as m, regexp_extract_all(text, '{x}', {g}) as v, string_split_regex(text, '{x}') as p from docs)" for k, (x, g, least) in enumerate(_SECRETS)
)
#: A match begins after the pieces between the matches before it, and these matches.
SECRETS = f"""with docs as (select doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),
places as (select doc_id, owner, kind, v[i] as value, (coalesce(list_sum([len(x) for x in p[1:i]]), 0) + coalesce(list_sum([len(x) for x in m[1:i - 1]]), 0))::bigint as start, len(m[i]) as size from ({_FOUND}) where len(v[i]) >= least
 and (kind < 3 or (len(regexp_extract_all(v[i], '[0-9]')) >= 3 and regexp_matches(v[i], '[a-z]') and regexp_matches(v[i], '[A-Z]') and len(list_distinct(string_split(v[i], ''))) >= 12))),
held as (select value, count(distinct owner) < 3 and count(distinct (owner, doc_id)) < 10 as live from places group by value),
base as (select doc_id, kind, start, start + size as stop, live from places join held using (value) where kind < 3),
extra as (select doc_id, kind, start, start + size as stop, live from places join held using (value) where kind = 3 and live and not exists (select 1 from base b where b.doc_id = places.doc_id and b.start < places.start + size and places.start < b.stop)),
every as (select * from base union all select * from extra),
told as (select doc_id, {", ".join(f"count(*) filter (where kind = {k}) as n_{n}" for k, n in enumerate(KINDS))}, count(*) filter (where live) as n_live, count(*) filter (where not live) as n_example,
 string_agg({list(KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans, string_agg({list(KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (where kind < 3) as b from every group by doc_id)
select doc_id, {", ".join(f"coalesce({c}, 0) as {c}" for c in (*(f"n_{n}" for n in KINDS), "n_live", "n_example"))}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from docs left join told using (doc_id)"""

#: Equal sets are one class; links between classes by the shingles they share.
NGRAM_JOIN = rf"""with recursive words as (select doc_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if w <> ''] as ws from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < {SHINGLE} then [array_to_string(ws, ' ')] else [array_to_string(ws[i : i + {SHINGLE - 1}], ' ') for i in range(1, len(ws) - {SHINGLE - 2})] end)) as s from words),
classes as (select min(doc_id) as c, s from sets where len(s) > 0 group by s),
tokens as (select c, len(s) as n, unnest(s) as t from classes),
links as (select a.c as a, b.c as b from tokens a join tokens b on a.t = b.t and a.c < b.c group by a.c, b.c, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach as (select c, c as r from classes union select reach.c, e.b from reach join (select a, b from links union all select b, a from links) e on e.a = reach.r),
named as (select c, min(r) as component_id from reach group by c)
select doc_id, len(s)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id from sets left join classes using (s) left join named using (c)"""

#: CRC-32 of a text, by bytes: eight steps of the reversed polynomial for each entry of the table.
_STEP = lambda x: f"(case when ({x}) & 1 = 1 then xor(({x}) >> 1, 3988292384) else ({x}) >> 1 end)"
_ENTRIES = "[list_reduce(range(8), lambda a, k: " + _STEP("a") + ", b) for b in range(256::bigint)]"
CRC = f"""entries as materialized (select {_ENTRIES} as e),
bytes as (select text, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::bigint) as bs from (select distinct text from docs)),
crcs as (select text, xor(list_reduce(bs, lambda h, b: xor(h >> 8, e[xor(h & 255, b) + 1]), 4294967295::bigint), 4294967295) as text_crc32 from bytes, entries)"""
#: Groups one by one, the largest first, each to the least loaded shard with the lowest number.
SHARDING = f"""with recursive docs as (select doc_id, coalesce(text, '') as text from documents),
{CRC},
parts as (select text, sum(octet_length(encode(text)) + {OVERHEAD})::bigint as bytes, row_number() over (order by sum(octet_length(encode(text)) + {OVERHEAD}) desc, min(doc_id) nulls first) as k from docs group by text),
dealt as (select 0::bigint as k, [0::bigint for i in range({SHARDS})] as loads, 0 as shard
 union all select parts.k, list_transform(loads, lambda x, i: case when i = list_position(loads, list_min(loads)) then x + bytes else x end), list_position(loads, list_min(loads)) - 1 from dealt join parts on parts.k = dealt.k + 1)
select doc_id, (octet_length(encode(text)) + {OVERHEAD})::bigint as size, text_crc32, 'bytes' as law, shard::int as shard, row_number() over (partition by shard order by doc_id nulls first) - 1 as slot, null::int as grown_shard
 from docs join parts using (text) join crcs using (text) join dealt using (k)"""

_WORDS = "[w for w in regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+') if w <> '']"
_CRC_ID = f"xor(list_reduce(list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint), lambda h, b: xor(h >> 8, e[xor(h & 255, b) + 1]), 4294967295::bigint), 4294967295)"
#: Every beginning of every conversation; sums over subtrees by the beginnings of a node's beginning.
PREFIX_TRIE = f"""with entries as materialized (select {_ENTRIES} as e),
whole as (select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as ts from conversations where conv_id is not null group by conv_id),
heads as (select conv_id, ({_CRC_ID} % {HEADS})::int as h, conv_id - conv_id % {EVERY} as base from whole, entries),
rebuilt as (select w.conv_id, list_concat(coalesce(b.ts, [])[1:h], w.ts[h + 1:]) as s from whole w join heads using (conv_id) left join whole b on b.conv_id = base),
begun as (select conv_id, d, s[1:d] as p, len(s) = d as whole from (select conv_id, s, unnest(range(len(s) + 1)) as d from rebuilt)),
node as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where whole), '') as ends,
 case when d = 0 then 0 else (count(*) - 1) * len({_WORDS.format("p[d].text")}) end as own from begun group by p, d),
kids as (select p[1:d - 1] as p, count(*) as n_children from node where d > 0 group by p[1:d - 1]),
known as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (p)),
sums as (select a as p, sum(own) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from (select own, n_children, unnest([p[1:k] for k in range(d + 1)]) as a from known) group by a)
select k.conv_id, k.d::bigint as depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens::bigint as saved_tokens, sha256(k.ends) as ends_sha256
 from known k join sums using (p) left join known u on k.d > 0 and u.p = k.p[1:k.d - 1]"""

SQL = {"op6_line_dedup": LINE_DEDUP, "op7_secrets": SECRETS, "op8_ngram_join": NGRAM_JOIN, "op12_sharding": SHARDING, "op13_prefix_trie": PREFIX_TRIE}
