"""SQL of the retrieval operators, as common table expressions that build on each other."""

from __future__ import annotations

from ..functions.tokenize import STOPWORDS
from .tables import ASKED, MEM, sql_parts, sql_stop, sql_terms, sql_words

STOP = sql_stop(STOPWORDS)
POST = f"""fields as (select id, 0 as f, title as t from mem union all select id, 1, array_to_string(tags, ' ') from mem union all select id, 2, body from mem),
wc as (select id, f, w, count(*) as n from (select id, f, unnest({sql_words("t")}) as w from fields) group by all),
vw as (select w, {sql_terms("w")} as terms from (select distinct w from wc)),
post as (select id, term, sum(case when f = 0 then n else 0 end)::bigint as tf_title, sum(case when f = 1 then n else 0 end)::bigint as tf_tags, sum(case when f = 2 then n else 0 end)::bigint as tf_body
 from (select id, f, n, unnest(terms) as term from wc join vw using (w)) where term not in {STOP} group by id, term)"""
LENGTHS = """dfs as (select term, count(*) as df from post group by term),
lens as (select mem.id, coalesce(l.len_title, 0)::bigint as len_title, coalesce(l.len_tags, 0)::bigint as len_tags, coalesce(l.len_body, 0)::bigint as len_body from mem left join
 (select id, sum(tf_title) as len_title, sum(tf_tags) as len_tags, sum(tf_body) as len_body from post group by id) l using (id)),
stats as (select count(*) as n_docs, sum(len_title)::bigint as total_title, sum(len_tags)::bigint as total_tags, sum(len_body)::bigint as total_body from lens)"""


def ln(source: str, keys: str) -> str:
    """Rows of source (keys, num, d), num > d, with idf_micros = ln(num / d)."""
    q = f"select {keys}, num, d, list_max([k for k in range(0, 40) if num >= d * (1::bigint << k)]) as k from ({source})"
    q = f"select {keys}, k, num, d * (1::bigint << k) as d from ({q})"
    q = f"select {keys}, k, ((num - d) * 1000000000 + (num + d) // 2) // (num + d) as z from ({q})"
    q = f"select {keys}, k, (z * z + 500000000) // 1000000000 as z2, z as t, z as s from ({q})"
    for n in range(3, 25, 2):
        q = f"select {keys}, k, z2, u as t, s + (u + {n // 2}) // {n} as s from (select *, (t * z2 + 500000000) // 1000000000 as u from ({q}))"
    return f"select {keys}, ((k * 693147181 + 2 * s + 500) // 1000)::bigint as idf_micros from ({q})"


QTERMS = f"""qall as (select qid, pos, term from (select qid, unnest(list_zip(ts, range(len(ts)))) as z, z[1] as term, z[2] as pos from (select qid, flatten([{sql_terms("w")} for w in {sql_words("text")}]) as ts from asked))),
qterms as (select distinct qid, term from qall where term not in {STOP})"""
SCORED = f"""idfs as ({ln("select term, df, 2 * n_docs + 2 as num, 2 * df + 1 as d from dfs, stats where term in (select term from qterms)", "term, df")}),
norms as (select id, case when 2 * total_title + 2 * total_tags + total_body = 0 then 1000000 else 250000 + (750000 * ((2 * len_title + 2 * len_tags + len_body) * n_docs) + (2 * total_title + 2 * total_tags + total_body) // 2) // (2 * total_title + 2 * total_tags + total_body) end as norm from lens, stats),
parts as (select qid, id, term, tf_title, tf_tags, tf_body, df, idf_micros, ((idf_micros * (tfw * 2200000) + b // 2) // b)::bigint as contribution_micros from
 (select *, 2 * tf_title + 2 * tf_tags + tf_body as tfw, (2 * tf_title + 2 * tf_tags + tf_body) * 1000000 + (1200000 * norm + 500000) // 1000000 as b from qterms join idfs using (term) join post using (term) join norms using (id))),
scored as (select qid, id, sum(contribution_micros)::bigint as score_micros from parts group by qid, id having sum(contribution_micros) > 0)"""
EDGES = "edges as (select id as src, link as dst from mem where link in (select id from mem) union select link, id from mem where link in (select id from mem))"


def pagerank() -> str:
    out = """deg as (select src, count(*) as deg from edges group by src),
r0 as materialized (select qid, id, (score_micros * 1000000 // sum(score_micros) over (partition by qid))::bigint as mass from scored)"""
    for i in range(1, 31):
        out += f""",
r{i} as materialized (select qid, id, sum(mass)::bigint as mass from (select qid, id, mass // 2 as mass from r0 union all
 select * from (select r.qid, e.dst, (r.mass // 2) // d.deg as share from r{i - 1} r join edges e on e.src = r.id join deg d on d.src = r.id) where share > 0) group by qid, id)"""
    return out


PPR = EDGES + ",\n" + pagerank()
REACHED = """reached as (select r.qid, r.id, r.mass from r30 r where r.mass >= 20000 and not exists (select 1 from scored s where s.qid = r.qid and s.id = r.id)),
linked as (select qid, id, mass, via from (select a.qid, a.id, a.mass, e.dst as via, row_number() over (partition by a.qid, a.id order by s.score_micros desc, e.dst) as n from reached a join edges e on e.src = a.id join scored s on s.qid = a.qid and s.id = e.dst) where n = 1)"""
GRAMS = """vocab as (select term from dfs union select term from qterms),
grams as (select term, substr('<' || term || '>', s, n) as g from vocab, (values (3), (4), (5)) x(n), unnest(range(1, len(term) + 4 - n)) y(s) union all select term, '=' || term from vocab),
hashed as (select g, list_reduce([('0x' || substr(hex(encode(g)), 1 + 2 * i, 2))::int for i in range(octet_length(encode(g)))], lambda h, b: (xor(h, b) * 435) % 1024, 805) as bucket from (select distinct g from grams)),
buckets as (select term, bucket, count(*) as weight from grams join hashed using (g) group by term, bucket),
norm2 as (select term, sum(weight * weight)::bigint as n2 from buckets group by term)"""
COSINES = """qtoks as (select qid, term as token, count(*) as times from qall where term not in STOP group by qid, term),
cosines as (select token, term, least(1000000, floor(sqrt((dot * dot * 1000000000000 // (na * nb))::double))::bigint) as cosine from
 (select a.term as token, b.term, sum(a.weight * b.weight)::bigint as dot, any_value(x.n2) as na, any_value(y.n2) as nb from buckets a join buckets b using (bucket) join norm2 x on x.term = a.term join norm2 y on y.term = b.term
 where a.term in (select token from qtoks) and b.term in (select term from dfs) group by a.term, b.term) where dot > 0)""".replace("STOP", STOP)
SIMS = """sims as (select qid, id, (sum(best * times) // any_value(n))::bigint as sim from (select qid, token, times, sum(times) over (partition by qid) as n from qtoks) t
 join (select id, token, max(cosine) as best from cosines join post using (term) group by id, token) b using (token) group by qid, id having (sum(best * times) // any_value(n)) > 0)"""
HITS = """base as (select qid, id, 'lexical' as kind, score_micros, 0::bigint as graph_micros, null::varchar as graph_via, score_micros as bm25_micros from scored union all select qid, id, 'graph', mass, mass, via, 0 from linked),
hits as (select b.qid, b.id, b.kind, (b.score_micros + coalesce(s.sim, 0) // 2)::bigint as score_micros, b.graph_micros, b.graph_via, b.bm25_micros, coalesce(s.sim, 0)::bigint as sim from base b left join sims s on s.qid = b.qid and s.id = b.id
 union all select qid, id, 'semantic', sim, 0, null, 0, sim from sims s where sim >= 350000 and not exists (select 1 from base b where b.qid = s.qid and b.id = s.id))"""


def query(select: str, *ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


WORDS = (MEM, POST)
INDEX = (MEM, POST, LENGTHS)
BM25 = (MEM, POST, LENGTHS, ASKED, QTERMS, SCORED)
GRAPH = (*BM25, PPR, REACHED)
SIM = (*BM25, GRAMS, COSINES, SIMS)
FULL = (*GRAPH, GRAMS, COSINES, SIMS, HITS)
PARTS = sql_parts
