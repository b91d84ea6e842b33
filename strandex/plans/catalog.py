"""Every registered query, with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import redact as rd
from ..functions import text as tx
from ..functions import tokenize as tk
from ..operators import bm25, embed, graph, lifecycle, rank
from ..operators import capture as cp
from ..operators import provenance as pv
from ..operators import recall as rc
from ..operators.index import freshness, hashed_text
from ..sources import transcripts as tr
from ..storage import materialised
from . import sql as q
from . import tables as t

QUERIES: dict = {}
SQL: dict = {}
MTYPES = ", ".join(f"'{x}'" for x in tx.TYPES)


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _literal(spark: SparkSession, rows, names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


# tokens and the index


@query(f"select term, count(*) as n from (select unnest(flatten([{t.sql_terms('w')} for w in {t.sql_words('text')}])) as term from documents) where term not in {q.STOP} group by term")
def tokenize_terms(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select(F.explode(tk.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c")).select("c", F.explode(tk.word_terms(F.col("w"))).alias("term")).where(~tk.is_stopword(F.col("term"))).groupBy("term").agg(F.sum("c").alias("n"))


@query(f"select w as word, array_to_string({q.PARTS('w')}, ' ') as parts from (select distinct unnest({t.sql_words('text')}) as w from documents) where len({q.PARTS('w')}) > 1")
def subtoken_expand(spark, sf_dir):
    words = t.read(spark, sf_dir, "documents").select(F.explode(tk.words(F.col("text"))).alias("word")).distinct()
    return words.where(F.col("word").rlike(tk.PARTED)).withColumn("p", tk.parts(F.col("word"))).where(F.size("p") > 1).select("word", F.array_join("p", " ").alias("parts"))


@query(q.query("select term, df from dfs", *q.INDEX))
def term_df(spark, sf_dir):
    return t.index(spark, sf_dir).df


@query(q.query("select * from post", *q.WORDS))
def postings(spark, sf_dir):
    return t.index(spark, sf_dir).postings


@query(q.query("select * from lens", *q.INDEX))
def field_lengths(spark, sf_dir):
    return t.index(spark, sf_dir).docs.select("id", "len_title", "len_tags", "len_body")


@query(q.query("select * from stats", *q.INDEX))
def corpus_stats(spark, sf_dir):
    return t.index(spark, sf_dir).stats


@query(q.query(q.ln("select distinct df, 2 * n_docs + 2 as num, 2 * df + 1 as d from dfs, stats", "df"), *q.INDEX))
def idf_micros(spark, sf_dir):
    ix = t.index(spark, sf_dir)
    return bm25.idf(ix.stats, ix.df.select("df").distinct())


# lexical scores


@query(q.query("select qid, rank, id, score_micros from (select *, row_number() over (partition by qid order by score_micros desc, id) as rank from scored) where rank <= 10", q.MEM, q.POST, q.LENGTHS, t.PASSAGES, q.QTERMS, q.SCORED))
def bm25_topk(spark, sf_dir):
    return rank.packed(rank.ranked(bm25.scores(t.index(spark, sf_dir), t.passages(spark, sf_dir)))).select("qid", "rank", "id", "score_micros")


@query(q.query("select qid, rank, id, score_micros from (select qid, id, score_micros, row_number() over (partition by qid order by score_micros desc, id) as rank from scored join mem using (id) where mtype = 'fact' and list_contains(tags, 'en') and coalesce(scope, 'global') in ('project:src3', 'global')) where rank <= 10", *q.BM25))
def bm25_filtered_topk(spark, sf_dir):
    ix = t.index(spark, sf_dir)
    docs = ix.docs.where(rc.passes(rc.Options(mtype="fact", tag="en", scope="project:src3"))).select("id")
    return rank.packed(rank.ranked(bm25.scores(ix, t.questions(spark)).join(docs, "id", "left_semi"))).select("qid", "rank", "id", "score_micros")


@query(q.query("select * from parts", *q.BM25))
def bm25_term_breakdown(spark, sf_dir):
    return bm25.contributions(t.index(spark, sf_dir), t.questions(spark))


@query(q.query("select s.qid, s.id, s.score_micros, p.total = s.score_micros as adds_up from scored s join (select qid, id, sum(contribution_micros) as total from parts group by all) p on p.qid = s.qid and p.id = s.id", *q.BM25))
def why_sum_invariant(spark, sf_dir):
    rows = bm25.scores(t.index(spark, sf_dir), t.questions(spark), explain=True)
    return rows.select("qid", "id", "score_micros", (F.aggregate("matched_terms", F.lit(0).cast("long"), lambda a, x: a + x.contribution_micros) == F.col("score_micros")).alias("adds_up"))


@query(q.query(f"select qid, pos, term, case when term in {q.STOP} then 'stopword' else 'not-in-corpus' end as reason from (select qid, term, row_number() over (partition by qid order by min(pos)) - 1 as pos from qall group by qid, term) where term in {q.STOP} or term not in (select term from dfs)", *q.BM25))
def ignored_terms(spark, sf_dir):
    return bm25.ignored_terms(t.index(spark, sf_dir), t.questions(spark))


@query(q.query("select qid, id, score_micros from scored where score_micros >= 1500000", *q.BM25))
def min_score_filter(spark, sf_dir):
    return bm25.scores(t.index(spark, sf_dir), t.questions(spark)).where(F.col("score_micros") >= 1_500_000)


@query(q.query("""select sum(case when rank = 1 then 1 else 0 end)::bigint * 1000000 // count(*)::bigint as p_at_1_micros, (sum(coalesce(1000000 // rank, 0)) // count(*))::bigint as mrr_micros from
 (select item_id, min(rank) as rank from benchmark left join (select qid, rank from (select qid, id, row_number() over (partition by qid order by score_micros desc, id) as rank from scored) h join mem using (id) join benchmark b on b.item_id = h.qid where rank <= 5 and contains(body, b.text)) r on r.qid = item_id group by item_id)""", q.MEM, q.POST, q.LENGTHS, t.PASSAGES, q.QTERMS, q.SCORED))
def eval_mrr(spark, sf_dir):
    """Passages as queries; a document that holds the passage is right."""
    asked = t.passages(spark, sf_dir)
    top = rank.packed(rank.ranked(bm25.scores(t.index(spark, sf_dir), asked)), 5).join(t.memories(spark, sf_dir).select("id", "body"), "id").join(asked, "qid")
    best = asked.select("qid").join(top.where(F.contains("body", "text")).groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")
    return best.agg(fx.div(F.count_if(F.col("rank") == 1) * 1_000_000, F.count("*")).alias("p_at_1_micros"), fx.div(F.sum(F.coalesce(fx.div(1_000_000, "rank"), F.lit(0).cast("long"))), F.count("*")).alias("mrr_micros"))


# graph


@query(q.query("select * from edges", q.MEM, q.EDGES))
def link_edges(spark, sf_dir):
    return graph.edges(t.memories(spark, sf_dir))


def _mass(spark, sf_dir):
    ix = t.index(spark, sf_dir)
    seeds = materialised(bm25.scores(ix, t.questions(spark)).withColumnRenamed("score_micros", "weight"), "seeds")
    edge = materialised(graph.edges(ix.docs), "edges")
    return seeds, edge, graph.personalized_pagerank(edge, seeds)


@query(q.query("select * from r30", *q.GRAPH))
def ppr_mass(spark, sf_dir):
    return _mass(spark, sf_dir)[2]


@query(q.query("select qid, id, mass, via from linked", *q.GRAPH))
def graph_hits_via(spark, sf_dir):
    seeds, edge, mass = _mass(spark, sf_dir)
    reached = mass.where(F.col("mass") >= graph.FLOOR).join(seeds, ["qid", "id"], "left_anti")
    return reached.join(graph.strongest_seed(edge, reached, seeds), ["qid", "id"]).select("qid", "id", "mass", "via")


# sub-words


@query(q.query("select bucket::bigint as bucket, count(*) as terms, sum(weight)::bigint as weight from buckets where term in (select term from dfs) group by bucket", *q.BM25, q.GRAMS))
def ngram_buckets(spark, sf_dir):
    return embed.term_buckets(t.index(spark, sf_dir).vocabulary()).groupBy("bucket").agg(F.count("*").alias("terms"), F.sum("weight").alias("weight"))


@query(q.query("select token, term, cosine from cosines where cosine >= 350000", *q.BM25, q.GRAMS, q.COSINES))
def term_cosine(spark, sf_dir):
    tokens = sorted({w for r in t.questions(spark).select(tk.tokenize(F.col("text")).alias("x")).collect() for w in r.x})
    return embed.term_cosines(t.index(spark, sf_dir).vocabulary(), tokens).where(F.col("cosine") >= rc.SEMANTIC_FLOOR)


@query(q.query("select * from sims", *q.SIM))
def maxsim_rerank(spark, sf_dir):
    ix = t.index(spark, sf_dir)
    return embed.similarities(ix.postings, ix.vocabulary(), t.questions(spark), documents=ix.documents)


@query(q.query("select qid, id, sim from hits where kind = 'semantic'", *q.FULL))
def semantic_only_hits(spark, sf_dir):
    return rc.candidates(t.index(spark, sf_dir), t.questions(spark), rc.Options()).where("kind = 'semantic'").select("qid", "id", "sim")


@query(q.query("""select qid, rank, id, mtype, score_micros, graph_micros, graph_via, bm25_micros, sim, coalesce(matched, '') as matched, coalesce(ignored, '') as ignored, coalesce(shared, '') as shared from top join mem using (id) left join matches using (qid, id) left join ignored using (qid) left join shares using (qid, id)""", *q.FULL,
    "top as (select * from (select *, row_number() over (partition by qid order by score_micros desc, id) as rank from hits) where rank <= 10)",
    "matches as (select qid, id, string_agg(term || ':' || concat_ws('+', case when tf_title > 0 then 'title' end, case when tf_tags > 0 then 'tags' end, case when tf_body > 0 then 'body' end) || ':' || contribution_micros, ' ' order by contribution_micros desc, term) as matched from parts join top using (qid, id) where kind = 'lexical' group by qid, id)",
    f"qfirst as (select qid, term, min(pos) as pos from qall group by qid, term)",
    f"ignored as (select qid, string_agg(term || ':' || case when term in {q.STOP} then 'stopword' else 'not-in-corpus' end, ' ' order by pos) as ignored from qfirst where term in {q.STOP} or term not in (select term from dfs) group by qid)",
    f"shares as (select qid, id, array_to_string(list(term order by pos)[1:3], ' ') as shared from top join qfirst using (qid) where term not in {q.STOP} and octet_length(encode(term)) >= 3 and exists (select 1 from post p where p.id = top.id and octet_length(encode(p.term)) >= 3 and (contains(p.term, qfirst.term) or contains(qfirst.term, p.term))) group by qid, id)"))
def recall_full(spark, sf_dir):
    """Hits of the questions with the whole explanation of each."""
    hits = rc.recall(t.index(spark, sf_dir), t.questions(spark))
    term = lambda x: F.concat_ws(":", x.term, F.array_join(x.fields_hit, "+"), x.contribution_micros.cast("string"))
    why = (F.array_join(F.transform("why.matched_terms", term), " ").alias("matched"), F.array_join(F.transform("why.ignored_terms", lambda x: F.concat_ws(":", x.term, x.reason)), " ").alias("ignored"), F.array_join("why.rerank.shared_subtokens", " ").alias("shared"))
    return hits.select(*why, "qid", "rank", "id", "mtype", "score_micros", "graph_micros", "graph_via", F.col("why.rerank.bm25_micros").alias("bm25_micros"), F.col("why.rerank.embed_sim_micros").alias("sim"))


# after scoring


def _top(spark, sf_dir, k=10):
    return rank.packed(rank.ranked(bm25.scores(t.index(spark, sf_dir), t.questions(spark))), k)


_TOP = "top as (select qid, rank, id, score_micros from (select *, row_number() over (partition by qid order by score_micros desc, id) as rank from scored) where rank <= 10)"


@query(q.query("select a.qid, a.id as id, b.id as other, (len(list_intersect(a.ts, b.ts)) * 1000000 // len(list_distinct(list_concat(a.ts, b.ts))))::bigint as jaccard_micros from sets a join sets b on a.qid = b.qid and a.rank < b.rank", *q.BM25, _TOP, "sets as (select qid, rank, id, list(term) as ts from top join post using (id) group by all)"))
def jaccard_pairs(spark, sf_dir):
    """Between the ten first hits of a question."""
    first = materialised(_top(spark, sf_dir), "first")
    top = materialised(first.join(rc.terms_of(first, t.index(spark, sf_dir).postings), "id"), "top")
    other = top.select("qid", F.col("rank").alias("r2"), F.col("id").alias("other"), F.col("terms").alias("t2"))
    return top.join(other, "qid").where("rank < r2").select("qid", "id", "other", fx.jaccard_micros(F.col("terms"), F.col("t2")).alias("jaccard_micros"))


#: Hits of a question that mmr_order orders.
DIVERSE = 100
_MMR = f"""sets as materialized (select qid, id, rank, score_micros * 1000000 // max(score_micros) over (partition by qid) as rel, ts from (select *, row_number() over (partition by qid order by score_micros desc, id) as rank from scored)
 join (select id, list(hash(term)) as ts from post where id in (select id from scored) group by id) using (id)),
 picks as (select qid, 0 as n, id, rank, rel, ts, 0::bigint as near, row_number() over (partition by qid order by rank) = 1 as best from sets
 union all select qid, n, id, rank, rel, ts, near, row_number() over (partition by qid order by case when rel >= near then (rel - near) // 2 else -((near - rel) // 2) end desc, rank) = 1 as best from
 (select qid, n + 1 as n, id, rank, rel, ts, greatest(near, len(list_intersect(ts, of)) * 1000000 // (len(ts) + len(of) - len(list_intersect(ts, of)))) as near from
 (select *, first_value(ts) over (partition by qid order by best desc) as of from picks) where not best and n < {DIVERSE - 1}))"""


@query(q.query("select qid, id, n + 1 as rank from picks where best", *q.BM25, _MMR).replace("with ", "with recursive ", 1))
def mmr_order(spark, sf_dir):
    """The first hits of a question by maximal marginal relevance, of all its hits."""
    ix = t.index(spark, sf_dir)
    hits = materialised(rank.placed(bm25.scores(ix, t.questions(spark))), "hits")
    return rank.diversified(hits, rc.terms_of(hits, ix.postings), DIVERSE).select("qid", "id", "rank")


@query(q.query("select qid, id, rank, cost from f where kept", *q.BM25, "f0 as (select qid, id, row_number() over (partition by qid order by score_micros desc, id) as rank, (len(title) + octet_length(encode(coalesce(rationale, ''))) + octet_length(encode(id))) // 4 + 8 as cost from scored join mem using (id))",
    "fold as (select qid, 0::bigint as rank, 0::bigint as spent, 0::bigint as n, ''::varchar as id, 0::bigint as cost, false as kept from asked union all select f0.qid, f0.rank, fold.spent + case when ok then f0.cost else 0 end, fold.n + ok::bigint, f0.id, f0.cost, ok from fold join f0 on f0.qid = fold.qid and f0.rank = fold.rank + 1, lateral (select fold.n < 10 and (fold.n = 0 or fold.spent + f0.cost <= 120) as ok) where fold.n < 10)", "f as (select * from fold)").replace("with ", "with recursive ", 1))
def budget_pack(spark, sf_dir):
    hits = rank.placed(bm25.scores(t.index(spark, sf_dir), t.questions(spark))).join(t.index(spark, sf_dir).docs.select("id", "title", "rationale"), "id")
    hits = hits.withColumn("cost", tx.card_cost(F.col("title"), F.col("rationale"), F.col("id")))
    return rank.packed(hits, 10, 120, F.col("cost")).select("qid", "id", "rank", "cost")


_DECAYED = f"""decayed as (select id, case when e <= 0 then b when e // 7776000 >= 63 then 0 when e % 7776000 > 0 then (b >> (e // 7776000)::int) * (15552000 - e % 7776000) // 15552000 else b >> (e // 7776000)::int end::bigint as confidence from
 (select id, coalesce(confidence, 1000000)::bigint as b, {t.NOW} - coalesce(last_used, created) as e from mem))"""


@query(q.query("select id, confidence from decayed", q.MEM, _DECAYED))
def decay_confidence(spark, sf_dir):
    return t.memories(spark, sf_dir).select("id", lifecycle.confidence_now(t.NOW).alias("confidence"))


@query(q.query("select qid, rank, id, score_micros from (select *, row_number() over (partition by qid order by score_micros desc, id) as rank from (select qid, id, (score_micros - 200000 * (1000000 - confidence) // 1000000)::bigint as score_micros from scored join decayed using (id))) where rank <= 10", *q.BM25, _DECAYED))
def decay_rerank(spark, sf_dir):
    ix = t.index(spark, sf_dir)
    hits = bm25.scores(ix, t.questions(spark)).join(ix.docs.select("id", "confidence", "last_used", "created"), "id")
    return rank.packed(rank.ranked(rank.with_decay(hits, t.NOW))).select("qid", "rank", "id", "score_micros")


@query(q.query("select id, confidence from decayed where confidence < 250000", q.MEM, _DECAYED))
def prune_candidates(spark, sf_dir):
    return lifecycle.stale(t.memories(spark, sf_dir), t.NOW)


# records

_SLUG = "case when s = '' then 'untitled' else s end"
_SLUGGED = rf"slugged as (select id, mtype, doc_id, {_SLUG} as slug from (select *, regexp_replace(left(regexp_replace(regexp_replace(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-', ''), 40), '-+$', '') as s from mem))"


@query(q.query("select id, slug from slugged", q.MEM, _SLUGGED))
def slugify_ids(spark, sf_dir):
    return t.memories(spark, sf_dir).select("id", tx.slugify(F.col("title")).alias("slug"))


@query(q.query("select id, mtype || '-' || slug || '-' || [n for n in range(1, rn + 3) if n <> 2 and n <> 4][rn] as new_id from (select *, row_number() over (partition by mtype, slug order by doc_id) as rn from slugged)", q.MEM, _SLUGGED))
def disambiguate_ids(spark, sf_dir):
    """Numbers 2 and 4 are taken for every stem."""
    rows = t.memories(spark, sf_dir).select(F.col("id").alias("old"), "mtype", tx.slugify(F.col("title")).alias("slug"), F.col("doc_id").alias("ord"))
    taken = rows.select(F.explode(F.array(*(F.concat_ws("-", "mtype", "slug", F.lit(str(k))) for k in (2, 4)))).alias("id")).distinct()
    return cp.lowest_free(rows, taken).select(F.col("old").alias("id"), F.col("id").alias("new_id"))


@query(q.query("select id, title from mem where mtype = 'decision' and list_contains(tags, 'de')", q.MEM))
def list_memories(spark, sf_dir):
    return lifecycle.listed(t.memories(spark, sf_dir), "decision", "de").select("id", "title")


_REDACTED = r"""regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9])AKIA[A-Z0-9]{16}', '\1[REDACTED:aws-key]', 'g'), '(^|[^A-Za-z0-9])((?i:password|passwd|secret|token|api_key|apikey)[ \t]*=[ \t]*)("[^"]+"|''[^'']+''|[^ \t\n\r\f&;,"''\[][^ \t\n\r\f&;,"'']{5,})', '\1\2[REDACTED:secret-assign]', 'g')"""


@query(f"select doc_id, md5({_REDACTED}) as text_md5, (len({_REDACTED}) - len(replace({_REDACTED}, '[REDACTED:', ''))) // 10 as n from documents")
def redact_text(spark, sf_dir):
    r = rd.redacted(F.col("text"))
    return t.read(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", F.md5("r.text").alias("text_md5"), F.size("r.kinds").cast("long").alias("n"))


_AWS, _ASSIGN = r"(^|[^A-Za-z0-9])AKIA[A-Z0-9]{16}", r"""(^|[^A-Za-z0-9])((?i:password|passwd|secret|token|api_key|apikey)[ \t]*=[ \t]*)("[^"]+"|''[^'']+''|[^ \t\n\r\f&;,"''\[][^ \t\n\r\f&;,"'']{5,})"""


@query(f"select kind, sum(n)::bigint as n from (select 'aws-key' as kind, len(regexp_extract_all(text, '{_AWS}')) as n from documents union all select 'secret-assign', len(regexp_extract_all(regexp_replace(text, '{_AWS}', '\\1[REDACTED:aws-key]', 'g'), '{_ASSIGN}')) from documents) group by kind having sum(n) > 0")
def redact_counts(spark, sf_dir):
    """What is replaced in all documents, by kind; they hold two of the kinds, the tests have all nine."""
    return t.read(spark, sf_dir, "documents").select(F.explode(rd.redacted(F.col("text"))["kinds"]).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# sessions


def _cases(branches: dict[int, str], n: str) -> str:
    """An expression that both engines read: what to make of a turn, by the rest of n."""
    return f"case {n} % {len(branches)} " + " ".join(f"when {k} then {v}" for k, v in branches.items()) + " end"


_MARKED = _cases({0: "concat('MEMORY decision: ', text)", 1: "concat('intro', chr(10), '  memory: ', text)", 2: "concat('Memory Rule : ', text, chr(10), 'MEMORY fact:')", 3: "concat('memory note: ', text)", 4: "text"}, "(conv_id + turn)")
_MARKER = r"(?i)^\s*memory\s*(fact|decision|rule)?\s*:\s*(\S.*?)\s*$"


@query(rf"""select path, row_number() over (partition by path order by n) - 1 as pos, case when kind = '' then 'fact' else kind end as mtype, body from
 (select path, n, lower(regexp_extract(l, '{_MARKER}', 1)) as kind, regexp_extract(l, '{_MARKER}', 2) as body from
 (select path, unnest(string_split(x, chr(10))) as l, generate_subscripts(string_split(x, chr(10)), 1) as n from (select conv_id || '/' || turn as path, {_MARKED} as x from conversations)) where regexp_matches(l, '{_MARKER}'))""")
def scan_markers(spark, sf_dir):
    """In every turn of the conversations, most of them made into marked notes of several shapes."""
    notes = t.read(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.expr(_MARKED).alias("text"))
    return notes.select("path", F.posexplode(tx.markers(F.col("text"))).alias("pos", "m")).select("path", F.col("pos").cast("long").alias("pos"), "m.mtype", "m.body")


_LOGGED = _cases({0: """concat('{"sessionId":"s', conv_id, '","type":"', role, '"}')""", 1: """case when turn = 0 then '{"type":"session_meta","payload":{"id":"1"}}' else concat('{"type":"', role, '"}') end""", 2: """concat('{"role":"', role, '","content":', turn, '}')""", 3: "text", 4: "''", 5: """concat('{"x":', turn, '}', chr(10), chr(10), case when turn > 2 then '{"message":{}}' else '{"y":[]}' end)"""}, "conv_id")


@query(f"""with logs as (select conv_id::varchar as path, string_agg({_LOGGED}, chr(10) order by turn) as x from conversations group by conv_id),
ls as (select path, l, row_number() over (partition by path order by n) as n from (select path, trim(unnest(string_split(x, chr(10)))) as l, generate_subscripts(string_split(x, chr(10)), 1) as n from logs) where l <> ''),
js as (select path, n, case when json_valid(l) then l end as j from ls where n <= 25),
signs as (select path, n, case when j is null then 'generic' when json_extract(j, '$.sessionId') is not null then 'claude-code' when json_extract(j, '$.payload') is not null and json_extract_string(j, '$.type') in ('session_meta', 'response_item', 'turn_context', 'event_msg') then 'codex' end as sign,
 json_extract(j, '$.message') is not null or json_extract(j, '$.role') is not null or json_extract(j, '$.content') is not null as loose from js)
select path, coalesce(first, case when loose then 'codex' end, 'generic') as format from logs left join (select path, arg_min(sign, n) filter (where sign is not null) as first, bool_or(loose) as loose from signs group by path) using (path)""")
def detect_format(spark, sf_dir):
    """Of a log for each conversation, in six shapes."""
    rows = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), "turn", F.expr(_LOGGED).alias("line"))
    return tr.formats(rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x.line), "\n").alias("text")))


def _transcripts(spark, sf_dir):
    return _logs(t.read(spark, sf_dir, "conversations"))


def _logs(turns):
    """Each conversation as a log, a line for each turn."""
    turn = F.to_json(F.struct(F.col("role"), F.col("text").alias("content"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id")))
    rows = turns.select(F.col("conv_id").cast("string").alias("path"), "turn", turn.alias("line"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x.line), "\n").alias("text"))


_ROLLED = r"""rolled as (select conv_id::varchar as path, 'conv-' || conv_id as session_id, count(*) filter (where role in ('user', 'assistant')) as message_count, left(regexp_replace(regexp_extract(first(text order by turn) filter (where role = 'user' and regexp_matches(text, '\S')), '(\S[^\n]*)', 1), '\s+$', ''), 100) as task from conversations group by conv_id)"""


@query(q.query("select path, session_id, message_count, task from rolled", _ROLLED))
def session_rollup(spark, sf_dir):
    return tr.sessions(_transcripts(spark, sf_dir)).select("path", "session_id", "message_count", "task")


_FNV = "lower(lpad(to_hex(list_reduce([('0x' || substr(hex(encode({0})), 1 + 2 * i, 2))::hugeint for i in range(octet_length(encode({0})))], lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint, 14695981039346656037::hugeint)), 16, '0'))"


@query(f"select doc_id, {_FNV.format('title')} as hash from (select doc_id, left(split_part(text, chr(10), 1), 100) as title from documents) where title <> ''")
def content_hash(spark, sf_dir):
    """Of titles only, where there is one, as its SQL says; record_hash covers whole records."""
    return t.memories(spark, sf_dir).where("title != ''").select("doc_id", fx.fnv1a64_hex("title").alias("hash"))


@query()
def record_hash(spark, sf_dir):
    """Of title, tags and the whole body of every document, as the index has it. Too slow in SQL; the tests hold it against plain FNV-1a."""
    return t.memories(spark, sf_dir).select("doc_id", fx.fnv1a64_hex(hashed_text()).alias("hash"))


_TITLE = "coalesce(task, 'agent session')"
_CAPTURED = rf"""select id, title from (select path, title, 'session-summary-' || {_SLUG} || '-' || left({_FNV.format("('codex:' || session_id)")}, 8) as id from (select *, regexp_replace(left(regexp_replace(regexp_replace(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-', ''), 40), '-+$', '') as s
 from (select *, {_REDACTED.replace("text", _TITLE)} as title from rolled))) where path::bigint % 3 <> 0"""


@query(q.query(_CAPTURED, _ROLLED))
def insert_if_absent(spark, sf_dir):
    """Sessions captured where every third is there already."""
    got = tr.sessions(_transcripts(spark, sf_dir), format="codex")
    there = cp.summaries(got.where(F.col("path").cast("long") % 3 == 0)).select("id")
    return cp.captured(got, there).where("mtype = 'session-summary'").select("id", "title")


_SAID = _cases({0: "concat('- We decided ', text)", 1: "concat('2. You must never skip', chr(10), text)", 2: "concat('## ', left(text, 40), ' instead of ', left(text, 30))", 3: "text", 4: "concat('> Always', chr(10), 'make sure that  the checks run')"}, "turn")
_CUED = lambda cues: "(" + " or ".join(f"contains(low, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"
_LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""select path, pos, mtype, line from (select path, line, mtype, row_number() over (partition by path order by turn, n) as pos from
 (select path, key, arg_min(line, turn * 100000 + n) as line, arg_min(mtype, turn * 100000 + n) as mtype, arg_min(turn, turn * 100000 + n) as turn, arg_min(n, turn * 100000 + n) as n from
 (select *, case when fits and {_CUED(tx.DECISION_CUES)} then 'decision' when fits and {_CUED(tx.RULE_CUES)} then 'rule' end as mtype, {_LOW("trim(regexp_replace(line, '[ \t\n\f\r]+', ' ', 'g'))")} as key from
 (select *, ' ' || {_LOW("line")} || ' ' as low, len(line) between 20 and 200 and len(regexp_extract_all(line, '\S+')) >= 4 and not regexp_matches(' ' || {_LOW("line")}, '^\s*memory') as fits from
 (select path, turn, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^[#>\-*+]+', ''), '^\s+', ''), '^[0-9]+[.)]\s*', '') as line from
 (select path, turn, unnest(string_split(x, chr(10))) as l, generate_subscripts(string_split(x, chr(10)), 1) as n from (select conv_id::varchar as path, turn, {_SAID} as x from conversations))))) where mtype is not null group by path, key)) where pos <= 12""")
def distill_candidates(spark, sf_dir):
    """Of a log for each conversation, with decisions and rules said in most turns."""
    said = t.read(spark, sf_dir, "conversations").withColumn("text", F.expr(_SAID))
    return cp.distilled(_logs(said))


@query(r"select conv_id::varchar as path, count(*) as n from conversations where regexp_matches(text, '\S') group by conv_id")
def json_extract_text(spark, sf_dir):
    """Prose blocks found in each conversation's log."""
    return _transcripts(spark, sf_dir).select("path", F.explode(tx.prose_blocks(F.col("text"))).alias("b")).where(F.col("b").rlike(r"\S")).groupBy("path").agg(F.count("*").alias("n"))


# lineage: events as logs of their users


def _log(events):
    """A log for each user, a record for each event."""
    d = events.select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("memory_id"), F.lit("captured").alias("event"), F.md5("props").alias("content_hash"), F.col("event_id").cast("string").alias("source"), F.lit(None).cast("string").alias("harness"), F.lit(None).cast("string").alias("core"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"))
    return pv.append_logs(d.withColumn("user_id", F.col("user_id").cast("long")), "user_id")


@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as seq from events),
b as (select *, lag(seq) over w as was, coalesce(lag(event_id % 89 = 0) over w, false) as after_wrong from e where event_id % 83 <> 0 window w as (partition by user_id order by seq)),
r as (select user_id, seq, case when seq <> coalesce(was, 0) + 1 then 'sequence gap' when event_id % 97 = 0 or after_wrong then 'prev_hash does not match' when event_id % 89 = 0 then 'entry_hash does not match' end as reason from b)
select user_id, reason, min(seq)::bigint as first_break, count(*) as breaks from r where reason is not null group by user_id, reason""")
def provenance_chain_check(spark, sf_dir):
    """Logs of which every 83rd event is missing, every 97th has a wrong prev_hash and every 89th a wrong entry_hash."""
    n = F.col("source").cast("long")
    log = _log(t.read(spark, sf_dir, "events")).where(n % 83 != 0).withColumn("prev_hash", F.when(n % 97 == 0, F.lit("bad")).otherwise(F.col("prev_hash"))).withColumn("entry_hash", F.when(n % 89 == 0, F.lit("wrong")).otherwise(F.col("entry_hash")))
    return pv.chain_breaks(log.withColumn("pos", F.col("seq")), "user_id").groupBy("user_id", "reason").agg(F.min("seq").alias("first_break"), F.count("*").alias("breaks"))


@query("select event_type as memory_id, max(event_id) as seq, md5(arg_max(props, event_id)) as content_hash from events group by event_type")
def provenance_latest(spark, sf_dir):
    return pv.latest(t.read(spark, sf_dir, "events").select(F.col("event_type").alias("memory_id"), F.col("event_id").alias("seq"), F.md5("props").alias("content_hash")))


@query("select seq, event_id::varchar as source, md5(props) as content_hash from (select *, row_number() over (partition by user_id order by event_id) as seq from events) where user_id = (select min(user_id) from events) and event_type = 'click'")
def lineage(spark, sf_dir):
    """What the first user's log has of one record."""
    events = t.read(spark, sf_dir, "events")
    own = _log(events.join(F.broadcast(events.agg(F.min("user_id").alias("user_id"))), "user_id", "left_semi"))
    return pv.lineage(own, "click").select("seq", "source", "content_hash")


@query("select state, count(*) as n from (select case when doc_id % 11 = 0 then 'deleted' when doc_id % 13 = 0 then 'new' when doc_id % 7 = 0 then 'changed' else 'fresh' end as state from documents where not (doc_id % 11 = 0 and doc_id % 13 = 0)) group by state")
def index_freshness_diff(spark, sf_dir):
    rows = t.memories(spark, sf_dir).select("id", "doc_id", F.md5("body").alias("content_hash"))
    known = rows.where("doc_id % 13 != 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return freshness(rows.where("doc_id % 11 != 0"), known).groupBy("state").agg(F.count("*").alias("n"))


@query("select id, case when ours is not distinct from base then theirs else ours end as content, ours is distinct from theirs and ours is distinct from base and theirs is distinct from base as conflict from (select doc_id as id, md5(text) as base, case when doc_id % 5 = 0 then null when doc_id % 3 = 0 then 'o' else md5(text) end as ours, case when doc_id % 7 = 0 then null when doc_id % 4 = 0 then 't' else md5(text) end as theirs from documents) where conflict or content is not null")
def snapshot_merge(spark, sf_dir):
    base = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content"))
    side = lambda a, b, s: base.where(F.col("id") % a != 0).withColumn("content", F.when(F.col("id") % b == 0, s).otherwise(F.col("content")))
    good, bad = lifecycle.merged(base, side(5, 3, "o"), side(7, 4, "t"))
    return good.select("id", "content", F.lit(False).alias("conflict")).unionByName(bad.select("id", F.col("ours").alias("content"), F.lit(True).alias("conflict")))


@query("select doc_id as id, text as content from documents")
def sealed_round_trip(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return lifecycle.decrypted(lifecycle.encrypted(rows, "00" * 16), "00" * 16).select(F.col("id").cast("long").alias("id"), "content")


@query("select event_id, epoch_us(ts) // 1000000 as seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as text, epoch_us(ts) // 1000000 as back from events")
def rfc3339_parse_format(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds")).withColumn("text", fx.format_rfc3339("seconds"))
    return rows.withColumn("back", fx.parse_rfc3339("text"))


@query(r"select page_id, false as conflicted from pages union all select * from (values (-1, true), (-2, false)) x(page_id, conflicted)")
def conflict_files(spark, sf_dir):
    rows = t.read(spark, sf_dir, "pages").select("page_id", "html").unionByName(_literal(spark, [(-1, "a\n<<<<<<< x\n>>>>>>> y"), (-2, "<<<<<<< x")], "page_id long, html string"))
    return rows.select("page_id", tx.is_conflicted(F.col("html")).alias("conflicted"))
