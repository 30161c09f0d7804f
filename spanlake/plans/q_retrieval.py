"""Retrieval queries (R1-R8, T4-T6) over documents, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import WS, sanitize_query, sql_str, title_prefix
from spanlake.operators import retrieval as R
from spanlake.operators.dictionary import DictionaryAnalyzer
from spanlake.operators.index_store import IndexStore
from spanlake.plans.registry import register
from spanlake.plans.sqlparts import DICTIONARY, PASSAGES, QUESTIONS, TITLE, bm25_ctes, dictionary_ctes, words_sql
from spanlake.session import scratch_path, written
from spanlake.sources import fixtures as FX

K = 10


def _passages(spark, sf):
    return R.passage_corpus(FX.corpus(spark, sf))


def _ranked(t):
    return t.select(F.col("qid").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                    F.col("doc_id").cast("bigint").alias("doc_id"), "score")


# ---------------------------------------------------------------- bm25_topk (R3+R5)
BM25_TOPK_SQL = f"""
with {PASSAGES}, {QUESTIONS}, {bm25_ctes('passages', 'text', 'questions')},
r as (select id, row_number() over (partition by id order by score desc, doc_id) as rank, doc_id, score from s)
select id::bigint as id, rank::bigint as rank, doc_id::bigint as doc_id, score from r where rank <= {K}
"""


@register("bm25_topk", BM25_TOPK_SQL)
def bm25_topk(spark, sf):
    return _ranked(R.search(_passages(spark, sf), FX.questions(spark, sf), K))


@register("bm25_saved_index", BM25_TOPK_SQL)
def bm25_saved_index(spark, sf):
    """The same top-10 from an index that was stored and read back."""
    store = IndexStore(spark, scratch_path(spark, "index")).create(_passages(spark, sf))
    return _ranked(R.top_k(R.bm25(store.index(), FX.questions(spark, sf)), K))


@register("index_upsert", BM25_TOPK_SQL)
def index_upsert(spark, sf):
    """The same top-10 from a stored index of earlier documents: of two languages only
    titles were known, and of each document of a third there was a copy under another
    id. They are replaced and removed, before and after a compaction."""
    passages = _passages(spark, sf)
    lang = F.coalesce("lang", F.lit(""))
    late, last = passages.where(lang.isin("de", "fr")), passages.where(lang == "fr")
    known = passages.withColumn("text", F.when(lang.isin("de", "fr"), F.col("title")).otherwise(F.col("text")))
    copies = passages.where(lang == "es").withColumn("doc_id", -F.col("doc_id") - 1)
    store = IndexStore(spark, scratch_path(spark, "index")).create(known.unionByName(copies))
    store.upsert(late.withColumn("text", F.when(lang == "fr", F.lit("not yet")).otherwise(F.col("text"))))
    store.compact().delete(copies).upsert(last)
    return _ranked(R.top_k(R.bm25(store.index(), FX.questions(spark, sf)), K))


# ---------------------------------------------------------------- bm25_multifield
MULTI_SQL = f"""
with {PASSAGES}, {QUESTIONS}, {bm25_ctes('passages', 'text', 'questions', 't_')},
{bm25_ctes('passages', 'title', 'questions', 'h_')},
s as (select id, doc_id, max(score) as score from (select * from t_s union all select * from h_s) group by 1, 2),
r as (select id, row_number() over (partition by id order by score desc, doc_id) as rank, doc_id, score from s)
select id::bigint as id, rank::bigint as rank, doc_id::bigint as doc_id, score from r where rank <= {K}
"""


@register("bm25_multifield", MULTI_SQL)
def bm25_multifield(spark, sf):
    return _ranked(R.search(_passages(spark, sf), FX.questions(spark, sf), K, ["text", "title"]))


# ---------------------------------------------------------------- hits_wide
_wide_cols = ", ".join([f"max(case when rank = {j} then text end) as text{j}" for j in range(1, K + 1)]
                       + [f"max(case when rank = {j} then score end) as score{j}" for j in range(1, K + 1)])
HITS_WIDE_SQL = f"""
with {PASSAGES}, {QUESTIONS}, {bm25_ctes('passages', 'text', 'questions')},
r as (select id, row_number() over (partition by id order by score desc, doc_id) as rank, doc_id, score from s),
h as (select r.id, r.rank, r.score, p.text from r join passages p using (doc_id) where r.rank <= {K})
select id::bigint as id, {_wide_cols} from h group by id
"""


@register("hits_wide", HITS_WIDE_SQL)
def hits_wide(spark, sf):
    p = _passages(spark, sf)
    hits = R.search(p, FX.questions(spark, sf), K)
    return R.hits_wide(R.attach_text(hits, p), K).withColumn("id", F.col("id").cast("bigint"))


# ---------------------------------------------------------------- retrieved_context (R7+R8)
CONTEXT_SQL = f"""
with {PASSAGES}, {QUESTIONS}, {bm25_ctes('passages', 'text', 'questions')},
r as (select id, row_number() over (partition by id order by score desc, doc_id) as rank, doc_id, score from s),
c as (select r.id, string_agg(p.text, '' order by r.rank) as context
      from r join passages p using (doc_id) where r.rank <= {K} group by r.id)
select q.id::bigint as id, q.question, coalesce(c.context, '') as context
from questions q left join c using (id)
"""


@register("retrieved_context", CONTEXT_SQL)
def retrieved_context(spark, sf):
    out = R.retrieve_contexts(FX.corpus(spark, sf), FX.questions(spark, sf), K)
    return out.withColumn("id", F.col("id").cast("bigint"))


# ---------------------------------------------------------------- index_postings
POSTINGS_SQL = f"""
with {PASSAGES},
tok as (select doc_id, unnest({words_sql('text')}) as term from passages),
tf as (select doc_id, term, count(*) as tf from tok group by 1, 2)
select doc_id::bigint as doc_id, term, tf::bigint as tf, (sum(tf) over (partition by doc_id))::bigint as dl from tf
"""


@register("index_postings", POSTINGS_SQL)
def index_postings(spark, sf):
    idx = R.build_index(_passages(spark, sf), materialize=False)  # used once
    return idx.postings.select(F.col("doc_id").cast("bigint").alias("doc_id"), "term",
                               F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"))


INDEX_STATS_SQL = f"""
with {PASSAGES},
tok as (select doc_id, unnest({words_sql('text')}) as term from passages),
tf as (select doc_id, term, count(*) as tf from tok group by 1, 2),
dl as (select doc_id, sum(tf) as dl from tf group by 1)
select (select count(*) from dl)::bigint as n_docs, round((select avg(dl) from dl), 6) as avgdl,
       (select count(distinct term) from tf)::bigint as n_terms, (select count(*) from tf)::bigint as n_postings
"""


@register("index_doc_stats", INDEX_STATS_SQL)
def index_doc_stats(spark, sf):
    idx = R.build_index(_passages(spark, sf))
    stats = idx.doc_stats.agg(F.count("*").cast("bigint").alias("n_docs"),
                              F.round(F.avg("dl"), 6).alias("avgdl"))
    terms = idx.postings.agg(F.countDistinct("term").cast("bigint").alias("n_terms"),
                             F.count("*").cast("bigint").alias("n_postings"))
    # Both sides are single-row aggregates: attach with scalar subqueries.
    out = written(stats.select("n_docs", "avgdl",
                               terms.select("n_terms").scalar().alias("n_terms"),
                               terms.select("n_postings").scalar().alias("n_postings")), "index-stats")
    idx.release()
    return out


# ---------------------------------------------------------------- stopword_filter (R2)
STOP_SQL = f"""
with {PASSAGES},
tok as (select doc_id, unnest({words_sql('text')}) as term from passages),
tf0 as (select doc_id, term, count(*) as tf from tok group by 1, 2),
n as (select count(distinct doc_id) as n from tf0),
stop as (select term from tf0 group by term having count(*) > 0.5::double * (select n from n)),
tf as (select * from tf0 where term not in (select term from stop))
select doc_id::bigint as doc_id, term, tf::bigint as tf, (sum(tf) over (partition by doc_id))::bigint as dl from tf
"""


@register("stopword_filter", STOP_SQL)
def stopword_filter(spark, sf):
    full = R.build_index(_passages(spark, sf))
    idx = R.without_terms(full, R.frequent_terms(full, 0.5))
    out = written(idx.postings.select(F.col("doc_id").cast("bigint").alias("doc_id"), "term",
                                      F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl")), "postings")
    full.release()
    return out


# ---------------------------------------------------------------- stopword_context (R2+R8)
STOP_CONTEXT_SQL = f"""
with {PASSAGES}, {QUESTIONS},
tok0 as (select doc_id, unnest({words_sql('text')}) as term from passages),
n0 as (select count(distinct doc_id) as n from tok0),
stop as (select term from (select distinct doc_id, term from tok0) group by term
         having count(*) > 0.5::double * (select n from n0)),
tok as (select * from tok0 where term not in (select term from stop)),
tf{bm25_ctes('passages', 'text', 'questions').partition('tf')[2]},
r as (select id, row_number() over (partition by id order by score desc, doc_id) as rank, doc_id, score from s),
c as (select r.id, string_agg(p.text, '' order by r.rank) as context
      from r join passages p using (doc_id) where r.rank <= {K} group by r.id)
select q.id::bigint as id, q.question, coalesce(c.context, '') as context
from questions q left join c using (id)
"""


@register("stopword_context", STOP_CONTEXT_SQL)
def stopword_context(spark, sf):
    """Retrieved contexts with a stop-word table as the analyzer's input."""
    corpus, questions = FX.corpus(spark, sf), FX.questions(spark, sf)
    full = R.build_index(R.passage_corpus(corpus))
    stop = written(R.frequent_terms(full, 0.5), "stop-words")
    full.release()
    out = R.retrieve_contexts(corpus, questions, K, stop)
    return out.withColumn("id", F.col("id").cast("bigint"))


# ---------------------------------------------------------------- dictionary_tokens (R2)
DICTIONARY_SQL = f"""
with t as (select regexp_extract(html, {sql_str('(?s)<title>(.*?)</title>')}, 1) as title from pages),
w as (select trim(unnest(regexp_split_to_array(regexp_replace(title, '[()]', '', 'g'), {sql_str(WS + '+')}))) as term from t),
dict as (select distinct lower(term) as term from w where term <> ''),
p as (select doc_id, unnest(regexp_split_to_array(lower(text), {sql_str(WS + '+')})) as piece from documents),
b as (select doc_id, piece, regexp_replace(piece, '[.,;:!?]+$', '') as bare from p where piece <> ''),
f as (select b.*, d1.term is not null as whole, d2.term is not null as core
      from b left join dict d1 on d1.term = piece left join dict d2 on d2.term = bare),
o as (select doc_id, piece as term, true as whole from f where whole
      union all select doc_id, bare, true from f where not whole and core
      union all select doc_id, unnest({words_sql('piece')}), false from f where not whole and not core)
select doc_id::bigint as doc_id, term, whole, count(*)::bigint as n from o group by all
"""


@register("dictionary_tokens", DICTIONARY_SQL)
def dictionary_tokens(spark, sf):
    dictionary = R.title_dictionary(FX.page_titles(spark, sf))
    t = R.dictionary_tokens(FX.corpus(spark, sf), dictionary)
    return t.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "term", "whole").agg(
        F.count("*").cast("bigint").alias("n"))


# ---------------------------------------------------------------- index_dictionary, dictionary_context (R2)
def _dictionary(spark, sf):
    """T5 terms of the pages' titles, and the corpus titles whole."""
    pieces = R.title_dictionary(FX.page_titles(spark, sf))
    return pieces.unionByName(R.phrase_dictionary(FX.corpus(spark, sf)))


INDEX_DICT_SQL = f"""
with recursive {PASSAGES}, {DICTIONARY}, {dictionary_ctes('p', 'passages', 'doc_id', 'text')},
tf as (select doc_id, term, count(*) as tf from pdtok group by 1, 2)
select doc_id::bigint as doc_id, term, tf::bigint as tf, (sum(tf) over (partition by doc_id))::bigint as dl from tf
"""


@register("index_dictionary", INDEX_DICT_SQL)
def index_dictionary(spark, sf):
    """Postings of an index whose analyzer keeps dictionary terms whole."""
    idx = R.build_index(_passages(spark, sf), materialize=False, analyzer=DictionaryAnalyzer(_dictionary(spark, sf)))
    return idx.postings.select(F.col("doc_id").cast("bigint").alias("doc_id"), "term",
                               F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"))


DICT_CONTEXT_SQL = f"""
with recursive {PASSAGES}, {QUESTIONS}, {DICTIONARY}, {dictionary_ctes('p', 'passages', 'doc_id', 'text')},
{dictionary_ctes('q', 'questions', 'id', 'question')},
{bm25_ctes('passages', 'text', 'questions', 'b_', 'pdtok', 'qdtok')},
top as (select id, row_number() over (partition by id order by score desc, doc_id) as rank, doc_id, score from b_s),
ctx as (select top.id, string_agg(p.text, '' order by top.rank) as context
        from top join passages p using (doc_id) where top.rank <= {K} group by top.id)
select q.id::bigint as id, q.question, coalesce(ctx.context, '') as context
from questions q left join ctx using (id)
"""


@register("dictionary_context", DICT_CONTEXT_SQL)
def dictionary_context(spark, sf):
    """Retrieved contexts with the dictionary in the analyzer of passages and questions."""
    analyzer = DictionaryAnalyzer(_dictionary(spark, sf))
    out = R.retrieve_contexts(FX.corpus(spark, sf), FX.questions(spark, sf), K, analyzer=analyzer)
    return out.withColumn("id", F.col("id").cast("bigint"))


# ---------------------------------------------------------------- T4 / T5 / T6
TITLE_PREFIX_SQL = f"select doc_id::bigint as doc_id, '!!' || {TITLE} || '!!' || text as text from documents"


@register("title_prefix", TITLE_PREFIX_SQL)
def title_prefix_q(spark, sf):
    c = FX.corpus(spark, sf)
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"), title_prefix("title", "text").alias("text"))


TITLE_DICT_SQL = f"""
with t as (select regexp_extract(html, {sql_str('(?s)<title>(.*?)</title>')}, 1) as title from pages),
w as (select trim(unnest(regexp_split_to_array(regexp_replace(title, '[()]', '', 'g'), {sql_str(WS + '+')}))) as term from t)
select distinct term from w where term <> ''
"""


@register("title_dictionary", TITLE_DICT_SQL)
def title_dictionary_q(spark, sf):
    return R.title_dictionary(FX.page_titles(spark, sf))


SANITIZE_SQL = "select item_id::bigint as id, replace(text, '~', '-') as question from benchmark"


@register("query_sanitize", SANITIZE_SQL)
def query_sanitize(spark, sf):
    q = FX.questions(spark, sf)
    return q.select(F.col("id").cast("bigint").alias("id"), sanitize_query("question").alias("question"))
