"""Span-decoding queries (D1-D10) over embeddings (logits) and documents (contexts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import decode as D
from spanlake.operators.common import explode_rows, r6
from spanlake.plans.registry import register
from spanlake.sources import fixtures as FX

N = D.N_BEST
L = D.MAX_ANSWER_LENGTH
Q = FX.QUESTION_POSITIONS
P = FX.FEATURES_PER_EXAMPLE


# ----------------------------------------------------------------------------- oracle CTEs
def _feat_sql(variant: str = "se") -> str:
    s, e = {"se": ("embedding", "list_reverse(embedding)"), "es": ("list_reverse(embedding)", "embedding"),
            "ee": ("embedding", "embedding")}[variant]
    return f"""fx as (select doc_id as ex, j as blk, doc_id * {P} + j as fid from documents, range({P}) t(j)),
f as (select fid, ex, blk, {s} as s, {e} as e, len(embedding) as n
      from fx join embeddings on vec_id = fid % (select count(*) from embeddings)),
a as (select ex, fid, blk, n, unnest(s)::double as sl, generate_subscripts(s, 1) - 1 as si from f),
b as (select fid, unnest(e)::double as el, generate_subscripts(e, 1) - 1 as ei from f),
ar as (select * from (select *, row_number() over (partition by fid order by sl desc, si desc) - 1 as sr from a)
       where sr < {N}),
br as (select * from (select *, row_number() over (partition by fid order by el desc, ei desc) - 1 as er from b)
       where er < {N})"""


def _cand_sql(maxctx: bool = True) -> str:
    mc = "and (fid % 2 = 0 or si % 3 <> 0)" if maxctx else ""
    return f"""c as (select ar.ex, ar.fid, sr, er, si, ei, sl, el, sl + el as score,
                 si * 4 + 8 * blk as cs, ei * 4 + 8 * blk + 3 as ce, false as is_null
          from ar join br using (fid)
          where si >= {Q} and ei >= {Q} and si < n and ei < n and ei >= si and ei - si + 1 <= {L} {mc})"""


def _null_sql(variant: str = "se") -> str:
    return f"""z0 as (select ex, fid, s[1]::double as s0, e[1]::double as e0 from f),
z as (select ex, fid, s0 + e0 as score, s0, e0 from
      (select *, row_number() over (partition by ex order by s0 + e0, fid) as k from z0) where k = 1)"""


def _ranked_sql(null_mode: bool) -> str:
    if not null_mode:
        return f"""r as (select * from (select *, row_number() over (partition by ex order by score desc, fid, sr, er) as rk
                 from c) where rk <= {N})"""
    return f"""cz as (select ex, fid, sr, er, si, ei, sl, el, score, cs, ce, is_null from c
      union all select ex, fid, null, null, 0, 0, s0, e0, score, 0, 0, true from z),
r as (select * exclude (rk0), least(rk0, {N + 1}) as rk from
      (select *, row_number() over (partition by ex order by score desc, is_null, fid, sr, er) as rk0 from cz)
      where rk0 <= {N} or is_null)"""


def _final_sql(variant: str = "se", null_mode: bool = False) -> str:
    """CTE chain ending in ``fin(id, rank, text, sl, el, score, is_null, probability)``."""
    nz = _null_sql(variant) + "," if null_mode else ""
    return f"""{_feat_sql(variant)}, {_cand_sql(True)}, {nz} {_ranked_sql(null_mode)},
r2 as (select r.*, substr(d.text, cs + 1, greatest(ce - cs, 0)) as txt from r join documents d on d.doc_id = r.ex),
ag as (select d.doc_id as id, count(r2.ex) as cnt, max(r2.txt) as any_txt
       from documents d left join r2 on r2.ex = d.doc_id group by d.doc_id),
fb as (select id, 0 as rk, 'empty' as txt, 0.0::double as sl, 0.0::double as el, 0.0::double as score,
              false as is_null from ag where cnt = 0 or (cnt = 1 and any_txt = '')),
allp as (select ex as id, rk, txt, sl, el, score, is_null from r2 union all select * from fb),
w as (select *, row_number() over (partition by id order by rk) as rank,
             exp(score - max(score) over (partition by id)) as x from allp),
fin as (select id, rank, txt as text, sl, el, score, is_null, x / sum(x) over (partition by id) as probability from w)"""


# ----------------------------------------------------------------------------- queries
def _features(spark, sf, variant="se"):
    return FX.eval_features(spark, sf, variant)


TOP_LOGITS_SQL = f"""
with {_feat_sql()}
select fid::bigint as feature_id, 'start' as side, sr::bigint as rank, si::bigint as idx, sl as logit from ar
union all
select fid::bigint, 'end', er::bigint, ei::bigint, el from br
"""


@register("top_logits", TOP_LOGITS_SQL)
def top_logits(spark, sf):
    f = _features(spark, sf)
    out = None
    for side, col in (("start", "start_logits"), ("end", "end_logits")):
        t = explode_rows(f, D.top_indexes(F.col(col), N), ["feature_id"], "t").select(
            F.col("feature_id").cast("bigint").alias("feature_id"), F.lit(side).alias("side"),
            F.col("t.rank").cast("bigint").alias("rank"), F.col("t.idx").cast("bigint").alias("idx"),
            F.col("t.logit").alias("logit"))
        out = t if out is None else out.unionByName(t)
    return out


def _cand_cols(c):
    return c.select(F.col("feature_id").cast("bigint").alias("feature_id"),
                    F.col("start_idx").cast("bigint").alias("start_idx"),
                    F.col("end_idx").cast("bigint").alias("end_idx"), "score")


SPAN_CANDS_SQL = f"""
with {_feat_sql()}, {_cand_sql(False)}
select fid::bigint as feature_id, si::bigint as start_idx, ei::bigint as end_idx, score from c
"""


@register("span_candidates", SPAN_CANDS_SQL)
def span_candidates(spark, sf):
    c = D.feature_candidates(_features(spark, sf), N, L, use_max_context=False, per_feature_cut=False)
    return _cand_cols(c)


MAXCTX_SQL = f"""
with {_feat_sql()}, {_cand_sql(True)}
select fid::bigint as feature_id, si::bigint as start_idx, ei::bigint as end_idx, score from c
"""


@register("max_context_filter", MAXCTX_SQL)
def max_context_filter(spark, sf):
    c = D.feature_candidates(_features(spark, sf), N, L, use_max_context=True, per_feature_cut=False)
    return _cand_cols(c)


NULL_SCORES_SQL = f"""
with {_feat_sql()}, {_null_sql()}
select ex::bigint as example_id, score as null_score, fid::bigint as null_feature_id from z
"""


@register("null_scores", NULL_SCORES_SQL)
def null_scores(spark, sf):
    z = D.null_scores(_features(spark, sf))
    return z.select(F.col("example_id").cast("bigint").alias("example_id"), "null_score",
                    F.col("null_feature_id").cast("bigint").alias("null_feature_id"))


NBEST_SQL = f"""
with {_feat_sql()}, {_cand_sql(True)}, {_ranked_sql(False)}
select ex::bigint as id, rk::bigint as rank, fid::bigint as feature_id, si::bigint as start_idx,
       ei::bigint as end_idx, score from r
"""


@register("nbest", NBEST_SQL)
def nbest(spark, sf):
    f = _features(spark, sf)
    t = D.example_topn(D.feature_candidates(f, N, L), N)
    return t.select(F.col("example_id").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                    F.col("feature_id").cast("bigint").alias("feature_id"),
                    F.col("start_idx").cast("bigint").alias("start_idx"),
                    F.col("end_idx").cast("bigint").alias("end_idx"), "score")


NBEST_NULL_SQL = f"""
with {_feat_sql()}, {_cand_sql(True)}, {_null_sql()}, {_ranked_sql(True)}
select ex::bigint as id, rk::bigint as rank, fid::bigint as feature_id, si::bigint as start_idx,
       ei::bigint as end_idx, score, is_null from r
"""


@register("nbest_null", NBEST_NULL_SQL)
def nbest_null(spark, sf):
    f = _features(spark, sf)
    t = D.example_topn(D.feature_candidates(f, N, L), N, D.null_scores(f))
    return t.select(F.col("example_id").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                    F.col("feature_id").cast("bigint").alias("feature_id"),
                    F.col("start_idx").cast("bigint").alias("start_idx"),
                    F.col("end_idx").cast("bigint").alias("end_idx"), "score", "is_null")


def _decoded(spark, sf, null_mode=False, variant="se"):
    return D.decode(FX.decode_examples(spark, sf), _features(spark, sf, variant), N, L, null_mode=null_mode)


FALLBACK_SQL = f"""
with {_final_sql()}
select id::bigint as id, bool_or(text = 'empty' and rank = 1 and sl = 0 and el = 0 and score = 0
       and not is_null) as fallback, count(*)::bigint as n_preds from fin group by id
"""


@register("empty_fallback", FALLBACK_SQL)
def empty_fallback(spark, sf):
    d = _decoded(spark, sf)
    head = F.get("preds", 0)
    fb = ((head["text"] == "empty") & (head["start_logit"] == 0) & (head["end_logit"] == 0)
          & (head["score"] == 0) & ~head["is_null"])
    return d.select(F.col("id").cast("bigint").alias("id"), fb.alias("fallback"),
                    F.size("preds").cast("bigint").alias("n_preds"))


PROB_SQL = f"""
with {_final_sql()}
select id::bigint as id, rank::bigint as rank, text, sl as start_logit, el as end_logit,
       round(probability, 6) as probability from fin
"""


@register("nbest_probability", PROB_SQL)
def nbest_probability(spark, sf):
    rows = D.nbest_rows(_decoded(spark, sf))
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                       "text", "start_logit", "end_logit", r6("probability").alias("probability"))


FINAL_SQL = f"""
with {_final_sql()}
select id::bigint as id, text as prediction_text from fin where rank = 1
"""


@register("final_answer", FINAL_SQL)
def final_answer(spark, sf):
    a = D.final_answers(_decoded(spark, sf))
    return a.select(F.col("id").cast("bigint").alias("id"), "prediction_text")


_NULL_FINAL = f"""
with {_final_sql(null_mode=True)},
nn as (select * from (select *, row_number() over (partition by id order by rank) as k from fin where text <> '')
       where k = 1),
zz as (select ex as id, score as null_score from z),
o as (select d.doc_id as id, zz.null_score - nn.sl - nn.el as score_diff, nn.text as best, zz.null_score
      from documents d left join nn on nn.id = d.doc_id left join zz on zz.id = d.doc_id)
"""

FINAL_NULL_SQL = _NULL_FINAL + """
select id::bigint as id, case when best is null or null_score is null then '' when score_diff > 0.0 then ''
       else best end as prediction_text from o
"""


@register("final_answer_null", FINAL_NULL_SQL)
def final_answer_null(spark, sf):
    a = D.final_answers(_decoded(spark, sf, null_mode=True), null_mode=True, threshold=0.0)
    return a.select(F.col("id").cast("bigint").alias("id"), "prediction_text")


NULL_ODDS_SQL = _NULL_FINAL + """
select id::bigint as id, round(score_diff, 6) as score_diff from o
"""


@register("null_odds", NULL_ODDS_SQL)
def null_odds(spark, sf):
    a = D.final_answers(_decoded(spark, sf, null_mode=True), null_mode=True, threshold=0.0)
    return a.select(F.col("id").cast("bigint").alias("id"), r6("score_diff").alias("score_diff"))


# ----------------------------------------------------------------------------- D1
ATTACH_SQL = f"""
with {_feat_sql()}
select fid::bigint as feature_id, ex::bigint as example_id, n::bigint as n_logits,
       round(list_sum(list_transform(s, lambda x: x::double)), 6) as start_sum,
       round(list_sum(list_transform(e, lambda x: x::double)), 6) as end_sum from f
"""


@register("attach_logits", ATTACH_SQL)
def attach_logits(spark, sf):
    f = _features(spark, sf)
    logits = f.select("feature_id", "start_logits", "end_logits")
    joined = D.attach_logits(f.drop("start_logits", "end_logits"), logits)

    def total(c):
        return r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")))
    return joined.select("feature_id", F.col("example_id").cast("bigint").alias("example_id"),
                         F.size("start_logits").cast("bigint").alias("n_logits"),
                         total("start_logits").alias("start_sum"), total("end_logits").alias("end_sum"))
