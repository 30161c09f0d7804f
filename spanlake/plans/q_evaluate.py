"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import sql_squad_normalize
from spanlake.operators import evaluate as E
from spanlake.operators.common import r6
from spanlake.operators.observed import evaluate_on_write as evaluate_and_write
from spanlake.plans.registry import register
from spanlake.plans.sqlparts import QA
from spanlake.session import scratch_path
from spanlake.sources import fixtures as FX

_TOKS = "list_filter(string_split({x}, ' '), lambda t: t <> '')"

PREDICTIONS = f"""{QA},
pr as (select id, id % 13 = 4 as missing, case when answer_start is null then ''
                  else substr(context, greatest(answer_start + (id % 7) - 3, 0) + 1, 24) end as prediction_text,
              coalesce(answer_text, '') as gold from qa)"""

# From predictions ``pr(id, missing, prediction_text, gold)`` to scores ``sc2``.
SCORES = f"""nz as (select id, missing, {sql_squad_normalize('prediction_text')} as pn, {sql_squad_normalize('gold')} as gn from pr),
ptc as (select id, tok, count(*) as c from (select id, unnest({_TOKS.format(x='pn')}) as tok from nz) group by id, tok),
gtc as (select id, tok, count(*) as c from (select id, unnest({_TOKS.format(x='gn')}) as tok from nz) group by id, tok),
ovl as (select ptc.id, sum(least(ptc.c, gtc.c)) as overlap from ptc join gtc using (id, tok) group by ptc.id),
sc as (select nz.id, missing, (pn = gn)::double as exact_match, coalesce(ovl.overlap, 0) as overlap,
              len({_TOKS.format(x='pn')}) as np, len({_TOKS.format(x='gn')}) as ng
       from nz left join ovl using (id)),
sc2 as (select id, missing, case when missing then 0.0::double else exact_match end as exact_match,
        case when missing or overlap = 0 then 0.0::double
        else 2.0 * (overlap / np) * (overlap / ng) / ((overlap / np) + (overlap / ng)) end as f1 from sc)"""
SCORE_CTES = f"{PREDICTIONS},\n{SCORES}"


def _scores(spark, sf):
    return E.score_rows(FX.shifted_predictions(spark, sf), FX.qa_examples(spark, sf))


@register("exact_match", f"with {SCORE_CTES} select id::bigint as id, exact_match from sc2")
def exact_match(spark, sf):
    return _scores(spark, sf).select(F.col("id").cast("bigint").alias("id"), "exact_match")


@register("token_f1", f"with {SCORE_CTES} select id::bigint as id, round(f1, 6) as f1 from sc2")
def token_f1(spark, sf):
    return _scores(spark, sf).select(F.col("id").cast("bigint").alias("id"), r6("f1").alias("f1"))


EVAL_ALL_SQL = f"""
with {SCORE_CTES}
select round(avg(exact_match) * 100, 6) as eval_exact_match, round(avg(f1) * 100, 6) as eval_f1,
       count(*)::bigint as eval_samples, count(*) filter (missing)::bigint as eval_missing from sc2
"""


@register("evaluate_all", EVAL_ALL_SQL)
def evaluate_all(spark, sf):
    m = E.evaluate(FX.shifted_predictions(spark, sf), FX.qa_examples(spark, sf))
    return m.select(r6("eval_exact_match").alias("eval_exact_match"), r6("eval_f1").alias("eval_f1"),
                    "eval_samples", "eval_missing")


@register("evaluate_on_write", EVAL_ALL_SQL)
def evaluate_on_write(spark, sf):
    """E3 observed while every reference's scores are written."""
    path = scratch_path(spark, "scores")
    m = evaluate_and_write(FX.shifted_predictions(spark, sf), FX.qa_examples(spark, sf), path)[1]
    return m.select(r6("eval_exact_match").alias("eval_exact_match"), r6("eval_f1").alias("eval_f1"),
                    "eval_samples", "eval_missing")


BEST_STEP_SQL = """
with l as (select event_type as run, event_id * 100 as step, value as metric from events where event_id % 97 <> 0)
select run, step::bigint as best_step, metric as best_metric from
  (select *, row_number() over (partition by run order by metric desc, step) as k from l) where k = 1
"""


@register("best_step", BEST_STEP_SQL)
def best_step(spark, sf):
    b = E.best_step(FX.eval_log(spark, sf))
    return b.select("run", F.col("best_step").cast("bigint").alias("best_step"), "best_metric")


KEEP_SQL = """
with l as (select event_type as run, event_id * 100 as step, value as metric from events)
select run, step::bigint as step, k::bigint as recency from
  (select *, row_number() over (partition by run order by step desc) as k from l) where k <= 5
"""


@register("keep_last_n", KEEP_SQL)
def keep_last_n(spark, sf):
    k = E.keep_last(FX.eval_log(spark, sf), 5)
    return k.select("run", F.col("step").cast("bigint").alias("step"), F.col("recency").cast("bigint").alias("recency"))
