"""Ensemble queries (V1-V4): three decoders' n-best lists from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import decode as D
from spanlake.operators import ensemble as V
from spanlake.operators.common import r6
from spanlake.plans.q_decode import _final_sql
from spanlake.plans.registry import register
from spanlake.sources import fixtures as FX

VARIANTS = ("se", "es", "ee")  # model 0, 1, 2


def _stacked(spark, sf):
    """The three decoders in one plan (one context join for all models)."""
    ex = FX.decode_examples(spark, sf)
    feats = None
    for i, v in enumerate(VARIANTS):
        f = FX.eval_features(spark, sf, v).withColumn("model", F.lit(i))
        feats = f if feats is None else feats.unionByName(f)
    rows = D.nbest_rows(D.decode(ex, feats, models=list(range(len(VARIANTS)))))
    return rows.select("id", "model", "rank", "text", r6("probability").alias("probability"))


def _top1_sql() -> str:
    parts = []
    for i, v in enumerate(VARIANTS):
        parts.append(f"m{i} as (with {_final_sql(v)} select {i} as model, id, text, round(probability, 6) as p "
                     f"from fin where rank = 1)")
    return ",\n".join(parts) + ",\nt as (select * from m0 union all select * from m1 union all select * from m2)"


MAXP_SQL = f"""
with {_top1_sql()}
select id::bigint as id, text as prediction_text from
  (select *, row_number() over (partition by id order by p desc, text) as k from t) where k = 1
"""


@register("ensemble_max_prob", MAXP_SQL)
def ensemble_max_prob(spark, sf):
    return V.vote(_stacked(spark, sf), "max_prob", len(VARIANTS)).select(F.col("id").cast("bigint").alias("id"), "prediction_text")


MAJ_SQL = f"""
with {_top1_sql()},
c as (select id, text, count(*) as n, max(p) as mp from t group by id, text)
select id::bigint as id, text as prediction_text from
  (select *, row_number() over (partition by id order by n desc, mp desc, text) as k from c) where k = 1
"""


@register("ensemble_majority", MAJ_SQL)
def ensemble_majority(spark, sf):
    return V.vote(_stacked(spark, sf), "majority", len(VARIANTS)).select(F.col("id").cast("bigint").alias("id"), "prediction_text")


FIRST_SQL = f"""
with {_top1_sql()},
d as (select id, count(distinct text) as nd, count(*) as nv from t group by id),
mp as (select id, text from (select *, row_number() over (partition by id order by p desc, text) as k from t)
       where k = 1)
select d.id::bigint as id, case when nd = nv then mp.text else m0.text end as prediction_text
from d join mp using (id) join m0 using (id)
"""


@register("ensemble_first_model", FIRST_SQL)
def ensemble_first_model(spark, sf):
    return V.vote(_stacked(spark, sf), "first_model", len(VARIANTS)).select(F.col("id").cast("bigint").alias("id"),
                                                             "prediction_text")
