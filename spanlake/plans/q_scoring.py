"""Scoring queries (M1, M2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanlake.operators import scoring as M
from spanlake.operators import windows as Wn
from spanlake.operators.common import r6
from spanlake.operators.models import save_model, score_from_table
from spanlake.plans.q_windows import BASE_SQL, SPEC, _vocab, _windows
from spanlake.plans.registry import register
from spanlake.session import scratch_path
from spanlake.sources.tables import table

LOSS_SQL = """
with f as (select vec_id, list_transform(embedding, lambda v: v::double) as s,
                  list_transform(list_reverse(embedding), lambda v: v::double) as e,
                  len(embedding) as n, least(greatest((vec_id * 7) % 70, 0), len(embedding)) as ps,
                  least(greatest((vec_id * 11) % 70, 0), len(embedding)) as pe from embeddings),
c as (select case when ps < n then list_max(s) + ln(list_sum(list_transform(s, lambda v: exp(v - list_max(s)))))
                  - s[ps + 1] end as ce_s,
             case when pe < n then list_max(e) + ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e)))))
                  - e[pe + 1] end as ce_e from f)
select round(avg(ce_s), 6) as start_loss, round(avg(ce_e), 6) as end_loss, count(ce_s)::bigint as n_start,
       count(ce_e)::bigint as n_end, round((avg(ce_s) + avg(ce_e)) / 2, 6) as total_loss from c
"""


@register("span_loss", LOSS_SQL)
def span_loss(spark, sf):
    e = table(spark, sf, "embeddings")
    lab = e.select(F.col("embedding").alias("start_logits"), F.reverse("embedding").alias("end_logits"),
                   ((F.col("vec_id") * 7) % 70).cast("int").alias("start_positions"),
                   ((F.col("vec_id") * 11) % 70).cast("int").alias("end_positions"))
    r = M.span_loss(lab)
    return r.select(r6("start_loss").alias("start_loss"), r6("end_loss").alias("end_loss"), "n_start", "n_end",
                    r6("total_loss").alias("total_loss"))


LEXICAL_SQL = f"""
with {BASE_SQL},
qd as (select distinct id, tid from qt where tid <> 1),
hit as (select win2.id, win2.w, count(*) as overlap from win2
        join ct on ct.id = win2.id and ct.tok_idx >= win2.ws and ct.tok_idx < win2.we
        join qd on qd.id = ct.id and qd.tid = ct.tid group by win2.id, win2.w)
select win2.id::bigint as id, win2.w::bigint as "window", coalesce(hit.overlap, 0)::bigint as overlap
from win2 left join hit using (id, w)
"""


def _scored_features(spark, sf):
    return Wn.pair_features(_windows(spark, sf), SPEC, eval_mode=True)


@register("lexical_scores", LEXICAL_SQL)
def lexical_scores(spark, sf):
    f = M.lexical_logits(_scored_features(spark, sf))
    s = F.aggregate("start_logits", F.lit(0.0), lambda a, x: a + x)
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    s.cast("bigint").alias("overlap"))


@register("model_scores", LEXICAL_SQL)
def model_scores(spark, sf):
    """M1 plug-in path: the numpy overlap model through Arrow batches."""
    f = _scored_features(spark, sf).select("id", "window", "input_ids", "sequence_ids", "q_ids",
                                           "attention_mask")
    s = M.score_by_name(f, "lexical-overlap", key_cols=("id", "window"))
    return s.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    F.aggregate("start_logits", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("overlap"))


# ----------------------------------------------------------------------------- stored models
DIM = 4  # of the vectors of two small models whose parameters follow a rule
MODELS = {"even": (7, 3), "odd": (11, 5)}  # name: factors of the rule


def _rule(a: int, b: int, rows: int, columns: int) -> np.ndarray:
    i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return (i * a + j * b) % 5 - 2.0


def _model_sql(name: str, a: int, b: int) -> str:
    """Sums of a model's logits over the windows' contexts, all of whole numbers."""
    e = [f"((tid * {a} + {j * b}) % 5 - 2)" for j in range(DIM)]
    sums = ", ".join(f"sum({x}) as {{}}{j}" for j, x in enumerate(e))

    def total(m):
        return " + ".join(f"{int(_rule(b + m, a, DIM, DIM)[j, k])} * c{j} * q{k}" for j in range(DIM) for k in range(DIM))
    none = ", ".join(f"coalesce(c{j}, 0) as c{j}" for j in range(DIM))
    return f"""select id::bigint as id, w::bigint as "window", '{name}' as model, ({total(0)})::bigint as start_sum, ({total(1)})::bigint as end_sum
from (select win2.id, win2.w, {none}, {', '.join(f'coalesce(q{j}, 0) as q{j}' for j in range(DIM))} from win2
      left join (select win2.id, win2.w, {sums.replace('{}', 'c')} from win2
                 join ct on ct.id = win2.id and ct.tok_idx >= win2.ws and ct.tok_idx < win2.we group by win2.id, win2.w) c using (id, w)
      left join (select id, {sums.replace('{}', 'q')} from qt group by id) q using (id))"""


MODEL_TABLE_SQL = f"with {BASE_SQL}\n" + "\nunion all ".join(_model_sql(n, a, b) for n, (a, b) in MODELS.items())


@register("model_table_scores", MODEL_TABLE_SQL)
def model_table_scores(spark, sf):
    """M1 with models that are rows of a table: two of them, stored, chosen by name and
    run in one pass."""
    path, size = scratch_path(spark, "models"), _vocab(spark, sf).count()
    for name, (a, b) in MODELS.items():
        save_model(spark, path, name, "bilinear-span", {
            "embedding": _rule(a, b, size, DIM), "start": _rule(b, a, DIM, DIM), "end": _rule(b + 1, a, DIM, DIM)})
    f = _scored_features(spark, sf).select("id", "window", "input_ids", "sequence_ids", "q_ids")
    s = score_from_table(f, path, list(MODELS), key_cols=("id", "window"), input_cols=("input_ids", "sequence_ids", "q_ids"))
    total = [F.aggregate(c, F.lit(0.0), lambda x, y: x + y).cast("bigint") for c in ("start_logits", "end_logits")]
    return s.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"), "model",
                    total[0].alias("start_sum"), total[1].alias("end_sum"))
