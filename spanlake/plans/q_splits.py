"""Split, fold, sampling and parameter-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import grid as G
from spanlake.operators import splits as K
from spanlake.plans.registry import register
from spanlake.plans.sqlparts import QA
from spanlake.session import scratch_path
from spanlake.sources import fixtures as FX
from spanlake.sources.tables import table

SEED, NFOLD = 10, 5


def _qa(spark, sf):
    return FX.qa_examples(spark, sf)


UNION_SQL = f"""
with {QA}
select id::bigint as id, split from qa where split = 'train'
union all select id::bigint, split from qa where split = 'validation'
"""


@register("union_splits", UNION_SQL)
def union_splits(spark, sf):
    qa = _qa(spark, sf)
    u = K.union_splits(qa.where(F.col("split") == "train"), qa.where(F.col("split") == "validation"))
    return u.select(F.col("id").cast("bigint").alias("id"), "split")


FOLDS_SQL = f"""
with {QA}
select id::bigint as id, (ntile({NFOLD}) over (order by md5('{SEED}:' || id::varchar), id) - 1)::bigint as fold from qa
"""


def _folded(spark, sf):
    return K.assign_folds(_qa(spark, sf).select("id", "split"), NFOLD, SEED)


@register("kfold_assign", FOLDS_SQL)
def kfold_assign(spark, sf):
    return _folded(spark, sf).select(F.col("id").cast("bigint").alias("id"), F.col("fold").cast("bigint").alias("fold"))


PARTS_SQL = f"""
with {QA},
f as (select id, ntile({NFOLD}) over (order by md5('{SEED}:' || id::varchar), id) - 1 as fold from qa)
select id::bigint as id, i::bigint as split_index, case when fold = i then 'validation' else 'train' end as part
from f, range({NFOLD}) r(i)
"""


@register("kfold_parts", PARTS_SQL)
def kfold_parts(spark, sf):
    """Every part of every split, read from folds that are stored once."""
    path = scratch_path(spark, "folds")
    K.write_folds(_folded(spark, sf), path)
    parts = [K.fold_part(spark, path, i, part).select(
        F.col("id").cast("bigint").alias("id"), F.lit(i).cast("bigint").alias("split_index"), F.lit(part).alias("part"))
        for i in range(NFOLD) for part in ("validation", "train")]
    return K.union_splits(*parts)


FRACTIONS = (0.0, 1e-5, 0.1, 0.999, 1.0)
SAMPLE_SQL = f"""
with {QA},
h as (select id, ('0x' || substr(md5('42:' || id::varchar), 1, 15))::bigint as h from qa)
""" + " union all ".join(
    f"select {f!r}::double as fraction, id::bigint as id from h where {f!r} >= 1 or h < {int(f * 2 ** K.HASH_BITS)}"
    for f in FRACTIONS)


@register("seeded_sample", SAMPLE_SQL)
def seeded_sample(spark, sf):
    ids = _qa(spark, sf).select("id")
    return K.union_splits(*[K.seeded_sample(ids, f, 42).select(
        F.lit(f).alias("fraction"), F.col("id").cast("bigint").alias("id")) for f in FRACTIONS])


# ----------------------------------------------------------------------------- grid
def _sql_lit(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}::double"
    return str(v)


def _decode_sql(id_expr: str) -> str:
    names = list(G.SWEEP_GRID)
    stride, strides = 1, {}
    for name in reversed(names):
        strides[name] = stride
        stride *= len(G.SWEEP_GRID[name])
    cols = []
    for name in names:
        vals = ", ".join(_sql_lit(v) for v in G.SWEEP_GRID[name])
        cols.append(f"[{vals}][(({id_expr}) // {strides[name]}) % {len(G.SWEEP_GRID[name])} + 1] as {name}")
    return ", ".join(cols)


GRID_N = G.grid_size()
PARAM_GRID_SQL = f"""
select event_id::bigint as event_id, (event_id % {GRID_N})::bigint as setting_id,
       {_decode_sql(f'event_id % {GRID_N}')} from events
"""


def _results(spark, sf):
    ev = table(spark, sf, "events")
    metric = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))  # diverged
    return ev.select("event_id", "event_type", (F.col("event_id") % GRID_N).alias("setting_id"), metric.alias("metric"))


@register("param_grid", PARAM_GRID_SQL)
def param_grid(spark, sf):
    r = _results(spark, sf).select(F.col("event_id").cast("bigint").alias("event_id"),
                                   F.col("setting_id").cast("bigint").alias("setting_id"))
    return G.decode_settings(r)


BEST_SETTING_SQL = f"""
with r as (select event_type as run, event_id % {GRID_N} as setting_id, value as metric from events
           where event_id % 97 <> 0),
b as (select * from (select *, row_number() over (partition by run order by metric desc, setting_id) as k from r)
      where k = 1)
select run, setting_id::bigint as setting_id, metric, {_decode_sql('setting_id')} from b
"""


@register("best_setting", BEST_SETTING_SQL)
def best_setting(spark, sf):
    b = G.best_setting(_results(spark, sf), "metric", group="event_type", maximize=True)
    b = b.select(F.col("event_type").alias("run"), F.col("setting_id").cast("bigint").alias("setting_id"), "metric")
    return G.decode_settings(b)


GRID_RESULTS_SQL = f"""
with r as (select (event_id * 31) % {GRID_N} as setting_id, count(*) as runs,
                  max(value) filter (event_id % 97 <> 0) as best_metric,
                  round(avg(value) filter (event_id % 97 <> 0), 6) as mean_metric from events group by 1),
g as (select i as setting_id, {_decode_sql('i')} from range({GRID_N}) t(i))
select setting_id::bigint as setting_id, {', '.join(G.SWEEP_GRID)}, coalesce(runs, 0)::bigint as runs, best_metric,
       mean_metric from g left join r using (setting_id)
"""


@register("grid_results", GRID_RESULTS_SQL)
def grid_results(spark, sf):
    """G1: the whole grid with the results of its runs (0 where there was none)."""
    results = _results(spark, sf).withColumn("setting_id", (F.col("event_id") * 31) % GRID_N)
    g = G.grid_results(spark, results.select("setting_id", "metric"))
    return g.withColumn("mean_metric", F.round("mean_metric", 6))
