"""Voting over several models' n-best lists (V1-V4).

Each model contributes one top-1 row per question; rows are grouped by question
id into an array of at most (number of models) entries, and the vote runs
in-row. Any number of models is supported; model order matters only for the
``first_model`` rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_models(nbests: list[DataFrame]) -> DataFrame:
    """V1: union the models' n-best rows ``(id, rank, text, probability)`` with a
    ``model`` index (0 = first model). (A multi-model ``decode`` already yields
    the stacked form, with ``model`` as the index.)"""
    out = None
    for i, nb in enumerate(nbests):
        part = nb.select("id", "rank", "text", "probability").withColumn("model", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def missing_ids(stacked: DataFrame, n_models: int) -> DataFrame:
    """V1 check: ids of the first model that another model lacks, with the model."""
    ids0 = stacked.where(F.col("model") == 0).select("id").distinct()
    miss = None
    for m in range(1, n_models):
        idm = stacked.where(F.col("model") == m).select("id").distinct()
        part = ids0.join(idm, "id", "left_anti").withColumn("model", F.lit(m))
        miss = part if miss is None else miss.unionByName(part)
    return miss


def assert_aligned(stacked: DataFrame, n_models: int) -> None:
    """Raise if a question id of the first model is missing from another model."""
    if n_models > 1:
        bad = missing_ids(stacked, n_models).limit(5).collect()
        if bad:
            raise ValueError(f"ids missing from some models: {[tuple(r) for r in bad]}")


def top1(stacked: DataFrame, n_models: int | None = None) -> DataFrame:
    """V2: ``(id, votes array<struct<model, text, probability>>)`` from rank-1 rows,
    for the ids of the first model (``model = 0``).

    With ``n_models``, an id that lacks another model's answer fails the query
    (checked inside the plan, no extra pass over the data).
    """
    t = stacked.where(F.col("rank") == 1)
    votes = F.array_sort(F.collect_list(F.struct("model", "text", "probability")))
    g = t.groupBy("id").agg(votes.alias("votes")).where(F.get("votes", 0)["model"] == 0)
    if n_models is not None:
        ok = F.size("votes") == n_models
        g = g.withColumn("votes", F.when(ok, F.col("votes")).otherwise(
            F.raise_error(F.concat(F.lit("an id lacks an answer of some model: "), F.col("id").cast("string")))))
    return g


def _max_prob(votes: Column) -> Column:
    """V3: highest probability; equal probabilities -> smallest text."""
    keyed = F.transform(votes, lambda v: F.struct((-v["probability"]).alias("np"), v["text"].alias("text")))
    return F.get(F.array_sort(keyed), 0)["text"]


def _majority(votes: Column) -> Column:
    keyed = F.transform(votes, lambda v: F.struct(
        (-F.size(F.filter(votes, lambda o: o["text"] == v["text"]))).alias("nc"),
        (-v["probability"]).alias("np"), v["text"].alias("text")))
    return F.get(F.array_sort(keyed), 0)["text"]


def vote(stacked: DataFrame, rule: str = "majority", n_models: int | None = None) -> DataFrame:
    """V3/V4: ``(id, prediction_text)``.

    ``max_prob``: V3. ``majority`` (the documented intent): the most voted text,
    ties by probability then text (all different -> V3). ``first_model`` (the
    reference as written): all different -> V3, else the first model's text.
    """
    t = top1(stacked, n_models)
    votes = F.col("votes")
    if rule == "max_prob":
        pred = _max_prob(votes)
    elif rule == "majority":
        pred = _majority(votes)
    elif rule == "first_model":
        distinct = F.size(F.array_distinct(F.transform(votes, lambda v: v["text"])))
        pred = F.when(distinct == F.size(votes), _max_prob(votes)).otherwise(F.get(votes, 0)["text"])
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return t.select("id", pred.alias("prediction_text"))
