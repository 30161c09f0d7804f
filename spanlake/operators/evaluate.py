"""Exact match, token F1 and checkpoint selection.

Predictions and references meet in one equi-join on ``id``; everything after it
is row-local array work on short answer token lists (no further shuffle) and a
single global average (partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import squad_normalize, squad_tokens
from spanlake.operators.common import let


def _overlap(p: Column, g: Column) -> Column:
    """Multiset intersection size of two token arrays."""
    return F.aggregate(
        F.array_distinct(p), F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))))


def f1_pair(pred_tokens: Column, gold_tokens: Column) -> Column:
    """SQuAD token F1 of one prediction against one gold answer (0 when no overlap).
    Both token lists are bound once (they are used inside the overlap lambdas)."""
    def body(v):
        p, g = v["p"], v["g"]
        ov = _overlap(p, g).cast("double")
        prec = ov / F.size(p)
        rec = ov / F.size(g)
        return F.when(ov == 0, F.lit(0.0)).otherwise(F.lit(2.0) * prec * rec / (prec + rec))
    return let({"p": pred_tokens, "g": gold_tokens}, body)


def golds(answers: str = "answers") -> Column:
    """Gold texts; an example without gold answers is scored against ``""``."""
    t = F.col(f"{answers}.text")
    return F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("")))


def score_rows(predictions: DataFrame, references: DataFrame, answers: str = "answers") -> DataFrame:
    """E1 + E2 per reference: ``(id, exact_match, f1, missing)``, scores in [0, 1], max
    over golds. A reference without a prediction scores 0 and is ``missing``;
    predictions without a reference are ignored."""
    p = predictions.select("id", "prediction_text", F.lit(True).alias("_has"))
    j = references.select("id", F.col(answers).alias("_ans")).join(p, "id", "left")
    bound = {"g": golds("_ans"), "pn": squad_normalize("prediction_text"), "pt": squad_tokens("prediction_text")}
    em = let(bound, lambda v: F.exists(v["g"], lambda x: squad_normalize(x) == v["pn"]).cast("double"))
    f1 = let(bound, lambda v: F.array_max(F.transform(v["g"], lambda x: f1_pair(v["pt"], squad_tokens(x)))))
    has = F.col("_has").isNotNull() & F.col("prediction_text").isNotNull()
    return j.select("id", F.when(has, em).otherwise(0.0).alias("exact_match"),
                    F.when(has, f1).otherwise(0.0).alias("f1"), (~has).alias("missing"))


def evaluate(predictions: DataFrame, references: DataFrame, prefix: str = "eval_") -> DataFrame:
    """One row ``{prefix}exact_match, {prefix}f1`` (x 100) over all references, their
    number and the number of those without a prediction."""
    s = score_rows(predictions, references)
    return s.agg((F.avg("exact_match") * 100).alias(f"{prefix}exact_match"),
                 (F.avg("f1") * 100).alias(f"{prefix}f1"),
                 F.count("*").cast("bigint").alias(f"{prefix}samples"),
                 F.count_if("missing").cast("bigint").alias(f"{prefix}missing"))


def metric_key(metric: str, maximize: bool, tie: str) -> Column:
    """Order of runs by a metric; a run whose metric is NaN (diverged) or null is never
    the best, whatever the direction. Ties go to the lowest ``tie``."""
    m = F.col(metric).cast("double")
    return F.when(m.isNotNull() & ~F.isnan(m), F.struct((m if maximize else -m).alias("m"), (-F.col(tie)).alias("t")))


def best_step(log: DataFrame, run: str = "run", step: str = "step", metric: str = "metric",
              maximize: bool = True) -> DataFrame:
    """The step with the best metric per run (lowest step on ties); null for a run
    without any finite metric."""
    best = F.max_by(F.struct(step, metric), metric_key(metric, maximize, step)).alias("b")
    return log.groupBy(run).agg(best).select(
        run, F.col(f"b.{step}").alias("best_step"), F.col(f"b.{metric}").alias("best_metric"))


def keep_last(log: DataFrame, n: int = 5, run: str = "run", step: str = "step") -> DataFrame:
    """The ``n`` most recent saves per run (``save_total_limit``)."""
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    return log.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)
