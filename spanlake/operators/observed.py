"""Metrics of a pass: counted while the rows are written.

An ``Observation`` on a write gives its aggregates when the write is done, so a table is
stored and measured in one scan. ``observed_write`` is the general form. P4 writes both
sides' rows with their counts observed and then compares the written keys alone; E3
writes each reference's scores and observes their means.

Aggregates of an empty table are zero counts and null means. A write that fails gives no
metrics.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanlake.operators.evaluate import score_rows
from spanlake.session import scratch_path


def observed_write(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
    """Write ``df`` as Parquet; the table, and the metrics of that pass."""
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in metrics.items())).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def observed_expectations(features: DataFrame, logits: DataFrame, splits: DataFrame, requested_len: int, model_limit: int,
                          path: str | None = None, key: str = "feature_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(features, logits, checks)``: both sides as written, and one row of checks like
    ``checks.row_expectations``. Each side is scanned once, by its write."""
    spark = features.sparkSession
    path = path or scratch_path(spark, "observed")
    f, f_seen = observed_write(features, f"{path}/features", n=F.count("*"))
    g, g_seen = observed_write(logits, f"{path}/logits", n=F.count("*"))
    _, s_seen = observed_write(splits.select("split"), f"{path}/splits",
                               val=F.coalesce(F.bool_or(F.col("split") == "validation"), F.lit(False)))
    sides = f.select(key, F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(g.select(key, F.lit(0).alias("f"), F.lit(1).alias("l")))
    per_key = sides.groupBy(key).agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    checks = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("l") == 0, F.col("f"))), F.lit(0)).alias("features_without_logits"),
        F.coalesce(F.sum(F.when(F.col("f") == 0, F.col("l"))), F.lit(0)).alias("logits_without_features"))
    return f, g, checks.select(
        F.lit(f_seen["n"]).cast("bigint").alias("n_features"), F.lit(g_seen["n"]).cast("bigint").alias("n_logits"),
        "features_without_logits", "logits_without_features", F.lit(f_seen["n"] == g_seen["n"]).alias("counts_match"),
        F.lit(s_seen["val"]).alias("has_validation"), F.lit(min(requested_len, model_limit)).cast("bigint").alias("max_seq_length"))


def evaluate_on_write(predictions: DataFrame, references: DataFrame, path: str, prefix: str = "eval_") -> tuple[DataFrame, DataFrame]:
    """``(scores, metrics)``: every reference's scores as written to ``path``, and the
    one row of ``evaluate.evaluate`` from the same pass."""
    spark = references.sparkSession
    scores, seen = observed_write(score_rows(predictions, references), path, exact_match=F.avg("exact_match") * 100,
                                  f1=F.avg("f1") * 100, samples=F.count("*"), missing=F.count_if("missing"))
    schema = f"{prefix}exact_match double, {prefix}f1 double, {prefix}samples bigint, {prefix}missing bigint"
    return scores, spark.createDataFrame([(seen["exact_match"], seen["f1"], seen["samples"], seen["missing"])], schema)
