"""Column roles and row-count expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLE_POSITIONS = {"question": 0, "context": 1, "answers": 2}


def resolve_roles(df: DataFrame, roles=("question", "context", "answers")) -> dict[str, str]:
    """A role is the column of that name, else the column at its position.

    Unlike the reference (which then silently picks ``question`` as the answers
    column when ``answers`` is absent), a resolved column of the wrong type is an
    error.
    """
    cols = df.columns
    out = {}
    for role in roles:
        name = role if role in cols else cols[ROLE_POSITIONS[role]]
        dtype = df.schema[name].dataType
        if role == "answers" and not isinstance(dtype, T.StructType):
            raise TypeError(f"answers role resolved to {name!r} of type {dtype.simpleString()}")
        if role != "answers" and not isinstance(dtype, T.StringType):
            raise TypeError(f"{role} role resolved to {name!r} of type {dtype.simpleString()}")
        out[role] = name
    return out


def select_roles(df: DataFrame, roles=("question", "context", "answers"), keep=()) -> DataFrame:
    r = resolve_roles(df, roles)
    return df.select(*keep, *[F.col(r[k]).alias(k) for k in roles])


def row_expectations(features: DataFrame, logits: DataFrame, splits: DataFrame,
                     requested_len: int, model_limit: int, key: str = "feature_id") -> DataFrame:
    """One row of expectation checks.

    Counts on both sides, features without logits and logits without features
    (one union grouped by key: each side is read once), whether a ``validation`` split exists, and the
    effective window length ``least(requested, model limit)``.
    """
    # Keys are counted per side and key, so repeated keys count as often as they occur.
    sides = features.select(key, F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(
        logits.select(key, F.lit(0).alias("f"), F.lit(1).alias("l")))
    per_key = sides.groupBy(key).agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    counts = per_key.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("n_features"), F.coalesce(F.sum("l"), F.lit(0)).alias("n_logits"),
        F.coalesce(F.sum(F.when(F.col("l") == 0, F.col("f"))), F.lit(0)).alias("features_without_logits"),
        F.coalesce(F.sum(F.when(F.col("f") == 0, F.col("l"))), F.lit(0)).alias("logits_without_features"))
    has_val = splits.agg(F.coalesce(F.bool_or(F.col("split") == "validation"), F.lit(False)).alias("has_validation"))
    return counts.join(F.broadcast(has_val)).select(  # one row each
        "n_features", "n_logits", "features_without_logits", "logits_without_features",
        (F.col("n_features") == F.col("n_logits")).alias("counts_match"), "has_validation",
        F.lit(min(requested_len, model_limit)).cast("bigint").alias("max_seq_length"))


def predictions_to_rows(pred_map: DataFrame, col: str = "predictions") -> DataFrame:
    """P5: a ``map<id, text>`` column -> rows ``(id, prediction_text)``."""
    return pred_map.select(F.explode(col).alias("id", "prediction_text"))


def references(examples: DataFrame, answers: str = "answers") -> DataFrame:
    """P5: ``(id, answers)`` rows of the labelled examples."""
    return examples.select("id", F.col(answers).alias("answers"))
