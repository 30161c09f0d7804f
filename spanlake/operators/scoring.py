"""Scoring slot (M1) and span loss (M2).

M1 runs a caller-supplied model over feature rows in Arrow batches with
``mapInArrow``; the model is built once per task and gets 2-D arrays of a bounded
number of rows. A JVM-side lexical scorer (question/context token overlap) gives
deterministic logits for end-to-end runs without a network.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanlake.operators.common import let
from spanlake.operators.windows import UNK_ID
from spanlake.session import ship_package

NONE = -1  # stands for nulls and beyond a row's end in stacked arrays


def lexical_logits(features: DataFrame, context_id: int = 1) -> DataFrame:
    """Built-in scorer: logit 1.0 at context tokens whose id occurs in the
    question (``[UNK]`` excluded), else 0.0; the same array for start and end.
    Needs ``input_ids, sequence_ids, q_ids``."""
    hit = let({"ids": "input_ids", "seq": "sequence_ids", "q": "q_ids"}, lambda v: F.zip_with(
        v["ids"], v["seq"], lambda t, s: F.when((s == context_id) & (t != UNK_ID) & F.array_contains(v["q"], t),
                                                F.lit(1.0)).otherwise(F.lit(0.0))))
    return features.withColumns({"start_logits": hit, "end_logits": hit})


def score_with(features: DataFrame, model_factory: Callable[[], Callable], key_cols=("feature_id",),
               input_cols=("input_ids", "attention_mask"), batch_size: int = 32) -> DataFrame:
    """M1 plug-in path: ``model_factory()`` returns ``model(inputs) -> (start, end)``.
    ``inputs`` has a 2-D integer array of up to ``batch_size`` rows per input column
    (see :func:`stacked_lists`); the logits are 2-D arrays as wide as the first one, and each
    row keeps as many as it has ids."""
    return score_many(features, {"": model_factory}, key_cols, input_cols, batch_size=batch_size).drop("model")


def stacked_lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of integers as one 2-D array, short rows and nulls filled with ``NONE``, and
    which of its places are theirs."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    inside = np.arange(int(sizes.max(initial=0))) < sizes[:, None]
    out = np.full(inside.shape, NONE, np.int64)
    out[inside] = pc.fill_null(column.flatten(), NONE).to_numpy(zero_copy_only=False)
    return out, inside


def score_many(features: DataFrame, factories: dict[str, Callable[[], Callable]], key_cols=("feature_id",),
               input_cols=("input_ids", "attention_mask"), keep=(), batch_size: int = 256) -> DataFrame:
    """M1 for several models in one pass: ``key_cols``, ``keep``, ``model`` and the logits,
    one row per feature and model. Models are called like those of :func:`score_with`;
    logits stay beside their feature's columns, so nothing is joined."""
    fields = [features.schema[c] for c in (*key_cols, *keep)]
    logits = T.ArrayType(T.FloatType())
    schema = T.StructType([*fields, T.StructField("model", T.StringType()), T.StructField("start_logits", logits),
                           T.StructField("end_logits", logits)])
    arrow = to_arrow_schema(schema)
    ship_package(features.sparkSession)
    first = len(fields)

    def run(batches):
        models = {name: make() for name, make in factories.items()}
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.slice(at, batch_size)
                inputs, inside = {}, None
                for c, column in zip(input_cols, part.columns[first:]):
                    inputs[c], own = stacked_lists(column)
                    inside = own if inside is None else inside
                bounds = pa.array(np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32))
                for name, model in models.items():
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(np.asarray(x, np.float32)[inside])) for x in model(inputs)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:first], pa.array([name] * len(part)), *lists], schema=arrow)

    return features.select(*key_cols, *keep, *input_cols).mapInArrow(run, schema)


class OverlapModel:
    """A numpy model for the plug-in path: context tokens that occur in the question
    score 1 plus ``bonus(ids)``, all others 0 (inputs ``input_ids, sequence_ids,
    q_ids``). Without a bonus these are the logits of ``lexical_logits``."""

    def __init__(self, bonus: Callable[[np.ndarray], np.ndarray] | None = None, context_id: int = 1):
        self.bonus, self.context_id = bonus, context_id

    def __call__(self, inputs: dict[str, np.ndarray]):
        ids, q = inputs["input_ids"], inputs["q_ids"]
        among = np.zeros(ids.shape, bool)
        for column in q.T:  # one comparison per question position, for all rows
            among |= ids == column[:, None]
        hit = among & (inputs["sequence_ids"] == self.context_id) & (ids != UNK_ID) & (ids != NONE)
        logits = hit * (1.0 if self.bonus is None else 1.0 + self.bonus(ids))
        return logits, logits


def mid_ids(ids: np.ndarray) -> np.ndarray:
    return (ids % 7) / 8


def late_ids(ids: np.ndarray) -> np.ndarray:
    return (ids % 16) / 16


# Scorers selectable by name (the reference picks its network by model name).
SCORERS: dict[str, Callable[[], Callable]] = {
    "lexical-overlap": OverlapModel,
    "lexical-sevenths": lambda: OverlapModel(mid_ids),
    "lexical-sixteenths": lambda: OverlapModel(late_ids),
}


def score_by_name(features: DataFrame, name: str, key_cols=("feature_id",),
                  input_cols=("input_ids", "sequence_ids", "q_ids"), batch_size: int = 32) -> DataFrame:
    """M1 dispatch: run the scorer registered under ``name``."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}")
    return score_with(features, SCORERS[name], key_cols, input_cols, batch_size)


def _lse(x: Column) -> Column:
    """log-sum-exp, max-shifted; ``x`` and its max are bound once per row."""
    return let({"x": x}, lambda b: let({"x": b["x"], "m": F.array_max(b["x"])}, lambda v: v["m"] + F.log(
        F.aggregate(F.transform(v["x"], lambda e: F.exp(e - v["m"])), F.lit(0.0), lambda a, e: a + e))))


def _ce(x: Column, pos: Column) -> Column:
    """Cross-entropy at ``pos`` clamped to ``[0, L]``; ``L`` (ignored) -> null."""
    n = F.size(x)
    p = F.least(F.greatest(pos, F.lit(0)), n)
    return F.when(p < n, _lse(x) - F.get(x, p))


def span_loss(df: DataFrame, start_logits: str = "start_logits", end_logits: str = "end_logits",
              start_positions: str = "start_positions", end_positions: str = "end_positions") -> DataFrame:
    """M2: one row ``start_loss, end_loss, total_loss, n_start, n_end``.

    Positions are clamped to ``[0, L]`` (``L`` = sequence length); position ``L``
    is ignored. Each side is the mean cross-entropy over its non-ignored rows and
    the total is the mean of the two sides.
    """
    out = {}
    for side, lg, pos in (("start", start_logits, start_positions), ("end", end_logits, end_positions)):
        out[side] = let({"x": F.transform(F.col(lg), lambda v: v.cast("double")), "pos": F.col(pos)},
                        lambda b: _ce(b["x"], b["pos"]))
    r = df.select(out["start"].alias("ce_s"), out["end"].alias("ce_e"))
    agg = r.agg(F.avg("ce_s").alias("start_loss"), F.avg("ce_e").alias("end_loss"),
                F.count("ce_s").cast("bigint").alias("n_start"), F.count("ce_e").cast("bigint").alias("n_end"))
    return agg.withColumn("total_loss", (F.col("start_loss") + F.col("end_loss")) / 2)
