"""M1: models that are rows of a table, chosen by name.

A model is a kind, which names the code that runs it, and named parameters, arrays of
numbers. They are stored as Parquet rows ``(model, kind, parameter, shape, chunk,
values)`` in a folder of the model's name, large arrays in chunks of ``CHUNK`` numbers.
To score, the parameters of the models asked for are read once, after a check of their
size, and broadcast: a worker loads them once, whatever number of tasks it runs, and a
task builds its models from them. All models run in one pass over the features.

Saving a model again replaces it. A name that is not there, a kind that is not known and
a parameter with missing chunks are errors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.scoring import NONE, score_many

CHUNK = 1 << 20
MAX_PARAMETERS = 64 << 20  # numbers of all models of one pass


class BilinearSpan:
    """``logit(i) = e(token i) . W . sum of e(question tokens)`` at context tokens, else
    0; parameters ``embedding`` (ids x d), ``start`` and ``end`` (d x d). Ids beyond the
    embedding have the null vector."""

    def __init__(self, parameters: dict[str, np.ndarray], context_id: int = 1):
        e = parameters["embedding"]
        self.embedding = np.concatenate([e, np.zeros((1, e.shape[1]))])  # the last for ids it doesn't have
        self.start, self.end, self.context_id = parameters["start"], parameters["end"], context_id

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.embedding) - 1
        return self.embedding[np.where((ids > NONE) & (ids < n), ids, n)]

    def __call__(self, inputs: dict[str, np.ndarray]):
        context = self.vectors(inputs["input_ids"])
        question = self.vectors(inputs["q_ids"]).sum(axis=1)
        among = inputs["sequence_ids"] == self.context_id
        return tuple(np.einsum("rid,rd->ri", context, question @ w.T) * among for w in (self.start, self.end))


KINDS: dict[str, Callable[[dict[str, np.ndarray]], Callable]] = {"bilinear-span": BilinearSpan}


def save_model(spark: SparkSession, path: str, name: str, kind: str, parameters: dict[str, np.ndarray]) -> None:
    """Store a model under its name, in the place of an earlier one."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(KINDS)}")
    rows = [(kind, p, list(a.shape), k, a.ravel()[at:at + CHUNK].astype(np.float64))
            for p, a in parameters.items() for k, at in enumerate(range(0, max(1, a.size), CHUNK))]
    kinds, names, shapes, chunks, values = zip(*rows)
    table = pa.table({"kind": pa.array(kinds), "parameter": pa.array(names), "shape": pa.array(shapes, pa.list_(pa.int64())),
                      "chunk": pa.array(chunks, pa.int32()), "values": pa.array(values, pa.list_(pa.float64()))})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/model={name}")


def load_models(spark: SparkSession, path: str, names: list[str],
                max_parameters: int = MAX_PARAMETERS) -> dict[str, tuple[str, dict[str, np.ndarray]]]:
    """``name -> (kind, parameters)``; only the folders of these names are read."""
    rows = spark.read.parquet(path).where(F.col("model").cast("string").isin(names))
    total = rows.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).first()[0]
    if total > max_parameters:
        raise ValueError(f"{total} parameters are more than {max_parameters}")
    found: dict[str, tuple[str, dict]] = {}
    for r in rows.withColumn("model", F.col("model").cast("string")).collect():  # max_parameters numbers
        found.setdefault(r["model"], (r["kind"], {}))[1].setdefault(r["parameter"], (r["shape"], {}))[1][r["chunk"]] = r["values"]
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"no model {missing} in {path}")
    out = {}
    for name in names:
        kind, parameters = found[name]
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r} of model {name!r}; known: {sorted(KINDS)}")
        arrays = {}
        for p, (shape, chunks) in parameters.items():
            flat = np.concatenate([np.asarray(chunks[k], np.float64) for k in sorted(chunks)])
            if flat.size != int(np.prod(shape)):
                raise ValueError(f"parameter {p!r} of model {name!r} is not whole")
            arrays[p] = flat.reshape(shape)
        out[name] = kind, arrays
    return out


def score_from_table(features: DataFrame, path: str, names: list[str], key_cols=("feature_id",),
                     input_cols=("input_ids", "sequence_ids", "q_ids"), keep=(), batch_size: int = 256) -> DataFrame:
    """M1 by stored models: ``key_cols, keep, model, start_logits, end_logits``, one row
    per feature and model."""
    spark = features.sparkSession
    held = spark.sparkContext.broadcast(load_models(spark, path, names))

    def factory(name):
        def make():
            kind, parameters = held.value[name]
            return KINDS[kind](parameters)
        return make
    return score_many(features, {n: factory(n) for n in names}, key_cols, input_cols, keep, batch_size)
