"""M1: stored models and several models in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import models as Mo
from spanlake.operators.scoring import SCORERS, score_by_name, score_many
from spanlake.session import scratch_path

FEATURES = [(1, [2, 5, 3, 5, 7, 3], [None, 0, None, 1, 1, None], [5]), (2, [2, 3, 900, 3], [None, None, 1, None], []),
            (3, [], [], [7, 7]), (1, [2, 7, 3, 7, 3], [None, 0, None, 1, None], [7])]
SCHEMA = "feature_id int, input_ids array<int>, sequence_ids array<int>, q_ids array<int>"


def parameters(seed, n=10, d=3):
    rng = np.random.default_rng(seed)
    return {"embedding": rng.integers(-3, 4, (n, d)).astype(float), "start": rng.integers(-2, 3, (d, d)).astype(float),
            "end": rng.integers(-2, 3, (d, d)).astype(float)}


def plain(p, row, side):
    _, ids, seq, q = row
    e = lambda i: p["embedding"][i] if i < len(p["embedding"]) else np.zeros(3)
    total = sum((e(i) for i in q), np.zeros(3))
    return [float(e(i) @ p[side] @ total) if s == 1 else 0.0 for i, s in zip(ids, seq)]


@pytest.fixture()
def features(spark):
    return spark.createDataFrame(FEATURES, SCHEMA).repartition(2)


def test_two_stored_models_in_one_pass(spark, features, monkeypatch):
    monkeypatch.setattr(Mo, "CHUNK", 7)  # parameters of several chunks
    path, params = scratch_path(spark, "models"), {"a": parameters(1), "b": parameters(2)}
    Mo.save_model(spark, path, "b", "bilinear-span", parameters(9))
    for name, p in params.items():
        Mo.save_model(spark, path, name, "bilinear-span", p)  # replaces the first b
    got = Mo.score_from_table(features, path, ["a", "b"]).collect()
    rows = sorted((r["feature_id"], r["model"], list(r["start_logits"]), list(r["end_logits"])) for r in got)
    want = sorted((f[0], m, plain(p, f, "start"), plain(p, f, "end")) for f in FEATURES for m, p in params.items())
    assert rows == want


def test_what_is_not_there_is_an_error(spark, features):
    path = scratch_path(spark, "models")
    Mo.save_model(spark, path, "a", "bilinear-span", parameters(1))
    with pytest.raises(ValueError, match="no model"):
        Mo.score_from_table(features, path, ["a", "z"])
    with pytest.raises(ValueError, match="unknown kind"):
        Mo.save_model(spark, path, "x", "other", {})
    with pytest.raises(ValueError, match="more than"):
        Mo.load_models(spark, path, ["a"], max_parameters=5)


def test_one_pass_gives_the_logits_of_single_passes(spark, features):
    inputs = ("input_ids", "sequence_ids", "q_ids")
    many = score_many(features, SCORERS, input_cols=inputs, keep=("q_ids",), batch_size=3)
    assert many.columns == ["feature_id", "q_ids", "model", "start_logits", "end_logits"]
    for name in SCORERS:
        one = score_by_name(features, name)
        assert sorted((r["feature_id"], r["start_logits"]) for r in many.where(F.col("model") == name).collect()) == \
            sorted((r["feature_id"], r["start_logits"]) for r in one.collect())
    assert score_many(features.where("feature_id = 99"), SCORERS, input_cols=inputs).collect() == []
