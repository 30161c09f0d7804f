"""Metrics of a write equal those of a second pass."""

import pytest
from pyspark.sql import functions as F

from spanlake.operators import checks as P
from spanlake.operators import evaluate as E
from spanlake.operators import observed as Ob
from spanlake.session import scratch_path


@pytest.mark.parametrize("n", [0, 7])
def test_expectations_of_the_write(spark, n):
    feats = spark.range(n).select((F.col("id") % 5).alias("feature_id"), F.lit("x").alias("more"))
    logits = spark.range(3, 3 + n).withColumnRenamed("id", "feature_id")
    splits = spark.createDataFrame([("train",), ("validation",)][:n], "split string")
    f, g, checks = Ob.observed_expectations(feats, logits, splits, 384, 512)
    want = P.row_expectations(feats, logits, splits, 384, 512)
    assert checks.columns == want.columns and checks.collect() == want.collect()
    assert sorted(f.collect()) == sorted(feats.collect()) and sorted(g.collect()) == sorted(logits.collect())


def test_metrics_of_the_write(spark):
    refs = spark.createDataFrame([(1, (["a b"],)), (2, (["c"],)), (3, ([],))], "id int, answers struct<text:array<string>>")
    preds = spark.createDataFrame([(1, "the a"), (3, ""), (9, "x")], "id int, prediction_text string")
    scores, metrics = Ob.evaluate_on_write(preds, refs, scratch_path(spark, "scores"))
    assert metrics.collect() == E.evaluate(preds, refs).collect()
    assert sorted(scores.collect()) == sorted(E.score_rows(preds, refs).collect())
    none = refs.where("id = 99")
    _, empty = Ob.evaluate_on_write(preds, none, scratch_path(spark, "scores"))
    assert empty.collect() == E.evaluate(preds, none).collect()


def test_a_failed_write_gives_no_metrics(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    with pytest.raises(Exception, match="broken"):
        Ob.observed_write(bad, scratch_path(spark, "bad"), n=F.count("*"))
