"""V1-V4, K1-K4, E1-E4, G1-G2, M2 on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from spanlake.operators import ensemble as V
from spanlake.operators import evaluate as E
from spanlake.operators import grid as G
from spanlake.operators import scoring as M
from spanlake.operators import splits as K
from spanlake.session import scratch_path


def nbest(spark, rows):
    return spark.createDataFrame(rows, "id string, rank int, text string, probability double")


def test_votes(spark):
    m0 = nbest(spark, [("a", 1, "x", .5), ("b", 1, "p", .2), ("c", 1, "u", .3), ("d", 1, "k", .4), ("e", 1, "z", .6)])
    m1 = nbest(spark, [("a", 1, "x", .6), ("b", 1, "q", .9), ("c", 1, "v", .3), ("d", 1, "k", .4), ("e", 1, "y", .6)])
    m2 = nbest(spark, [("a", 1, "x", .7), ("b", 1, "q", .1), ("c", 1, "w", .9), ("d", 1, "m", .9), ("e", 1, "w", .6)])
    st = V.stack_models([m0, m1, m2])
    maj = {r.id: r.prediction_text for r in V.vote(st, "majority").collect()}
    first = {r.id: r.prediction_text for r in V.vote(st, "first_model").collect()}
    maxp = {r.id: r.prediction_text for r in V.vote(st, "max_prob").collect()}
    assert maj["a"] == first["a"] == "x"            # 3-0
    assert maj["b"] == "q" and first["b"] == "p"    # 2-1, first model in the minority
    assert maj["c"] == first["c"] == maxp["c"] == "w"  # 1-1-1 -> most probable
    assert maj["e"] == maxp["e"] == "w"             # equal probabilities -> smallest text
    assert maj["d"] == "k"


def test_missing_id_is_an_error(spark):
    m0 = nbest(spark, [("a", 1, "x", .5), ("b", 1, "y", .5)])
    m1 = nbest(spark, [("a", 1, "x", .5)])
    with pytest.raises(ValueError):
        V.assert_aligned(V.stack_models([m0, m1]), 2)
    with pytest.raises(Exception):  # the same check inside the plan
        V.vote(V.stack_models([m0, m1]), "majority", 2).collect()


@pytest.mark.parametrize("n,k", [(23, 5), (10, 5), (7, 3)])
def test_folds_partition(spark, n, k):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"))
    f = K.assign_folds(df, k, seed=10)
    rows = f.collect()
    assert len(rows) == n
    sizes = [sum(1 for r in rows if r.fold == i) for i in range(k)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    again = {r.id: r.fold for r in K.assign_folds(df, k, seed=10).collect()}
    assert again == {r.id: r.fold for r in rows}
    path = scratch_path(spark, "folds")
    K.write_folds(f, path)
    for i in range(k):
        own = {r.id for r in K.fold_part(spark, path, i, "validation").collect()}
        rest = {r.id for r in K.fold_part(spark, path, i, "train").collect()}
        assert len(own) == sizes[i] and not own & rest and len(own | rest) == n


def test_fold_part_reads_only_its_folders(spark):
    path = scratch_path(spark, "folds")
    K.write_folds(K.assign_folds(spark.range(20), 5), path)
    plan = K.fold_part(spark, path, 2, "validation")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_seeded_sample_is_stable(spark):
    df = spark.range(2000).select(F.col("id"))
    a = {r.id for r in K.seeded_sample(df, 0.25, 5).collect()}
    b = {r.id for r in K.seeded_sample(df, 0.25, 5).collect()}
    assert a == b and 400 < len(a) < 600
    sizes = [K.seeded_sample(df, f).count() for f in (0.0, 1e-5, 0.999, 1.0, 2.0)]
    assert sizes[0] == 0 and sizes[1] <= 1 and 1980 <= sizes[2] <= 2000 and sizes[3:] == [2000, 2000]
    assert {r.id for r in K.seeded_sample(df, 0.1, 5).collect()} <= a
    many = spark.range(400_000)
    assert 1 <= K.seeded_sample(many, 1e-5).count() <= 15  # 4 expected


def test_exact_match_and_f1(spark):
    preds = spark.createDataFrame([("1", "The Cat!"), ("2", ""), ("3", "a the"), ("4", "red blue green")],
                                  "id string, prediction_text string")
    refs = spark.createDataFrame([
        ("1", {"answer_start": [0, 5], "text": ["dog", "cat"]}),   # several golds: max
        ("2", {"answer_start": [0], "text": ["x"]}),              # empty prediction
        ("3", {"answer_start": [0], "text": ["an"]}),             # articles only: both empty
        ("4", {"answer_start": [0], "text": ["blue red"]}),
    ], "id string, answers struct<answer_start:array<int>,text:array<string>>")
    s = {r.id: r for r in E.score_rows(preds, refs).collect()}
    assert s["1"].exact_match == 1.0 and s["1"].f1 == 1.0
    assert s["2"].exact_match == 0.0 and s["2"].f1 == 0.0
    assert s["3"].exact_match == 1.0 and s["3"].f1 == 0.0
    p, r = 2 / 3, 1.0
    assert s["4"].f1 == pytest.approx(2 * p * r / (p + r))
    m = E.evaluate(preds, refs).first()
    assert m.eval_exact_match == pytest.approx(50.0) and (m.eval_samples, m.eval_missing) == (4, 0)
    # a reference without a prediction counts as wrong, and is reported
    few = E.evaluate(preds.where("id in ('1', '2')"), refs).first()
    assert few.eval_exact_match == pytest.approx(25.0) and (few.eval_samples, few.eval_missing) == (4, 2)


def test_best_step_and_keep_last(spark):
    log = spark.createDataFrame([("r", 100, .5), ("r", 200, .7), ("r", 300, .7), ("r", 400, .1)],
                                "run string, step int, metric double")
    b = E.best_step(log).first()
    assert (b.best_step, b.best_metric) == (200, .7)
    nan = spark.createDataFrame([("r", 1, float("nan")), ("r", 2, 0.1), ("s", 3, float("nan")), ("r", 4, None)],
                                "run string, step int, metric double")
    for maximize in (True, False):
        got = {r.run: r.best_step for r in E.best_step(nan, maximize=maximize).collect()}
        assert got == {"r": 2, "s": None}
    assert [r.step for r in E.keep_last(log, 2).orderBy("recency").collect()] == [400, 300]


def test_grid(spark):
    g = G.full_grid(spark)
    assert g.count() == 5 * 15 * 10 * 2 * 7 * 7 * 3 == G.grid_size()
    first, last = g.where("setting_id = 0").first(), g.where(f"setting_id = {G.grid_size() - 1}").first()
    assert (first.learning_rate, first.dropout, first.pad_to_max_length) == (1e-5, 0.0, True)
    assert (last.learning_rate, last.dropout, last.max_seq_length) == (5e-5, 0.2, 512)
    res = spark.createDataFrame([(3, 0.5), (9, 0.9), (4, 0.9)], "setting_id long, metric double")
    assert G.best_setting(res).first().setting_id == 4
    assert G.best_setting(res, maximize=False).first().setting_id == 3
    diverged = res.union(spark.createDataFrame([(7, float("nan"))], "setting_id long, metric double"))
    assert [G.best_setting(diverged, maximize=m).first().setting_id for m in (True, False)] == [4, 3]
    runs = G.grid_results(spark, diverged).where("runs > 0 or setting_id = 5").orderBy("setting_id").collect()
    assert [(r.setting_id, r.runs, r.best_metric) for r in runs] == [(3, 1, .5), (4, 1, .9), (5, 0, None), (7, 1, None), (9, 1, .9)]
    big = spark.createDataFrame([((1 << 60) + 1,)], "setting_id long")
    assert G.decode_settings(big).first().dropout == [0.0, 0.1, 0.2][((1 << 60) + 1) % 3]


def test_span_loss(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], [2.0, 1.0, 0.0], 2, 0), ([1.0, 1.0, 1.0], [0.0, 0.0, 0.0], 9, 1)],
                               "start_logits array<double>, end_logits array<double>, "
                               "start_positions int, end_positions int")
    r = M.span_loss(df).first()

    def ce(x, p):
        mx = max(x)
        return mx + math.log(sum(math.exp(v - mx) for v in x)) - x[p]
    assert r.n_start == 1 and r.n_end == 2  # position 9 is clamped to L = 3 and ignored
    assert r.start_loss == pytest.approx(ce([0, 1, 2], 2))
    assert r.end_loss == pytest.approx((ce([2, 1, 0], 0) + ce([0, 0, 0], 1)) / 2)
    assert r.total_loss == pytest.approx((r.start_loss + r.end_loss) / 2)


def test_plugin_scorer_in_batches(spark):
    rows = [(i, [2, 5, 6, 3, 7, 5, 1, 0][:6 + i % 3], [None, 0, 0, None, 1, 1, 1, None][:6 + i % 3], [5, 6][:i % 3]) for i in range(10)]
    f = spark.createDataFrame(rows, "feature_id int, input_ids array<int>, sequence_ids array<int>, q_ids array<int>")
    f = f.withColumn("q_ids", F.coalesce("q_ids", F.array().cast("array<int>")))
    want = {r.feature_id: r.start_logits for r in M.lexical_logits(f).collect()}
    for size in (1, 3, 32):
        got = M.score_by_name(f, "lexical-overlap", batch_size=size).collect()
        assert {r.feature_id: r.start_logits for r in got} == want
    bonus = {r.feature_id: r.start_logits for r in M.score_by_name(f, "lexical-sixteenths").collect()}
    assert bonus[1] == [0, 0, 0, 0, 0, 1 + 5 / 16, 0]
    with pytest.raises(ValueError):
        M.score_by_name(f, "unknown")


def test_row_expectations_on_different_sides(spark):
    from spanlake.operators.checks import row_expectations
    f = spark.createDataFrame([(1,), (2,), (2,), (3,)], "feature_id int")
    lg = spark.createDataFrame([(2,), (4,), (4,)], "feature_id int")
    splits = spark.createDataFrame([("train",)], "split string")
    r = row_expectations(f, lg, splits, 600, 512).first()
    assert tuple(r) == (4, 3, 2, 2, False, False, 512)
    empty = row_expectations(f.limit(0), lg.limit(0), splits.limit(0), 600, 512).first()
    assert tuple(empty) == (0, 0, 0, 0, True, False, 512)
