"""Top logits and candidate spans against plain loops over Spark's order."""

import math
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from spanlake.operators import decode as D
from spanlake.operators import spans
from spanlake.sources import fixtures as FX

NAN = float("nan")
FEATURES = "feature_id long, example_id long, start_logits array<float>, end_logits array<double>, " \
           "offset_mapping array<struct<start:int,end:int>>, token_is_max_context map<string,boolean>"


def plain_top(logits, n):
    """Nulls first, then from large to small with NaN last, higher index first."""
    def key(i):
        x = logits[i]
        return (0, 0, -i) if x is None else (2, 0, -i) if math.isnan(x) else (1, -x, -i)
    return [(i, logits[i], r) for r, i in enumerate(sorted(range(len(logits)), key=key)[:n])]


def plain_candidates(f, n, longest, cut):
    _, _, s, e, offs, marks = f
    if s is None or e is None or offs is None:
        return []
    out = []
    for i, a, ra in plain_top(s, n):
        for j, b, rb in plain_top(e, n):
            if i >= len(offs) or j >= len(offs) or offs[i] is None or offs[j] is None or not 0 <= j - i < longest:
                continue
            if marks is not None and not marks.get(str(i)):
                continue
            score = None if a is None or b is None else a + b
            out.append((ra, rb, i, j, a, b, score, offs[i][0], offs[j][1]))
    if not cut:
        return out

    def order(x, y):
        def key(c):
            return (0, 0) if c[6] is None else (2, 0) if math.isnan(c[6]) else (1, -c[6])
        return (key(x) > key(y)) - (key(x) < key(y)) or (x[:2] > y[:2]) - (x[:2] < y[:2])
    return sorted(out, key=cmp_to_key(order))[:n]


def features():
    rows = []
    for k in range(40):
        size = (0, 1, 5, 12)[k % 4]
        s = [float((i * 7 + k) % 5) for i in range(size)]
        e = [float((i * 3 + k) % 4) - 1 for i in range(size + k % 2)]
        offs = [None if i % 6 == 0 else (i * 3, None if i % 7 == 5 else i * 3 + 2) for i in range(size - (k % 5 == 0))]
        marks = None if k % 3 == 0 else {str(i): None if i == 4 else i % 3 != 0 for i in range(0, size, 1 + k % 2)} | {"x": True, "01": True}
        if size > 3 and k % 8 == 2:
            s[2], s[3], e[1] = None, NAN, None
        if size > 3 and k % 8 == 7:
            s[1], s[2], e[3] = -0.0, 0.0, float("-inf")
        rows.append((k, k // 2, s, e, offs, marks))
    return rows + [(90, 9, None, [1.0], [(0, 1)], None), (91, 9, [1.0], None, [(0, 1)], None), (92, 9, [1.0], [1.0], None, None)]


def shown(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("pairs", [1, spans.SLICE_PAIRS])
def test_top_indexes(spark, monkeypatch, pairs):
    monkeypatch.setattr(spans, "SLICE_PAIRS", pairs)
    given = [r for r in features() if r[2] is not None]
    df = spark.createDataFrame(features(), FEATURES).repartition(2)
    got = df.select("feature_id", D.top_indexes(F.col("start_logits"), 4).alias("t")).collect()
    assert [r["feature_id"] for r in got if r["t"] is None] == [90]
    want = [(f[0], *t) for f in given for t in plain_top(f[2], 4)]
    assert shown((r["feature_id"], *t) for r in got if r["t"] is not None for t in r["t"]) == shown(want)


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("pairs", [1, spans.SLICE_PAIRS])
def test_candidates(spark, monkeypatch, pairs, cut):
    monkeypatch.setattr(spans, "SLICE_PAIRS", pairs)
    df = spark.createDataFrame(features(), FEATURES).repartition(2)
    got = D.feature_candidates(df, 4, 3, per_feature_cut=cut).collect()
    want = [(f[1], f[0], *c) for f in features() for c in plain_candidates(f, 4, 3, cut)]
    assert len(want) > 30 and shown(got) == shown(want)


def test_tasks_grow_with_the_features(spark, tmp_path, monkeypatch):
    """the tasks that decode features were as many as the bytes took."""
    monkeypatch.setattr(FX, "FEATURES_PER_TASK", 10)
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(7).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    tasks = [len(part) for part in FX.eval_features(spark, str(tmp_path)).select("feature_id").rdd.glom().collect()]
    assert len(tasks) == 20 and sum(tasks) == 200 and max(tasks) <= 40
