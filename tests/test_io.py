"""S1-S12 round trips on hand-made rows (quotes, commas, newlines, nulls, blanks)."""

import json
import os

from spanlake.session import scratch_path
from spanlake.sources import io as S


def local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_corpus_object_and_lines(spark):
    corpus = {str(i): {"text": f"t{i}\n\"q\"", "title": f"T{i}", "corpus_source": "w", "url": None, "domain": None,
                       "author": None, "html": None, "document_id": i} for i in range(3)}
    path = scratch_path(spark, "corpus-object")
    os.makedirs(local(path), exist_ok=True)
    with open(os.path.join(local(path), "wiki.json"), "w", encoding="utf-8") as f:
        json.dump(corpus, f)
    df = S.read_corpus_object(spark, path)
    rows = {r.doc_key: r for r in df.collect()}
    assert rows["2"].text == "t2\n\"q\"" and rows["1"].document_id == 1
    out = scratch_path(spark, "corpus-lines")
    S.write_corpus(df, out, "json")
    back = {r.doc_key: r for r in S.read_corpus_lines(spark, out).collect()}
    assert back == rows


TRICKY = ["plain", "with, comma", 'with "quotes"', "new\nline", "crlf\r\nline", "  edge blanks  ", "", None,
          "back\\slash", "한국어 ‘curly’"]


def test_hits_csv_round_trip(spark):
    k = 3
    rows = []
    for i, t in enumerate(TRICKY):
        rows.append((str(i), t, TRICKY[(i + 1) % len(TRICKY)], None, 1.5 * i, None if i % 2 else -0.25, 3.0))
    df = spark.createDataFrame(rows, S.hits_schema(k))
    path = scratch_path(spark, "hits")
    S.write_hits_csv(df, path)
    back = S.read_hits_csv(spark, path, k)
    assert sorted(back.collect()) == sorted(df.collect())


def test_hits_csv_with_index_column(spark):
    path = scratch_path(spark, "hits-pandas")
    os.makedirs(local(path), exist_ok=True)
    with open(os.path.join(local(path), "hits.csv"), "w") as f:
        f.write(',id,text1,score1\n0,q1,"a, ""b""",1.5\n1,q2,x,2.0\n')
    back = S.read_hits_csv(spark, path, 1).orderBy("id").collect()
    assert [(r.id, r.text1, r.score1) for r in back] == [("q1", 'a, "b"', 1.5), ("q2", "x", 2.0)]


def test_nbest_object_and_lines(spark):
    obj = {"q1": [{"start_logit": 1.0, "end_logit": 2.0, "text": "a", "probability": 0.7},
                  {"start_logit": 0.5, "end_logit": 0.1, "text": "b", "probability": 0.3}],
           "q2": [{"start_logit": 0.0, "end_logit": 0.0, "text": "empty", "probability": 1.0}]}
    path = scratch_path(spark, "nbest-object")
    os.makedirs(local(path), exist_ok=True)
    with open(os.path.join(local(path), "nbest_predictions.json"), "w") as f:
        json.dump(obj, f)
    rows = S.read_nbest_object(spark, path)
    got = sorted((r.id, r.rank, r.text, r.probability) for r in rows.collect())
    assert got == [("q1", 1, "a", 0.7), ("q1", 2, "b", 0.3), ("q2", 1, "empty", 1.0)]
    out = S.write_nbest(rows, scratch_path(spark, "nbest-lines"), prefix="m1")
    assert out.endswith("nbest_predictions_m1")
    back = sorted((r.id, r.rank, r.text, r.probability) for r in S.read_nbest_lines(spark, out).collect())
    assert back == got


def test_predictions_file_name(spark):
    p = spark.createDataFrame([("q1", "ans"), ("q2", "")], "id string, prediction_text string")
    out = S.write_predictions(p, scratch_path(spark, "pred"))
    assert out.endswith("/predictions")
    back = spark.read.schema("id string, prediction_text string").json(out)
    assert sorted(map(tuple, back.collect())) == [("q1", "ans"), ("q2", "")]


def test_hits_csv_columns_go_by_name(spark):
    path = scratch_path(spark, "hits-reordered")
    os.makedirs(local(path), exist_ok=True)
    with open(os.path.join(local(path), "hits.csv"), "w") as f:
        f.write("score1,id,text1\n1.5,q1,x\n")
    assert [tuple(r) for r in S.read_hits_csv(spark, path, 1).collect()] == [("q1", "x", 1.5)]
    try:
        S.read_hits_csv(spark, path, 2)
    except ValueError as e:
        assert "text2" in str(e)
    else:
        raise AssertionError("missing column accepted")


def test_metrics_lines_sorted(spark):
    m = spark.createDataFrame([(75.5, 80.25, 1000)], "eval_f1 double, eval_exact_match double, train_samples long")
    path = scratch_path(spark, "metrics")
    S.write_metrics_lines(m, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["eval_exact_match = 80.25", "eval_f1 = 75.5", "train_samples = 1000"]


def test_enforce_schema(spark):
    df = spark.createDataFrame([("c", 1, "q")], "context string, id int, question string")
    out = S.enforce_schema(df, S.JOINED_EXAMPLE)
    assert out.schema == S.JOINED_EXAMPLE
    try:
        S.enforce_schema(df.drop("question"), S.JOINED_EXAMPLE)
    except ValueError:
        pass
    else:
        raise AssertionError("missing column accepted")


def test_splits_partition_pruning(spark):
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "train")], "id int, split string")
    path = scratch_path(spark, "splits")
    S.write_splits(df, path)
    v = S.read_split(spark, path, "validation")
    assert [r.id for r in v.collect()] == [2]
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "validation" in plan


def test_prediction_map_rows_and_null_odds(spark):
    from spanlake.operators.checks import predictions_to_rows
    m = spark.createDataFrame([({"q1": "a", "q2": ""},)], "predictions map<string,string>")
    assert sorted(tuple(r) for r in predictions_to_rows(m).collect()) == [("q1", "a"), ("q2", "")]
    odds = spark.createDataFrame([("q1", 0.5), ("q2", -1.25)], "id string, score_diff double")
    out = S.write_null_odds(odds, scratch_path(spark, "odds"), prefix="m1")
    assert out.endswith("null_odds_m1")
    back = sorted(tuple(r) for r in spark.read.schema("id string, score_diff double").json(out).collect())
    assert back == [("q1", 0.5), ("q2", -1.25)]


def test_object_files_have_a_largest_size(spark, sf_small, monkeypatch):
    from urllib.parse import unquote, urlparse

    from pyspark.sql import functions as F

    from spanlake.operators import checks as P
    from spanlake.plans import q_checks, q_io

    def sizes(df):
        return [os.path.getsize(unquote(urlparse(f).path)) for f in df.inputFiles()]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    largest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    bound = 4 * largest
    monkeypatch.setattr(S, "MAX_OBJECT_BYTES", bound, raising=False)
    monkeypatch.setattr(S, "MAX_OBJECT_ROWS", 2 ** 40, raising=False)
    # one source holds every row, eight times over
    many = docs.crossJoin(spark.range(8).withColumnRenamed("id", "k")).select(
        (F.col("doc_id") * 8 + F.col("k")).alias("doc_id"), "text", F.lit("all").alias("source"), F.lit("t").alias("title"))
    monkeypatch.setattr(q_io.FX, "corpus", lambda spark, sf: many)
    back = q_io.corpus_object(spark, sf_small)
    assert max(sizes(back)) <= 2 * bound < sum(sizes(back)) / 2
    assert sorted(back.select("document_id", "text").collect()) == sorted(many.select("doc_id", "text").collect())

    monkeypatch.setattr(S, "MAX_OBJECT_BYTES", 8 << 20, raising=False)
    monkeypatch.setattr(S, "MAX_OBJECT_ROWS", 2, raising=False)
    lists = q_io.nbest_object(spark, sf_small)
    assert len(sizes(lists)) > 100 and lists.select("id").distinct().count() == docs.count()
    maps = []
    monkeypatch.setattr(P, "predictions_to_rows", lambda m, col="predictions", f=P.predictions_to_rows: maps.append(m) or f(m, col))
    rows = q_checks.prediction_rows(spark, sf_small).count()
    held = [r[0] for r in maps[0].select(F.size("predictions")).collect()]
    assert sum(held) == rows and len(held) > 100
