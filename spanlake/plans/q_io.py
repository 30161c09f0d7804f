"""Round trips through the sinks and sources.

Each query writes to a fresh folder under the shared checkpoint folder and
returns what reading it back gives; the oracle is the SQL of the source query.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators import cleaning as C
from spanlake.operators import decode as D
from spanlake.operators import evaluate as E
from spanlake.operators.common import r6
from spanlake.plans import q_decode, q_evaluate, q_retrieval, q_text
from spanlake.plans.registry import register
from spanlake.session import scratch_path, written
from spanlake.sources import fixtures as FX
from spanlake.sources import io as S


@register("roundtrip_corpus_json", q_text.CLEAN_CORPUS_SQL)
def roundtrip_corpus_json(spark, sf):
    clean = C.clean_corpus_frame(q_text.raw_corpus(spark, sf))
    path = scratch_path(spark, "corpus")
    S.write_corpus(clean, path, "json")
    back = S.read_corpus_lines(spark, path)
    return back.select("doc_key", "text", "title", F.col("document_id").cast("bigint").alias("document_id"))


@register("roundtrip_hits_csv", q_retrieval.HITS_WIDE_SQL)
def roundtrip_hits_csv(spark, sf):
    wide = q_retrieval.hits_wide(spark, sf)
    path = scratch_path(spark, "hits")
    # another order of columns: they are read by their names
    S.write_hits_csv(wide.select("id", *reversed(wide.columns[1:])), path)
    return S.read_hits_csv(spark, path, q_retrieval.K, T.LongType())


@register("roundtrip_nbest_json", q_decode.PROB_SQL)
def roundtrip_nbest_json(spark, sf):
    rows = D.nbest_rows(D.decode(FX.decode_examples(spark, sf), FX.eval_features(spark, sf)))
    path = scratch_path(spark, "nbest")
    written = S.write_nbest(rows, path, prefix="m0")
    back = S.read_nbest_lines(spark, written, "bigint")
    return back.select(F.col("id").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                       "text", "start_logit", "end_logit", r6("probability").alias("probability"))


METRICS_SQL = f"""
with {q_evaluate.SCORE_CTES},
m as (select round(avg(exact_match) * 100, 6) as eval_exact_match, round(avg(f1) * 100, 6) as eval_f1,
             count(*)::bigint as eval_samples, count(*) filter (missing)::bigint as eval_missing from sc2)
select 'eval_exact_match = ' || eval_exact_match::varchar as line from m
union all select 'eval_f1 = ' || eval_f1::varchar from m
union all select 'eval_samples = ' || eval_samples::varchar from m
union all select 'eval_missing = ' || eval_missing::varchar from m
"""


@register("metrics_lines", METRICS_SQL)
def metrics_lines(spark, sf):
    m = E.evaluate(FX.shifted_predictions(spark, sf), FX.qa_examples(spark, sf))
    m = m.select(r6("eval_exact_match").alias("eval_exact_match"), r6("eval_f1").alias("eval_f1"),
                 "eval_samples", "eval_missing")
    path = scratch_path(spark, "metrics")
    S.write_metrics_lines(m, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("roundtrip_predictions_json", q_decode.FINAL_SQL)
def roundtrip_predictions_json(spark, sf):
    a = D.final_answers(D.decode(FX.decode_examples(spark, sf), FX.eval_features(spark, sf)))
    path = scratch_path(spark, "pred")
    written = S.write_predictions(a, path, prefix="m0")
    back = spark.read.schema("id bigint, prediction_text string").json(written)
    return back.select(F.col("id").cast("bigint").alias("id"), "prediction_text")


@register("roundtrip_splits", q_text.SHIFT_SQL)
def roundtrip_splits(spark, sf):
    shifted = q_text.clean_qa_shift_answer(spark, sf)
    path = scratch_path(spark, "splits")
    S.write_splits(shifted, path, ("split",))
    back = S.read_split(spark, path, "train").unionByName(S.read_split(spark, path, "validation"))
    return back.select("id", "split", "context", "answer_start", "answer_text")



SCHEMA_SQL = f"""
with {q_retrieval.CONTEXT_SQL.strip()[len("with "):].rsplit("select q.id", 1)[0]}
select coalesce(c.context, '') as context, q.id::varchar as id, q.question
from questions q left join c using (id)
"""


@register("enforced_schema", SCHEMA_SQL)
def enforced_schema(spark, sf):
    """The joined examples with the declared column order and types."""
    return S.enforce_schema(q_retrieval.retrieved_context(spark, sf), S.JOINED_EXAMPLE)


@register("roundtrip_null_odds_json", q_decode.NULL_ODDS_SQL)
def roundtrip_null_odds_json(spark, sf):
    odds = q_decode.null_odds(spark, sf)
    written = S.write_null_odds(odds, scratch_path(spark, "odds"), prefix="m0")
    return spark.read.schema("id bigint, score_diff double").json(written)


OBJECT_SQL = """
select doc_id::varchar as doc_key, text, doc_id::bigint as document_id from documents
"""


@register("corpus_object", OBJECT_SQL)
def corpus_object(spark, sf):
    """A corpus of JSON object files, as many per source as its size takes."""
    d = FX.corpus(spark, sf)
    entry = F.struct("text", "title", F.col("doc_id").alias("document_id"))
    d = S.with_object(d, "doc_id", entry, group="source")
    objects = d.groupBy("source", "object").agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.col("doc_id").cast("string"), entry)))).alias("value"))
    path = scratch_path(spark, "objects")
    objects.select("source", "object", "value").write.partitionBy("source", "object").text(path)
    return S.read_corpus_object(spark, path).select("doc_key", "text", "document_id")


@register("nbest_object", q_decode.PROB_SQL)
def nbest_object(spark, sf):
    """N-best lists of JSON object files, a hundred of them or as many as the size takes."""
    rows = D.nbest_rows(D.decode(FX.decode_examples(spark, sf), FX.eval_features(spark, sf)))
    item = F.struct("rank", F.struct("start_logit", "end_logit", "text", "probability").alias("p"))
    lists = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("preds"))
    lists = S.with_object(written(lists, "nbest-lists"), "id", F.col("preds"), least=100, out="file")
    objects = lists.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.col("id").cast("string"), "preds")))).alias("value"))
    path = scratch_path(spark, "nbest-objects")
    objects.write.partitionBy("file").text(path)
    back = S.read_nbest_object(spark, path)
    return back.select(F.col("id").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                       "text", "start_logit", "end_logit", r6("probability").alias("probability"))


RANGE = 1 << 20  # bytes of an object file for one task


@register("corpus_object_split", OBJECT_SQL)
def corpus_object_split(spark, sf):
    """The whole corpus as one JSON object, written by all tasks and read by ranges."""
    d = FX.corpus(spark, sf)
    path = S.write_object(d, f"{scratch_path(spark, 'corpus')}/corpus.json", "doc_id",
                          F.struct("text", "title", F.col("doc_id").alias("document_id")))
    return S.read_corpus_split(spark, path, RANGE).select("doc_key", "text", "document_id")


@register("nbest_object_split", q_decode.PROB_SQL)
def nbest_object_split(spark, sf):
    """S8 + S10: all n-best lists as one JSON object, written by all tasks and read by ranges."""
    rows = D.nbest_rows(D.decode(FX.decode_examples(spark, sf), FX.eval_features(spark, sf)))
    path = S.write_nbest_object(rows, scratch_path(spark, "nbest"), prefix="m0")
    back = S.read_nbest_split(spark, path, RANGE)
    return back.select(F.col("id").cast("bigint").alias("id"), F.col("rank").cast("bigint").alias("rank"),
                       "text", "start_logit", "end_logit", r6("probability").alias("probability"))


@register("predictions_object", q_decode.FINAL_SQL)
def predictions_object(spark, sf):
    """All predictions as one JSON object."""
    a = D.final_answers(D.decode(FX.decode_examples(spark, sf), FX.eval_features(spark, sf)))
    path = S.write_predictions_object(a, scratch_path(spark, "pred"), prefix="m0")
    return S.read_object_of(spark, path, "string", "prediction_text", "bigint", RANGE)


@register("null_odds_object", q_decode.NULL_ODDS_SQL)
def null_odds_object(spark, sf):
    """All null odds as one JSON object."""
    path = S.write_null_odds_object(q_decode.null_odds(spark, sf), scratch_path(spark, "odds"), prefix="m0")
    return S.read_object_of(spark, path, "double", "score_diff", "bigint", RANGE)
