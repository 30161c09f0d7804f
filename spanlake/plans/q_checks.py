"""Column-role and expectation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import checks as P
from spanlake.operators import observed as Ob
from spanlake.plans.registry import register
from spanlake.plans.sqlparts import QA
from spanlake.sources import fixtures as FX
from spanlake.sources import io as S
from spanlake.sources.tables import table

ROLES_SQL = f"""
with {QA}
select id::bigint as id, question, context, answer_text from qa
"""


@register("column_roles", ROLES_SQL)
def column_roles(spark, sf):
    qa = FX.qa_examples(spark, sf)
    # Non-standard names: the roles fall back to positions 0, 1, 2.
    odd = qa.select(F.col("question").alias("q_text"), F.col("context").alias("passage"),
                    F.col("answers").alias("labels"), "id")
    out = P.select_roles(odd, keep=("id",))
    return out.select(F.col("id").cast("bigint").alias("id"), "question", "context",
                      F.get("answers.text", 0).alias("answer_text"))


# The sides differ: features without logits, and logits without a feature.
EXPECT_SQL = """
with f as (select doc_id as feature_id from documents),
l as (select vec_id * 2 as feature_id from embeddings)
select (select count(*) from f)::bigint as n_features,
       (select count(*) from l)::bigint as n_logits,
       (select count(*) from f where feature_id not in (select feature_id from l))::bigint as features_without_logits,
       (select count(*) from l where feature_id not in (select feature_id from f))::bigint as logits_without_features,
       (select count(*) from f) = (select count(*) from l) as counts_match,
       (select count(*) from documents where doc_id % 5 = 0) > 0 as has_validation,
       least(200, 512)::bigint as max_seq_length
"""


@register("row_expectations", EXPECT_SQL)
def row_expectations(spark, sf):
    feats = table(spark, sf, "documents").select(F.col("doc_id").alias("feature_id"))
    logits = table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("feature_id"))
    return P.row_expectations(feats, logits, FX.qa_examples(spark, sf), 200, 512)


@register("observed_expectations", EXPECT_SQL)
def observed_expectations(spark, sf):
    """P4 counted by the write of both sides."""
    feats = table(spark, sf, "documents").select(F.col("doc_id").alias("feature_id"))
    logits = table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("feature_id"), "embedding")
    return Ob.observed_expectations(feats, logits, FX.qa_examples(spark, sf), 200, 512)[2]


ROWS_SQL = f"""
with {QA}
select id::varchar as id, coalesce(answer_text, '') as prediction_text, answer_start::bigint as answer_start
from qa
"""


@register("prediction_rows", ROWS_SQL)
def prediction_rows(spark, sf):
    """P5: maps of predictions (one per file of bounded size) and the references."""
    qa = FX.qa_examples(spark, sf)
    text = F.coalesce(F.get("answers.text", 0), F.lit(""))
    maps = S.with_object(qa, "id", text, least=100, out="file").groupBy("file").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("id").cast("string"), text))).alias("predictions"))
    refs = P.references(qa).select(F.col("id").cast("string").alias("id"),
                                   F.get("answers.answer_start", 0).cast("bigint").alias("answer_start"))
    return P.predictions_to_rows(maps).join(refs, "id")
