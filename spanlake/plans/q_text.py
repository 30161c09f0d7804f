"""Text cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import clean_qa, sql_clean_corpus, sql_clean_qa, sql_squad_normalize, squad_normalize
from spanlake.operators import cleaning as C
from spanlake.operators import positions as Po
from spanlake.plans.registry import register
from spanlake.plans.sqlparts import QA, TITLE
from spanlake.sources import fixtures as FX
from spanlake.sources.tables import table

CLEAN_TEXT_SQL = f"select doc_id::bigint as doc_id, {sql_clean_qa('text')} as text from documents"


@register("clean_text", CLEAN_TEXT_SQL)
def clean_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_qa("text").alias("text"))


def raw_corpus(spark, sf):
    """The reference's raw corpus shape, from the documents table."""
    d = table(spark, sf, "documents")
    s = F.lit(None).cast("string")
    return d.select(F.col("doc_id").cast("string").alias("doc_key"), "text",
                    F.regexp_extract("text", FX.TITLE_PATTERN, 1).alias("title"),
                    F.col("source").alias("corpus_source"), s.alias("url"), F.col("lang").alias("domain"),
                    s.alias("author"), s.alias("html"), F.col("doc_id").alias("document_id"))


CLEAN_CORPUS_SQL = f"""
select doc_id::varchar as doc_key, {sql_clean_corpus('text')} as text, {TITLE} as title,
       doc_id::bigint as document_id from documents
"""


@register("clean_corpus", CLEAN_CORPUS_SQL)
def clean_corpus_q(spark, sf):
    out = C.clean_corpus_frame(raw_corpus(spark, sf))
    return out.select("doc_key", "text", "title", F.col("document_id").cast("bigint").alias("document_id"))


_CB = sql_clean_qa("substr(context, 1, answer_start)")
_CA = sql_clean_qa("substr(context, answer_start + 1)")
SHIFTED = f"""shifted as (select id, split,
  case when answer_start is null then {sql_clean_qa('context')} else {_CB} || {_CA} end as context,
  case when answer_start is null then null else length({_CB}) end as answer_start,
  {sql_clean_qa('answer_text')} as answer_text from qa)"""

SHIFT_SQL = f"""
with {QA}, {SHIFTED}
select id::bigint as id, split, context, answer_start::bigint as answer_start, answer_text from shifted
"""


def _shifted(spark, sf):
    return C.clean_and_shift(FX.qa_examples(spark, sf))


@register("clean_qa_shift_answer", SHIFT_SQL)
def clean_qa_shift_answer(spark, sf):
    s = _shifted(spark, sf)
    return s.select(F.col("id").cast("bigint").alias("id"), "split", "context",
                    C.first_answer_start().cast("bigint").alias("answer_start"),
                    F.get("answers.text", 0).alias("answer_text"))


SPAN_CHECK_SQL = f"""
with {QA}, {SHIFTED}
select id::bigint as id, answer_start::bigint as answer_start, answer_text as expected,
       substr(context, answer_start + 1, length(answer_text)) as found,
       substr(context, answer_start + 1, length(answer_text)) = answer_text as ok
from shifted where answer_start is not null
"""


@register("answer_span_check", SPAN_CHECK_SQL)
def answer_span_check(spark, sf):
    out = C.answer_span_check(_shifted(spark, sf))
    return out.select(F.col("id").cast("bigint").alias("id"), F.col("answer_start").cast("bigint").alias("answer_start"),
                      "expected", "found", "ok")


NORMALIZE_SQL = f"""
with {QA}
select id::bigint as id, {sql_squad_normalize('answer_text')} as normalized from qa
"""


@register("answer_normalize", NORMALIZE_SQL)
def answer_normalize(spark, sf):
    qa = FX.qa_examples(spark, sf)
    return qa.select(F.col("id").cast("bigint").alias("id"),
                     squad_normalize(F.get("answers.text", 0)).alias("normalized"))


# Three answers of each example: the fixture's, one elsewhere and the first sentence.
def _places(clean_of):
    at = "((doc_id * {}) % greatest(n_chars - 24, 1))".format
    return f"""spans as (
  select doc_id as id, text as context, unnest([0, 1, 2]) as n, unnest([{at(131)}, {at(977)}, 0]) as s,
         unnest([{at(131)} + 24, {at(977)} + 24, length({TITLE})]) as e from documents),
cut as (select id, n, context, least(s, length(context)) as s, least(greatest(e, s), length(context)) as e from spans),
moved as (select id, n, length({clean_of('substr(context, 1, s)')}) as a, length({clean_of('substr(context, 1, e)')}) as b,
                 {clean_of('context')} as clean from cut)"""


POSITIONS_SQL = f"""
with {_places(sql_clean_qa)}
select id::bigint as id, n::bigint as n, a::bigint as new_start, b::bigint as new_end,
       substr(clean, a + 1, b - a) as text, substr(clean, a + 1, b - a) as raw_text_cleaned
from moved
"""


@register("answer_positions", POSITIONS_SQL)
def answer_positions(spark, sf):
    """T3 for all answers: every answer's place in the cleaned context, and the same span
    found again in the raw one."""
    d = table(spark, sf, "documents")

    def at(k):
        return (F.col("doc_id") * k) % F.greatest(F.col("n_chars") - FX.ANSWER_LEN, F.lit(1))
    starts = F.array(at(131), at(977), F.lit(0).cast("bigint"))
    texts = F.array(F.lpad(F.lit(""), FX.ANSWER_LEN, "x"), F.lpad(F.lit(""), FX.ANSWER_LEN, "x"),
                    F.regexp_extract("text", FX.TITLE_PATTERN, 1))
    spans = F.transform(F.arrays_zip(starts.alias("s"), texts.alias("t")), lambda a: F.struct(
        a["s"].cast("int").alias("start"), (a["s"] + F.length(a["t"])).cast("int").alias("end")))
    moved = Po.to_cleaned(d.select(F.col("doc_id").alias("id"), "text", spans.alias("spans")), F.col("spans"), "moved", "text")
    back = Po.to_raw(moved, F.col("moved"), "back", "text").withColumn("clean", clean_qa("text"))
    rows = back.select("id", "text", "clean", F.posexplode(F.arrays_zip("moved", "back")).alias("n", "p"))
    a, b = F.col("p.moved.start"), F.col("p.moved.end")
    raw = F.substr("text", F.col("p.back.start") + 1, F.col("p.back.end") - F.col("p.back.start"))
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n"),
                       a.cast("bigint").alias("new_start"), b.cast("bigint").alias("new_end"),
                       F.substr("clean", a + 1, b - a).alias("text"), clean_qa(raw).alias("raw_text_cleaned"))
