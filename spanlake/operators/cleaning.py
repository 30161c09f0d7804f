"""Cleaning of corpora and labelled QA examples.

All row-local: no shuffle, whole-stage codegen, works on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import clean_corpus, clean_qa
from spanlake.operators.common import require_columns

CORPUS_METADATA = ("corpus_source", "url", "domain", "author", "html")


def clean_corpus_frame(raw: DataFrame, text: str = "text",
                       drop: tuple[str, ...] = CORPUS_METADATA) -> DataFrame:
    """T2 + P1: clean the corpus text and drop the metadata columns.

    A missing metadata column is an error (``DataFrame.drop`` alone is silent).
    ``document_id`` is kept: it is the key the index declares.
    """
    require_columns(raw, (text,) + tuple(drop), "raw corpus")
    return raw.withColumn(text, clean_corpus(text)).drop(*drop)


def first_answer_start(answers: str = "answers") -> Column:
    return F.get(F.col(f"{answers}.answer_start"), 0)


def clean_and_shift(df: DataFrame, context: str = "context", answers: str = "answers") -> DataFrame:
    """Clean a context without losing the first answer's position.

    The context is cut at ``answer_start[0]``; each half is cleaned on its own and
    the halves are concatenated, so the new start is the cleaned length of the
    first half. Every answer text is cleaned. Only ``answer_start[0]`` moves (the
    reference's contract). An example without answers gets its context cleaned
    as a whole.
    """
    start = first_answer_start(answers)
    ctx = F.col(context)
    # The cleaned halves are projected once (null without an answer): used in two
    # conditional branches, they would otherwise be computed twice.
    staged = df.withColumns({
        "_cb": clean_qa(F.substr(ctx, F.lit(1), start)),
        "_ca": clean_qa(F.substr(ctx, start + 1)),
    })
    new_ctx = F.when(start.isNull(), clean_qa(ctx)).otherwise(F.concat("_cb", "_ca"))
    old_starts = F.col(f"{answers}.answer_start")
    new_starts = F.when(start.isNull(), old_starts).otherwise(
        F.concat(F.array(F.length("_cb").cast("int")),
                 F.slice(old_starts, 2, F.greatest(F.size(old_starts) - 1, F.lit(0)))))
    new_answers = F.struct(new_starts.alias("answer_start"),
                           F.transform(F.col(f"{answers}.text"), clean_qa).alias("text"))
    # One projection: both new columns must read the original context.
    return staged.withColumns({context: new_ctx, answers: new_answers}).drop("_cb", "_ca")


def answer_span_check(df: DataFrame, context: str = "context", answers: str = "answers") -> DataFrame:
    """For every answered example, compare ``answers.text[0]`` with the context
    slice at ``answer_start[0]``; returns every row with ``ok`` (not only the first
    bad one)."""
    start = first_answer_start(answers)
    text = F.get(F.col(f"{answers}.text"), 0)
    found = F.substr(F.col(context), start + 1, F.length(text))
    return (df.where(start.isNotNull())
            .select("id", start.alias("answer_start"), text.alias("expected"), found.alias("found"),
                    (found == text).alias("ok")))
