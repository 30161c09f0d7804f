"""Stand-ins for the reference's inputs, derived by Spark from the synthetic tables.

Every derivation is a projection of whole tables (no row subsets), so the work of
each query grows with the data. ``plans/sqlparts.py`` derives the same rows with
DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.sources.tables import table

# Fixture rules (shared with the oracle SQL).
TITLE_CHARS = 40  # a title, which is also a question, is short: the reference's are names
TITLE_PATTERN = rf"^([^.\n]{{0,{TITLE_CHARS}}})"
ANSWER_LEN = 24
QUESTION_POSITIONS = 8  # feature positions 0..7 belong to the question
FEATURES_PER_EXAMPLE = 2
FEATURES_PER_TASK = 1 << 14  # decoded by one task, some seconds of work


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows ``(doc_id, title, text, source, lang)``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.regexp_extract("text", TITLE_PATTERN, 1).alias("title"),
        "text", "source", "lang")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test questions ``(id, question)`` from the benchmark table."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("question"))


def qa_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples with the reference's schema plus ``split``."""
    d = table(spark, sf_dir, "documents")
    start = (F.col("doc_id") * 131) % F.greatest(F.col("n_chars") - ANSWER_LEN, F.lit(1))
    answered = (F.col("doc_id") % 10) != 0
    ans_text = F.substr(F.col("text"), start + 1, F.lit(ANSWER_LEN))
    answers = F.when(
        answered,
        F.struct(F.array(start.cast("int")).alias("answer_start"),
                 F.array(ans_text).alias("text")),
    ).otherwise(
        F.struct(F.array().cast("array<int>").alias("answer_start"),
                 F.array().cast("array<string>").alias("text")))
    title = F.regexp_extract("text", TITLE_PATTERN, 1)
    return d.select(
        title.alias("title"),
        F.col("text").alias("context"),
        title.alias("question"),
        F.col("doc_id").alias("id"),
        answers.alias("answers"),
        F.col("doc_id").alias("document_id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split"),
    )


def decode_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples for span decoding: every document is an example ``(id, context)``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("context"))


def eval_features(spark: SparkSession, sf_dir: str, variant: str = "se") -> DataFrame:
    """Features and logits: every document is an example with ``FEATURES_PER_EXAMPLE``
    features, whose logits are vectors of the embeddings table.

    ``feature_id = doc_id * 2 + j`` takes the vector ``feature_id`` modulo their number;
    start logits are the embedding and end logits the reversed embedding (``variant``
    picks the pair: ``se`` = (e, reverse e), ``es`` = (reverse e, e), ``ee`` = (e, e)).
    Positions 0..7 are question tokens (null offsets); position i >= 8 maps to
    characters ``[i*4 + 8*j, +3)``. ``token_is_max_context`` is null for even
    ``feature_id``, else ``{str(i): i % 3 <> 0}``.
    """
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.count("*")).scalar()
    docs = table(spark, sf_dir, "documents")
    tasks = max(spark.sparkContext.defaultParallelism, -(-docs.count() * FEATURES_PER_EXAMPLE // FEATURES_PER_TASK))
    d = docs.select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(FEATURES_PER_EXAMPLE - 1))).alias("j"))
    d = d.withColumn("feature_id", F.col("doc_id") * FEATURES_PER_EXAMPLE + F.col("j"))
    # The decoding of a feature takes far longer than its bytes tell: the features go to
    # tasks by their number, those of an example together. Variants share this exchange.
    e = d.withColumn("vec_id", F.col("feature_id") % n).join(e, "vec_id").drop("vec_id").repartition(tasks, "doc_id")
    emb = F.col("embedding")
    rev = F.reverse(emb)
    start, end = {"se": (emb, rev), "es": (rev, emb), "ee": (emb, emb)}[variant]
    base = F.col("j") * 8
    positions = F.sequence(F.lit(0), F.size(emb) - 1)
    offsets = F.transform(
        positions,
        lambda i: F.when(
            i >= QUESTION_POSITIONS,
            F.struct((i * 4 + base).cast("int").alias("start"),
                     (i * 4 + base + 3).cast("int").alias("end"))))
    max_ctx = F.when(
        F.col("feature_id") % 2 == 1,
        F.map_from_arrays(F.transform(positions, lambda i: i.cast("string")),
                          F.transform(positions, lambda i: (i % 3) != 0)))
    return e.select(
        "feature_id",
        F.col("doc_id").alias("example_id"),
        start.alias("start_logits"),
        end.alias("end_logits"),
        offsets.alias("offset_mapping"),
        max_ctx.alias("token_is_max_context"),
    )


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the raw web pages ``(page_id, title)`` (the term-dictionary source)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation log ``(run, step, metric)`` from the events table; every 97th run
    diverged (its metric is NaN)."""
    ev = table(spark, sf_dir, "events")
    metric = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return ev.select(F.col("event_type").alias("run"),
                     (F.col("event_id") * 100).alias("step"), metric.alias("metric"))


def shifted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for scoring: the gold span shifted by ``doc_id % 7 - 3``
    characters (exact for one example in seven); ``''`` when unanswered; none at all
    for one example in thirteen."""
    qa = qa_examples(spark, sf_dir)
    s = F.get("answers.answer_start", 0)
    start = F.greatest(s + (F.col("id") % 7) - 3, F.lit(0))
    text = F.when(s.isNull(), F.lit("")).otherwise(F.substr(F.col("context"), start + 1, F.lit(ANSWER_LEN)))
    return qa.where(F.col("id") % 13 != 4).select("id", text.alias("prediction_text"))
