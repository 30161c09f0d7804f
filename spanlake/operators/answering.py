"""Questions to answers end to end: retrieval, windows, scorers, decoding, vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import decode as D
from spanlake.operators.common import r6
from spanlake.operators.ensemble import vote
from spanlake.operators.retrieval import retrieve_contexts
from spanlake.operators.scoring import SCORERS, score_many
from spanlake.operators.windows import WindowSpec, eval_features
from spanlake.session import written

KEYS = ["example_id", "feature_id"]


def scored_features(features: DataFrame, scorers: list[str], batch_size: int = 256) -> DataFrame:
    """Every scorer's logits beside every feature, as rows of a ``model`` (its number in
    the list), from one pass over the features, which have ``example_id`` and
    ``feature_id``. (Logits that come from outside are attached by D1 instead.)"""
    unknown = [name for name in scorers if name not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorers {unknown}; known: {sorted(SCORERS)}")
    made = {str(i): SCORERS[name] for i, name in enumerate(scorers)}
    scored = score_many(features, made, KEYS, ("input_ids", "sequence_ids", "q_ids"), ("offset_mapping",), batch_size)
    return scored.withColumn("model", F.col("model").cast("int"))


def answer_questions(corpus: DataFrame, questions: DataFrame, vocab: DataFrame, scorers: list[str], k: int = 10,
                     spec: WindowSpec = WindowSpec(max_seq_length=384), rule: str = "majority") -> DataFrame:
    """``(id, prediction_text)`` for every question: contexts of its ``k`` best passages,
    their windows scored by every scorer, decoded, and the scorers' answers put to the
    vote. Contexts and features are written once; all scorers read them."""
    contexts = written(retrieve_contexts(corpus, questions, k), "contexts")
    features = eval_features(contexts, vocab, spec).withColumn("feature_id", F.col("window").cast("bigint"))
    features = written(features.select(*KEYS, "input_ids", "sequence_ids", "q_ids", "offset_mapping"), "features")
    decoded = D.decode(contexts.select("id", "context"), scored_features(features, scorers),
                       models=list(range(len(scorers))))
    rows = D.nbest_rows(decoded).select("id", "model", "rank", "text", r6("probability").alias("probability"))
    return vote(rows, rule, len(scorers))
