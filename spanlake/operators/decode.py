"""Span decoding: start/end logits -> n-best answer spans.

Plan shape
----------
* D3-D5 run inside each feature row with array functions: the top ``n`` start
  and end indexes are sorted and sliced in-row, and only *valid* (start, end)
  pairs are generated (the validity predicate is applied before the pairs become
  rows). Each feature is then cut to its own best ``n`` candidates: the best
  ``n`` of an example are contained in the union of its features' best ``n``.
* D6 is ``row_number() <= n`` per example: Spark runs a partial
  ``WindowGroupLimit`` before the shuffle, so an example with very many features
  sends at most ``n`` rows per task over the network.
* After the cut, each example has at most ``n + 1`` candidates; they are gathered
  into one bounded array per example (no further shuffle: the window already
  partitioned by example), and D7-D10 run in-row on that array.
* Examples drive the final join, so an example without features still gets a
  row (the ``"empty"`` fallback).

Logits are cast to double before adding; ties follow the reference's loop
order (feature order, start rank, end rank); index ties inside a feature are
broken by the higher index first (documented choice for ``argsort`` ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators import spans
from spanlake.operators.common import explode_rows, let, posexplode_rows

N_BEST = 20
MAX_ANSWER_LENGTH = 30


def _model(df: DataFrame) -> list[str]:
    """Several models can be decoded in one plan: a ``model`` column, when present,
    is part of every grouping key."""
    return ["model"] if "model" in df.columns else []


def attach_logits(features: DataFrame, logits: DataFrame, key="feature_id") -> DataFrame:
    """Features + logits by key (the reference aligns by row position). A feature
    without logits, or logits without a feature, fail the query."""
    keys = [key] if isinstance(key, str) else list(key)
    f = features.withColumn("_f", F.lit(True))
    lg = logits.withColumn("_l", F.lit(True))
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    both = F.when(F.col("_f").isNull(), F.raise_error(F.concat(F.lit("logits without a feature: "), name))).when(
        F.col("_l").isNull(), F.raise_error(F.concat(F.lit("a feature without logits: "), name))).otherwise(F.lit(True))
    # the check decides which rows remain, so column pruning cannot drop it
    return f.join(lg, keys, "full").where(both).drop("_f", "_l")


def top_indexes(logits: Column, n: int) -> Column:
    """D3: ``array<struct<idx, logit, rank>>`` of the ``n`` largest logits;
    equal logits: higher index first."""
    return spans.top_of(logits, n)


def feature_candidates(features: DataFrame, n_best: int = N_BEST, max_answer_length: int = MAX_ANSWER_LENGTH,
                       use_max_context: bool = True, per_feature_cut: bool = True) -> DataFrame:
    """D3 + D4 (+ D5): one row per valid candidate span of each feature.

    Columns: ``example_id, feature_id, start_rank, end_rank, start_idx, end_idx,
    start_logit, end_logit, score, char_start, char_end``.
    """
    with_mc = use_max_context and "token_is_max_context" in features.columns
    given = [F.col("start_logits").alias("s"), F.col("end_logits").alias("e"), F.col("offset_mapping").alias("o")]
    if with_mc:
        given.append(F.col("token_is_max_context").alias("m"))
    place = features.schema["offset_mapping"].dataType.elementType
    chars = place["start"].dataType.simpleString(), place["end"].dataType.simpleString()
    # With the cut: the feature's own best n by (-score, start_rank, end_rank).
    cands = spans.candidates(F.struct(*given), n_best, max_answer_length, per_feature_cut, with_mc, chars)
    rows = explode_rows(features, cands, [*_model(features), "example_id", "feature_id"], "c")
    return rows.select(*_model(features), "example_id", "feature_id", "c.start_rank", "c.end_rank", "c.start_idx", "c.end_idx",
                       "c.start_logit", "c.end_logit", "c.score",
                       "c.char_start", "c.char_end")


def null_scores(features: DataFrame) -> DataFrame:
    """Per example, the minimum over its features of ``start[0] + end[0]``;
    the first feature wins ties. Partial aggregation keeps hot examples cheap."""
    s0 = F.get("start_logits", 0).cast("double")
    e0 = F.get("end_logits", 0).cast("double")
    best = F.min_by(F.struct((s0 + e0).alias("score"), s0.alias("start_logit"), e0.alias("end_logit"),
                             F.col("feature_id")),
                    F.struct(s0 + e0, F.col("feature_id")))
    keys = [*_model(features), "example_id"]
    return (features.groupBy(*keys).agg(best.alias("b"))
            .select(*keys, F.col("b.score").alias("null_score"),
                    F.col("b.start_logit").alias("null_start_logit"),
                    F.col("b.end_logit").alias("null_end_logit"),
                    F.col("b.feature_id").alias("null_feature_id")))


def example_topn(cands: DataFrame, n_best: int = N_BEST, nulls: DataFrame | None = None) -> DataFrame:
    """D6 (+ D7): the ``n`` best candidates per example with 1-based ``rank``.

    With ``nulls`` (null-answer mode) the minimum null candidate joins the list
    before the cut (after all real candidates on equal scores) and is kept even
    when the cut drops it, so a list may hold ``n + 1`` rows.
    """
    w = Window.partitionBy(*_model(cands), "example_id").orderBy(
        F.col("score").desc(), F.col("is_null").asc(), F.col("feature_id").asc(),
        F.col("start_rank").asc(), F.col("end_rank").asc())
    # Plain limit first: Spark adds a partial WindowGroupLimit, so a hot example
    # sends at most n rows per task through the shuffle.
    top = (cands.withColumn("is_null", F.lit(False))
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_best))
    if nulls is None:
        return top
    nrows = nulls.select(
            *_model(nulls), "example_id", F.col("null_feature_id").alias("feature_id"),
            F.lit(None).cast("int").alias("start_rank"), F.lit(None).cast("int").alias("end_rank"),
            F.lit(0).alias("start_idx"), F.lit(0).alias("end_idx"),
            F.col("null_start_logit").alias("start_logit"), F.col("null_end_logit").alias("end_logit"),
            F.col("null_score").alias("score"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"),
            F.lit(True).alias("is_null"))
    # The null candidate joins the (at most n) survivors and the list is re-cut;
    # if the cut drops it, it is appended at position n + 1.
    ranked = top.drop("rank").unionByName(nrows).withColumn("rank", F.row_number().over(w))
    return (ranked.where((F.col("rank") <= n_best) | F.col("is_null"))
            .withColumn("rank", F.least(F.col("rank"), F.lit(n_best + 1))))


def gather(topn: DataFrame) -> DataFrame:
    """Bounded per-example arrays (at most n + 1 entries), ordered by rank."""
    item = F.struct("rank", "feature_id", "start_idx", "end_idx", "start_logit", "end_logit", "score",
                    "char_start", "char_end", "is_null")
    return topn.groupBy(*_model(topn), "example_id").agg(F.array_sort(F.collect_list(item)).alias("cands"))


def decode(examples: DataFrame, features: DataFrame, n_best: int = N_BEST,
           max_answer_length: int = MAX_ANSWER_LENGTH, null_mode: bool = False,
           use_max_context: bool = True, models: list | None = None) -> DataFrame:
    """``(id, preds, null_score)`` where ``preds`` is the final n-best list
    ``array<struct<text, start_logit, end_logit, score, probability, is_null,
    feature_id, start_idx, end_idx>>`` in rank order (``"empty"`` fallback
    included).

    ``examples``: ``id, context``. ``features``: ``feature_id, example_id,
    offset_mapping, start_logits, end_logits[, token_is_max_context]``.

    Several models decode in one plan when ``features`` has a ``model`` column
    and ``models`` lists its values: every example gets one row per model, and
    the contexts are joined (shuffled) once for all models.
    """
    mk = _model(features)
    if mk and not models:
        raise ValueError("features have a model column: pass the list of models")
    cands = feature_candidates(features, n_best, max_answer_length, use_max_context)
    nulls = null_scores(features) if null_mode else None
    lists = gather(example_topn(cands, n_best, nulls))
    if nulls is not None:
        # The null candidate is kept in every list: read its score from the array
        # (no second aggregation of the features, no join).
        lists = lists.withColumn("null_score", F.get(F.filter("cands", lambda c: c["is_null"]), 0)["score"])
    else:
        lists = lists.withColumn("null_score", F.lit(None).cast("double"))
    ex = examples.select("id", "context")
    # All models' lists of an example come together before the contexts move, so these
    # are joined once; the models are exploded after the join. An example without any
    # list still has its row, and a duplicated example id is an error (the reference
    # keeps the last one silently): ids are counted without their texts.
    fields = F.struct(*([F.col("model")] if mk else []), "cands", "null_score")
    per_id = lists.groupBy(F.col("example_id").alias("id")).agg(F.collect_list(fields).alias("lists"))
    ids = ex.groupBy("id").agg(F.count("*").alias("n"))
    known = ids.join(per_id, "id", "left").withColumn("lists", F.when(F.col("n") > 1, F.raise_error(F.concat(
        F.lit("duplicate example id: "), F.col("id").cast("string")))).otherwise(F.col("lists"))).drop("n")
    joined = ex.join(known, "id")
    if mk:
        joined = joined.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        own = F.get(F.filter("lists", lambda x: x["model"] == F.col("model")), 0)
    else:
        own = F.get("lists", 0)
    joined = joined.withColumn("own", own).withColumn("cands", F.col("own.cands")).withColumn(
        "null_score", F.col("own.null_score"))
    ctx = F.col("context")
    texted = F.transform(
        F.coalesce(F.col("cands"), F.array().cast(lists.schema["cands"].dataType)),
        lambda c: F.struct(
            F.substr(ctx, c["char_start"] + 1, F.greatest(c["char_end"] - c["char_start"], F.lit(0))).alias("text"),
            c["start_logit"].alias("start_logit"), c["end_logit"].alias("end_logit"),
            c["score"].alias("score"), c["is_null"].alias("is_null"), c["feature_id"].alias("feature_id"),
            c["start_idx"].alias("start_idx"), c["end_idx"].alias("end_idx")))
    # No candidate, or a single one with empty text -> "empty" at the head.
    empty = F.struct(F.lit("empty").alias("text"), F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit"),
                     F.lit(0.0).alias("score"), F.lit(False).alias("is_null"),
                     F.lit(None).cast("bigint").alias("feature_id"),
                     F.lit(None).cast("int").alias("start_idx"), F.lit(None).cast("int").alias("end_idx"))
    need = (F.size("p0") == 0) | ((F.size("p0") == 1) & (F.get("p0", 0)["text"] == ""))
    staged = joined.select("id", *mk, "null_score", texted.alias("p0"))
    staged = staged.select("id", *mk, "null_score",
                           F.when(need, F.concat(F.array(empty), F.col("p0"))).otherwise(F.col("p0")).alias("p1"))
    # Max-shifted softmax over the list (the fallback row counts); the max,
    # the exponentials and their total are each bound once per example.
    def softmax(b):
        return let({"p": b["p"], "m": F.array_max(F.transform(b["p"], lambda p: p["score"]))}, lambda c: let(
            {"p": c["p"], "x": F.transform(c["p"], lambda p: F.exp(p["score"] - c["m"]))}, lambda d: let(
                {"p": d["p"], "x": d["x"], "t": F.aggregate(d["x"], F.lit(0.0), lambda acc, x: acc + x)},
                lambda f: F.zip_with(f["p"], f["x"], lambda p, x: p.withField("probability", x / f["t"])))))

    preds = let({"p": "p1"}, softmax)
    return staged.select("id", *mk, "null_score", preds.alias("preds"))


def nbest_rows(decoded: DataFrame) -> DataFrame:
    """S10/D9 long form: ``(id, rank, text, start_logit, end_logit, probability)``."""
    return posexplode_rows(decoded, F.col("preds"), ["id", *_model(decoded)], "pos", "p").select(
        "id", *_model(decoded), (F.col("pos") + 1).alias("rank"), "p.text", "p.start_logit", "p.end_logit", "p.probability",
        "p.is_null")


def final_answers(decoded: DataFrame, null_mode: bool = False, threshold: float = 0.0) -> DataFrame:
    """``(id, prediction_text, score_diff)``.

    Plain mode: the top entry. Null mode: the first non-empty entry unless
    ``null_score - start_logit - end_logit > threshold`` (then ``""``). When no
    entry is non-empty, or the example had no features, the answer is ``""``.
    """
    if not null_mode:
        return decoded.select("id", *_model(decoded), F.get("preds", 0)["text"].alias("prediction_text"),
                              F.lit(None).cast("double").alias("score_diff"))
    best = F.get(F.filter("preds", lambda p: p["text"] != ""), 0)
    diff = F.col("null_score") - best["start_logit"] - best["end_logit"]
    text = F.when(best.isNull() | F.col("null_score").isNull(), F.lit("")).when(
        diff > F.lit(threshold), F.lit("")).otherwise(best["text"])
    return decoded.select("id", *_model(decoded), text.alias("prediction_text"), diff.alias("score_diff"))
