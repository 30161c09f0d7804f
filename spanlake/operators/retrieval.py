"""Retrieval as tables and joins (R1-R8): inverted index, BM25, top-k, contexts.

Plan shape at scale
-------------------
* The corpus is hash-partitioned once by ``doc_id``; each document is tokenized after
  the shuffle, its length is known in-row, and the postings ``(doc_id, field, term,
  tf, dl)`` are aggregated without another shuffle (hash partitioning on ``doc_id``
  satisfies grouping on ``(doc_id, field, term)``).
* To answer questions without a stored index, only the questions' terms are kept
  before the postings are grouped; collection statistics come from the in-row lengths.
  With a user dictionary the texts are cut once, and their lengths and the questions'
  terms written; these are partitioned by ``doc_id``, not the texts.
* A stored index (``index_store``) is bucketed by ``doc_id``, with its terms' document
  frequencies and statistics beside it, so answering questions reads the postings once
  and shuffles none.
* The weighted question terms are broadcast only after a check of their bytes;
  otherwise the join shuffles on ``(field, term)`` and adaptive execution splits hot
  terms. Hot terms are pre-aggregated map side in document frequencies.
* ``row_number() <= k`` gets a partial ``WindowGroupLimit`` before the shuffle on the
  question id: at most ``k`` rows per question per task cross the network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from spanlake.functions.text import WS, title_prefix, words
from spanlake.operators.common import MAX_BROADCAST_BYTES, broadcast_if_small, explode_rows, r6, size_of
from spanlake.operators.dictionary import DictionaryAnalyzer
from spanlake.session import written

K1 = 1.2
B = 0.75
PARTITION_BYTES = 8 << 20  # of text whose postings one task groups


@dataclass
class InvertedIndex:
    """Postings ``(doc_id, field, term, tf, dl)`` with ``stats`` ``(field, n_docs,
    avgdl)`` of one or several fields. An index restricted to some terms has the
    statistics of the whole collection. A stored index (``index_store``) has its terms'
    ``dfs`` ``(field, term, df)`` beside the postings, and may have ``more`` postings of
    other documents. A ``restricted`` index has the postings of some questions' terms."""

    postings: DataFrame
    stats: DataFrame
    fields: tuple
    dfs: DataFrame | None = None
    more: DataFrame | None = None
    restricted: bool = False

    def parts(self) -> list[DataFrame]:
        """The postings, in parts that have no document in common."""
        return [self.postings] if self.more is None else [self.postings, self.more]

    def release(self) -> None:
        """Free the postings if they were persisted."""
        self.postings.unpersist()

    @property
    def doc_stats(self) -> DataFrame:
        """``(doc_id, field, dl)`` of documents with a posting."""
        return self.postings.groupBy("doc_id", "field").agg(F.first("dl").alias("dl"))

    def term_df(self) -> DataFrame:
        """``(field, term, df)``; partial aggregation makes a hot term one row per task
        before the shuffle."""
        return self.postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def analyze(text) -> Column:
    """R2 analyzer: lower-case word tokens."""
    return words(text)


def with_terms(df: DataFrame, columns: dict[str, str], analyzer: DictionaryAnalyzer | None = None) -> DataFrame:
    """Add the terms of text columns as array columns, with a user dictionary's terms
    whole if there is an ``analyzer`` of one."""
    if analyzer is not None:
        return analyzer.tokens(df, columns)
    return df.withColumns({out: analyze(text) for text, out in columns.items()})


def _fields(text) -> list[str]:
    return [text] if isinstance(text, str) else list(text)


def index_partitions(docs: DataFrame) -> int:
    """As many partitions as leave each about ``PARTITION_BYTES`` of text, so that a task's
    postings take the same memory whatever the size of the corpus."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size_of(docs)[1] // PARTITION_BYTES))


def _docs_by_id(corpus: DataFrame, key: str, fields: list[str], num_partitions: int | None,
                analyzer: DictionaryAnalyzer | None = None) -> DataFrame:
    """Raw field texts hash-partitioned by ``doc_id`` (the text moves, not tokens),
    then one row per (document, field) with its tokens, tokenized after the shuffle."""
    docs = _field_texts(corpus, key, fields)
    if analyzer is not None:
        analyzer = analyzer.checked(docs, [f"_f{i}" for i in range(len(fields))])  # before the texts move
    docs = docs.repartition(num_partitions or index_partitions(docs), "doc_id")
    if analyzer is None:
        toks = [analyze(f"_f{i}") for i in range(len(fields))]
    else:
        docs = with_terms(docs, {f"_f{i}": f"_t{i}" for i in range(len(fields))}, analyzer)
        toks = [F.col(f"_t{i}") for i in range(len(fields))]
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.alias("toks")) for f, t in zip(fields, toks)]))
    return docs.select("doc_id", per_field.alias("_fz")).select("doc_id", "_fz.field", "_fz.toks")


def _field_texts(corpus: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return corpus.select(F.col(key).alias("doc_id"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)])


def _cut_by_id(corpus: DataFrame, key: str, fields: list[str], num_partitions: int | None,
               analyzer: DictionaryAnalyzer, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, field, dl, term, tf)`` by a dictionary's analyzer, of the distinct ``terms`` at
    least, hash-partitioned by ``doc_id``; and ``(field, dl)`` of all documents. Spark does not
    know how rows are partitioned behind a Python function, so it is the counted terms that
    move, not the texts: these are cut where they lie, unless they lie in fewer partitions
    than there are cores."""
    docs = _field_texts(corpus, key, fields)
    n = num_partitions or index_partitions(docs)
    if docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism:
        docs = docs.repartition(n, "doc_id")
    texts = [f"_f{i}" for i in range(len(fields))]
    docs = analyzer.cut_once(docs, texts, terms)
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{t}.n").alias("dl"), F.col(f"{t}.terms").alias("terms"))
                                    for f, t in zip(fields, texts)]))
    docs = docs.select("doc_id", per_field.alias("_fz")).select("doc_id", "_fz.field", "_fz.dl", "_fz.terms")
    moved = docs.where(F.size("terms") > 0).repartition(n, "doc_id")
    rows = explode_rows(moved, F.col("terms"), ["doc_id", "field", "dl"], "_t")
    return rows.select("doc_id", "field", "dl", "_t.term", "_t.tf"), docs.select("field", "dl")


def tokens(corpus: DataFrame, key: str = "doc_id", text="text", num_partitions: int | None = None) -> DataFrame:
    """Exploded ``(doc_id, field, term)`` tokens, hash-partitioned by ``doc_id``."""
    docs = _docs_by_id(corpus, key, _fields(text), num_partitions)
    return explode_rows(docs, F.col("toks"), ["doc_id", "field"], "term")


def build_index(corpus: DataFrame, key: str = "doc_id", text="text", stopwords: DataFrame | None = None,
                terms: DataFrame | None = None, num_partitions: int | None = None,
                materialize: bool = True, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                analyzer: DictionaryAnalyzer | None = None) -> InvertedIndex:
    """Postings with term frequency and document length, for one field (``text`` a
    column name) or several (a list), in a single pass.

    ``stopwords`` (a ``term`` column) are no terms and count in no length. ``terms`` (a
    ``term`` column) restricts the postings to those terms, before they are grouped;
    lengths and statistics stay those of all terms. An ``analyzer`` keeps the terms of a
    user dictionary whole; questions must then be asked with the same one.

    ``materialize=True`` persists the postings (memory, spilling to disk): the corpus
    is tokenized once for all later uses, and the cached plan keeps its ``doc_id``
    hash partitioning, so the scoring aggregation needs no shuffle. Lost blocks are
    recomputed from the short lineage; an ``IndexStore`` writes a durable copy.
    ``release()`` unpersists.
    """
    held = terms if terms is None else _distinct_terms(terms, max_broadcast_bytes)
    cut = analyzer is not None and terms is not None and stopwords is None
    docs = None if cut else _docs_by_id(corpus, key, _fields(text), num_partitions, analyzer)
    if stopwords is not None:
        stop = broadcast_if_small(stopwords.select("term").distinct(), "stop-words", max_broadcast_bytes)
        kept = explode_rows(docs, F.col("toks"), ["doc_id", "field"], "term").join(stop, "term", "left_anti")
        # lengths without stop words need the tokens together again: same partitioning
        kept = kept.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"))
        kept = kept.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id", "field")))
        lengths = kept.select("doc_id", "field", "dl").distinct()
        if terms is not None:
            kept = kept.join(held, "term", "left_semi")
        postings = kept
    else:
        if cut:
            toks, lengths = _cut_by_id(corpus, key, _fields(text), num_partitions, analyzer, held)
        else:
            docs = docs.withColumn("dl", F.size("toks").cast("bigint"))
            lengths = docs.select("field", "dl")
            toks = explode_rows(docs, F.col("toks"), ["doc_id", "field", "dl"], "term")
        lengths = lengths.where("dl > 0")
        if terms is not None:
            toks = toks.join(held, "term", "left_semi")
        tf = F.sum("tf") if cut else F.count("*")
        postings = toks.groupBy("doc_id", "field", "term").agg(tf.alias("tf"), F.first("dl").alias("dl"))
    if materialize:
        postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
        if terms is None:
            lengths = postings.groupBy("doc_id", "field").agg(F.first("dl").alias("dl"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return InvertedIndex(postings, stats, tuple(_fields(text)), restricted=terms is not None)


def _distinct_terms(terms: DataFrame, max_bytes: int) -> DataFrame:
    return broadcast_if_small(terms.select("term").distinct(), "terms", max_bytes)


def query_terms(queries: DataFrame, qid: str = "id", qtext: str = "question",
                analyzer: DictionaryAnalyzer | None = None) -> DataFrame:
    """``(qid, term, qtf)``: a query is a plain bag of words (and dictionary terms)."""
    q = queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("_q"))
    if analyzer is None:
        rows = explode_rows(q, analyze("_q"), ["qid"], "term")
    else:
        rows = explode_rows(with_terms(q, {"_q": "_terms"}, analyzer), F.col("_terms"), ["qid"], "term")
    return rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25(index: InvertedIndex, queries: DataFrame, qid: str = "id", qtext: str = "question",
         k1: float = K1, b: float = B, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
         analyzer: DictionaryAnalyzer | None = None, terms: DataFrame | None = None) -> DataFrame:
    """R3 (+ R4): ``(qid, doc_id, score)`` for every document sharing a term with
    the query; with several fields each is scored with its own statistics and
    the best field wins.

    ``score = sum qtf * ln(1 + (N - df + .5)/(df + .5)) * tf / (tf + k1*(1 - b + b*dl/avgdl))``
    rounded to 6 places (so that ranks do not depend on summation order).

    A stored index knows its terms' document frequencies, so its postings are read once;
    otherwise the frequencies are counted first, for the questions' terms only. ``terms``
    are the questions' terms (:func:`query_terms`) if they have been made before. The
    weighted terms are broadcast if their bytes pass the check; otherwise the join
    shuffles. Both score aggregations are satisfied by a ``doc_id`` partitioning of the
    postings.
    """
    qt = query_terms(queries, qid, qtext, analyzer) if terms is None else terms
    stats = F.broadcast(index.stats)  # one row per field: a proven bound
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    if index.dfs is not None:
        dfs = index.dfs.join(_distinct_terms(qt, max_broadcast_bytes), "term", "left_semi")
    else:
        postings = index.postings
        if not index.restricted:
            postings = postings.join(_distinct_terms(qt, max_broadcast_bytes), "term", "left_semi")
        dfs = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    weighted = qt.join(dfs, "term").join(stats, "field").select(
        "qid", "field", "term", (F.col("qtf") * idf).alias("w"), "avgdl")
    weighted = broadcast_if_small(weighted, "weighted-terms", max_broadcast_bytes)
    scores = None
    for postings in index.parts():
        contrib = postings.join(weighted, ["field", "term"]).select(
            "qid", "doc_id", "field", (F.col("w") * F.col("tf") / norm).alias("c"))
        if len(index.fields) == 1:
            part = contrib.groupBy("qid", "doc_id").agg(r6(F.sum("c")).alias("score"))
        else:
            per_field = contrib.groupBy("qid", "doc_id", "field").agg(r6(F.sum("c")).alias("score"))
            part = per_field.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    return scores


def top_k(scores: DataFrame, k: int = 10, qid: str = "qid", doc: str = "doc_id",
          score: str = "score") -> DataFrame:
    """The ``k`` best documents per query with 1-based ``rank``; ties by doc id."""
    w = Window.partitionBy(qid).orderBy(F.col(score).desc(), F.col(doc).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, fields="text", key: str = "doc_id", qid: str = "id",
           qtext: str = "question", stopwords: DataFrame | None = None,
           max_broadcast_bytes: int = MAX_BROADCAST_BYTES, analyzer: DictionaryAnalyzer | None = None) -> DataFrame:
    """R1+R3+R4+R5 without a stored index: the ``k`` best documents per question, from
    the postings of the questions' terms alone. Several fields (a list) are scored
    each with its own statistics and the best one wins. The result is written once, so
    the postings are released."""
    terms = written(query_terms(queries, qid, qtext, analyzer), "question-terms")
    index = build_index(corpus, key, fields, stopwords, terms, max_broadcast_bytes=max_broadcast_bytes, analyzer=analyzer)
    scores = bm25(index, queries, qid, qtext, max_broadcast_bytes=max_broadcast_bytes, terms=terms)
    hits = written(top_k(scores, k), "hits")
    index.release()
    return hits


def passage_corpus(corpus: DataFrame) -> DataFrame:
    """T4 applied: the indexed passage is ``!!title!!text``."""
    return corpus.withColumn("text", title_prefix("title", "text"))


def attach_text(hits: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text",
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join the hit list to the corpus text. A hit list whose bytes pass the check is
    broadcast, and the corpus is streamed, not shuffled."""
    src = corpus.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return src.join(broadcast_if_small(hits, "hits", max_broadcast_bytes), "doc_id")


def hits_wide(hits: DataFrame, k: int = 10, qid: str = "qid") -> DataFrame:
    """Pivot ranked hits to ``text1..k, score1..k``; fewer than k hits -> nulls."""
    p = (hits.groupBy(qid).pivot("rank", list(range(1, k + 1)))
         .agg(F.first("text").alias("text"), F.first("score").alias("score")))
    cols = [F.col(qid).alias("id")]
    cols += [F.col(f"{j}_text").alias(f"text{j}") for j in range(1, k + 1)]
    cols += [F.col(f"{j}_score").alias(f"score{j}") for j in range(1, k + 1)]
    return p.select(*cols)


def concat_context(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Concatenate the passages in rank order without separator (null -> '')."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t"))))
    return hits.groupBy(qid).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("context"))


def retrieve_contexts(corpus: DataFrame, questions: DataFrame, k: int = 10, stopwords: DataFrame | None = None,
                      max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                      analyzer: DictionaryAnalyzer | None = None) -> DataFrame:
    """R1+R3+R5+R7+R8: ``(id, question, context)`` for every question.

    The corpus needs ``doc_id, title, text``; questions need ``id, question``.
    Questions with no hit get an empty context. ``stopwords`` (a ``term`` column) are
    left out of the index; an ``analyzer`` keeps a user dictionary's terms whole in the
    passages and in the questions. The hits' texts are read from the raw corpus, and only they
    get their title prefix.
    """
    hits = search(passage_corpus(corpus), questions, k, stopwords=stopwords, max_broadcast_bytes=max_broadcast_bytes,
                  analyzer=analyzer)
    raw = corpus.select("doc_id", "title", "text").join(
        broadcast_if_small(hits.select("qid", "doc_id", "rank"), "hits", max_broadcast_bytes), "doc_id")
    ctx = concat_context(raw.withColumn("text", title_prefix("title", "text")))
    return (questions.select("id", "question")
            .join(ctx.withColumnRenamed("qid", "id"), "id", "left")
            .select("id", "question", F.coalesce("context", F.lit("")).alias("context")))


def title_dictionary(titles: DataFrame, title: str = "title") -> DataFrame:
    """T5: user-dictionary terms from titles: drop parentheses, split on blanks,
    trim, distinct, no empty term."""
    parts = F.split(F.regexp_replace(F.col(title), r"[()]", ""), WS + "+")
    return (explode_rows(titles, parts, [], "term")
            .select(F.trim("term").alias("term")).where(F.col("term") != "").distinct())


def phrase_dictionary(titles: DataFrame, title: str = "title") -> DataFrame:
    """Whole titles as dictionary terms of several words: without parentheses, trimmed,
    distinct, not empty."""
    phrase = F.trim(F.regexp_replace(F.regexp_replace(F.col(title), r"[()]", ""), WS + "+", " "))
    return titles.select(phrase.alias("term")).where(F.col("term") != "").distinct()


def frequent_terms(index: InvertedIndex, min_doc_fraction: float = 0.5) -> DataFrame:
    """A stop-word table derived from the corpus: terms in more than the given
    fraction of the documents of a field (the reference loads its list from a
    file)."""
    return (index.term_df().join(F.broadcast(index.stats), "field")
            .where(F.col("df") > F.lit(min_doc_fraction) * F.col("n_docs")).select("term").distinct())


def without_terms(index: InvertedIndex, stopwords: DataFrame,
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> InvertedIndex:
    """The index without the given terms (a ``term`` column), lengths and statistics
    included; the corpus is not tokenized again."""
    stop = broadcast_if_small(stopwords.select("term").distinct(), "stop-words", max_broadcast_bytes)
    kept = index.postings.join(stop, "term", "left_anti").withColumn(
        "dl", F.sum("tf").over(Window.partitionBy("doc_id", "field")))
    stats = (kept.select("doc_id", "field", "dl").distinct().groupBy("field")
             .agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))
    return InvertedIndex(kept, stats, index.fields)


def dictionary_tokens(corpus: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text",
                      max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """R2 user dictionary: ``(doc_id, term, whole)`` tokens in which a dictionary term
    stays whole.

    The text is cut at blanks first. A piece that is a dictionary term (lower-cased;
    also without the full stop, comma or the like behind it) is one token, with
    ``whole`` true; any other piece is analyzed into words.
    """
    docs = corpus.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))
    pieces = explode_rows(docs, F.split(F.lower("_t"), WS + "+"), ["doc_id"], "piece").where("piece != ''")
    terms = broadcast_if_small(dictionary.select(F.lower("term").alias("_term")).distinct(), "dictionary",
                               max_broadcast_bytes)
    bare = F.regexp_replace("piece", r"[.,;:!?]+$", "")
    found = pieces.withColumn("_bare", bare).join(terms.withColumn("_whole", F.lit(True)), F.col("piece") == F.col("_term"), "left")
    found = found.drop("_term").join(terms.withColumn("_core", F.lit(True)), F.col("_bare") == F.col("_term"), "left")
    whole = F.when(F.col("_whole"), F.array("piece")).when(F.col("_core"), F.array("_bare"))
    token = F.coalesce(whole, analyze("piece"))
    flag = F.coalesce("_whole", "_core", F.lit(False))
    return explode_rows(found.withColumn("whole", flag), token, ["doc_id", "whole"], "term").select("doc_id", "term", "whole")
