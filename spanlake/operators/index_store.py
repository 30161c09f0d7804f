"""R1 as a stored index that documents can be replaced in.

Layout under ``path``
---------------------
* ``base-<n>/postings``: ``(doc_id, field, term, tf, dl)``, bucketed by ``doc_id`` and
  sorted by term in each bucket. All postings of a document are in one bucket, so the
  question terms (broadcast after a size check) join and the scores of a document add up
  without an exchange of postings, and no term is hot: each is spread over all buckets.
* ``base-<n>/terms``: ``(field, term, df)``, sorted by term; ``base-<n>/stats``:
  ``(field, n_docs, total)``, documents and their lengths' sum.
* ``change-<n>``: the postings of replaced documents, their ids (tombstones of all that
  was stored of them before) and what the change adds to ``terms`` and ``stats``.
* ``log``: one row per base or change, appended last, so a change that failed is not
  seen. Readers take the last base and the changes after it.

A replaced document costs its own postings: statistics are corrected by what it adds and
what its stored postings took. ``compact`` writes a new base from all of it. Scores are
those of an index built anew from the current documents.

Null ids are indexed but can't be replaced. Documents without terms only leave their
tombstone. One writer at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.common import MAX_BROADCAST_BYTES, broadcast_if_small
from spanlake.operators.dictionary import DictionaryAnalyzer
from spanlake.operators.retrieval import InvertedIndex, build_index, index_partitions

POSTINGS_PER_BUCKET = 20_000_000


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        self.spark, self.path, self.max_broadcast_bytes = spark, path.rstrip("/"), max_broadcast_bytes

    # ------------------------------------------------------------------ the log
    def _log(self) -> list:
        """``(n, kind, buckets)`` of the last base and the changes after it, in order;
        one row per change since the last compaction."""
        try:
            rows = sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/log").select("n", "kind", "buckets").collect())
        except AnalysisException:
            return []
        last = max((i for i, r in enumerate(rows) if r[1] == "base"), default=0)
        return rows[last:]

    def _append(self, n: int, kind: str, buckets: int) -> None:
        row = self.spark.createDataFrame([(n, kind, buckets)], "n int, kind string, buckets int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _next(self) -> int:
        return max((r[0] for r in self._log()), default=-1) + 1

    # ------------------------------------------------------------------ base
    def create(self, corpus: DataFrame, key: str = "doc_id", text="text", stopwords: DataFrame | None = None,
               buckets: int | None = None, analyzer: DictionaryAnalyzer | None = None) -> IndexStore:
        """A new base from a corpus. Texts are shuffled once, by id; the postings that a
        task makes are one bucket, of a bounded amount of text."""
        fields = [text] if isinstance(text, str) else list(text)
        buckets = buckets or index_partitions(corpus.select(key, *fields))
        index = build_index(corpus, key, text, stopwords, num_partitions=buckets, materialize=False, analyzer=analyzer)
        self._write_base(index.postings, buckets)
        return self

    def save(self, index: InvertedIndex, buckets: int | None = None) -> IndexStore:
        """A new base from an index."""
        buckets = buckets or max(1, -(-index.postings.count() // POSTINGS_PER_BUCKET))
        self._write_base(index.postings.repartition(buckets, "doc_id"), buckets)
        return self

    def _write_base(self, postings: DataFrame, buckets: int) -> None:
        n = self._next()
        (postings.select("doc_id", "field", "term", "tf", "dl").write.format("parquet").bucketBy(buckets, "doc_id")
         .sortBy("term").option("path", f"{self.path}/base-{n}/postings").saveAsTable(self._table(n)))
        stored = self._postings(n, buckets)
        terms = stored.groupBy("field", "term").agg(F.count("*").alias("df"))
        terms.repartitionByRange("term", "field").sortWithinPartitions("term", "field").write.parquet(f"{self.path}/base-{n}/terms")
        _stats(stored).write.parquet(f"{self.path}/base-{n}/stats")
        self._append(n, "base", buckets)

    def _table(self, n: int) -> str:
        return f"spanlake_index_{hashlib.md5(self.path.encode()).hexdigest()}_{n}"

    def _postings(self, n: int, buckets: int) -> DataFrame:
        """The stored postings as a bucketed table, which a new session has to be told of."""
        name, folder = self._table(n), f"{self.path}/base-{n}/postings"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema)
            self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (doc_id) sorted by (term) "
                           f"into {buckets} buckets location '{folder}'")
        return self.spark.table(name)

    # ------------------------------------------------------------------ reading
    def index(self) -> InvertedIndex:
        """The current documents' index. What the base and the changes hold are two parts
        with different documents."""
        (base, _, buckets), *changes = self._log()
        postings = self._postings(base, buckets)
        terms = self.spark.read.parquet(f"{self.path}/base-{base}/terms")
        stats = self.spark.read.parquet(f"{self.path}/base-{base}/stats")
        more = None
        if changes:
            def each(name):
                return [self.spark.read.parquet(f"{self.path}/change-{n}/{name}").withColumn("_n", F.lit(n)) for n, _, _ in changes]
            gone = _union(each("gone")).groupBy("doc_id").agg(F.max("_n").alias("_n"))
            gone = broadcast_if_small(gone, "replaced", self.max_broadcast_bytes)
            postings = postings.join(gone.select("doc_id"), "doc_id", "left_anti")
            fresh = _union(each("postings"))
            # a document without an id is in no tombstone and stays in all changes
            more = (fresh.join(gone, ["doc_id", "_n"], "left_semi").unionByName(fresh.where("doc_id is null"))).drop("_n")
            terms = (terms.unionByName(_union(each("terms")).drop("_n")).groupBy("field", "term")
                     .agg(F.sum("df").alias("df")).where("df > 0"))
            stats = (stats.unionByName(_union(each("stats")).drop("_n")).groupBy("field")
                     .agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total")).where("n_docs > 0"))
        stats = stats.select("field", "n_docs", (F.col("total") / F.col("n_docs")).alias("avgdl"))
        fields = tuple(sorted(r["field"] for r in stats.select("field").collect()))  # one row per field
        return InvertedIndex(postings, stats, fields, terms, more)

    # ------------------------------------------------------------------ changes
    def upsert(self, docs: DataFrame, key: str = "doc_id", text="text", stopwords: DataFrame | None = None,
               analyzer: DictionaryAnalyzer | None = None) -> IndexStore:
        """Replace the documents of these ids, or add them."""
        return self._change(docs.select(F.col(key).alias("doc_id")),
                            build_index(docs, key, text, stopwords, materialize=False, analyzer=analyzer).postings)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> IndexStore:
        """Remove the documents of these ids."""
        current = self.index().postings.select("doc_id", "field", "term", "tf", "dl")
        return self._change(ids.select(F.col(key).alias("doc_id")), current.where(F.lit(False)))

    def _change(self, ids: DataFrame, postings: DataFrame) -> IndexStore:
        n, folder = self._next(), f"{self.path}/change-{self._next()}"
        ids.where("doc_id is not null").distinct().write.parquet(f"{folder}/gone")
        postings.select("doc_id", "field", "term", "tf", "dl").write.parquet(f"{folder}/postings")
        gone = broadcast_if_small(self.spark.read.parquet(f"{folder}/gone"), "gone", self.max_broadcast_bytes)
        fresh = self.spark.read.parquet(f"{folder}/postings")
        before = self.index()
        old = [p.join(gone, "doc_id", "left_semi") for p in before.parts()]
        terms = [p.select("field", "term", F.lit(s).alias("df")) for p, s in [*((p, -1) for p in old), (fresh, 1)]]
        (_union(terms).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df != 0")
         .write.parquet(f"{folder}/terms"))
        stats = [_stats(p).select("field", (s * F.col("n_docs")).alias("n_docs"), (s * F.col("total")).alias("total"))
                 for p, s in [*((p, -1) for p in old), (fresh, 1)]]
        (_union(stats).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
         .write.parquet(f"{folder}/stats"))
        self._append(n, "change", 0)
        return self

    def compact(self, buckets: int | None = None) -> IndexStore:
        """Write a new base with all changes; readers of the earlier one are not disturbed."""
        buckets = buckets or self._log()[0][2]
        whole = _union([p.select("doc_id", "field", "term", "tf", "dl") for p in self.index().parts()])
        self._write_base(whole.repartition(buckets, "doc_id"), buckets)
        return self


def _stats(postings: DataFrame) -> DataFrame:
    lengths = postings.groupBy("doc_id", "field").agg(F.first("dl").alias("dl"))
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
