"""R1-R8 against a brute-force BM25 model; ties, short hit lists, wide form."""

import math
import re

import pytest
from pyspark.sql import functions as F

from spanlake.operators import retrieval as R
from spanlake.operators.index_store import IndexStore
from spanlake.session import scratch_path

DOCS = [
    (1, "Seoul", "Seoul is the capital of Korea. Seoul is big."),
    (2, "Busan", "Busan is a port city in Korea."),
    (3, "Tokyo", "Tokyo is the capital of Japan."),
    (4, "Empty", "..."),
    (5, "Twin", "Busan is a port city in Korea."),  # equal text: equal scores, tie by doc id
]
QUESTIONS = [(10, "capital of Korea"), (11, "port city"), (12, "zzz unknown")]


def py_bm25(docs, question, k1=1.2, b=0.75):
    toks = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs.items()}
    toks = {d: t for d, t in toks.items() if t}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    q = {}
    for w in re.findall(r"[^\W_]+", question.lower()):
        q[w] = q.get(w, 0) + 1
    scores = {}
    for d, t in toks.items():
        s = 0.0
        for w, qtf in q.items():
            tf = t.count(w)
            if tf == 0:
                continue
            df = sum(1 for tt in toks.values() if w in tt)
            s += qtf * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len(t) / avgdl))
        if s:
            scores[d] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture()
def frames(spark):
    corpus = spark.createDataFrame(DOCS, "doc_id bigint, title string, text string")
    qs = spark.createDataFrame(QUESTIONS, "id bigint, question string")
    return corpus, qs


def test_bm25_matches_model(spark, frames):
    corpus, qs = frames
    top = R.top_k(R.bm25(R.build_index(corpus), qs), 3).collect()
    got = {}
    for r in sorted(top, key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    docs = {d: t for d, _, t in DOCS}
    for qid, q in QUESTIONS:
        want = py_bm25(docs, q)[:3]
        g = got.get(qid, [])
        assert [d for d, _ in g] == [d for d, _ in want]
        assert [s for _, s in g] == pytest.approx([s for _, s in want], abs=1e-6)


def test_tie_by_doc_id_and_short_lists(spark, frames):
    corpus, qs = frames
    hits = R.top_k(R.bm25(R.build_index(corpus), qs), 10)
    port = [(r.rank, r.doc_id) for r in hits.where("qid = 11").orderBy("rank").collect()]
    assert port[:2] == [(1, 2), (2, 5)]
    wide = R.hits_wide(R.attach_text(hits, corpus), 10).collect()
    w = {r.id: r for r in wide}
    assert w[11].text3 is None and w[11].score3 is None  # fewer than k hits -> nulls
    assert 12 not in w  # no hit at all -> no wide row; the context is empty instead
    ctx = {r.id: r.context for r in R.retrieve_contexts(corpus, qs, 2).collect()}
    assert ctx[12] == ""
    assert ctx[11] == "!!Busan!!Busan is a port city in Korea.!!Twin!!Busan is a port city in Korea."


def test_multifield_takes_best_field(spark, frames):
    corpus, qs = frames
    s = R.bm25(R.build_index(corpus, text=["text", "title"]), qs).collect()
    t = {(r.qid, r.doc_id): r.score for r in R.bm25(R.build_index(corpus, text="text"), qs).collect()}
    h = {(r.qid, r.doc_id): r.score for r in R.bm25(R.build_index(corpus, text="title"), qs).collect()}
    for r in s:
        assert r.score == max(t.get((r.qid, r.doc_id), -1), h.get((r.qid, r.doc_id), -1))


def test_stopwords_and_dictionary(spark, frames):
    corpus, _ = frames
    stop = spark.createDataFrame([("is",), ("the",)], "term string")
    idx = R.build_index(corpus, stopwords=stop)
    assert idx.postings.where(F.col("term").isin("is", "the")).count() == 0
    d = R.title_dictionary(spark.createDataFrame([("New (York) City",), ("  ",), ("City",)], "title string"))
    assert sorted(r.term for r in d.collect()) == ["City", "New", "York"]


def ranked(df):
    return sorted(tuple(r) for r in df.select("qid", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("fields", ["text", ["text", "title"]])
def test_search_equals_the_full_index(spark, frames, fields):
    corpus, qs = frames
    full = ranked(R.top_k(R.bm25(R.build_index(corpus, text=fields), qs), 3))
    assert ranked(R.search(corpus, qs, 3, fields)) == full
    assert ranked(R.search(corpus, qs, 3, fields, max_broadcast_bytes=0)) == full  # every join shuffles
    stop = spark.createDataFrame([("is",), ("of",)], "term string")
    index = R.build_index(corpus, text=fields)
    want = ranked(R.top_k(R.bm25(R.build_index(corpus, text=fields, stopwords=stop), qs), 3))
    assert ranked(R.search(corpus, qs, 3, fields, stopwords=stop)) == want
    assert ranked(R.top_k(R.bm25(R.without_terms(index, stop), qs), 3)) == want
    index.release()


def test_contexts_are_the_same_without_broadcasts(spark, frames):
    corpus, qs = frames
    a, b = (sorted(map(tuple, R.retrieve_contexts(corpus, qs, 2, max_broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b


@pytest.mark.parametrize("fields", ["text", ["text", "title"]])
def test_saved_index_keeps_fields_and_scores(spark, frames, fields):
    corpus, qs = frames
    idx = R.build_index(corpus, text=fields)
    path = scratch_path(spark, "index")
    IndexStore(spark, path).save(idx, buckets=3)
    loaded = IndexStore(spark, path).index()
    assert loaded.fields == tuple([fields] if isinstance(fields, str) else fields)
    assert ranked(R.top_k(R.bm25(loaded, qs), 3)) == ranked(R.top_k(R.bm25(idx, qs), 3))
    assert ranked(R.top_k(R.bm25(loaded, qs, max_broadcast_bytes=0), 3)) == ranked(R.top_k(R.bm25(idx, qs), 3))
    plan = R.bm25(loaded, qs)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "tf#" in line]
    assert len(scan) == 1 and "Bucketed: true" in scan[0]
    assert "Exchange hashpartitioning" not in plan  # no exchange of postings or scores


def contents(store):
    index = store.index()
    rows = [tuple(r) for p in index.parts() for r in p.select("doc_id", "field", "term", "tf", "dl").collect()]
    return (sorted(rows, key=str), sorted(tuple(r) for r in index.dfs.select("field", "term", "df").collect()),
            sorted((r["field"], r["n_docs"], round(r["avgdl"], 9)) for r in index.stats.collect()))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_changed_index_equals_one_built_anew(spark, limit):
    schema = "doc_id bigint, title string, text string"
    fields = ["text", "title"]
    now = {d: (d, t, x) for d, t, x in DOCS}
    store = IndexStore(spark, scratch_path(spark, "index"), limit).create(spark.createDataFrame(DOCS, schema), text=fields, buckets=3)

    def same():
        anew = IndexStore(spark, scratch_path(spark, "index")).create(
            spark.createDataFrame(list(now.values()), schema), text=fields, buckets=2)
        assert contents(store) == contents(anew)
        # another session finds the table by its folder
        spark.sql(f"drop table if exists {store._table(store._log()[0][0])}")
        assert contents(IndexStore(spark, store.path, limit)) == contents(anew)

    def upsert(rows):
        store.upsert(spark.createDataFrame(rows, schema), text=fields)
        now.update({r[0]: r for r in rows})
        same()

    same()
    upsert([(2, "Busan", "A port no more"), (9, None, "new words here"), (4, "Empty", None)])
    upsert([(2, "Busan", "a port again, a port"), (1, "", "")])
    store.delete(spark.createDataFrame([(5,), (2,), (77,)], "doc_id bigint"))
    now.pop(5), now.pop(2)
    same()
    upsert([(5, "Back", "is back")])
    store.compact()
    same()
    upsert([(3, "Tokyo", "changed after compaction"), (5, "t", "zzz unknown")])
    qs = spark.createDataFrame(QUESTIONS, "id bigint, question string")
    got = {(r.qid, r.doc_id): r.score for r in R.bm25(store.index(), qs).collect()}
    want = R.bm25(R.build_index(spark.createDataFrame(list(now.values()), schema), text=fields), qs).collect()
    assert got == {(r.qid, r.doc_id): r.score for r in want}


def test_a_change_that_was_not_logged_is_not_seen(spark):
    schema = "doc_id bigint, title string, text string"
    store = IndexStore(spark, scratch_path(spark, "index")).create(spark.createDataFrame(DOCS, schema), buckets=2)
    before = contents(store)
    spark.createDataFrame([(1,)], "doc_id bigint").write.parquet(f"{store.path}/change-9/gone")
    assert contents(store) == before


def test_dictionary_terms_stay_whole(spark):
    corpus = spark.createDataFrame([(1, "t", "The New-York times, new-york. (Seoul) seoul!"), (2, "t", None)],
                                   "doc_id bigint, title string, text string")
    d = spark.createDataFrame([("New-York",), ("Seoul",)], "term string")
    for limit in (1 << 20, 0):
        got = sorted((r.term, r.whole) for r in R.dictionary_tokens(corpus, d, max_broadcast_bytes=limit).collect())
        assert got == [("new-york", True), ("new-york", True), ("seoul", False), ("seoul", True), ("the", False), ("times", False)]


def test_a_task_groups_a_bounded_amount_of_text(spark, monkeypatch):
    """The number of partitions follows the bytes of the texts, not a fixed setting."""
    monkeypatch.setattr(R, "PARTITION_BYTES", 1000)
    corpus = spark.createDataFrame([(i, "word " * 200) for i in range(40)], "doc_id long, text string")
    postings = R.build_index(corpus, materialize=False).postings
    assert R.index_partitions(corpus) == 41  # 1,008 bytes a row
    assert postings.rdd.getNumPartitions() == 41
