"""R2: the analyzer with a user dictionary, against a plain left-to-right version."""

import random
from collections import Counter

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake.functions.text import SEGMENT, WORD
from spanlake.operators import dictionary
from spanlake.operators import retrieval as R
from spanlake.operators.dictionary import DictionaryAnalyzer, Trie, chosen, folded, unspaced


def plain(text, terms):
    """Tries the terms from long to short at every place, comparing whole texts."""
    text = regex.sub(r"\s+", " ", (text or "").lower())
    atoms = regex.findall(SEGMENT, text)
    known = sorted({" ".join(t.lower().split()) for t in terms if t and t.strip()}, key=lambda t: -len(regex.findall(SEGMENT, t)))
    out, i = [], 0
    while i < len(atoms):
        for t in known:
            n = len(regex.findall(SEGMENT, t))
            if "".join(atoms[i:i + n]) == t and i + n <= len(atoms):
                out.append((t, True))
                i += n
                break
        else:
            if regex.fullmatch(WORD, atoms[i]):
                out.append((atoms[i], False))
            i += 1
    return out


ALPHABET = st.text(st.sampled_from("ab c-'.é"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=6), ALPHABET)
def test_longest_terms_from_left_to_right(terms, text):
    folded = [" ".join(t.split()) for t in terms]
    atoms = regex.findall(SEGMENT, regex.sub(r"\s+", " ", text))
    trie = Trie([t for t in folded if t])
    words, whole = chosen(atoms, trie.finds(atoms), regex.compile(WORD).fullmatch)
    assert list(zip(words, whole)) == plain(text, terms)


TERMS = ["New York", "new  york\ncity", "York City Hall", "covid-19", "C++", "é", "(x", "", "  ", None, "of the"]
TEXTS = ["New York City Hall in new\tyork", "COVID-19 and covid 19, C++ c+", "x (x) of the é É of  the", None, "", "   ",
         "york city hall", "new york cit", "new york citys", "of of the the", "new york city hall " * 50]


def tokens_of(spark, analyzer, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    out = analyzer.tokens(df, {"text": "toks"}, flags=True)
    assert set(out.columns) == {"id", "text", "toks"}
    return {r["id"]: [(x["term"], x["whole"]) for x in r["toks"]] for r in out.collect()}


@pytest.mark.parametrize("max_nodes", [400_000, 8, 2])
def test_terms_of_several_words_and_blocks(spark, max_nodes):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    analyzer = DictionaryAnalyzer(terms, max_nodes)
    assert (len(analyzer.tries) > 1) == (max_nodes < 400_000)
    assert tokens_of(spark, analyzer, TEXTS) == {i: plain(t, TERMS) for i, t in enumerate(TEXTS)}


def test_many_terms_and_overlaps(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d-e", "f's"]
    terms = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    for n in (400_000, 60):
        assert tokens_of(spark, DictionaryAnalyzer(frame, n), texts) == {i: plain(t, terms) for i, t in enumerate(texts)}


def test_empty_dictionary_is_the_plain_analyzer(spark):
    analyzer = DictionaryAnalyzer(spark.createDataFrame([], "term string"))
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = analyzer.tokens(df, {"text": "toks"}).select("toks", F.coalesce(R.analyze("text"), F.array()).alias("want")).collect()
    assert all(r["toks"] == r["want"] for r in got)


def test_questions_find_documents_by_whole_terms_only(spark):
    corpus = spark.createDataFrame([(1, "t", "the new york marathon"), (2, "t", "york is new to me"), (3, "t", None)],
                                   "doc_id long, title string, text string")
    questions = spark.createDataFrame([(7, "New York")], "id long, question string")
    analyzer = DictionaryAnalyzer(spark.createDataFrame([("new york",)], "term string"))
    hits = R.search(corpus, questions, analyzer=analyzer).collect()
    assert [r["doc_id"] for r in hits] == [1]
    assert {r["doc_id"] for r in R.search(corpus, questions).collect()} == {1, 2}


def test_dictionary_with_stop_words_and_fields(spark):
    corpus = spark.createDataFrame([(1, "New York", "of the people"), (2, "york", "new of the")], "doc_id long, title string, text string")
    analyzer = DictionaryAnalyzer(spark.createDataFrame([("new york",), ("of the",)], "term string"))
    stop = spark.createDataFrame([("of the",)], "term string")
    index = R.build_index(corpus, text=["text", "title"], stopwords=stop, analyzer=analyzer, materialize=False)
    assert {tuple(r) for r in index.postings.select("doc_id", "field", "term", "tf", "dl").collect()} == {
        (1, "title", "new york", 1, 1), (1, "text", "people", 1, 1), (2, "title", "york", 1, 1), (2, "text", "new", 1, 1)}


def test_phrases_of_titles(spark):
    titles = spark.createDataFrame([("Foo (bar)  baz",), (" ",), (None,), ("Foo bar baz",)], "title string")
    assert [r["term"] for r in R.phrase_dictionary(titles).collect()] == ["Foo bar baz"]


def test_large_dictionary_takes_two_filters_of_bounded_size(spark, monkeypatch):
    """Filters that are full take many strings for terms; the tokens are right all the same."""
    monkeypatch.setattr(dictionary, "MAX_BITS", dictionary.BITMAP)
    rng = random.Random(3)
    words = [f"{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    terms = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(6000)})
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)] + [None, "", terms[7].upper()]
    analyzer = DictionaryAnalyzer(spark.createDataFrame([(t,) for t in terms], "term string"), 100)
    assert [len(t.value) for t in analyzer.tries] == [dictionary.BITMAP // 8] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    wrong = analyzer.checked(df, ["text"]).excluded
    assert wrong.value and not wrong.value & set(terms)
    trie, cut = Trie(terms), regex.compile(SEGMENT).findall
    for i, got in tokens_of(spark, analyzer, texts).items():
        atoms = cut((texts[i] or "").lower())
        assert got == list(zip(*chosen(atoms, trie.finds(atoms), regex.compile(WORD).fullmatch)))


def random_corpus(rng, words, n):
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(n)]
    return [(i, "New York", t) for i, t in enumerate(texts)] + [(0, "New York", texts[0]), (None, "x", "a b"), (n, "y", None), (n + 1, "", "")]


@pytest.mark.parametrize("max_nodes", [400_000, 2])
def test_search_cuts_each_text_once(spark, monkeypatch, max_nodes):
    """The texts are cut once for postings, lengths and the check of the filters' finds, and
    no score moves before the best of a task are chosen."""
    cut, seen = DictionaryAnalyzer._cutter, spark.sparkContext.accumulator(0)

    def counting(self):
        of = cut(self)

        def run(texts):
            seen.add(len(texts))
            return of(texts)
        return run
    rows = random_corpus(random.Random(5), ["a", "b c", "c", "d-e", "é"], 60)
    corpus = spark.createDataFrame(rows, "doc_id long, title string, text string")
    terms = spark.createDataFrame([("b c",), ("c d",), ("é a",)], "term string")
    analyzer = DictionaryAnalyzer(terms, max_nodes)
    asked = spark.createDataFrame([("b c",), ("é",), ("a",)], "term string")
    monkeypatch.setattr(DictionaryAnalyzer, "_cutter", counting)
    index = R.build_index(corpus, terms=asked, analyzer=analyzer)
    postings = index.postings.collect()
    stats = index.stats.collect()
    assert seen.value == len(rows)
    cuts = [(i, plain(t, ["b c", "c d", "é a"])) for i, _, t in rows]
    tf = Counter((i, term) for i, toks in cuts for term, _ in toks if term in ("b c", "é", "a"))
    assert {(r["doc_id"], r["term"]): r["tf"] for r in postings} == tf
    length = {i: len(toks) for i, toks in cuts}
    assert all(r["dl"] == length[r["doc_id"]] for r in postings)
    lengths = [len(toks) for _, toks in cuts if toks]
    assert [(r["field"], r["n_docs"]) for r in stats] == [("text", len(lengths))]
    assert stats[0]["avgdl"] == pytest.approx(sum(lengths) / len(lengths))
    scores = R.bm25(index, spark.createDataFrame([(1, "b c é")], "id long, question string"), analyzer=analyzer)
    assert "hashpartitioning(qid" not in scores._jdf.queryExecution().executedPlan().toString()
    index.release()


def test_several_fields_are_cut_once(spark):
    corpus = spark.createDataFrame(random_corpus(random.Random(6), ["new york", "c", "york"], 20), "doc_id long, title string, text string")
    analyzer = DictionaryAnalyzer(spark.createDataFrame([("New  York",)], "term string"), 1)
    questions = spark.createDataFrame([(1, "new york"), (2, "york c"), (3, "")], "id long, question string")
    hits = R.search(corpus, questions, fields=["text", "title"], analyzer=analyzer)
    index = R.build_index(corpus, text=["text", "title"], analyzer=analyzer, materialize=False)  # of all terms
    want = R.top_k(R.bm25(index, questions, analyzer=analyzer))
    assert sorted(map(tuple, hits.collect()), key=str) == sorted(map(tuple, want.select(hits.columns).collect()), key=str)
    assert hits.count()


def test_cut_once_excludes_what_only_the_filters_hold(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MAX_BITS", dictionary.BITMAP)
    monkeypatch.setattr(dictionary, "MAX_ONLY", 1)
    rng = random.Random(4)
    words = [f"{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    terms = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(6000)})
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)] + [None, "", terms[7].upper()]
    analyzer = DictionaryAnalyzer(spark.createDataFrame([(t,) for t in terms], "term string"), 100)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    assert analyzer.checked(df, ["text"]).excluded.value
    only = spark.createDataFrame([(t,) for t in terms[:2]], "term string")  # too many to be compared with in the tasks
    trie, cut = Trie(terms), regex.compile(SEGMENT).findall
    for given in (None, only):
        for r in analyzer.cut_once(df, ["text"], given).collect():
            want = chosen(a := cut((texts[r["id"]] or "").lower()), trie.finds(a), regex.compile(WORD).fullmatch)[0]
            assert r["text"]["n"] == len(want)
            assert {x["term"]: x["tf"] for x in r["text"]["terms"]} == Counter(want)


def test_blanks_in_python_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([(f"a{chr(c)}{chr(c)}b",) for c in range(1, 0x3100)], "text string")
    got = df.select(F.lower("text").alias("lower"), folded("text").alias("folded")).collect()
    assert unspaced(pa.array([r["lower"] for r in got])) == [r["folded"] for r in got]
