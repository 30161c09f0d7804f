"""T1-T3, T7, T8 on hand-made rows with their expected results written out."""

from pyspark.sql import functions as F

from spanlake.functions.text import clean_corpus, clean_qa, span_text, squad_normalize
from spanlake.operators.cleaning import answer_span_check, clean_and_shift

# text, cleaned (the corpus cleaner differs only where a third value is given)
CLEANED = [
    ("line one\nline two", "line one line two"),
    ("literal \\n escape", "literal escape"),
    ("back\\\nslash", "back\\ slash"),
    ("hash # sign ##", "hash sign "),
    ("“quoted” and ‘single’", "'quoted' and 'single'"),
    ("〈a〉 ＜b＞ 「c」 ≪d≫ 《e》 『f』", "<a> <b> <c> <d> <e> <f>"),
    ("nbsp\u00a0and\u3000ideographic\u2003em", "nbsp and ideographic em"),
    ("bar ｜ full-width", "bar ｜ full-width", "bar  full-width"),
    ("ctrl\x01\x02\x07chars\x1b and \x1c\x1f seps", "ctrlchars and seps"),
    ("Café naïve Привет مرحبا 한국어 日本語 カタカナ", "Café naïve Привет مرحبا 한국어 日本語 カタカナ"),
    ("  leading and trailing  ", " leading and trailing "),
    ("tabs\t\tand\r\nCRLF", "tabs and CRLF"),
    ("emoji 😀 and 𝄞 clef", "emoji  and  clef"),
    ("a…b €5", "ab 5"),
    ("junk $$$ %%% &&& *** @@@ ~~~ ^^^", "junk $$$ %%% &&& *** @@@ ~~~ ^^^"),
    ("", ""),
]


def test_cleaned_texts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLEANED)], "i int, t string")
    got = {r.i: (r.qa, r.co) for r in df.select("i", clean_qa("t").alias("qa"), clean_corpus("t").alias("co")).collect()}
    assert got == {i: (c[1], c[-1]) for i, c in enumerate(CLEANED)}


# context, answer starts and texts; the same after cleaning
SHIFTED = [
    ("Hello\n\n world # answer here", [16], ["answer"], "Hello world answer here", [12], ["answer"]),
    ("“Quote” then ANSWER", [13], ["ANSWER"], "'Quote' then ANSWER", [13], ["ANSWER"]),
    ("no answers at all\n", [], [], "no answers at all ", [], []),
    ("x  \u3000 y target", [7], ["target"], "x y target", [4], ["target"]),
    ("a\x01b\x02c answer", [6, 2], ["answer", "other\nanswer"], "abc answer", [4, 2], ["answer", "other answer"]),
    # blanks on both sides of the cut: the halves are cleaned separately
    ("left \n right", [6], [" right"], "left  right", [5], [" right"]),
    ("answer first", [0], ["answer"], "answer first", [0], ["answer"]),
]


def test_clean_and_shift(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(SHIFTED)],
                               "id int, context string, s array<int>, t array<string>")
    df = df.select("id", "context", F.struct(F.col("s").alias("answer_start"), F.col("t").alias("text")).alias("answers"))
    out = {r.id: (r.context, list(r.answers.answer_start), list(r.answers.text)) for r in clean_and_shift(df).collect()}
    assert out == {i: r[3:] for i, r in enumerate(SHIFTED)}
    for context, starts, texts in out.values():  # the first answer stands where it says
        if starts:
            assert context[starts[0]:].startswith(texts[0])


def test_answer_span_check_reports_every_bad_row(spark):
    rows = [(1, "abc answer", [4], ["answer"]), (2, "abc answer", [3], ["answer"]),
            (3, "abc answer", [0], ["xyz"]), (4, "no", [], [])]
    df = spark.createDataFrame(rows, "id int, context string, s array<int>, t array<string>")
    df = df.select("id", "context", F.struct(F.col("s").alias("answer_start"), F.col("t").alias("text")).alias("answers"))
    res = {r.id: r.ok for r in answer_span_check(df).collect()}
    assert res == {1: True, 2: False, 3: False}


def test_span_text_python_slicing(spark):
    ctx = "0123456789"
    cases = [(0, 0), (2, 5), (8, 20), (5, 3), (12, 15)]
    df = spark.createDataFrame([(ctx, a, b) for a, b in cases], "c string, a int, b int")
    got = [r[0] for r in df.select(span_text("c", "a", "b")).collect()]
    assert got == [ctx[a:b] for a, b in cases]


def test_squad_normalize(spark):
    cases = {"The Answer!": "answer", "a an the": "", "  An  apple, the pear.  ": "apple pear", "": "", "...": "",
             "theory of a thing": "theory of thing", "ÉCOLE d'été": "école dété", "U.S. A.": "us"}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.n for r in df.select("s", squad_normalize("s").alias("n")).collect()} == cases
