"""Positions through cleaning, against cleaning itself."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake.functions.text import CLEAN_STEPS_QA, KEEP_QA, clean_qa
from spanlake.operators.positions import PositionMap, _tables, clean_with_answers, to_cleaned, to_raw

TABLES = _tables(KEEP_QA)


def plain_clean(text):
    for pattern, by in CLEAN_STEPS_QA[:-2]:
        text = re.sub(pattern, by, text)
    return re.sub(f"[^{KEEP_QA}]", "", re.sub(r"\s+", " ", text))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab \n\\n#“〈》🙂é　\t´ñ日"), max_size=25))
def test_map_of_every_place(text):
    found = PositionMap(text, *TABLES)
    clean = plain_clean(text)
    assert found.before[-1] == len(clean) == len(found.places)
    assert (np.diff(found.before) >= 0).all()
    for p in range(len(text) + 1):
        if text[p - 1:p + 1] != "\\n" and not re.search(r"\\$", text[:p]):
            assert found.before[p] == len(plain_clean(text[:p]))
    for a in range(len(clean)):
        for b in range(a + 1, len(clean) + 1):
            s, e = found.to_raw(a, b)
            assert plain_clean(text[s:e]) == clean[a:b]
            assert found.to_cleaned(s, e) == (a, b)


TEXT = "A  “quoted”\\n#text ñ🙂 with\n\nlines 〈x〉."


def test_all_answers_move(spark):
    starts = [3, 0, TEXT.index("with"), TEXT.index("x〉")]
    texts = ["“quoted”", "A  “", "with\n\nlines", "x〉."]
    rows = [(1, TEXT, (starts, texts)), (2, None, ([0], ["a"])), (3, "plain", ([], [])), (4, "x", None)]
    df = spark.createDataFrame(rows, "id int, context string, answers struct<answer_start:array<int>,text:array<string>>")
    got = {r["id"]: r for r in clean_with_answers(df).collect()}
    clean = plain_clean(TEXT)
    assert got[1]["context"] == clean
    for s, t, raw in zip(got[1]["answers"]["answer_start"], got[1]["answers"]["text"], texts):
        assert clean[s:s + len(t)] == t == plain_clean(raw)
    assert got[3]["answers"]["answer_start"] == [] and got[4]["answers"]["answer_start"] is None
    assert got[2]["context"] is None


def test_predictions_are_found_in_the_raw_text(spark):
    clean = plain_clean(TEXT)
    spans = [(a, min(a + 4, len(clean))) for a in range(len(clean))] + [(5, 5), (-3, 2), (len(clean), 999)]
    df = spark.createDataFrame([(TEXT, [*spans, None]), (TEXT, None), ("", [(0, 3)])], "context string, spans array<struct<start:int,end:int>>")
    rows = to_raw(df, F.col("spans"), "raw").collect()
    for (a, b), r in zip(spans, rows[0]["raw"]):
        assert plain_clean(TEXT[r["start"]:r["end"]]) == clean[max(a, 0):b]
    assert rows[0]["raw"][-1] is None and rows[1]["raw"] is None and [tuple(x) for x in rows[2]["raw"]] == [(0, 0)]
    back = to_cleaned(to_raw(df, F.col("spans"), "raw"), F.col("raw"), "again").first()["again"]
    assert [tuple(x) for x in back[:len(clean)]] == spans[:len(clean)]


def test_the_cleaner_gives_as_many_characters(spark):
    texts = ["a\u0085b  c", "﻿x​y", "｜bar", "힣가 ㄱ", "\\\\n", "\\n\\n  #", TEXT * 50]
    df = spark.createDataFrame([(t, [(0, len(t))]) for t in texts], "context string, spans array<struct<start:int,end:int>>")
    for r in to_cleaned(df, F.col("spans"), "moved").select("moved", F.length(clean_qa("context")).alias("n")).collect():
        assert tuple(r["moved"][0]) == (0, r["n"])
