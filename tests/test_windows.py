"""Offsets, window coverage and overlap, labels (incl. the overrun case)."""

import re

import pytest
from pyspark.sql import functions as F

from spanlake.operators import windows as Wn


def py_tokens(text):
    out, pos = [], 0
    for m in re.finditer(r"[^\W_]+|[\W_]", text):
        seg = m.group(0)
        if not seg.isspace():
            out.append((seg, pos, pos + len(seg)))
        pos += len(seg)
    return out


def test_token_offsets_cover_text(spark):
    texts = ["Hello, world!  Ça va? 한국어 12.5%", "", "   ", "a\tb\nc", "x😀y 𝄞z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, context string")
    got = {}
    for r in Wn.token_offsets(df).orderBy("id", "tok_idx").collect():
        got.setdefault(r.id, []).append((r.token, r.start, r.end))
    for i, t in enumerate(texts):
        toks = got.get(i, [])
        assert toks == py_tokens(t), (t, toks)
        for tok, s, e in toks:
            assert t[s:e] == tok


def vocab(spark):
    return Wn.vocabulary_from_terms(spark.createDataFrame([(w,) for w in "a b c d e q".split()], "term string"))


def build(spark, n_ctx, question="q", spec=Wn.WindowSpec(max_seq_length=12, doc_stride=3, pad_to_max_length=False)):
    ctx = " ".join(["a"] * n_ctx)
    ex = spark.createDataFrame([(1, question, ctx)], "id int, question string, context string")
    return Wn.windows(Wn.encode(ex, vocab(spark)), spec).orderBy("window").collect()


@pytest.mark.parametrize("n_ctx", [7, 8, 9, 20, 33])
def test_windows_cover_and_overlap(spark, n_ctx):
    # cap = 12 - 1 - 3 = 8, stride 3 -> step 5
    rows = build(spark, n_ctx)
    cap, step = rows[0].cap, rows[0].step
    assert (cap, step) == (8, 5)
    expected = 1 if n_ctx <= cap else 1 + -(-(n_ctx - cap) // step)
    assert len(rows) == expected
    covered = set()
    for a, b in zip(rows, rows[1:]):
        assert a.we - b.ws == 3  # neighbours overlap by exactly the stride
    for r in rows:
        covered |= set(range(r.ws, r.we))
        assert r.we - r.ws <= cap
    assert covered == set(range(n_ctx))


def test_question_too_long_is_an_error(spark):
    with pytest.raises(Exception):
        build(spark, 5, question=" ".join(["q"] * 6))


def labels(spark, ctx, start, text, compat=False, spec=Wn.WindowSpec(max_seq_length=9, doc_stride=2,
                                                                        pad_to_max_length=True)):
    ans = "struct(array({s}) as answer_start, array('{t}') as text)".format(s=start, t=text) if start is not None \
        else "struct(cast(array() as array<int>) as answer_start, cast(array() as array<string>) as text)"
    ex = spark.createDataFrame([(1, "q", ctx)], "id int, question string, context string") \
        .withColumn("answers", F.expr(ans))
    enc = Wn.encode(ex, vocab(spark))
    f = Wn.span_labels(Wn.pair_features(Wn.windows(enc, spec), spec, eval_mode=False), compat=compat)
    return [(r.window, r.start_positions, r.end_positions) for r in f.orderBy("window").collect()]


def test_labels(spark):
    ctx = "a b c d e a b c d e"  # 10 tokens; cap = 9 - 1 - 3 = 5, step 3
    # no answer -> [CLS]
    assert all(s == 0 and e == 0 for _, s, e in labels(spark, ctx, None, ""))
    # "c d" at chars 4..7 (tokens 2..3): inside window 0 at positions 3 + 2, 3 + 3
    res = labels(spark, ctx, 4, "c d")
    assert res[0] == (0, 5, 6)
    # window 1 covers tokens 3..7: the answer starts before it -> [CLS]
    assert res[1][1:] == (0, 0)
    # answer in the first context token of window 0
    assert labels(spark, ctx, 0, "a")[0] == (0, 3, 3)
    # answer in the last context token of window 0 (token 4 = "e" at char 8)
    clamp = labels(spark, ctx, 8, "e")[0]
    assert clamp == (0, 7, 7)
    compat = labels(spark, ctx, 8, "e", compat=True)[0]
    assert compat == (0, 8, 7)  # the reference's overrun: last index of the row, start > end


def test_padding_and_masks(spark):
    spec = Wn.WindowSpec(max_seq_length=12, doc_stride=3, pad_to_max_length=True)
    ex = spark.createDataFrame([(1, "q", "a b c")], "id int, question string, context string")
    f = Wn.pair_features(Wn.windows(Wn.encode(ex, vocab(spark)), spec), spec).first()
    assert len(f.input_ids) == 12 and sum(f.attention_mask) == 1 + 1 + 1 + 3 + 1
    assert f.input_ids[:2] == [Wn.CLS_ID, f.input_ids[1]] and f.input_ids[-1] == Wn.PAD_ID
    assert f.offset_mapping[:3] == [None, None, None] and f.offset_mapping[3] is not None
    assert f.sequence_ids[:3] == [None, 0, None] and f.sequence_ids[3:6] == [1, 1, 1]


def test_vocab_extension(spark):
    v = vocab(spark)
    add = Wn.extend_vocabulary(v, Wn.added_symbols(spark)).orderBy("id").collect()
    assert len(add) == 299 and add[0].token == "[UNK1]" and add[-1].token == "[unused699]"
    last = v.agg(F.max("id")).first()[0]
    assert [r.id for r in add] == list(range(last + 1, last + 300))


def test_rows_with_one_id_stay_rows(spark):
    spec = Wn.WindowSpec(max_seq_length=12, doc_stride=3, pad_to_max_length=False)
    ex = spark.createDataFrame([(1, "q", "a b c"), (1, "q", "d e"), (2, None, None)], "id int, question string, context string")
    got = sorted((r.id, r.input_ids) for r in Wn.pair_features(Wn.windows(Wn.encode(ex, vocab(spark)), spec), spec).collect())
    ids = {t: i for t, i in zip("abcdeq", range(4, 10))}
    cls, sep = Wn.CLS_ID, Wn.SEP_ID
    assert got == [(1, [cls, ids["q"], sep, ids["a"], ids["b"], ids["c"], sep]),
                   (1, [cls, ids["q"], sep, ids["d"], ids["e"], sep]), (2, [cls, sep, sep])]


def test_vocabulary_too_large_for_the_tasks_is_joined(spark):
    rows = [(1, "q a", "a b zz A"), (1, "", "c  d"), (3, None, None)]
    ex = spark.createDataFrame(rows, "id int, question string, context string").withColumn("extra", F.lit("x"))
    small, joined = (Wn.encode(ex, vocab(spark), max_broadcast_bytes=n) for n in (1 << 20, 1))
    assert small.columns == joined.columns
    key = ["id", "c_ids"]
    assert sorted(small.collect(), key=lambda r: [str(r[k]) for k in key]) == sorted(joined.collect(), key=lambda r: [str(r[k]) for k in key])


def test_layouts(spark):
    ex = spark.createDataFrame([(1, "q q", "a b c")], "id int, question string, context string")
    v = {r.token: r.id for r in vocab(spark).collect()}
    a, b, c, q = (v[t] for t in "abcq")
    cls, sep, pad = Wn.CLS_ID, Wn.SEP_ID, Wn.PAD_ID

    def row(**kw):
        spec = Wn.WindowSpec(max_seq_length=12, doc_stride=2, **kw)
        return Wn.pair_features(Wn.windows(Wn.encode(ex, vocab(spark)), spec), spec).first()
    left = row(side="left")
    assert left.input_ids == [pad] * 4 + [cls, a, b, c, sep, q, q, sep]
    assert left.attention_mask == [0] * 4 + [1] * 8 and left.token_type_ids == [0] * 9 + [1] * 3
    assert left.sequence_ids == [None] * 5 + [0, 0, 0, None, 1, 1, None]
    assert [o and (o.start, o.end) for o in left.offset_mapping] == [None] * 5 + [(0, 1), (2, 3), (4, 5)] + [None] * 4
    assert (left.context_start, left.cls_index) == (5, 4)
    double = row(double_separator=True)
    assert double.input_ids == [cls, q, q, sep, sep, a, b, c, sep, pad, pad, pad] and double.cap == 12 - 2 - 4
    assert double.sequence_ids == [None, 0, 0, None, None, 1, 1, 1, None, None, None, None]
    assert double.token_type_ids == [0] * 5 + [1] * 4 + [0] * 3
    both = row(side="left", double_separator=True)
    assert both.input_ids == [pad] * 3 + [cls, a, b, c, sep, sep, q, q, sep]
    with pytest.raises(ValueError):
        Wn.WindowSpec(side="up")


def test_labels_of_the_left_layout(spark):
    ctx = "a b c d e a b c d e"
    spec = Wn.WindowSpec(max_seq_length=10, doc_stride=2, side="left")  # cap 6, step 4: windows of 6 and 6 tokens
    assert labels(spark, ctx, 4, "c d", spec=spec)[0] == (0, 3, 4)
    assert labels(spark, ctx, None, "", spec=spec)[0] == (0, 0, 0)
    wide = Wn.WindowSpec(max_seq_length=20, doc_stride=2, side="left")  # 14 ids behind 6 of padding
    assert labels(spark, ctx, 4, "c d", spec=wide) == [(0, 6 + 3, 6 + 4)]
    assert labels(spark, ctx, None, "", spec=wide) == [(0, 6, 6)]


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
def test_batch_padding(spark, max_bytes):
    rows = [(i, w, [1] * (1 + (7 * i + 3 * w) % 11)) for i in (5, 2, 9) for w in range(i % 4 + 1)]
    f = spark.createDataFrame(rows, "id int, window int, input_ids array<int>").repartition(3)
    out = Wn.batch_pad(f, batch_size=3, multiple=4, max_broadcast_bytes=max_bytes).orderBy("feature_ordinal").collect()
    order = sorted(rows)
    assert [(r.id, r.window) for r in out] == [r[:2] for r in order]
    for k, r in enumerate(out):
        longest = max(len(x[2]) for x in order[k // 3 * 3:k // 3 * 3 + 3])
        assert (r.feature_ordinal, r.batch) == (k, k // 3)
        assert len(r.input_ids) == r.padded_length == -(-longest // 4) * 4
        assert r.input_ids[:len(order[k][2])] == order[k][2]
