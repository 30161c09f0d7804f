"""W1 + W9: subword pieces against a plain longest-match version."""

import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlake.functions.text import SEGMENT
from spanlake.operators import windows as Wn
from spanlake.operators.subwords import Cutter, PieceTrie, Subwords, lowered, subword_vocabulary

SYMBOLS = {"[UNK1]": 90, "[UNK12]": 91, "[unused500]": 92, "<a>": 93}


def plain(text, vocab, symbols):
    """Tries every end from the far one for each piece, and every symbol at each place."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        for s in sorted(symbols, key=len, reverse=True):
            if text.startswith(s, at):
                out.append((symbols[s], at, at + len(s)))
                at += len(s)
                break
        else:
            end = regex.compile(SEGMENT).match(text, at).end()
            segment = lowered(text[at:end])
            if not segment.isspace():
                pieces, i = [], 0
                while i < len(segment):
                    for j in range(len(segment), i, -1):
                        piece = ("##" if i else "") + segment[i:j]
                        if piece in vocab:
                            pieces.append((vocab[piece], at + i, at + j))
                            i = j
                            break
                    else:
                        pieces = [(Wn.UNK_ID, at, end)]
                        break
                out += pieces
            at = end
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(st.sampled_from("abc#"), min_size=1, max_size=4), max_size=12), st.text(st.sampled_from("abcABC é."), max_size=20))
def test_longest_pieces(pieces, text):
    vocab = {p: 10 + i for i, p in enumerate(sorted(pieces))}
    trie, got = PieceTrie(vocab.items()), []
    for s, e, number in Cutter({})(text):
        for a, b, i in trie.pieces(lowered(text[s:e])) or [(0, e - s, Wn.UNK_ID)]:
            got.append((i, s + a, s + b))
    # a token that is ## alone, or continues nothing, begins no segment
    assert got == plain(text, {p: i for p, i in vocab.items() if p.startswith("##") or "#" not in p} | {
        p: i for p, i in vocab.items() if not p.startswith("##")}, {})


VOCAB = {t: 10 + i for i, t in enumerate(
    ["un", "##aff", "##able", "a", "##a", "b", "##b", "ab", "##ab", "abc", "é", "##é", ".", "[", "]", "1", "##2", "unk", "日", "##本", "i̇"])}
TEXTS = ["unaffable UNAFFABLE", "aab abab abcab", "[UNK1] [UNK12] x[UNK1]a [UNK123] [unk1]", "<a>ab<a", "ÉéÉ. é", None, "", " \t ",
         "日本 日x", "İ ab", "12 21", "[unused500]ab[unused500]", "abab" * 300, "a\x00b 🙂a"]


def tokens_of(spark, subwords, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    out = subwords.tokens(df, {"text": "toks"})
    assert set(out.columns) == {"id", "text", "toks"}
    return {r["id"]: [tuple(x) for x in r["toks"]] for r in out.collect()}


@pytest.mark.parametrize("max_nodes", [1000, 12, 3])
def test_pieces_symbols_offsets_and_blocks(spark, max_nodes):
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, id long")
    symbols = spark.createDataFrame(list(SYMBOLS.items()), "token string, id long")
    subwords = Subwords(vocab, symbols, max_nodes)
    assert (len(subwords.tries) > 1) == (max_nodes < 1000)
    assert tokens_of(spark, subwords, TEXTS) == {i: plain(t, VOCAB, SYMBOLS) for i, t in enumerate(TEXTS)}


def test_empty_vocabulary_and_no_symbols(spark):
    vocab = spark.createDataFrame([], "token string, id long")
    assert tokens_of(spark, Subwords(vocab), TEXTS) == {i: plain(t, {}, {}) for i, t in enumerate(TEXTS)}


def test_vocabulary_by_rule(spark):
    df = spark.createDataFrame([("Abcd ab",), ("ab x",), (None,)], "text string")
    got = {r["token"]: r["id"] for r in subword_vocabulary(df).collect()}
    want = sorted({"ab"} | {"a", "ab", "abc", "x"} | {"##b", "##bc", "##c", "##cd", "##d"})
    assert got == {s: i for i, s in enumerate(Wn.SPECIALS)} | {t: 4 + i for i, t in enumerate(want)}


def test_features_have_the_pieces_of_their_windows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["unaffable", "abab", "[UNK1]", "é.", "zzz"], k=60)) for _ in range(5)]
    rows = [(i, "ab un", t) for i, t in enumerate(texts)]
    examples = spark.createDataFrame(rows, "id long, question string, context string")
    subwords = Subwords(spark.createDataFrame(list(VOCAB.items()), "token string, id long"),
                        spark.createDataFrame(list(SYMBOLS.items()), "token string, id long"))
    spec = Wn.WindowSpec(max_seq_length=40, doc_stride=10)
    for r in Wn.eval_features(examples, spec=spec, subwords=subwords).collect():
        context = [(i, o["start"], o["end"]) for i, o in zip(r["input_ids"], r["offset_mapping"]) if o is not None]
        whole = plain(texts[r["example_id"]], VOCAB, SYMBOLS)
        at = whole.index(context[0])
        assert context and whole[at:at + len(context)] == context


def test_symbols_of_an_empty_vocabulary_get_the_first_ids(spark):
    vocab = spark.createDataFrame([], "token string, id long")
    symbols = spark.createDataFrame([("x", 1), ("y", 2)], "token string, ord long")
    assert {tuple(r) for r in Wn.extend_vocabulary(vocab, symbols).select("token", "id").collect()} == {("x", 0), ("y", 1)}


def test_tokens_of_a_long_text_take_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "ab cd. " * n)], "id long, context string")
        t0 = time.perf_counter()
        Wn.token_offsets(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0
    seconds(100)
    assert seconds(40_000) < 2.5 * seconds(20_000) + 2
