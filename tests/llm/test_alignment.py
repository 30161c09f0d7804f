"""Cross-tokenizer alignment against a plain version that compares all byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlake.llm.alignment import (Encoder, _files, byte_alphabet,
                                    cross_tokenizer_alignment, ranks_by_galloping)
from spanlake.llm.queries import QUERIES

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(text):
    """Both sides as (id, bytes) of the whole text, or nothing if a side is not whole."""
    if not text:
        return [], []
    of = byte_alphabet()
    a = [(i, bytes(of[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain(rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        sides = plain_tokens(text)
        spans = []
        for side in sides:
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        a, b = spans
        common = sorted({x[1] for x in a} & {x[1] for x in b})
        groups, lo = [], 0
        for hi in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in (a, b)))
            lo = hi
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(d, na, nb, len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def key(row):
    return tuple((x is None, x) for x in row)


def checked(df, rows):
    got = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


TEXTS = ["the cat sat on the mat", "", None, " ", "  two  spaces  ", "a\nb\r\nc\td", "naïve café – déjà vu",
         "<|endoftext|> and <s>x</s> <unk> <0x41>", "日本語のテキストです。", "a▁b is not whole", "🙂🙃 emoji👩‍👩‍👧", "x" * 700,
         "don't can't we'll I'd", "1234567 3.14159 12,345", "\x00nul \x7f", "é combining", "the cat sat on the mat",
         "end.\n\nNew paragraph  with\ttabs ", "ﬁne ligature", "antidisestablishmentarianism " * 40, "　wide space", "?!... (x)"]


@given(st.lists(st.integers(0, 300)), st.lists(st.integers(0, 300)))
def test_galloping_ranks(short, long):
    short, long = sorted(set(short)), sorted(set(long))
    assert ranks_by_galloping(short, long) == [sum(y < x for y in long) for x in short]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n.▁日'́ \t1<")), st.text()), max_size=6))
def test_parts_give_the_ids_of_whole_texts(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    a, a_bound, b, b_bound = ENCODER.encode(texts)
    for k, t in enumerate(texts):
        want = plain_tokens(t)
        assert a[a_bound[k]:a_bound[k + 1]].tolist() == [i for i, _ in want[0]]
        assert b[b_bound[k]:b_bound[k + 1]].tolist() == [i for i, _ in want[1]]


ENCODER = Encoder(*_files(None, None))


def test_small_and_odd_texts(spark, docs_of):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, "another text"), (None, None)]
    checked(cross_tokenizer_alignment(docs_of(rows)), rows)


@pytest.mark.parametrize("block", [1, 40])
def test_counted_pairs_in_blocks(spark, docs_of, block):
    rng = random.Random(5)
    words = "the of quick brown unbelievable straße jumps 42 over's ok".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(40)] + [(1, None), (1, "the of")]
    checked(cross_tokenizer_alignment(docs_of(rows), block_pairs=150 * block), rows)


def test_empty_table(spark, docs_of):
    empty = docs_of([(1, "x")]).where("doc_id = 2")
    assert cross_tokenizer_alignment(empty).collect() == []


def test_groups_are_the_digested_texts(spark, docs_of):
    got = cross_tokenizer_alignment(docs_of([(1, "Hello tokenization"), (2, None)]), with_groups=True).collect()
    for r in got:
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    assert {r["doc_id"]: r["groups"].count("|") for r in got} == {1: [r["n_groups"] for r in got if r["doc_id"] == 1][0], 2: 0}


def test_long_text_without_spaces(spark, docs_of):
    rows = [(1, "ab" * 4000), (2, "x y " * 2000)]
    checked(cross_tokenizer_alignment(docs_of(rows)), rows)


def test_query_on_the_smallest_tables(spark, sf_small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    df = QUERIES["op13_cross_tokenizer_alignment"](spark, sf_small)
    got = {tuple(r) for r in df.select(COLUMNS).collect()}
    assert len(got) == len(rows)
    want = {r[0]: r for r in plain_without_links(rows)}
    for r in got:
        assert r[:4] + r[7:] == want[r[0]]


def plain_without_links(rows):
    for doc_id, text in rows:
        ends, out = [], []
        sides = plain_tokens(text)
        for side in sides:
            ends.append(np.cumsum([len(x) for _, x in side]).tolist())
        common = sorted(set(ends[0]) & set(ends[1]))
        i = j = 0
        for hi in common:
            i2, j2 = ends[0].index(hi, i) + 1, ends[1].index(hi, j) + 1
            out.append(",".join(str(x) for x, _ in sides[0][i:i2]) + "|" + ",".join(str(x) for x, _ in sides[1][j:j2]))
            i, j = i2, j2
        yield (doc_id, len(sides[0]), len(sides[1]), len(out), hashlib.sha256(";".join(out).encode()).hexdigest() if out else "")
