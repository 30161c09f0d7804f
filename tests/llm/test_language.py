import itertools
import math
import random

import numpy as np
import pytest

from spanlake.llm import language
from spanlake.llm.language import Lattice, Model, identified, learn, predict, public_pieces, text_words
from spanlake.llm.q_corpus import op9

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "bab", "▁ab"]


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES or n == 1:
            for rest in segmentations(word[n:]):
                yield [PIECES.index(word[:n]) if word[:n] in PIECES else len(PIECES), *rest]


@pytest.fixture
def p():
    p = np.random.default_rng(1).random((len(PIECES) + 2, 2))
    p[-1] = 0
    return p


WORDS = ["▁" + "".join(x) for n in range(0, 6) for x in itertools.product("abz", repeat=n)]


def test_forward_sums_all_segmentations(p):
    got = Lattice(PIECES).log_scores(WORDS, p)
    for w, row in zip(WORDS, got):
        want = sum(np.prod(p[s], axis=0) for s in segmentations(w))
        assert np.allclose(row, np.log(want))


def test_expected_uses_against_all_segmentations(p):
    counts = np.random.default_rng(2).integers(0, 5, (len(WORDS), 2)).astype(float)
    want = np.zeros_like(p)
    for w, c in zip(WORDS, counts):
        each = [(s, np.prod(p[s], axis=0)) for s in segmentations(w)]
        total = sum(x for _, x in each)
        for s, x in each:
            for i in s:
                want[i] += c * x / total
    assert np.allclose(Lattice(PIECES).expected(WORDS, counts, p), want)


def test_words_keep_every_character():
    text = "Ab  ÇD\n" + "x" * 100 + " 日本"
    assert "".join(text_words(text)).replace("▁", "") == "".join(text.lower().split())


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_long_words_equal_the_unsplit_recursion(p, monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    rng, words, counts = random.Random(3), ["▁ab"], [[2.0, 1.0]]
    for n in (32, 33, 100, 500, 3000):
        words.append("▁" + "".join(rng.choices("abz", k=n)))
        counts.append([1.0, 3.0])
    lattice, log_p = Lattice(PIECES), np.log(p[:-1])
    got, want_uses = lattice.log_scores(words, p), np.zeros_like(p)
    for w, c, row in zip(words, counts, got):
        n = len(w)
        edges = [(i, j, PIECES.index(w[i:j]) if w[i:j] in PIECES else len(PIECES)) for i in range(n)
                 for j in range(i + 1, min(i + 3, n) + 1) if j == i + 1 or w[i:j] in PIECES]
        alpha, beta = np.full((n + 1, 2), -np.inf), np.full((n + 1, 2), -np.inf)
        alpha[0] = beta[n] = 0
        for i, j, k in edges:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_p[k])
        for i, j, k in reversed(edges):
            beta[i] = np.logaddexp(beta[i], beta[j] + log_p[k])
        for i, j, k in edges:
            want_uses[k] += np.array(c) * np.exp(alpha[i] + log_p[k] + beta[j] - alpha[n])
        assert np.isfinite(row).all() and np.allclose(row, alpha[n])
    assert np.allclose(lattice.expected(words, np.array(counts), p), want_uses)


def rows():
    rng = random.Random(1)
    vocab = {"en": ["the", "thing", "and", "with", "which"], "de": ["der", "und", "schön", "nicht", "ich"]}
    out = []
    for i in range(200):
        lang = rng.choice(["en", "de"])
        out.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(3, 40))), lang))
    return out


def test_predictions_and_edge_rows(docs_of):
    data = rows()
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 ... !", "de"), (None, "the thing and", "en"), (1003, None, None),
           (1004, "und nicht " * 20000, None), (1004, "und nicht", "de"), (1005, "日本語 テキスト", None)]
    docs = docs_of([(i, t) for i, t, _ in data + odd], [x for _, _, x in data + odd])
    model = learn(docs)
    assert model.languages == ["de", "en"]
    got = {}
    for r in predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(got[i] == [(lang, pytest.approx(got[i][0][1]))] and 0.5 < got[i][0][1] <= 1 for i, _, lang in data)
    assert got[1000] == got[1001] == got[1002] == got[1003] == [("und", 0.0)]
    assert got[None][0][0] == "en" and {x[0] for x in got[1004]} == {"de"} and len(got[1004]) == 2
    assert 0 < got[1005][0][1] <= 1
    kept = identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, _, _ in data} | {None, 1004}
    assert not {1000, 1001, 1002, 1003} & {r.doc_id for r in kept.collect()}
    none = learn(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in predict(docs, none).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark, sf_small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = op9(spark, sf_small).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in out)


def test_public_vocabulary():
    pieces = public_pieces()
    assert len(pieces) == len(set(pieces)) > 30000 and "▁the" in pieces and "<s>" not in pieces
    assert Model(["x"], pieces).p[-1, 0] == 0
