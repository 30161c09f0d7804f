import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanlake.llm.packing import Places, bin_plan, fullest, pack_documents, pieces
from spanlake.llm.q_corpus import op2


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [None, "", " ", "a", "Isn't it 12.5% of “Ünï”?   x\x1cy z\r\n\ttab", "é ́", "日本語テキスト のテスト",
         "<|endoftext|> is an id <|startoftext|>", "x<|endoftext|>y <|ENDOFTEXT|> <|endoftext|><|endoftext|>\n<|startoftext|> |", "word " * 3000, "x" * 30000, "İI ΑΣ ß ﬁ ퟿😀", "a\n\nb\n"]


def by_document(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece) for k, v in out.items()}


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(bins)


def test_pieces_hold_the_whole_texts_ids(docs_of, whole):
    rows = by_document(pieces(docs_of(list(enumerate(TEXTS))), capacity=700, with_ids=True).collect())
    for i, t in enumerate(TEXTS):
        ids = whole(t)
        assert [x for r in rows[i] for x in r.ids] == ids
        assert [r.start for r in rows[i]] == list(range(0, len(ids), 700))
        for k, r in enumerate(rows[i]):
            part = ids[700 * k:700 * (k + 1)]
            assert (r.piece, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))


def test_packed_documents_fill_sequences_without_gaps(docs_of, whole):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + i, "w " * rng.randrange(0, 900)) for i in range(80)]
    rows += [(500, "same text"), (500, "same text"), (None, "no id")]
    out = pack_documents(docs_of(rows), capacity=512).collect()
    bins = check_bins(out, 512)
    total = sum(len(whole(t)) for _, t in rows)
    assert sum(r.length for r in out) == total and bins <= -(-total // 512) + 1
    assert pack_documents(docs_of(rows).limit(0)).count() == 0


def test_query_on_the_small_table(spark, sf_small, whole):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = op2(spark, sf_small).collect()
    assert out[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins = check_bins(out, 2048)
    lengths = {i: whole(t) for i, t in docs.items()}
    got = by_document(out)
    assert got.keys() == docs.keys()
    for i, ids in lengths.items():
        assert [(r.start, r.length) for r in got[i]] == [(s, len(ids[s:s + 2048])) for s in range(0, len(ids), 2048)]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in got[i])
    assert bins <= -(-sum(map(len, lengths.values())) // 2048) + 1


def test_fullest_combination_against_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        counts = {}
        for _ in range(rng.randrange(1, 9)):
            counts[rng.randrange(1, 30)] = rng.randrange(1, 4)
        room = rng.randrange(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = fullest(counts, sorted(counts, reverse=True), room)
        assert all(0 < n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_up_the_histogram_and_places_every_rank():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(60)} | {100: 5000}
    plan = bin_plan(histogram, 100)
    used = {}
    for chosen, bins in plan:
        assert bins > 0 and sum(k * n for k, n in chosen.items()) <= 100
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + n * bins
    assert used == histogram
    assert len(plan) <= 4 * len(histogram)
    places = Places(plan, 100)
    seen = {}
    for length, n in histogram.items():
        seq, off = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist()):
            seen.setdefault(s, []).append((o, length))
    assert len(seen) == places.sequences == sum(b for _, b in plan)
    for parts in seen.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 100
    assert bin_plan({}, 100) == []
