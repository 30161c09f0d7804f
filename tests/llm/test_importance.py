"""Importance resampling against a plain version, and quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake.llm.importance import crc32s, crc_table, importance_resample, kth_key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, max_n):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [" ".join(ws[i:i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, max_n=1, buckets=10_000, percent=10, min_words=20):
    def counted(texts):
        c = [0] * buckets
        for t in texts:
            for f in plain_features(t, max_n)[1]:
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c
    s, t = counted(x for _, x in docs), counted(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for d, x in docs:
        n, fs = plain_features(x, max_n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = k
    return [tuple(r) for r in out]


def key(row):
    return tuple((x is None, x) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=key)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=30))
def test_crc_of_many_texts(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    assert crc32s(data, starts, ends, crc_table()).tolist() == [zlib.crc32(t) for t in texts]


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta", "straße", "ÉTÉ", "été", "x" * 90, "42", "naïve", "omega"]
    return [(k, " -\n".join(rng.choices(words, k=rng.randrange(60)))) for k in range(n)]


@pytest.mark.parametrize("max_n, percent", [(1, 10), (2, 35), (3, 100), (1, 0)])
def test_against_the_plain_version(spark, docs_of, max_n, percent):
    docs = corpus(150) + [(5, None), (None, None), (7, ""), (8, "-.,"), (None, "word " * 30), (9, "alpha " * 25), (9, "alpha " * 25)]
    target = ["alpha beta gamma", None, "", "Naïve 42"]
    frame = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    got = importance_resample(docs_of(docs), frame, max_n=max_n, percent=percent, buckets=500, pivots=3)
    assert rows_of(got) == sorted(plain(docs, target, max_n, 500, percent), key=key)


def test_documents_are_carried_along(spark, docs_of):
    docs = corpus(60)
    frame = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    got = importance_resample(docs_of(docs), frame, with_document=True, min_words=1)
    assert sorted(r["document"]["text"] for r in got.where("rank is not null").collect()) == \
        sorted(dict(docs)[r[0]] for r in plain(docs, ["alpha"], min_words=1) if r[5])


def test_empty_tables(spark, docs_of):
    docs = docs_of(corpus(30))
    target = spark.createDataFrame([], "item_id string, text string")
    assert rows_of(importance_resample(docs, target)) == sorted(plain(corpus(30), []), key=key)
    assert rows_of(importance_resample(docs.where("doc_id < 0"), target)) == []


@pytest.mark.parametrize("k", [1, 2, 50, 199, 200])
def test_quickselect(spark, k):
    rng = random.Random(k)
    keys = [(rng.randrange(5), d is None, d, i) for i, d in enumerate(rng.choice([None, 1, 2, 3]) for _ in range(200))]
    rows = spark.createDataFrame(keys, "_down long, _no_id boolean, _id long, _row long").repartition(4)
    want = sorted(keys, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))[k - 1]
    assert kth_key(rows, k, pivots=4) == want


def test_rank_is_gapless_and_follows_scores(spark, docs_of):
    frame = spark.createDataFrame([("a", "alpha beta")], "item_id string, text string")
    got = importance_resample(docs_of(corpus(200)), frame, min_words=5, percent=50).where(F.col("rank").isNotNull()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)
