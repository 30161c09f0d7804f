"""The pipeline, stage by stage, against plain versions on the stage's own input."""

import math

import corpus_pipeline
from spanlake.llm.language import MARK, learn
from test_decontamination import brute as contaminated
from test_decontamination import windows
from test_lines import brute as lines
from test_packing import by_document, check_bins
from test_simhash import brute_print, roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def log_probability(word, of, unknown):
    """Of a word: the sum over all segmentations, by a plain recurrence."""
    best = [1.0] + [0.0] * len(word)
    for t in range(1, len(word) + 1):
        for k in range(1, min(t, 16) + 1):
            piece = word[t - k:t]
            p = of.get(piece, unknown if k == 1 else 0.0)
            best[t] += best[t - k] * p
    return math.log(best[len(word)])


def known_language(text, model, memo):
    if not text or not any(c.isalpha() for c in text):
        return False
    totals = [0.0] * len(model.languages)
    for word in text.lower().split():
        if word not in memo:
            memo[word] = [log_probability(MARK + word, of, unknown) for of, unknown in model_tables(model)]
        totals = [a + b for a, b in zip(totals, memo[word])]
    top = max(totals)
    return 1 / sum(math.exp(t - top) for t in totals) >= 0.5


def model_tables(model, made={}):
    if id(model) not in made:
        made[id(model)] = [(dict(zip(model.pieces, model.p[:, c])), model.p[len(model.pieces), c]) for c in range(len(model.languages))]
    return made[id(model)]


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_against_a_plain_version(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        after.append((name, before, docs))
    _, before, kept = after[0]
    model, memo = learn(before), {}
    assert rows(kept) == [r for r in rows(before) if known_language(r[1], model, memo)]
    _, before, kept = after[1]
    want = {i: t for i, _, _, t in lines([r[:2] for r in rows(before)])}
    assert rows(kept) == sorted(((r[0], want[r[0]], r[2], r[3], len(want[r[0]])) for r in rows(before)), key=str)
    _, before, kept = after[2]
    data = rows(before)
    prints = [brute_print(r[1]) for r in data]
    root = roots(len(data), [(a, b) for a in range(len(data)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3])
    least = {}
    for k, r in enumerate(data):
        least[root[k]] = min(least.get(root[k], r[0]), r[0])
    assert rows(kept) == [r for k, r in enumerate(data) if least[root[k]] == r[0]] and len(least) < len(data)
    _, before, kept = after[3]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    wins = windows(items, 10)
    assert rows(kept) == [r for r in rows(before) if not contaminated(r[1], wins)[4]]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()
    assert by_document(packed).keys() == {r[0] for r in rows(docs)}
    assert check_bins(packed, 2048) <= -(-sum(r.length for r in packed) // 2048) + 1
    ran = corpus_pipeline.run(spark, sf_small).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, ran.collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_odd_and_empty_documents(spark, sf_small, docs_of):
    odd = docs_of([(1, None), (2, ""), (3, "123"), (None, "the words of a text"), (4, "the words of a text"), (5, "x" * 100000),
                   (5, "x" * 100000)]).select(*COLUMNS)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_small)
        assert docs.count() >= 0
