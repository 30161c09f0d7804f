import hashlib
import random

import numpy as np
import pytest

from spanlake.llm.suffixes import contexts, deduplicated_bytes, repeated_starts, suffix_order, union_of
from spanlake.llm.textarrays import Powers


def brute(rows, length=100):
    """Documents in order; the set of earlier strings decides."""
    data = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is not None, data[k][0] or 0))
    seen, out = set(), {}
    for k in order:
        i, b = data[k]
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:len(b)]).sum())
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order_against_sorting():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(0, 60))]
        top = max(s, default=1)
        assert suffix_order(np.array(s, np.int64), top).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_every_string_has_one_context_and_equal_strings_equal_names():
    rng = random.Random(2)
    common = bytes(rng.randrange(97, 105) for _ in range(400))
    texts = [bytes(rng.randrange(97, 99) for _ in range(rng.randrange(0, 300))) + common[rng.randrange(200):] for _ in range(12)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    rows, lo, count, name, _ = contexts(data, offsets, 100, 50, Powers())
    seen, names = set(), {}
    for r, a, n, k in zip(rows.tolist(), lo.tolist(), count.tolist(), name.tolist()):
        for s in range(a, a + n):
            assert offsets[r] <= s and s + 100 <= offsets[r + 1] and s not in seen
            seen.add(s)
            assert names.setdefault(data[s:s + 100].tobytes(), k) == k
    assert len(seen) == sum(max(0, len(t) - 99) for t in texts)


def test_repeated_starts_in_a_block():
    texts = [b"abcabcabc", b"xxabcabcyy", b"\0\0\0\0", b"ab"]
    got = repeated_starts(texts, np.array([100, 0, 200, 300]), 4)
    # abca is first at 2, bcab at 3 and cabc at 4 of the second text
    assert [x.tolist() for x in got] == [[0, 1, 2, 3, 4, 5], [], [], []]
    got = repeated_starts([b"aaaaaa"], np.array([7]), 3)
    assert [x.tolist() for x in got] == [[1, 2, 3]]


def test_union_of_spans():
    assert union_of(np.array([5, 0, 20, 10]), np.array([10, 3, 30, 12])) == [(0, 3), (5, 12), (20, 30)]
    assert union_of(np.array([], np.int64), np.array([], np.int64)) == []


def sample():
    rng = random.Random(3)
    words = ["été", "word", "日本", "x", "lorem"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(n))
    passage, line = prose(40), prose(12)
    rows = [(1, None), (2, ""), (3, "short"), (4, prose(300)), (5, "a" * 3000), (6, "ab" * 200 + "a" * 150)]
    for i in range(10, 60):
        own = prose(rng.randrange(5, 60))
        k = rng.randrange(0, 200)
        rows.append((i, rng.choice([own, own + passage, passage[k:] + own, own + line + own, passage[:-k - 1] + line + passage, own + own])))
    base = prose(200)
    for i in range(60, 90):
        cut = rng.randrange(len(base))
        rows.append((i, base[:cut] + rng.choice(["", "!", "é", "edited "]) + base[cut + rng.randrange(3):]))
    return rows + [(None, passage), (90, base), (91, base), (92, passage[:99]), (93, passage[:100]), (94, "é" + passage[1:101])]


@pytest.mark.parametrize("name_limit", [5000, 3])
def test_removed_bytes_against_brute_force(docs_of, name_limit):
    rows = sample()
    out = deduplicated_bytes(docs_of(rows), filter_bits=1 << 20, name_limit=name_limit).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert len(out) == len(rows) and got == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_tiny_filter_repeated_rows_and_empty_table(docs_of):
    rows = sample()[:40]
    twice = docs_of(rows + rows[4:8])
    got = {}
    for r in deduplicated_bytes(twice, filter_bits=4096).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = brute(rows)
    assert all(set(v) == {want[k]} for k, v in got.items()) and sum(map(len, got.values())) == len(rows) + 4
    assert deduplicated_bytes(docs_of(rows).limit(0), filter_bits=4096).count() == 0


def test_query_on_the_small_table(spark, sf_small):
    from spanlake.llm.q_corpus import op5
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = brute(docs)
    assert {r[0]: tuple(r)[1:] for r in op5(spark, sf_small).collect()} == want
