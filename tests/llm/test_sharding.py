import itertools
import random
import zlib

from spanlake.llm.sharding import difference, shard_by_bytes


def spread(items, slots, shards):
    sums = [0] * shards
    for v, to in zip(items, slots):
        for s, x in enumerate(v):
            sums[to[s]] += x
    return sorted(sums, reverse=True)


def test_difference_places_every_slot_once():
    rng = random.Random(7)
    items = [[rng.randrange(0, 1000) for _ in range(rng.choice([1, 4]))] for _ in range(200)]
    sums, slots = difference(items, 4)
    assert all(sorted(s) == [0, 1, 2, 3] for s in slots)
    assert spread(items, slots, 4) == sums
    assert sums[0] - sums[-1] <= 5
    assert difference([], 4) == ([], [])
    assert difference([[5]], 2)[0] == [5, 0]


def test_two_way_differencing_known_example_and_near_the_best():
    assert difference([[8], [7], [6], [5], [4]], 2)[0] == [16, 14]
    rng = random.Random(8)
    for _ in range(20):
        sizes = [rng.randrange(1, 50) for _ in range(9)]
        best = min(max(sum(x for x, g in zip(sizes, c) if g == k) for k in range(3))
                   for c in itertools.product(range(3), repeat=9))
        assert difference([[x] for x in sizes], 3)[0][0] <= 1.15 * best


def test_shards_of_documents(docs_of):
    rng = random.Random(11)
    texts = ["t" * rng.randrange(1, 400) + str(i) for i in range(300)] + [None, "", "é" * 50, "z" * 9000]
    rows = list(enumerate(texts)) + [(1000 + i, texts[5]) for i in range(60)] + [(3, texts[3]), (None, "no id"), (None, "no id")]
    for fan in (20_000, 12):
        out = shard_by_bytes(docs_of(rows), shards=8, fan=fan).collect()
        by_id = {}
        for i, t in rows:
            by_id.setdefault(i, []).append(t)
        assert len(out) == len(rows)
        sums, slots, of_text = [0] * 8, {}, {}
        for r in out:
            data = [(t or "").encode() for t in by_id[r.doc_id]]
            assert r.size == len(data[0]) + 1 and r.text_crc32 == zlib.crc32(data[0])
            sums[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
            of_text.setdefault(r.text_md5, set()).add(r.shard)
        assert all(len(v) == 1 for v in of_text.values())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        big = 60 * (len(texts[5]) + 1)
        rest = sorted(sums, reverse=True)[2:] if big > sum(sums) / 8 else sums
        assert max(rest) - min(rest) <= 30
    assert shard_by_bytes(docs_of(rows).limit(0)).count() == 0


def test_query_balances_the_table(spark, sf_small):
    from spanlake.llm.q_corpus import op10
    out = op10(spark, sf_small).collect()
    sums = {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert out[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert len(sums) == 16
