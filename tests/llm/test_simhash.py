import random

import xxhash
from pyspark.sql import functions as F

from spanlake.llm.components import components
from spanlake.llm.simhash import deduplicate, fingerprint, links, near_duplicates


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    """Smallest member of each item's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


TEXTS = ["", None, "  \t\n", "one", "one two", "A b C d", "a B c D", "ä b c d É", "a b a b a b a b",
         "word " * 5000, "x" * 200000, "a b a b a b a b"]


def test_fingerprint_matches_definition():
    for t in TEXTS:
        assert fingerprint(t) & (2 ** 64 - 1) == brute_print(t)


def test_near_duplicates_brute_force(docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i + 7, t) for i, t in enumerate(TEXTS)]
    for i in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            copy[rng.randrange(150)] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(copy)))
    rows += [(None, "one"), (None, "quite alone here in the row"), rows[-1]]
    got = {}
    for r in near_duplicates(docs_of(rows)).collect():
        got.setdefault((r.doc_id, r.fingerprint & (2 ** 64 - 1)), set()).add(r.component_id)
    prints = [brute_print(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)
             if bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = roots(len(rows), pairs)
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        assert got[(i, prints[k])] == {min(ids, default=None)}


def test_links_connect_dense_groups_over_the_run_limit(spark):
    rng = random.Random(9)
    base, prints = rng.getrandbits(64), set()
    while len(prints) < 600:
        p = base
        for b in rng.sample(range(64), rng.randrange(0, 9)):
            p ^= 1 << b
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [(p - 2 ** 64 if p >= 2 ** 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint long").repartition(4)
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = roots(len(prints), pairs)
    want_sets = {frozenset(signed[j][0] for j in range(len(prints)) if want[j] == r) for r in set(want)}
    for limit in (16, 4096):
        rows = links(df, run_limit=limit).collect()
        at = {s[0]: k for k, s in enumerate(signed)}
        got = roots(len(prints), [(at[r.a], at[r.b]) for r in rows])
        assert {frozenset(signed[j][0] for j in range(len(prints)) if got[j] == r) for r in set(got)} == want_sets


def test_components_of_chain_star_loop_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each_group_and_all_columns(docs_of):
    rows = [(5, "a b c d e"), (3, "A B C D E"), (9, "f g h i j k"), (9, "f g h i j k"), (None, "f g h i j k"), (8, None), (2, "")]
    out = deduplicate(docs_of(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "rank"]
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(2, ""), (3, "A B C D E"), (9, "f g h i j k")]
    empty = deduplicate(docs_of(rows).where(F.lit(False)))
    assert empty.count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark, docs_of):
    a, b = "alpha beta gamma delta epsilon zeta", "entirely other words stand in this line here"
    rows = [(5, a), (5, b), (9, b), (None, a), (None, a)]
    assert sorted(tuple(r) for r in deduplicate(docs_of(rows)).select("doc_id", "text").collect()) == [(5, a), (5, b)]
    rows = [(None, a), (None, a), (None, b), (3, ""), (None, None), (3, "")]
    got = deduplicate(docs_of(rows)).select("doc_id", "text").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, a), (0, b), (3, "")]
