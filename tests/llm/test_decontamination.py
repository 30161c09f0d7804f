import hashlib
import random
import re

import pytest

from spanlake.llm.decontamination import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def windows(items, n):
    out = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            out.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    return out


def brute(text, wins):
    w, hit, items = words(text), set(), set()
    for k in {len(x) for x in wins}:
        for i in range(len(w) - k + 1):
            found = wins.get(tuple(w[i:i + k]))
            if found:
                hit |= set(range(i, i + k))
                items |= found
    ids = ",".join(sorted(items))
    return (len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


def sample():
    rng = random.Random(5)
    pool = [f"w{i}é" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "..!"), (28, "ONE"), (3, "another text of an id that occurs twice here and more"), (None, "no id at all")]
    rows = [(1, None), (2, ""), (3, " .,! "), (4, "one"), (5, "One-two (ONE)"), (6, "no  ID, at all!"), (7, "x" * 200000)]
    for i in range(100, 180):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            w = words(rng.choice(items[:25])[1])
            a = rng.randrange(len(w))
            text += "; " + " - ".join(w[a:a + rng.randrange(1, 25)]).upper() + " " + text
        rows.append((i, text))
    return rows + [(100, rows[10][1]), (None, "one")], items


@pytest.mark.parametrize("max_bytes", [1 << 20, 700])
def test_report_against_brute_force(spark, docs_of, max_bytes):
    rows, items = sample()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = contamination(docs_of(rows), bench, n=4, max_benchmark_bytes=max_bytes).collect()
    wins = windows(items, 4)
    assert sorted(map(str, (tuple(r)[:6] for r in out))) == sorted(str((i, *brute(t, wins))) for i, t in rows)
    texts = dict(rows)
    for r in out:
        inside = sum(len(words(texts[r.doc_id][s.start:s.end])) for s in r.hit_spans)
        assert inside == r.n_hit and r.n_items == len(r.items)


@pytest.mark.parametrize("max_bytes", [1 << 20, 700])
def test_documents_and_spans_go(spark, docs_of, max_bytes):
    rows, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = windows(items, 4)
    docs = docs_of(rows)
    kept = decontaminate(docs, bench, n=4, max_benchmark_bytes=max_bytes)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(r) for r in rows if not brute(r[1], wins)[4])
    cut = decontaminate(docs, bench, n=4, mode="spans", max_benchmark_bytes=max_bytes).collect()
    assert len(cut) == len(rows) and sum(r.text is None for r in cut) == 1
    clean = {str((r.doc_id, r.text)) for r in cut}
    assert all(str(r) in clean for r in rows if not brute(r[1], wins)[4])
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)
    with pytest.raises(ValueError):
        decontaminate(docs, bench, mode="words")


def test_overlapping_items_of_several_blocks_are_cut_once(spark, docs_of):
    words = [f"w{i}" for i in range(60)]
    # windows of ten words that overlap, and two that only touch
    items = [(str(i), " ".join(words[i:i + 10])) for i in (0, 2, 5, 9, 12, 30, 40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_of([(1, "before " + " ".join(words) + " after"), (2, None), (3, "clean é text"), (1, "é " + " ".join(words[2:15]) + ".")])
    whole = sorted(map(tuple, decontaminate(docs, bench, mode="spans").collect()), key=str)
    blocks = sorted(map(tuple, decontaminate(docs, bench, mode="spans", max_benchmark_bytes=40).collect()), key=str)
    assert blocks == whole and any(r[1] and r[1].startswith("before \n w22") for r in whole)
