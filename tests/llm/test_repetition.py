import random
import re

import numpy as np

from spanlake.llm.repetition import Rules, good_documents, quality, repeats
from spanlake.llm.textarrays import Powers


def brute_repeats(words, m):
    """Longest prefix of each suffix that occurs elsewhere, if it has m words."""
    out = {}
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= m:
            out[i] = best
    return out


def brute(text, rules):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = brute_repeats(words, rules.min_repeat)
    cover = {j for i, k in spans.items() for j in range(i, i + k)}
    n, chars = len(words), sum(map(len, words))
    failed = n < 10 or 100 * len(hit) > 20 * n
    points = sum(len(words[j]) for j in cover)
    longest = max(spans.values(), default=0)
    kept = not failed and points <= rules.max_covered * chars and longest <= rules.max_longest
    return (n, chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            points, longest, failed, kept)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "a", "a b c d e f g h i j", "x " * 300, "é# " * 40, "l\nl\n\nl \nl", "n\n\n\n"]
    for _ in range(40):
        out.append(" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 120))))
        base = [f"w{rng.randrange(500)}ü" for _ in range(rng.randrange(10, 150))]
        k = rng.randrange(0, 40)
        out.append("\n".join([" ".join(base), " ".join(base[:k]), "* | tail"]))
    return out


def test_quality_against_brute_force(docs_of):
    rules = Rules(max_longest=30)
    rows = list(enumerate(texts()))
    got = {r.doc_id: tuple(r)[1:] for r in quality(docs_of(rows), rules=rules).collect()}
    assert got == {i: brute(t, rules) for i, t in rows}


def test_repeats_of_several_rows_do_not_mix():
    rng = random.Random(2)
    for _ in range(50):
        parts = [[rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))] for _ in range(4)]
        words = np.array([x for p in parts for x in p], np.uint64)
        rows = np.array([k for k, p in enumerate(parts) for _ in p], np.int64)
        at, length = repeats(words, rows, Powers(), 3)
        want, base = {}, 0
        for p in parts:
            want |= {base + i: k for i, k in brute_repeats(p, 3).items()}
            base += len(p)
        assert dict(zip(at.tolist(), length.tolist())) == want


def test_good_documents_keep_columns(docs_of):
    clean = " ".join(f"word{i}" for i in range(400))
    rows = [(1, clean), (1, clean), (None, clean), (2, None), (3, ""), (4, "spam and eggs " * 5000),
            (5, clean + " " + " ".join(f"word{i}" for i in range(100, 250)))]
    out = good_documents(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1]
    assert good_documents(docs_of(rows).limit(0)).count() == 0


def test_texts_whose_polynomial_hashes_are_equal(spark, docs_of):
    for n in (1024, 2048, 4096):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = one.translate(str.maketrans("ab", "ba"))
        filler = " ".join(f"w{i}" for i in range(20))
        rows = [(1, f"{one}\n{other}\n{filler}"), (2, f"{one}\n{one}\n{filler}"), (3, f"{one} a b c d\n{other} a b c d\n{filler}"),
                (4, f"{one} a b c d\n{one} a b c d\n{filler}")]
        got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality(docs_of(rows)).collect()}
        assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (1, 10)}
