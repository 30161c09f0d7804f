import hashlib
import random

from spanlake.llm.lines import deduplicate_lines, rebuilt_documents

BLANKS = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_chars=40, min_docs=5):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(docs, **options):
    out, n_lines, n_dropped = rebuilt_documents(docs.select("doc_id", "text", "n_words"), **options)
    return sorted(((r.doc_id, r[n_lines], r[n_dropped], r.text or "") for r in out.collect()), key=str)


def sample():
    rng = random.Random(4)
    pool = [f"Line {i} é " + "x" * rng.randrange(20, 60) for i in range(40)] + ["é" * 40, "é" * 39, "Ä" * 40, "ä" * 40]
    rows = [(None, None), (1, ""), (2, "\n"), (3, "\n\n a \n"), (4, "y" * 100000 + "\n" + pool[0])]
    for i in range(5, 60):
        lines = [rng.choice(["", "  ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", " \r"])
                 for _ in range(rng.randrange(0, 12))]
        rows.append((i, "\n".join(lines)))
    return rows + [(7, pool[1] + "\n" + pool[1]), (30, rows[30][1]), (None, "\n".join(pool))]


def test_lines_against_brute_force(docs_of):
    rows = sample()
    assert run(docs_of(rows)) == brute(rows)


def test_tiny_filters_only_make_more_suspects(docs_of):
    rows = sample()
    assert run(docs_of(rows), filter_bits=1 << 20) == run(docs_of(rows), filter_bits=64 * 8)


def test_columns_and_empty_table(docs_of):
    rows = sample()
    out = deduplicate_lines(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert sum(r.text is None for r in out.collect()) == 1
    assert deduplicate_lines(docs_of(rows).limit(0)).count() == 0


def test_digest_of_the_query(spark, sf_small):
    from spanlake.llm.q_corpus import op7
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs))
    assert sorted(map(tuple, op7(spark, sf_small).collect())) == want


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_lines_whose_polynomial_hashes_are_equal(spark, docs_of):
    for n in (1024, 4096):
        one = thue_morse(n)
        other = one.translate(str.maketrans("ab", "ba"))
        rows = [(i, f"{one}\n{other}") for i in range(5)]
        got = {r["doc_id"]: r["text"] for r in deduplicate_lines(docs_of(rows)).collect()}
        assert got == {0: "", 1: "", 2: "", 3: "", 4: f"{one}\n{other}"}
