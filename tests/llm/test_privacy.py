import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from spanlake.llm.privacy import PATTERNS, Disclosure, _matches, personal_data, sanitised
from spanlake.llm.q_corpus import op6

# the contract's patterns, as they are
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        double = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "", re.A) if passes(k, m[0])]


def row(i, text):
    found = base(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (i, *(sum(x[0] == k for x in found) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest())


ODD = [None, "", "no data", "😀 a@b.cd é x.y+z%@m-1.example.com.", "a@b", "a@b.c_d@e.f", "a@b.c.d@e.f", "@x.y ..@a.b",
       "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004 1.2.3", "00000000000.1.2.255", "4111 1111-1111 1111 and 4111111111111112",
       "4111111111111111 4111111111111111", "+1 (409) 555-8387 +123 +49.30.1234567- +1234567890123456", "1" * 50000,
       "a" * 50000 + "@", "1 " * 20000, "+1" + " " * 30000, "x@y.zz " * 400, "a+1 555 123 4567@b.cc", "\n10.0.0.1\t",
       "5 5-5 5"]


def test_base_spans_against_the_plain_patterns(docs_of):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("a@.+1234 5-(").replace("(", "()") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(200)]
    rows = list(enumerate(texts)) + [(None, "a@b.cd"), (3, ODD[3])]
    got = sorted((tuple(r)[:6] for r in personal_data(docs_of(rows)).collect()), key=str)
    assert got == sorted((row(i, t) for i, t in rows), key=str)
    spans = {r.doc_id: r.spans for r in personal_data(docs_of(rows), rules=Disclosure(min_contexts=3)).collect()}
    assert spans[3] == ",".join(f"{k}:{a}:{b}" for k, a, b in base(ODD[3]))
    assert personal_data(docs_of(rows).limit(0)).count() == 0


def brute_terms(rows, rules):
    """Disclosing pairs by counting everything; contexts here reach no text's edge."""
    words = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for _, t in rows]
    co, contexts, df = {}, {}, {}
    for i, (_, t) in enumerate(rows):
        for k, a, b in base(t):
            e = t[a:b].lower()
            df.setdefault(e, set()).add(i)
            for w in set(re.findall(r"[^\W\d_]{3,}", (t[:a] + " " + t[b:]).lower())):
                co.setdefault((e, w), set()).add(i)
                contexts.setdefault((e, w), set()).add(t)
    n, out = len(rows), set()
    for (e, w), docs in co.items():
        ic = math.log2(n / len(df[e]))
        pmi = math.log2(len(docs) * n / (sum(w in x for x in words) * len(df[e])))
        if len(contexts[e, w]) >= rules.min_contexts and ic > 0 and pmi >= rules.threshold * ic:
            out.add((e, w))
    return out


def test_disclosing_terms_and_sanitised_texts(docs_of):
    rng = random.Random(4)
    common = ["the", "and", "über", "words", "of", "many"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(12))) for i in range(60)]
    for i in range(5):
        rows.append((100 + i, f"{rng.choice(common)} Quentin {i} {rng.choice(common)} quentin@x.example of {'über' * (i + 1)}"))
    rows += [(200 + i, "copied rareword text rare@y.example") for i in range(6)] + [(300, "Quentin alone"), (301, None), (None, "")]
    rules = Disclosure(min_contexts=3)
    want = brute_terms(rows, rules)
    assert want == {("quentin@x.example", "quentin")}
    docs = docs_of(rows)
    for r in personal_data(docs, rules=rules).collect():
        terms = re.findall(r"term:(\d+):(\d+)", r.spans)
        text = dict(rows)[r.doc_id] or ""
        if r.doc_id and 100 <= r.doc_id < 110:
            assert [text[int(a):int(b)] for a, b in terms] == re.findall("Quentin", text)
        else:
            assert not terms
    out = {r.doc_id: r.text for r in sanitised(docs, rules=rules).collect()}
    assert out[200] == "copied rareword text [EMAIL]" and out[300] == "Quentin alone" and out[301] is None
    assert all("[TERM]" in out[100 + i] and "[EMAIL]" in out[100 + i] and "uentin" not in out[100 + i] for i in range(5))
    clash = docs.withColumns({c: F.lit("x") for c in ("terms", "row", "_row", "_email", "_term", "entity")})
    again = sanitised(clash, rules=rules)
    assert again.columns == clash.columns and {r.doc_id: r.text for r in again.collect()} == out


def test_overlapping_spans_are_one(docs_of):
    out = sanitised(docs_of([(1, "x a+1 555 123 4567@b.cc y"), (2, "+4111111111111111 z")]), rules=Disclosure(min_contexts=3)).collect()
    assert sorted(r.text for r in out) == ["[CARD] z".replace("[CARD]", "+[CARD]"), "x a[PHONE] y"]


def plain_spans(texts, threshold):
    """The term spans of each text, by counting all pairs over the different texts."""
    word = re.compile(r"[^\W_]+")

    def outside(t):
        return [m for m in word.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in base(t))]
    holds = {t: ({t[a:b].lower() for _, a, b in base(t)}, {m[0].lower() for m in outside(t)},
                 {w.lower() for w in word.findall(t)}) for t in texts}
    n, out = len(holds), {}

    def tells(e, w):
        df_e, df_w = sum(e in x[0] for x in holds.values()), sum(w in x[2] for x in holds.values())
        co = sum(e in x[0] and w in x[1] for x in holds.values())
        return df_e < n and co and math.log2(co * n / (df_w * df_e)) >= threshold * math.log2(n / df_e)
    for t, (entities, words, _) in holds.items():
        told = {w for w in words if any(tells(e, w) for e in entities)}
        out[t] = ",".join(f"term:{m.start()}:{m.end()}" for m in outside(t) if m[0].lower() in told)
    return out


def test_terms_of_entities_that_stand_once(spark, docs_of, tmp_path):
    rng = random.Random(5)
    common = ["the", "and", "über", "words", "of", "many"]

    def some(n):
        return " ".join(rng.choice(common) for _ in range(n))
    texts = [some(12) + f" {i % 9}" for i in range(80)]
    texts += [f"Li {some(60)} B52x a.li@x.example {some(60)} teléfono+1 (409) 555-8387 and abc1.2.3.4x {some(3)}"]
    texts += ["copied rareword text rare@y.example, \ufdd0rareword"] * 6 + ["rareword of many"] * 3 + ["a.li@z.example a.li li"]
    texts += [f"{some(4)} Quentin {i} q@x.example r@x.example" for i in range(5)] + [f"{some(2)} q@x.example", "Quentin of words"]
    want = plain_spans(texts, Disclosure().threshold)
    assert any(want.values()) and want[texts[80]].startswith("term:0:2,")
    docs_of(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in op6(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert ",".join(x for x in got[i].split(",") if x.startswith("term:")) == want[t], t
    assert [t for t in want if "rareword text" in t and want[t].count("term") == 4]


def test_places_of_many_matches_take_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("".join(f"{i} x " for i in range(n)),)], "text string")
        t0 = time.perf_counter()
        found = df.select(_matches(F.col("text"), PATTERNS["card"]).alias("m")).first()["m"]
        assert len(found) == n - 10 and all(len(x["value"]) == x["end"] - x["start"] for x in found)
        return time.perf_counter() - t0
    seconds(100)
    assert seconds(40_000) < 2.5 * seconds(20_000) + 2
