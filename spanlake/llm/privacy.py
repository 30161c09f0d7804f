"""Personal data: base patterns, and terms that give a protected entity away.

All in DataFrame functions. Base spans (email, ip, card, phone) are the leftmost
matches of fixed patterns that do not overlap within their kind and pass the kind's
test; failing matches are dropped. The patterns are written so that the scan is linear:
runs are taken whole, and a match begins only at the beginning of a run or where the
last match ended.

Every distinct value of a base span is a protected entity. The corpus tells how much a
term reveals of it (Sánchez and Batet's information-theoretic sanitisation): with N
different texts, ``df`` of them holding a term or an entity and ``co`` of them holding
both, the term as a word outside base spans,

    PMI(term; entity) = log2(co * N / (df(term) * df(entity)))
    IC(entity)        = log2(N / df(entity))

and a term discloses the entity if PMI >= ``threshold`` * IC, that is, if knowing it
leaves little of the entity unknown. ``min_contexts`` asks for a pair in that many
different texts; with 1, the default, entities that stand only once are protected too. A
disclosing term becomes a span of kind ``term`` wherever it is
a word of a document that holds the entity, outside base spans, which all stay.
:func:`sanitised` generalises every span to the name of its kind.

A term is a run of letters, marks and digits of any length. Counts are over all
documents; copies of a text (equal by a digest) count once, and so does each term of a
text. As ``co <= df(entity)``, only terms with ``df <= N^(1-t) * df(entity)^t`` can
disclose an entity (t is the threshold), and entities of the same texts are disclosed by
the same terms: pairs are made of such terms only, and of one entity for each set of
texts. Null texts count as empty, and have no spans. Every row gets its spans.
Offsets are code points, ends exclusive. Other columns are not read by
:func:`personal_data`, and carried along by :func:`sanitised`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.shared import free_name, written
from spanlake.operators.common import broadcast_if_small, explode_rows, let

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be tried.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}\p{M}\p{N}"
COVERED = "\ufdd0"  # no character; stands for those of base spans
SPAN = "struct<start:int,end:int,value:string>"


@dataclass(frozen=True)
class Disclosure:
    threshold: float = 0.8
    min_contexts: int = 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d
    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _small_parts(value: Column) -> Column:
    def small(part):
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)
    return F.forall(F.split(value, r"\."), small)


TESTS = {"email": lambda v: F.lit(True), "ip": _small_parts, "card": _luhn,
         "phone": lambda v: F.length(_digits(v)).between(8, 15)}


def _sums_before(lengths: Column, begin: Column) -> Column:
    """``begin`` plus the sum of the numbers before each: the list grows as it is made, so
    this is for short arrays."""
    start = F.struct(begin.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda done, n: F.struct(
        (done["at"] + n).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])


BLOCK = 64


def _running(lengths: Column) -> Column:
    """The sum of the numbers before each, block by block, in a time that hardly grows
    faster than the array."""
    def blocks(v):
        last = F.floor((F.greatest(F.size(v["n"]), F.lit(1)) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v["n"], b * BLOCK + 1, BLOCK))

    def joined(v):
        sums = F.transform(v["blocks"], lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(v["blocks"], _sums_before(sums, F.lit(0)), _sums_before))
    return let({"blocks": let({"n": lengths}, blocks)}, joined)


def _matches(text: Column, pattern: str, keep=None) -> Column:
    """All matches (that ``keep`` wants) with their places: the gaps between them come
    from splitting, the places from running sums of the lengths."""
    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def placed(v):
        def span(pair, at):
            start = at + F.length(pair["0"])
            return F.struct(start.alias("start"), (start + F.length(pair["1"])).alias("end"), pair["1"].alias("value"))
        lengths = F.transform(v["pairs"], lambda x: F.length(x["0"]) + F.coalesce(F.length(x["1"]), F.lit(0)))
        spans = F.zip_with(v["pairs"], _running(lengths), span)
        return F.filter(spans, lambda s: s["value"].isNotNull() & keep(s["value"]) if keep else s["value"].isNotNull())
    return let({"pairs": pairs}, placed)


def _kind_spans(text: Column, kind: str) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind]), lambda s: TESTS[kind](s["value"]))
    gate = GATES[kind]
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.contains(text, F.lit(gate)), found).otherwise(none) if gate else found


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _terms(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def _terms_outside(text: Column, base: Column) -> Column:
    """The terms that are words outside the base spans."""
    text = F.translate(text, COVERED, " ")

    def step(done, s):
        at = F.greatest(done["at"], s["start"])
        covered = F.regexp_replace(F.substr(text, at + 1, s["end"] - at), f"[{WORD}]", COVERED)
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.concat(
            done["out"], F.substr(text, done["at"] + 1, at - done["at"]), covered).alias("out"))
    rest = F.aggregate(F.array_sort(base), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    words = F.array_distinct(F.regexp_extract_all(rest, F.lit(f"[{WORD}{COVERED}]+"), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.contains(w, F.lit(COVERED))), F.lower))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str, rules: Disclosure) -> DataFrame:
    """``(digest, terms)``: the terms of each text that disclose an entity of it.
    ``found`` has the digest, the text and the base spans of the documents that hold any."""
    def entities(kind):
        return F.transform(kind, lambda s: _entity(kind, s["value"]))
    texts = written(found.dropDuplicates(["digest"]).select(
        "digest", F.array_distinct(F.concat(*map(entities, KINDS))).alias("entities"),
        _terms_outside(F.col("text"), F.concat(*KINDS)).alias("terms")), "texts")

    text = F.coalesce(F.col(text_col), F.lit(""))
    copies = docs.groupBy(F.xxhash64(text).alias("digest")).agg(F.count("*").alias("copies"))
    n = copies.count()
    copied = broadcast_if_small(copies.where("copies > 1").select("digest", F.col("digest").alias("copied")), "copied")
    words = docs.select(F.xxhash64(text).alias("digest"), text.alias("text")).join(copied, "digest", "left")
    words = explode_rows(words, _terms(F.col("text")), ["copied"], "term")
    term_df = words.groupBy("term").agg((F.count(F.when(F.col("copied").isNull(), 1)) + F.count_distinct("copied")).alias("df_term"))

    held = texts.select("digest", F.explode("entities").alias("entity"))
    entity_df = held.groupBy("entity").agg(
        F.count("*").alias("df_entity"), F.bit_xor("digest").alias("a"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("b"))
    # one entity for each set of texts; one that all texts hold has nothing to disclose
    entity_df = written(entity_df.groupBy("df_entity", "a", "b").agg(F.min("entity").alias("entity"))
                        .where(F.col("df_entity") < n).select("entity", "df_entity"), "entities")
    most = entity_df.agg(F.max("df_entity")).first()[0] or 0

    def bound(df_entity):  # a little more than the bound, for rounding
        return 1.000001 * n ** (1 - rules.threshold) * F.pow(df_entity, F.lit(rules.threshold))
    rare = broadcast_if_small(term_df.where(F.col("df_term") <= bound(F.lit(most))), "terms")
    near = (texts.select("digest", F.explode("terms").alias("term")).join(rare, "term")
            .join(held.join(entity_df, "entity"), "digest").where(F.col("df_term") <= bound(F.col("df_entity"))))
    near = written(near.select("digest", "entity", "term", "df_entity", "df_term"), "pairs")
    counted = near.groupBy("entity", "term", "df_entity", "df_term").agg(F.count("*").alias("co"))
    pmi = F.log2(F.col("co") * F.lit(n) / (F.col("df_term") * F.col("df_entity")))
    ic = F.log2(F.lit(n) / F.col("df_entity"))
    told = counted.where((F.col("co") >= rules.min_contexts) & (pmi >= rules.threshold * ic)).select("entity", "term")
    return near.join(told, ["entity", "term"], "left_semi").groupBy("digest").agg(F.collect_set("term").alias("terms"))


def _with_spans(docs: DataFrame, text_col: str, rules: Disclosure) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents that may hold personal data, with all span columns, and the others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gate = text.rlike("[0-9@]")  # every base span has one
    names = {k: free_name(docs, f"_{k}") for k in KINDS}
    digest = free_name(docs, "_digest")
    maybe = docs.where(gate).withColumns({names[k]: _kind_spans(text, k) for k in KINDS} | {digest: F.xxhash64(text)})
    maybe = written(maybe, "personal-data")
    found = maybe.where(sum(F.size(names[k]) for k in KINDS) > 0).select(
        F.col(digest).alias("digest"), F.col(text_col).alias("text"), *[F.col(names[k]).alias(k) for k in KINDS])
    told_terms = free_name(docs, "_terms")
    terms = disclosing_terms(docs, found, text_col, rules).select(F.col("digest").alias(digest), F.col("terms").alias(told_terms))
    told = maybe.join(broadcast_if_small(terms, "disclosing"), digest, "left")
    word_spans = _matches(text, f"[{WORD}]+", lambda w: F.array_contains(told_terms, F.lower(w)))
    none = F.array().cast(f"array<{SPAN}>")
    term = free_name(docs, "_term")
    base = F.concat(*names.values())
    told = told.withColumn(term, F.when(F.col(told_terms).isNotNull(), F.filter(
        word_spans, lambda s: ~F.exists(
            base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(none)).drop(told_terms, digest)
    return told, docs.where(~gate), [*names.values(), term]


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  rules: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: id, the number of spans of each base kind, base_sha256 and
    spans (``kind:start:end`` by kind, then start, joined by commas; terms last)."""
    told, clear, names = _with_spans(docs.select(id_col, text_col), text_col, rules)
    base = F.concat(*[_listed(k, F.col(c)) for k, c in zip(KINDS, names)])
    every = F.concat(base, _listed("term", F.col(names[-1])))
    some = told.select(id_col, *[F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(KINDS, names)],
                       F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
    none = clear.select(id_col, *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return some.unionByName(none)


def sanitised(docs: DataFrame, *, text_col: str = "text", rules: Disclosure = Disclosure()) -> DataFrame:
    """The documents with every span generalised to the name of its kind in brackets
    (where spans overlap, to that of the first and then longest, over all of them);
    columns as they came."""
    told, clear, names = _with_spans(docs, text_col, rules)

    def named(kind, column):
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["end"].alias("end"),
                                                      F.lit(f"[{kind.upper()}]").alias("name")))
    spans = F.array_sort(F.concat(*map(named, (*KINDS, "term"), names)))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(done, s):
        new = F.struct(s["end"].alias("at"), F.concat(
            done["out"], F.substr(text, done["at"] + 1, s["start"] - done["at"]), s["name"]).alias("out"))
        longer = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], new).otherwise(longer)
    replaced = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                           lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    changed = told.withColumn(text_col, F.when(F.size(spans) > 0, replaced).otherwise(F.col(text_col)))
    return changed.select(*docs.columns).unionByName(clear)
