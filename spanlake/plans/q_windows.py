"""Window-feature queries (W1-W9) over documents (contexts, titles as questions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import SEGMENT, WS, sql_str
from spanlake.operators import subwords as Sw
from spanlake.operators import windows as Wn
from spanlake.operators.common import posexplode_rows
from spanlake.plans.registry import register
from spanlake.plans.sqlparts import QA, words_sql
from spanlake.session import written
from spanlake.sources import fixtures as FX
from spanlake.sources.tables import table

SPEC = Wn.WindowSpec()
ML, ST = SPEC.max_seq_length, SPEC.doc_stride


def _vocab(spark, sf):
    return Wn.vocabulary_from_text(table(spark, sf, "benchmark"), "text")


def _examples(spark, sf):
    return FX.qa_examples(spark, sf)


def _tok_sql(side: str, col: str) -> str:
    p = side
    return f"""{p}l as (select id, regexp_extract_all({col}, {sql_str(SEGMENT)}) as segs from qa),
{p}s as (select id, unnest(segs) as token, generate_subscripts(segs, 1) as pos from {p}l),
{p}o as (select id, pos, token, coalesce(sum(length(token)) over (partition by id order by pos
          rows between unbounded preceding and 1 preceding), 0) as start from {p}s),
{p}t0 as (select id, row_number() over (partition by id order by pos) - 1 as tok_idx, token, start,
          start + length(token) as "end" from {p}o where not regexp_full_match(token, {sql_str(WS)})),
{p}t as (select {p}t0.*, coalesce(v.id, 1) as tid from {p}t0 left join vocab v on v.token = lower({p}t0.token))"""


VOCAB_SQL = f"""vterms as (select distinct unnest({words_sql('text')}) as token from benchmark),
vocab as (select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) v(token, id)
          union all select token, 3 + row_number() over (order by token) as id from vterms)"""


def base_sql(specials: int = 3, source: str = QA, length: int = ML, vocab: str = VOCAB_SQL, tokens=_tok_sql) -> str:
    """CTEs from examples ``qa`` to windows ``win2`` and features ``feat`` of the
    ``question | context`` layout with 3 or 4 special symbols."""
    between = specials - 2
    seps = " + ".join(f"3 * (qn + {1 + i})" for i in range(1, between + 1))
    return f"""{source},
{vocab},
{tokens('q', 'question')},
{tokens('c', 'context')},
qagg as (select id, count(*) as qn, sum(tid * (tok_idx + 1)) as qsum, sum(tid) as qtid from qt group by id),
cagg as (select id, count(*) as n from ct group by id),
ex as (select qa.id, qa.split, coalesce(qagg.qn, 0) as qn, coalesce(qagg.qsum, 0) as qsum,
              coalesce(qagg.qtid, 0) as qtid, coalesce(cagg.n, 0) as n,
              {length} - coalesce(qagg.qn, 0) - {specials} as cap, {length} - coalesce(qagg.qn, 0) - {specials} - {ST} as step,
              qa.answer_start as s, qa.answer_start + length(qa.answer_text) as e
       from qa left join qagg using (id) left join cagg using (id)),
win as (select *, unnest(range(case when n <= cap then 1 else 1 + ceil((n - cap) / step)::int end)) as w from ex),
win2 as (select *, w * step as ws, least(w * step + cap, n) as we from win),
fw as (select win2.id, win2.w, split, qn, qsum, qtid, ws, we, s, e,
              coalesce(sum(ct.tid * (ct.tok_idx - ws + 1)), 0) as csum, coalesce(sum(ct.tid), 0) as ctid,
              max(case when ct.tok_idx = ws then ct.start end) as first_start,
              max(case when ct.tok_idx = we - 1 then ct."end" end) as last_end,
              count(ct.tok_idx) filter (where ct.start <= s) as k,
              count(ct.tok_idx) filter (where ct."end" < e) as m,
              coalesce(sum(ct.start), 0) as sum_start, coalesce(sum(ct."end"), 0) as sum_end
       from win2 left join ct on ct.id = win2.id and ct.tok_idx >= win2.ws and ct.tok_idx < win2.we
       group by win2.id, win2.w, split, qn, qsum, qtid, ws, we, s, e),
fi as (select *, we - ws as cn, qn + (we - ws) + {specials} as n_ids,
              s is not null and we > ws and first_start <= s and last_end >= e as inside from fw),
feat as (select *, 2 + qsum + qtid + {seps} + csum + (qn + {1 + between}) * ctid + 3 * n_ids as ids_checksum,
                case when inside then qn + {1 + between} + k - 1 else 0 end as start_positions,
                case when inside then qn + {1 + between} + m else 0 end as end_positions
         from fi),
lf as (select *, {length} - n_ids as x from fi),
left_feat as (select *, 2 * (x + 1) + csum + (x + 1) * ctid + 3 * (x + cn + 2) + qsum + (x + cn + 2) * qtid
                        + 3 * {length} as ids_checksum,
                     case when inside then x + k else x end as start_positions,
                     case when inside then x + 1 + m else x end as end_positions
              from lf)"""


BASE_SQL = base_sql()


# ----------------------------------------------------------------------------- W1
TOKEN_OFFSETS_SQL = f"""
with {BASE_SQL}
select id::bigint as id, tok_idx::bigint as tok_idx, token, start::bigint as start, "end"::bigint as "end" from ct
"""


@register("token_offsets", TOKEN_OFFSETS_SQL)
def token_offsets(spark, sf):
    """W1 through the plug-in slot (the built-in tokenizer is a plug-in)."""
    t = Wn.token_offsets(_examples(spark, sf), "id", "context")
    return t.select(F.col("id").cast("bigint").alias("id"), F.col("tok_idx").cast("bigint").alias("tok_idx"),
                    "token", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@register("token_offsets_plugin", TOKEN_OFFSETS_SQL)
def token_offsets_plugin(spark, sf):
    """W1 with a tokenizer that is not the library's."""
    t = Wn.token_offsets(_examples(spark, sf), "id", "context", _character_classes)
    return t.select(F.col("id").cast("bigint").alias("id"), F.col("tok_idx").cast("bigint").alias("tok_idx"),
                    "token", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def _character_classes():
    """A tokenizer by character class, without a pattern: the same tokens, other ids."""
    from itertools import groupby

    def kind(pair):
        at, c = pair
        return "word" if c.isalnum() else at

    def tokenize(texts):
        for text in texts:
            parts = ["".join(c for _, c in g) for _, g in groupby(enumerate(text or ""), kind)]
            starts, at, found = [], 0, []
            for part in parts:
                if not part.isspace():
                    found.append(part)
                    starts.append(at)
                at += len(part)
            yield [len(t) for t in found], starts, [s + len(t) for s, t in zip(starts, found)]
    return tokenize


def _windows(spark, sf, spec=SPEC):
    ex = _examples(spark, sf)
    return Wn.windows(Wn.encode(ex, _vocab(spark, sf)), spec)


# ----------------------------------------------------------------------------- W2
TOKEN_WINDOWS_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", ws::bigint as token_start, we::bigint as token_end,
       cap::bigint as cap, step::bigint as step from win2
"""


@register("token_windows", TOKEN_WINDOWS_SQL)
def token_windows(spark, sf):
    w = _windows(spark, sf)
    return w.select(*[F.col(c).cast("bigint").alias(a) for c, a in
                      (("id", "id"), ("window", "window"), ("ws", "token_start"), ("we", "token_end"),
                       ("cap", "cap"), ("step", "step"))])


# ----------------------------------------------------------------------------- W3
PAIR_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", n_ids::bigint as n_ids, ids_checksum::bigint as ids_checksum,
       qn::bigint as n_question, cn::bigint as n_context from feat
"""


@register("pair_features", PAIR_SQL)
def pair_features(spark, sf):
    f = Wn.pair_features(_windows(spark, sf), Wn.WindowSpec(pad_to_max_length=False), eval_mode=True)
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    F.size("input_ids").cast("bigint").alias("n_ids"),
                    Wn.checksum("input_ids").alias("ids_checksum"),
                    F.size("q_ids").cast("bigint").alias("n_question"),
                    (F.col("we") - F.col("ws")).cast("bigint").alias("n_context"))


# The other layouts, padded: sizes, masks and types are compared through sums.
def _layout(f):
    ints = {"ids_checksum": Wn.checksum("input_ids"), "mask_checksum": Wn.checksum("attention_mask"),
            "type_checksum": Wn.checksum("token_type_ids"),
            "n_question": F.size(F.filter("sequence_ids", lambda x: x == 0)),
            "n_null_offsets": F.size(F.filter("offset_mapping", lambda o: o.isNull()))}
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    *[c.cast("bigint").alias(n) for n, c in ints.items()])


def _sum_of(first: str, last: str) -> str:
    """Sum of the numbers first..last."""
    return f"(({last}) * (({last}) + 1) - (({first}) - 1) * ({first})) // 2"


LEFT_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", ids_checksum::bigint as ids_checksum,
       ({_sum_of('x + 1', str(ML))})::bigint as mask_checksum,
       ({_sum_of('x + cn + 3', str(ML))})::bigint as type_checksum,
       cn::bigint as n_question, ({ML} - cn)::bigint as n_null_offsets from left_feat
"""


@register("pair_features_left", LEFT_SQL)
def pair_features_left(spark, sf):
    """``context | question`` behind padding; part 0 is the context."""
    spec = Wn.WindowSpec(side="left")
    return _layout(Wn.pair_features(_windows(spark, sf, spec), spec, eval_mode=True))


DOUBLE_SQL = f"""
with {base_sql(4)}
select id::bigint as id, w::bigint as "window", ids_checksum::bigint as ids_checksum,
       ({_sum_of('1', 'n_ids')})::bigint as mask_checksum,
       ({_sum_of('qn + 4', 'n_ids')})::bigint as type_checksum,
       qn::bigint as n_question, ({ML} - cn)::bigint as n_null_offsets from feat
"""


@register("pair_features_double_sep", DOUBLE_SQL)
def pair_features_double_sep(spark, sf):
    spec = Wn.WindowSpec(double_separator=True)
    return _layout(Wn.pair_features(_windows(spark, sf, spec), spec, eval_mode=True))


# ----------------------------------------------------------------------------- W4
PADDED_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", {ML}::bigint as size, n_ids::bigint as mask_sum,
       ids_checksum::bigint as ids_checksum from feat
"""


@register("padded_features", PADDED_SQL)
def padded_features(spark, sf):
    f = Wn.pair_features(_windows(spark, sf), SPEC, eval_mode=True)
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    F.size("input_ids").cast("bigint").alias("size"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    Wn.checksum("input_ids").alias("ids_checksum"))


# ----------------------------------------------------------------------------- W5
BATCH_SQL = f"""
with {BASE_SQL},
o as (select id, w, n_ids, ids_checksum, row_number() over (order by id, w) - 1 as ord from feat),
b as (select *, ord // 8 as batch from o)
select ord::bigint as feature_ordinal, id::bigint as id, w::bigint as "window", batch::bigint as batch,
       (ceil(max(n_ids) over (partition by batch) / 8) * 8)::bigint as padded_length,
       (ceil(max(n_ids) over (partition by batch) / 8) * 8)::bigint as size, ids_checksum::bigint as ids_checksum,
       ({_sum_of('1', 'n_ids')})::bigint as mask_checksum from b
"""


@register("batch_padding", BATCH_SQL)
def batch_padding(spark, sf):
    f = Wn.pair_features(_windows(spark, sf), Wn.WindowSpec(pad_to_max_length=False), eval_mode=True)
    f = f.select("id", "window", "input_ids", "attention_mask")
    b = Wn.batch_pad(f, batch_size=8, multiple=8)
    return b.select(F.col("feature_ordinal").cast("bigint").alias("feature_ordinal"),
                    F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    F.col("batch").cast("bigint").alias("batch"),
                    F.col("padded_length").cast("bigint").alias("padded_length"),
                    F.size("input_ids").cast("bigint").alias("size"), Wn.checksum("input_ids").alias("ids_checksum"),
                    Wn.checksum("attention_mask").alias("mask_checksum"))


# ----------------------------------------------------------------------------- W6
MASKED_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", ({ML} - cn)::bigint as n_null_offsets,
       sum_start::bigint as sum_start, sum_end::bigint as sum_end from feat
"""


@register("masked_offsets", MASKED_SQL)
def masked_offsets(spark, sf):
    f = Wn.pair_features(_windows(spark, sf), SPEC, eval_mode=True)
    offs = F.filter("offset_mapping", lambda o: o.isNotNull())
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    (F.size("offset_mapping") - F.size(offs)).cast("bigint").alias("n_null_offsets"),
                    F.aggregate(offs, F.lit(0).cast("bigint"), lambda a, o: a + o["start"]).alias("sum_start"),
                    F.aggregate(offs, F.lit(0).cast("bigint"), lambda a, o: a + o["end"]).alias("sum_end"))


# ----------------------------------------------------------------------------- W7
LABELS_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", start_positions::bigint as start_positions,
       end_positions::bigint as end_positions from feat
"""


def _labels(spark, sf, spec):
    f = Wn.span_labels(Wn.pair_features(_windows(spark, sf, spec), spec, eval_mode=False))
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    F.col("start_positions").cast("bigint").alias("start_positions"),
                    F.col("end_positions").cast("bigint").alias("end_positions"))


@register("span_labels", LABELS_SQL)
def span_labels(spark, sf):
    return _labels(spark, sf, SPEC)


@register("span_labels_left", LABELS_SQL.replace("from feat", "from left_feat"))
def span_labels_left(spark, sf):
    return _labels(spark, sf, Wn.WindowSpec(side="left"))


# ----------------------------------------------------------------------------- W8
TRAIN_SQL = f"""
with {BASE_SQL}
select id::bigint as id, w::bigint as "window", ids_checksum::bigint as ids_checksum, n_ids::bigint as mask_sum,
       start_positions::bigint as start_positions, end_positions::bigint as end_positions
from feat where split = 'train'
"""


@register("train_features", TRAIN_SQL)
def train_features(spark, sf):
    ex = _examples(spark, sf).where(F.col("split") == "train")
    f = Wn.train_features(ex, _vocab(spark, sf), SPEC)
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    Wn.checksum("input_ids").alias("ids_checksum"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.col("start_positions").cast("bigint").alias("start_positions"),
                    F.col("end_positions").cast("bigint").alias("end_positions"))


EVAL_SQL = f"""
with {BASE_SQL}
select id::bigint as example_id, w::bigint as "window", ids_checksum::bigint as ids_checksum,
       ({ML} - cn)::bigint as n_null_offsets, (cn + 1)::bigint as n_type_one
from feat where split = 'validation'
"""


@register("eval_features", EVAL_SQL)
def eval_features(spark, sf):
    ex = _examples(spark, sf).where(F.col("split") == "validation")
    f = Wn.eval_features(ex, _vocab(spark, sf), SPEC)
    return f.select(F.col("example_id").cast("bigint").alias("example_id"),
                    F.col("window").cast("bigint").alias("window"),
                    Wn.checksum("input_ids").alias("ids_checksum"),
                    F.size(F.filter("offset_mapping", lambda o: o.isNull())).cast("bigint").alias("n_null_offsets"),
                    F.aggregate("token_type_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_type_one"))


# ----------------------------------------------------------------------------- W9
VOCAB_SQL = f"""
with vterms as (select distinct unnest({words_sql('text')}) as token from benchmark),
vocab as (select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) v(token, id)
          union all select token, 3 + row_number() over (order by token) as id from vterms),
sym as (select '[UNK' || i || ']' as token, i as ord from range(1, 100) t(i)
        union all select '[unused' || i || ']', i - 500 + 1000 from range(500, 700) t(i)),
new as (select * from sym where token not in (select token from vocab))
select token, ((select max(id) from vocab) + row_number() over (order by ord))::bigint as id from new
"""


@register("vocab_extend", VOCAB_SQL)
def vocab_extend(spark, sf):
    v = _vocab(spark, sf)
    return Wn.extend_vocabulary(v, Wn.added_symbols(spark))


# ----------------------------------------------------------------------------- W1 + W9: subword pieces
# Examples whose contexts hold added symbols: one before the text and one for each line break.
MARKED_QA = f"{QA.replace('qa as', 'qa0 as')}, qa as (select * replace ('[unused500] ' || replace(context, chr(10), '[UNK7]') as context) from qa0)"
SYMBOL = r"\[UNK(?:[1-9]|[1-9][0-9])\]|\[unused[56][0-9][0-9]\]"
PIECES_VOCAB_SQL = f"""words0 as (select unnest({words_sql('text')}) as w from benchmark),
words1 as (select w, count(*) as n from words0 group by w),
vterms as (select w as token from words1 where n > 1
           union select w[1:k] from words1, (select unnest([1, 2, 3]) as k)
           union select '##' || w[i:i + k - 1] from (select w, unnest(range(2, length(w) + 1)) as i from words1 where length(w) > 1),
                 (select unnest([1, 2]) as k)),
vocab as (select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) v(token, id)
          union all select token, 3 + row_number() over (order by token) as id from vterms),
longest as (select max(length(token)) as most from vocab),
symbols as (select token, (select max(id) from vocab) + row_number() over (order by o) as id from (
            select '[UNK' || i || ']' as token, i as o from range(1, 100) r(i)
            union all select '[unused' || i || ']', i + 500 from range(500, 700) r(i)))"""


def _piece_sql(side: str, col: str) -> str:
    p = side
    return f"""{p}l as (select id, regexp_extract_all({col}, {sql_str(SYMBOL + '|' + SEGMENT)}) as segs from qa),
{p}s as (select id, unnest(segs) as seg, generate_subscripts(segs, 1) as pos from {p}l),
{p}o as (select id, pos, seg, lower(seg) as w, coalesce(sum(length(seg)) over (partition by id order by pos
          rows between unbounded preceding and 1 preceding), 0) as start from {p}s),
{p}w as (select distinct w from {p}o where not regexp_full_match(w, {sql_str(WS)}) and not regexp_full_match(seg, {sql_str(SYMBOL)})),
{p}c as (select w, i, unnest(range(1, least(length(w) - i + 1, most) + 1)) as n
         from (select w, unnest(range(1, length(w) + 1)) as i from {p}w), longest),
{p}b as (select w, i, max(n) as n, max_by(vocab.id, n) as id from {p}c
         join vocab on vocab.token = case when i > 1 then '##' else '' end || w[i:i + n - 1] group by w, i),
{p}r as (select w, 1 as i from {p}w union all select r.w, r.i + b.n from {p}r r join {p}b b on b.w = r.w and b.i = r.i),
{p}k as (select distinct w from {p}r where i = length(w) + 1),
{p}p as (select r.w, r.i, b.n, b.id from {p}r r join {p}k k using (w) join {p}b b on b.w = r.w and b.i = r.i
         union all select w, 1, length(w), 1 from {p}w where w not in (select w from {p}k)),
{p}t0 as (select o.id, pos, p.i, start + p.i - 1 as start, start + p.i - 1 + p.n as "end", p.id as tid
          from {p}o o join {p}p p using (w) where not regexp_full_match(seg, {sql_str(SYMBOL)})
          union all select o.id, pos, 1, start, start + length(seg), s.id from {p}o o join symbols s on s.token = o.seg),
{p}t as (select id, row_number() over (partition by id order by pos, i) - 1 as tok_idx, start, "end", tid from {p}t0)"""


def _marked_examples(spark, sf):
    context = F.concat(F.lit("[unused500] "), F.replace("context", F.lit("\n"), F.lit("[UNK7]")))
    return FX.qa_examples(spark, sf).withColumn("context", context)


def _subwords(spark, sf):
    vocab = written(Sw.subword_vocabulary(table(spark, sf, "benchmark"), "text"), "piece-vocabulary")
    return Sw.Subwords(vocab, Wn.extend_vocabulary(vocab, Wn.added_symbols(spark)))


PIECES_BASE = base_sql(source=MARKED_QA, vocab=PIECES_VOCAB_SQL, tokens=_piece_sql)
SUBWORD_SQL = f"""
with recursive {PIECES_BASE}
select id::bigint as id, w::bigint as "window", n_ids::bigint as n_ids, ids_checksum::bigint as ids_checksum,
       qn::bigint as n_question, cn::bigint as n_context, first_start::bigint as first_start, last_end::bigint as last_end,
       (sum_start + sum_end)::bigint as offset_sum
from feat
"""


@register("subword_features", SUBWORD_SQL)
def subword_features(spark, sf):
    """Pair features of subword pieces, with the places of their context's pieces."""
    win = Wn.windows(Wn.encode(_marked_examples(spark, sf), subwords=_subwords(spark, sf)))
    f = Wn.pair_features(win, Wn.WindowSpec(pad_to_max_length=False), eval_mode=True)
    offs = F.filter("offset_mapping", lambda o: o.isNotNull())
    total = F.aggregate(offs, F.lit(0).cast("bigint"), lambda a, o: a + o["start"] + o["end"])
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("window").cast("bigint").alias("window"),
                    F.size("input_ids").cast("bigint").alias("n_ids"), Wn.checksum("input_ids").alias("ids_checksum"),
                    F.size("q_ids").cast("bigint").alias("n_question"), (F.col("we") - F.col("ws")).cast("bigint").alias("n_context"),
                    F.get(offs, 0)["start"].cast("bigint").alias("first_start"),
                    F.get(offs, F.size(offs) - 1)["end"].cast("bigint").alias("last_end"), total.alias("offset_sum"))


SUBWORD_OFFSETS_SQL = f"""
with recursive {PIECES_BASE}
select id::bigint as id, tok_idx::bigint as tok_idx, tid::bigint as piece_id, start::bigint as start, "end"::bigint as "end" from ct
"""


@register("subword_offsets", SUBWORD_OFFSETS_SQL)
def subword_offsets(spark, sf):
    """W1 + W9: every piece of the contexts with its id and its place in the text."""
    toks = _subwords(spark, sf).tokens(_marked_examples(spark, sf).select("id", "context"), {"context": "_toks"})
    rows = posexplode_rows(toks, F.col("_toks"), ["id"], "tok_idx", "x")
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("tok_idx").cast("bigint").alias("tok_idx"),
                       F.col("x.id").cast("bigint").alias("piece_id"), F.col("x.start").cast("bigint").alias("start"),
                       F.col("x.end").cast("bigint").alias("end"))
