"""Queries op11 to op13: each applies its operator to the whole of its table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.alignment import cross_tokenizer_alignment
from spanlake.llm.importance import importance_resample
from spanlake.llm.registry import read, register
from spanlake.llm.vector_search import exact_top_k


@register("op13_cross_tokenizer_alignment")
def op13(spark, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(read(spark, sf_dir, "documents"))


# CRC-32 of four bits at a time, from its polynomial
NIBBLES = [functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(4), i) for i in range(16)]

OP12_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
           from documents),
dw as (select r, unnest(ws) as w from d),
bw as (select unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
       from benchmark),
vocab as (select w, hex(w) as h from (select w from dw union select w from bw)),
nibbles as (select w, flatten(list_transform(range(len(h) // 2), lambda i:
              [('0x' || h[2 * i + 2])::bigint, ('0x' || h[2 * i + 1])::bigint])) as ns from vocab),
bucket as (select w, xor(list_reduce(list_prepend(4294967295, ns),
              lambda c, x: xor(c >> 4, {NIBBLES}[xor(c & 15, x) + 1])), 4294967295) % 10000 as b from nibbles),
s as (select b, count(*) as s from dw join bucket using (w) group by b),
t as (select b, count(*) as t from bw join bucket using (w) group by b),
ns as (select (select count(*) from dw) as all_s, (select count(*) from bw) as all_t),
gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (all_s + 10000)::double
                                   / ((coalesce(s, 0) + 1)::double * (all_t + 10000)::double)))::bigint as g
         from s full join t using (b), ns),
weight as (select r, sum(g)::bigint as weight from dw join bucket using (w) join gain using (b) group by r),
f as (select r, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint
               + 0.5::double) / 4294967296::double)))::bigint as score
      from d left join weight using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, r) as place, count(*) over () as n
           from f where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank
from f left join ranked using (r)
"""


@register("op12_importance_resampling", OP12_SQL)
def op12(spark, sf_dir: str) -> DataFrame:
    drawn = importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.r as r, c.vec_id as vec_id, c.r as cr, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on c.r <> q.r and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
n as (select *, row_number() over (partition by r order by score desc, vec_id nulls last, cr) as place from s)
select query_id, place::int as rank, vec_id, score from n where place <= 5
"""


@register("op11_exact_top_k", OP11_SQL)
def op11(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
