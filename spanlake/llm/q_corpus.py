"""Queries op1 to op10: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.decontamination import contamination
from spanlake.llm.language import learn, predict
from spanlake.llm.lines import rebuilt_documents
from spanlake.llm.packing import pack_documents
from spanlake.llm.pages import main_texts
from spanlake.llm.privacy import personal_data
from spanlake.llm.registry import read, register
from spanlake.llm.repetition import quality
from spanlake.llm.sharding import shard_by_bytes
from spanlake.llm.simhash import near_duplicates
from spanlake.llm.suffixes import deduplicated_bytes

OP1_SQL = r"""
with w as (select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
           from (select row_number() over () as rowid, * from documents)),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
       from benchmark where text is not null),
bn as (select item_id, ws, least(10, len(ws)) as k from bw where len(ws) > 0),
win as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as g
        from (select item_id, k, ws, unnest(range(1, len(ws) - k + 2)) as i from bn)),
ks as (select distinct k from win),
dg as (select r, k, i, array_to_string(ws[i:i + k - 1], ' ') as g
       from (select r, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, ks where len(ws) >= k)),
hits as (select r, i, dg.k as k, item_id from dg join win on win.k = dg.k and win.g = dg.g),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hits) group by r),
items as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
          from (select distinct r, cast(item_id as varchar) as id from hits) group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words using (r) left join items using (r)
"""


@register("op1_decontamination", OP1_SQL)
def op1(spark, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op4_simhash_near_dedup")
def op4(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register("op2_best_fit_packing")
def op2(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
rep as (select key, max(doc_id) as kept from k where length(key) >= 40
        group by key having count(distinct doc_id) >= 5),
m as (select k.*, rep.key is not null and doc_id <> rep.kept as gone from k left join rep using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""


@register("op7_line_dedup", OP7_SQL)
def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, n_lines, n_dropped = rebuilt_documents(docs)
    return out.select("doc_id", n_lines, n_dropped, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op10_sharding")
def op10(spark, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


# The words in repeats of 8 words or more are those in 8-word windows found twice; a repeat
# of over 100 words is a 101-word window found twice.
OP3_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select r, k, i, array_to_string(ws[i:i + k - 1], ' ') as g
      from (select r, k, ws, unnest(range(1, len(ws) - k + 2)) as i from d, (values (5), (8), (101)) ks(k) where len(ws) >= k)),
twice as (select r, k, i from (select *, count(*) over (partition by r, k, g) as n from g) where n > 1),
hit as (select distinct r, k, unnest(range(i, i + k)) as p from twice),
cover as (select hit.r, count(*) filter (k = 5) as n5, count(*) filter (k = 101) as n101,
                 sum(length(d.ws[p])) filter (k = 8) as chars8 from hit join d using (r) group by hit.r),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
dup as (select r, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
f as (select r, doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(dup.n, 0) as n_dup_lines, coalesce(n5, 0) as n_repeat_words,
             coalesce(chars8, 0) as chars8, coalesce(n101, 0) as n101
      from d left join dup using (r) left join cover using (r))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       n_words >= 10 and 100 * n_repeat_words <= 20 * n_words and chars8 <= 0.25 * word_chars and n101 = 0 as kept
from f
"""


@register("op3_quality_repetition", OP3_SQL)
def op3(spark, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@register("op9_language_id")
def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register("op8_html_extraction")
def op8(spark, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register("op6_pii")
def op6(spark, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


OP5_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(n - 99)) as i from d where n >= 100)),
f as (select s, min(doc_id::hugeint * 4294967296 + i) as k from w group by s having count(*) > 1),
gone as (select doc_id, i from w join f using (s) where doc_id::hugeint * 4294967296 + i > k),
isl as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run
        from (select *, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as new from gone)),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from isl group by doc_id, run),
edges as (select doc_id, a, b from runs union all select doc_id, n, n from d),
parts as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a, b), 0) as x, a as y from edges),
kept as (select doc_id, unhex(coalesce(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x), '')) as bytes
         from parts join d using (doc_id) group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(sum(b - a), 0)::bigint as n_removed, count(a)::bigint as n_spans,
       any_value(sha256(bytes)) as kept_sha256
from d join kept using (doc_id) left join runs using (doc_id) group by d.doc_id, n
"""


@register("op5_suffix_array_dedup", OP5_SQL)
def op5(spark, sf_dir: str) -> DataFrame:
    return deduplicated_bytes(read(spark, sf_dir, "documents"), with_bytes=False)
