"""DuckDB CTE fragments that mirror the fixtures (used by the oracle SQL)."""

from __future__ import annotations

from spanlake.functions.text import SEGMENT, WORD, WS, sql_str
from spanlake.sources.fixtures import ANSWER_LEN, TITLE_PATTERN

TITLE = f"regexp_extract(text, {sql_str(TITLE_PATTERN)}, 1)"

CORPUS = f"corpus as (select doc_id, {TITLE} as title, text, source, lang from documents)"
PASSAGES = f"passages as (select doc_id, {TITLE} as title, '!!' || {TITLE} || '!!' || text as text from documents)"
QUESTIONS = "questions as (select item_id as id, text as question from benchmark)"

# A user dictionary: the pieces of the pages' titles and the whole titles of the corpus.
DICTIONARY = f"""dict as (select distinct trim(regexp_replace(lower(term), {sql_str(WS + '+')}, ' ', 'g')) as term from (
  select unnest(regexp_split_to_array(regexp_replace(regexp_extract(html, {sql_str('(?s)<title>(.*?)</title>')}, 1), '[()]', '', 'g'),
                {sql_str(WS + '+')})) as term from pages
  union all select regexp_replace({TITLE}, '[()]', '', 'g') from documents) where term is not null),
dterms as (select term, regexp_extract_all(term, {sql_str(SEGMENT)}) as atoms from dict where term <> ''),
heads as (select distinct atoms[1] as a, atoms[2] as b, atoms[3] as c, len(atoms) as n from dterms)"""


def dictionary_ctes(p: str, table: str, key: str, text: str) -> str:
    """CTEs ending in ``{p}dtok(<key>, term)``: the longest dictionary terms from left to
    right, and the words between them. Terms that overlap are chosen within the runs of
    overlapping ones, following from each the next behind it."""
    return f"""{p}a as (select {key}, regexp_extract_all(regexp_replace(lower({text}), {sql_str(WS + '+')}, ' ', 'g'), {sql_str(SEGMENT)}) as atoms
        from {table} where {text} is not null),
{p}x as (select {key}, unnest(atoms) as a, generate_subscripts(atoms, 1) as i from {p}a),
{p}y as (select {key}, i, a, lead(a, 1) over o as b, lead(a, 2) over o as c from {p}x window o as (partition by {key} order by i)),
{p}c as (select {key}, i, n from {p}y join heads using (a) where n = 1
         union all select {key}, i, n from {p}y join heads using (a, b) where n = 2
         union all select {key}, i, n from {p}y join heads using (a, b, c) where n > 2),
{p}w as (select {key}, i, i + n as e, array_to_string(atoms[i:i + n - 1], '') as term
         from {p}c join {p}a using ({key}) where i + n - 1 <= len(atoms)),
{p}m as (select {key}, i, max(e) as e from {p}w join dterms using (term) group by 1, 2),
{p}g as (select *, case when i >= max(e) over (partition by {key} order by i rows between unbounded preceding and 1 preceding)
         then 1 else 0 end as new from {p}m),
{p}r as (select {key}, i, e, sum(new) over (partition by {key} order by i) as run from {p}g),
{p}n as (select s.{key}, s.run, s.i, s.e, min(t.i) as nxt from {p}r s left join {p}r t
         on t.{key} = s.{key} and t.run = s.run and t.i >= s.e group by all),
{p}k as (select {key}, run, i, e, nxt from (select *, row_number() over (partition by {key}, run order by i) as o from {p}n) where o = 1
         union all select n.{key}, n.run, n.i, n.e, n.nxt from {p}k k join {p}n n on n.{key} = k.{key} and n.run = k.run and n.i = k.nxt),
{p}t as (select distinct {key}, unnest(range(i, e)) as i from {p}k),
{p}dtok as (select k.{key}, array_to_string(a.atoms[i:e - 1], '') as term from {p}k k join {p}a a using ({key})
         union all select x.{key}, x.a from {p}x x anti join {p}t t using ({key}, i)
         where regexp_full_match(x.a, {sql_str(WORD)}))"""


_START = f"((doc_id * 131) % greatest(n_chars - {ANSWER_LEN}, 1))"
QA = (f"qa as (select {TITLE} as title, text as context, {TITLE} as question, doc_id as id, "
      f"case when doc_id % 10 <> 0 then {_START} end as answer_start, "
      f"case when doc_id % 10 <> 0 then substr(text, {_START} + 1, {ANSWER_LEN}) end as answer_text, "
      f"doc_id as document_id, case when doc_id % 5 = 0 then 'validation' else 'train' end as split "
      f"from documents)")


def words_sql(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {sql_str(WORD)})"


def bm25_ctes(corpus: str, text_col: str, qtable: str, prefix: str = "", tokens: str | None = None,
              qtokens: str | None = None) -> str:
    """CTEs ``{prefix}tf, {prefix}dl, {prefix}st, {prefix}q, {prefix}dfq, {prefix}s``
    scoring ``qtable(id, question)`` against ``corpus(doc_id, <text_col>)``; ``tokens``
    ``(doc_id, term)`` and ``qtokens`` ``(id, term)`` are other tables of terms."""
    p = prefix
    tok = f"select * from {tokens}" if tokens else f"select doc_id, unnest({words_sql(text_col)}) as term from {corpus}"
    qtok = qtokens or f"(select id, unnest({words_sql('question')}) as term from {qtable})"
    return f"""
{p}tok as ({tok}),
{p}tf as (select doc_id, term, count(*) as tf from {p}tok group by 1, 2),
{p}dl as (select doc_id, sum(tf) as dl from {p}tf group by 1),
{p}st as (select count(*) as n, avg(dl) as avgdl from {p}dl),
{p}q as (select id, term, count(*) as qtf from {qtok} group by 1, 2),
{p}dfq as (select term, count(*) as df from {p}tf where term in (select term from {p}q) group by 1),
{p}s as (select {p}q.id, {p}tf.doc_id,
          round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf
                / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
        from {p}q join {p}dfq using (term) join {p}tf using (term) join {p}dl using (doc_id), {p}st
        group by 1, 2)"""
