"""The whole chain from questions to evaluated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import WORD, sql_str
from spanlake.operators import decode as D
from spanlake.operators import evaluate as E
from spanlake.operators.answering import answer_questions
from spanlake.operators.common import r6
from spanlake.operators.windows import WindowSpec, vocabulary_from_text
from spanlake.plans.q_evaluate import SCORES
from spanlake.plans.q_retrieval import CONTEXT_SQL, K
from spanlake.plans.q_windows import base_sql
from spanlake.plans.registry import register
from spanlake.sources import fixtures as FX
from spanlake.sources.tables import table

SPEC = WindowSpec(max_seq_length=384)
SCORERS = ["lexical-overlap", "lexical-sevenths", "lexical-sixteenths"]
BONUS = ["0.0", "(tid % 7) / 8.0", "(tid % 16) / 16.0"]

CONTEXTS = CONTEXT_SQL.strip()[len("with "):].rsplit("select q.id", 1)
SOURCE = f"""{CONTEXTS[0].rstrip()},
qa as (select q.id{CONTEXTS[1].strip().replace('::bigint as id', '')}),
""".replace("select q.id, q.question, coalesce(c.context, '') as context",
            "select q.id, q.question, coalesce(c.context, '') as context, 'validation' as split, "
            "null::int as answer_start, null::varchar as answer_text").rstrip().rstrip(",")

LOGITS = " union all ".join(
    f"select {m} as model, id, w, p, cs, ce, case when hit then 1 + {b} else 0.0 end::double as x from tp"
    for m, b in enumerate(BONUS))

PIPELINE_SQL = f"""
with {base_sql(3, SOURCE, SPEC.max_seq_length)},
qd as (select distinct id, tid from qt where tid <> 1),
tk as (select win2.id, win2.w, win2.qn + 2 + ct.tok_idx - win2.ws as p, ct.tid, ct.start as cs, ct."end" as ce,
              qd.tid is not null as hit
       from win2 join ct on ct.id = win2.id and ct.tok_idx >= win2.ws and ct.tok_idx < win2.we
       left join qd on qd.id = ct.id and qd.tid = ct.tid),
ps as (select id, w, unnest(range({SPEC.max_seq_length})) as p from win2),
tp as (select ps.id, ps.w, ps.p, tid, cs, ce, coalesce(hit, false) as hit from ps left join tk using (id, w, p)),
lg as ({LOGITS}),
top as (select * from (select *, row_number() over (partition by model, id, w order by x desc, p desc) - 1 as rk from lg)
        where rk < {D.N_BEST}),
cand as (select a.model, a.id, a.w, a.rk as sr, b.rk as er, a.x + b.x as score, a.cs, b.ce
         from top a join top b using (model, id, w)
         where a.cs is not null and b.cs is not null and b.p >= a.p and b.p - a.p + 1 <= {D.MAX_ANSWER_LENGTH}),
best as (select * from (select *, row_number() over (partition by model, id order by score desc, w, sr, er) as rank
                        from cand) where rank <= {D.N_BEST}),
txt as (select best.*, substr(qa.context, cs::bigint + 1, greatest(ce - cs, 0)::bigint) as text from best join qa using (id)),
m as (select qa.id, model from qa, range({len(SCORERS)}) t(model)),
ag as (select m.id, m.model, count(txt.id) as n, max(txt.text) as any_text
       from m left join txt on txt.id = m.id and txt.model = m.model group by 1, 2),
allp as (select model, id, rank, text, score from txt
         union all select model, id, 0, 'empty', 0.0 from ag where n = 0 or (n = 1 and any_text = '')),
pb as (select *, row_number() over (partition by model, id order by rank) as k,
              exp(score - max(score) over (partition by model, id)) as e from allp),
t as (select * from (select id, model, text, k, round(e / sum(e) over (partition by model, id), 6) as p from pb) where k = 1),
votes as (select id, text, count(*) as n, max(p) as mp from t group by id, text),
ans as (select id, text from (select *, row_number() over (partition by id order by n desc, mp desc, text) as k from votes)
        where k = 1),
pr as (select qa.id, false as missing, ans.text as prediction_text,
              regexp_extract(qa.question, {sql_str(WORD)}) as gold from qa join ans using (id)),
{SCORES}
select pr.id::bigint as id, pr.prediction_text, sc2.exact_match, round(sc2.f1, 6) as f1
from pr join sc2 using (id)
"""


@register("qa_pipeline", PIPELINE_SQL)
def qa_pipeline(spark, sf):
    """Every benchmark question answered from the documents by the vote of three
    scorers, and scored (gold answer: the question's first word)."""
    questions = FX.questions(spark, sf)
    vocab = vocabulary_from_text(table(spark, sf, "benchmark"), "text")
    answers = answer_questions(FX.corpus(spark, sf), questions, vocab, SCORERS, K, SPEC)
    none = F.array().cast("array<int>")
    gold = F.struct(none.alias("answer_start"), F.array(F.regexp_extract("question", WORD, 0)).alias("text"))
    scores = E.score_rows(answers, questions.select("id", gold.alias("answers")))
    return scores.join(answers, "id").select(F.col("id").cast("bigint").alias("id"), "prediction_text", "exact_match",
                                             r6("f1").alias("f1"))
