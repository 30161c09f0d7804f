"""The corpus pipeline: documents to packed training sequences.

Five stages, each a whole-table operator of ``spanlake.llm``; a stage's result is
written as Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``.

1. language_id: learns the languages from the labelled documents and drops documents
   without a letter or with less than half of the probability on one language.
2. line_dedup: drops repeated lines; ``n_chars`` is that of the new text.
3. simhash_dedup: keeps one document of every group of linked fingerprints.
4. decontamination: drops documents that hold a window of a benchmark item.
5. packing: tokenizes and packs what is left into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.decontamination import decontaminate
from spanlake.llm.language import identified, learn
from spanlake.llm.lines import deduplicate_lines
from spanlake.llm.packing import pack_documents
from spanlake.llm.registry import read
from spanlake.llm.shared import written
from spanlake.llm.simhash import deduplicate


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs, learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("packing", packing)]

# A learned model, a fingerprint of hashes and a packing plan are no SQL; the stages
# are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
