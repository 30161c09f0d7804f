"""The row-local cleaners on a Structured Streaming source.

The reference has no streaming. Its stateless steps (T1-T4, T6) are column
expressions, so they run unchanged on a streaming DataFrame; this module wires
them to a file source and a Parquet sink with a checkpoint in the shared
folder, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spanlake.functions.text import clean_qa, sanitize_query
from spanlake.operators.cleaning import clean_and_shift

QA_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("answers", T.StructType([T.StructField("answer_start", T.ArrayType(T.IntegerType())),
                                          T.StructField("text", T.ArrayType(T.StringType()))])),
])


def cleaned_examples(stream: DataFrame) -> DataFrame:
    """T3 + T1 + T6 on a (streaming or static) example frame."""
    out = clean_and_shift(stream)
    return out.withColumn("question", sanitize_query(clean_qa("question")))


def start_clean_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                       schema: T.StructType = QA_SCHEMA, fmt: str = "json", available_now: bool = True):
    """Clean every new example file under ``source`` into Parquet under ``sink``."""
    src = spark.readStream.schema(schema).format(fmt).load(source)
    q = (cleaned_examples(src).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
