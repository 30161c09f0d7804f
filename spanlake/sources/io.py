"""Sources and sinks.

Distributed forms are preferred everywhere: JSON Lines and Parquet folders,
partitioned by split/fold. Files that are one JSON object are read by byte ranges and
written by all tasks (``objects``: ``read_*_split``, ``write_*_object``); the older
``read_*_object`` take such a file as one value of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.common import broadcast_if_small
from spanlake.sources.objects import RANGE_BYTES, read_object_entries, write_object_entries

CORPUS_ENTRY = ("struct<text:string,title:string,corpus_source:string,url:string,domain:string,"
                "author:string,html:string,document_id:bigint>")
NBEST_ENTRY = "struct<start_logit:double,end_logit:double,text:string,probability:double>"

# CSV options that round-trip quotes, commas, newlines, nulls, empty strings and
# edge blanks (both sides must use them).
CSV_COMMON = {"header": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "",
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE = {**CSV_COMMON, "quoteAll": "true"}
CSV_READ = {**CSV_COMMON, "multiLine": "true"}

# An object file has half of these on average, so that hardly one has more.
MAX_OBJECT_BYTES = 16 << 20
MAX_OBJECT_ROWS = 20_000


def with_object(df: DataFrame, key: str, entry: Column, group: str | None = None, least: int = 1,
                out: str = "object") -> DataFrame:
    """``df`` with the number of the object file that a row goes to: a hash of ``key``,
    over as many files (``least`` at least) per ``group`` as the rows and the bytes of
    their JSON ``entry`` take, so that no file grows with the table."""
    size = F.octet_length(F.to_json(F.struct(F.col(key), entry))).cast("bigint")
    by = [F.col(group).alias("_group")] if group else []
    files = df.groupBy(*by).agg(F.greatest(F.ceil(F.sum(size) * 2 / MAX_OBJECT_BYTES),
                                           F.ceil(F.count("*") * 2 / MAX_OBJECT_ROWS), F.lit(least)).alias("_files"))
    on = F.col(group).eqNullSafe(F.col("_group")) if group else F.lit(True)
    side = broadcast_if_small(files, "files") if group else F.broadcast(files)  # one row
    return df.join(side, on).withColumn(out, F.pmod(F.xxhash64(key), "_files")).drop("_files", "_group")


def json_text(value) -> Column:
    """A column's value as JSON text (null as ``null``)."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def from_json_text(value, kind: str) -> Column:
    """A JSON text as a value of the given type."""
    return F.get(F.from_json(F.concat(F.lit("["), F.col(value) if isinstance(value, str) else value, F.lit("]")), f"array<{kind}>"), 0)


def write_object(df: DataFrame, path: str, key: str, value, mode: str = "overwrite") -> str:
    """Rows as one JSON object file in the order of ``key``, written by all tasks."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    return write_object_entries(ordered.select(F.col(key).cast("string").alias("key"), json_text(value).alias("value")), path, mode)


# ----------------------------------------------------------------------------- S1/S2 corpus
def read_corpus_split(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The corpus object of a file, or of the files of a folder, by byte ranges."""
    rows = read_object_entries(spark, path, range_bytes)
    return rows.select(F.col("key").alias("doc_key"), from_json_text("value", CORPUS_ENTRY).alias("d")).select("doc_key", "d.*")


def read_corpus_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{"0": {...}, "1": {...}}`` -> rows with ``doc_key``."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,{CORPUS_ENTRY}>")
    return raw.select(F.explode(m).alias("doc_key", "d")).select("doc_key", "d.*")


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 (splittable form): JSON Lines with ``doc_key`` and the corpus fields."""
    schema = T.StructType([T.StructField("doc_key", T.StringType())] +
                          T._parse_datatype_string(CORPUS_ENTRY).fields)
    return spark.read.schema(schema).json(path)


def write_corpus(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write the cleaned corpus (UTF-8, not ASCII-escaped)."""
    df.write.mode(mode).format(fmt).save(path)


# ----------------------------------------------------------------------------- S3/S4 splits
def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """S3: one split of a dataset folder partitioned by ``split`` (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_splits(df: DataFrame, path: str, by=("split",), mode: str = "overwrite") -> None:
    """A dataset with its splits (or folds) as partition folders."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


# ----------------------------------------------------------------------------- S5/S6 hits CSV
def hits_schema(k: int = 10, id_type: T.DataType = T.StringType()) -> T.StructType:
    fields = [T.StructField("id", id_type)]
    fields += [T.StructField(f"text{j}", T.StringType()) for j in range(1, k + 1)]
    fields += [T.StructField(f"score{j}", T.DoubleType()) for j in range(1, k + 1)]
    return T.StructType(fields)


def write_hits_csv(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Wide hits as CSV (no index column)."""
    wide.write.mode(mode).options(**CSV_WRITE).csv(path)


def read_hits_csv(spark: SparkSession, path: str, k: int = 10,
                  id_type: T.DataType = T.StringType()) -> DataFrame:
    """Wide hits from CSV with a declared schema. Columns are taken by the names in
    the header, in any order; others (a leading unnamed index column, as pandas
    writes) are ignored, and a missing one is an error."""
    header = spark.read.options(**CSV_READ).csv(path)
    return enforce_schema(header, hits_schema(k, id_type))


# ----------------------------------------------------------------------------- S7 schema
def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared schema; a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


JOINED_EXAMPLE = T.StructType([T.StructField("context", T.StringType()), T.StructField("id", T.StringType()),
                               T.StructField("question", T.StringType())])


# ----------------------------------------------------------------------------- S8-S11 n-best, predictions
def read_nbest_object(spark: SparkSession, path: str) -> DataFrame:
    """``{id: [{start_logit, end_logit, text, probability}, ...]}`` ->
    ``(id, rank, start_logit, end_logit, text, probability)``, rank 1-based."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,array<{NBEST_ENTRY}>>")
    ex = raw.select(F.explode(m).alias("id", "lst"))
    return ex.select("id", F.posexplode("lst").alias("pos", "p")).select(
        "id", (F.col("pos") + 1).alias("rank"), "p.*")


def read_nbest_split(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """N-best object files by byte ranges; rows as of :func:`read_nbest_object`."""
    rows = read_object_entries(spark, path, range_bytes)
    lists = rows.select(F.col("key").alias("id"), from_json_text("value", f"array<{NBEST_ENTRY}>").alias("lst"))
    return lists.select("id", F.posexplode("lst").alias("pos", "p")).select("id", (F.col("pos") + 1).alias("rank"), "p.*")


def read_nbest_lines(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """S8 (splittable form): JSON Lines ``{"id": ..., "preds": [...]}``."""
    df = spark.read.schema(f"id {id_type}, preds array<{NBEST_ENTRY}>").json(path)
    return df.select("id", F.posexplode("preds").alias("pos", "p")).select(
        "id", (F.col("pos") + 1).alias("rank"), "p.*")


def output_name(kind: str, prefix: str | None = None) -> str:
    """S9-S11 file names: ``predictions[_prefix]``, ``nbest_predictions[_prefix]``,
    ``null_odds[_prefix]``."""
    return kind if prefix is None else f"{kind}_{prefix}"


def write_predictions(pred: DataFrame, out_dir: str, prefix: str | None = None, mode: str = "overwrite") -> str:
    """``(id, prediction_text)`` as JSON Lines under ``predictions[_prefix]``."""
    path = f"{out_dir}/{output_name('predictions', prefix)}"
    pred.select("id", "prediction_text").write.mode(mode).json(path)
    return path


def write_nbest(nbest: DataFrame, out_dir: str, prefix: str | None = None, mode: str = "overwrite") -> str:
    """N-best rows -> one JSON line per id with the list in rank order."""
    path = f"{out_dir}/{output_name('nbest_predictions', prefix)}"
    item = F.struct("rank", F.struct("start_logit", "end_logit", "text", "probability").alias("p"))
    per_id = nbest.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    per_id.select("id", F.transform("l", lambda x: x["p"]).alias("preds")).write.mode(mode).json(path)
    return path


def write_null_odds(odds: DataFrame, out_dir: str, prefix: str | None = None, mode: str = "overwrite") -> str:
    """``(id, score_diff)`` under ``null_odds[_prefix]`` (null-answer mode)."""
    path = f"{out_dir}/{output_name('null_odds', prefix)}"
    odds.select("id", "score_diff").write.mode(mode).json(path)
    return path


def write_predictions_object(pred: DataFrame, out_dir: str, prefix: str | None = None, mode: str = "overwrite") -> str:
    """``{id: prediction_text}`` as one object, ``predictions[_prefix].json``."""
    return write_object(pred, f"{out_dir}/{output_name('predictions', prefix)}.json", "id", F.col("prediction_text"), mode)


def write_nbest_object(nbest: DataFrame, out_dir: str, prefix: str | None = None, mode: str = "overwrite") -> str:
    """``{id: [{start_logit, end_logit, text, probability}, ...]}`` in rank order as
    one object, ``nbest_predictions[_prefix].json``."""
    item = F.struct("rank", F.struct("start_logit", "end_logit", "text", "probability").alias("p"))
    lists = nbest.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("preds"))
    return write_object(lists, f"{out_dir}/{output_name('nbest_predictions', prefix)}.json", "id", F.col("preds"), mode)


def write_null_odds_object(odds: DataFrame, out_dir: str, prefix: str | None = None, mode: str = "overwrite") -> str:
    """``{id: score_diff}`` as one object, ``null_odds[_prefix].json``."""
    return write_object(odds, f"{out_dir}/{output_name('null_odds', prefix)}.json", "id", F.col("score_diff"), mode)


def read_object_of(spark: SparkSession, path: str, kind: str, name: str, id_type: str = "string",
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(id, name)`` rows of an object file whose values are of type ``kind``."""
    rows = read_object_entries(spark, path, range_bytes)
    return rows.select(F.col("key").cast(id_type).alias("id"), from_json_text("value", kind).alias(name))


# ----------------------------------------------------------------------------- S12 metrics
def metrics_long(metrics_row: DataFrame) -> DataFrame:
    """One-row metrics frame -> ``(key, value)`` rows (values as strings)."""
    cols = metrics_row.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cols])
    return metrics_row.select(F.explode(pairs).alias("kv")).select("kv.key", "kv.value")


def write_metrics_lines(metrics_row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted ``key = value`` lines in one small text file."""
    lines = metrics_long(metrics_row).orderBy("key").select(F.concat_ws(" = ", "key", "value").alias("value"))
    lines.coalesce(1).write.mode(mode).text(path)
