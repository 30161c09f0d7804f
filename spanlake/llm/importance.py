"""Importance resampling of documents towards a target distribution.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; features
are all runs of 1 to ``max_n`` words joined by one space, each counted in the bucket
that its CRC-32 modulo ``buckets`` names. A bucket's gain is the floor of 1000 times the
log ratio of its smoothed shares in the target and in the documents; a document's
weight is the sum of the gains over its features. Its score adds floored Gumbel noise
from a hash of its id, so the highest scores are a weighted draw without replacement.

Array-scored weights: the gains are one array of ``buckets`` numbers, which is all that
tasks get; buckets of a slice of texts are computed at once on its bytes. Documents are
read twice, for the counts (summed within tasks, then by Spark) and for the scores, and
no text is shuffled.

Distributed quickselect finds the k-th key of (score descending, id, row): some random
rows of the range still open are pivots, one aggregate counts exactly which rows of the
range stand before and at each pivot, and the range narrows to that between two of them
until the k-th row is a pivot itself. A row number ends the key, so no two are equal,
whatever repeats. Only the winners are then sorted, by range, and ranked.

Null and empty texts have no words: weight 0, never drawn. A null id is hashed as the
empty string and comes last among equal scores. Repeated rows score alike and are drawn
one by one. An empty table gives an empty result, an empty target only its smoothing.
Only the id and text columns are read, unless ``with_document`` carries the whole row
along as a struct.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.decontamination import WORD_BYTES
from spanlake.llm.shared import arrow_schema, written
from spanlake.llm.textarrays import LOWER, per_row, slices, word_bounds
from spanlake.operators.ordering import prefix_sums

BUCKETS = 10_000
LONG_FEATURE = 64
PIVOTS = 24


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of every ``data[s:e]``, one byte of all of them at a time; longer ones than
    ``LONG_FEATURE`` bytes one by one."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    lengths, at = lengths[order], starts[order]
    n_long = int(np.searchsorted(-lengths, -LONG_FEATURE, "left"))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for p in range(LONG_FEATURE):
        k = int(np.searchsorted(-lengths, -p, "left"))  # those with more than p bytes
        if k <= n_long:
            break
        part = crc[n_long:k]
        crc[n_long:k] = table[(part ^ data[at[n_long:k] + p]) & 0xFF] ^ (part >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        crc[i] = zlib.crc32(data[at[i]:at[i] + lengths[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, max_n: int, buckets: int, table: np.ndarray):
    """``(words per text, features' texts, features' buckets)`` of a slice, for each n."""
    low = LOWER[data]
    s, e, rows = word_bounds(WORD_BYTES[data], offsets)
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    if max_n > 1:  # words behind one another with a space between
        lengths = e - s + 1
        ends = np.cumsum(lengths)
        spaced = np.full(int(lengths.sum()), 0x20, np.uint8)
        keep = np.ones(len(spaced), bool)
        keep[ends - 1] = False
        first = ends - lengths
        inside = np.arange(len(spaced))[keep]
        spaced[keep] = low[inside + np.repeat(s - first, lengths - 1)]
        low, s, e = spaced, first, ends - 1
    found = []
    for n in range(1, max_n + 1):
        last = np.arange(n - 1, len(s))
        last = last[rows[last] == rows[last - (n - 1)]]
        found.append((rows[last], crc32s(low, s[last - (n - 1)], e[last], table) % np.uint32(buckets)))
    texts, bucket = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(texts, kind="stable") if max_n > 1 else slice(None)
    return n_words, texts[order], bucket[order].astype(np.int64)


BUCKET_COUNT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def bucket_counts(texts: DataFrame, text_col: str = "text", *, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket (``buckets`` numbers)."""
    arrow = arrow_schema(BUCKET_COUNT)

    def count(batches):
        table, total = crc_table(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                total += np.bincount(features(data, offsets, max_n, buckets, table)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=arrow)

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_col).mapInArrow(count, BUCKET_COUNT).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The buckets' gains from their counts in the documents and in the target."""
    n = len(source)
    all_s, all_t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t)))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(seed: int, doc_id) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1,
           seed: int = 2024, with_document: bool = False) -> DataFrame:
    """id, n_words, n_features, weight, score [, document] of every row."""
    source = docs.select(id_col, text_col, *([F.struct(*docs.columns).alias("document")] if with_document else []))
    fields = [source.schema[0], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")),
              *source.schema[2:]]
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)

    def score(batches):
        table = crc_table()
        for batch in batches:
            columns = [[], [], []]
            for lo, hi, data, offsets in slices(batch.column(1)):
                n_words, texts, bucket = features(data, offsets, max_n, len(gain), table)
                bounds = np.searchsorted(texts, np.arange(hi - lo + 1))
                for held, more in zip(columns, (n_words, np.diff(bounds), per_row(gain[bucket], bounds))):
                    held.append(more)
            n_words, n_features, weight = (np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64) for c in columns)
            added = np.array([noise(seed, d) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, weight + added)),
                 *batch.columns[2:]], schema=arrow)

    return source.mapInArrow(score, schema)


KEY = ["_down", "_no_id", "_id", "_row"]


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th (from 1) of the keys ``KEY`` of ``rows``, which are written and all
    different; there are at least ``k``."""
    types = {c: rows.schema[c].dataType for c in KEY}

    def at(key):
        return F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(KEY, key)))

    key = F.struct(*KEY)
    low, high, turn = None, None, 0
    while True:
        turn += 1
        inside = rows
        if low is not None:
            inside = inside.where(key > at(low))
        if high is not None:
            inside = inside.where(key < at(high))
        picked = inside.select(*KEY).orderBy(F.xxhash64(F.lit(turn), "_row"), "_row").limit(pivots).collect()
        chosen = sorted((tuple(r) for r in picked), key=lambda r: (r[0], r[1], 0 if r[1] else r[2], r[3]))
        counts = inside.agg(*(F.count_if(key < at(p)).alias(f"before{i}") for i, p in enumerate(chosen)),
                            *(F.count_if(key == at(p)).alias(f"equal{i}") for i, p in enumerate(chosen))).first()
        passed = 0
        for i, p in enumerate(chosen):
            before, upto = counts[f"before{i}"], counts[f"before{i}"] + counts[f"equal{i}"]
            if before < k <= upto:
                return p
            if k <= before:
                high = p
                break
            low, passed = p, upto
        k -= passed


def importance_resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                        target_col: str = "text", max_n: int = 1, buckets: int = BUCKETS, percent: int = 10,
                        min_words: int = 20, seed: int = 2024, with_document: bool = False,
                        pivots: int = PIVOTS) -> DataFrame:
    """Every document with id, n_words, n_features, weight, score, [document,] and rank:
    1, 2, 3... for the drawn ``percent`` of those with ``min_words`` words, else null."""
    gain = gains(bucket_counts(docs, text_col, max_n=max_n, buckets=buckets),
                 bucket_counts(target, target_col, max_n=max_n, buckets=buckets))
    scored = scores(docs, gain, id_col=id_col, text_col=text_col, max_n=max_n, seed=seed, with_document=with_document)
    names = scored.columns
    rows = written(scored.select(
        *names, (-F.col("score")).alias("_down"), F.col(id_col).isNull().alias("_no_id"), F.col(id_col).alias("_id"),
        F.monotonically_increasing_id().alias("_row")), "importance")
    able = rows.where(F.col("n_words") >= min_words)
    k = percent * able.count() // 100
    if k == 0:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    last = kth_key(able, k, pivots)
    drawn = (F.col("n_words") >= min_words) & (F.struct(*KEY) <= F.struct(
        *(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(KEY, last))))
    winners = prefix_sums(rows.where(drawn), KEY, "rank")
    return (winners.select(*names, (F.col("rank") + 1).alias("rank"))
            .unionByName(rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))))
