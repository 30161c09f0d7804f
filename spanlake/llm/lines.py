"""Line deduplication with two Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys
of at least ``min_chars`` code points that are found in at least ``min_docs`` documents
lose all their lines except in the largest id that holds them; all other lines stay.

1. Every task marks its lines' hashes in two filters of fixed size, one of those seen
   once and one of those seen twice, which are merged by segment (``twice_seen``). More
   lines than the filters were sized for only mean more suspects, never another result.
2. Only lines that the twice-seen filter suspects are shuffled, as a 128-bit digest and
   an id, once per document. Exact counts of documents and the largest id are partial
   aggregates, so a line that a third of all documents hold is no hot task.
3. What each document loses is joined back by id and its lines are rebuilt.

Null or empty texts have one empty line. A null id is one document, smaller than all
others. Rows with the same id count as one document and lose the same keys.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, free_name, written
from spanlake.llm.textarrays import (BLANK, CONTINUATION, LOWER, Powers, prefix_sums,
                                     range_hashes, slices)
from spanlake.llm.twice_seen import passes, twice_seen

MIN_CHARS = 40
MIN_DOCS = 5
FILTER_BITS = 1 << 26


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int, powers: Powers):
    """Rows, starts, ends (of the stripped lines) and hashes of the long enough keys,
    once per row and key."""
    low = LOWER[data]
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([breaks + 1, offsets]))  # a line begins at each
    begin, end = bounds[:-1], bounds[1:]
    solid = np.flatnonzero(~BLANK[data])
    first = np.searchsorted(solid, begin)
    last = np.searchsorted(solid, end) - 1
    full = first <= last
    start, stop = solid[first[full]], solid[last[full]] + 1
    points = np.concatenate([[0], np.cumsum(~CONTINUATION[data])])
    enough = points[stop] - points[start] >= min_chars
    start, stop = start[enough], stop[enough]
    rows = np.searchsorted(offsets, start, "right") - 1
    hashes = range_hashes(low, start, stop, powers, prefix_sums(low, powers))
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    # lines of a row that share a hash are compared; different ones both stay
    seen: set[bytes] = set()
    other: list[int] = []
    for j in np.flatnonzero(~new):
        if new[j - 1]:
            seen = {low[start[order[j - 1]]:stop[order[j - 1]]].tobytes()}
        line = low[start[order[j]]:stop[order[j]]].tobytes()
        if line not in seen:
            seen.add(line)
            other.append(j)
    new[other] = True
    at = order[new]
    return low, rows[at], start[at], stop[at], hashes[at]


def _suspects(batches, min_chars: int, twice: np.ndarray, schema: pa.Schema):
    powers = Powers()
    for batch in batches:
        at, digests = [], []
        for lo, _, data, offsets in slices(batch.column(1)):
            low, rows, start, stop, hashes = _keys(data, offsets, min_chars, powers)
            for i in np.flatnonzero(passes(twice, hashes)):
                at.append(lo + int(rows[i]))
                digests.append(xxhash.xxh3_128_digest(low[start[i]:stop[i]].tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())),
                                          pa.array(digests, pa.binary())], schema=schema)


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\v\f\r").translate(LOWER.tobytes())


def _rebuilt(batches, text: int, drops: int, min_chars: int, schema: pa.Schema):
    """The input's columns but ``drops``, the text without its dropped lines, and
    n_lines and n_dropped after them."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for t, d in zip(batch.column(text), batch.column(drops)):
            t, d = t.as_py(), d.as_py()
            lines = (t or "").count("\n") + 1
            gone = 0
            if d and t:
                gone_keys, kept = set(d), []
                for line in t.encode().split(b"\n"):
                    key = line_key(line)
                    if len(key) >= min_chars and xxhash.xxh3_128_digest(key) in gone_keys:
                        gone += 1
                    else:
                        kept.append(line)
                t = b"\n".join(kept).decode()
            texts.append(t)
            n_lines.append(lines)
            n_dropped.append(gone)
        columns = [c for i, c in enumerate(batch.columns) if i != drops]
        columns[text] = pa.array(texts, schema.field(text).type)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                         schema=schema)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                   min_docs: int = MIN_DOCS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(id, drops)``: the digests of the keys whose lines each document loses."""
    powers = Powers()

    def hashes_of(batch):
        for _, _, data, offsets in slices(batch.column(0)):
            yield _keys(data, offsets, min_chars, powers)[4]

    twice = twice_seen(docs.select(text_col), hashes_of, filter_bits)
    source = docs.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("digest", T.BinaryType())])
    suspects = written(source.mapInArrow(partial(
        _suspects, min_chars=min_chars, twice=twice, schema=arrow_schema(schema)), schema),
        "suspect-lines")
    # written, so that the join below can broadcast it if it is small, or split a digest
    # that very many documents hold
    confirmed = written(suspects.groupBy("digest")
                        .agg(F.count_distinct(F.struct(id_col)).alias("n"), F.max(id_col).alias("kept"))
                        .where(F.col("n") >= min_docs).select("digest", "kept"), "repeated-lines")
    return (suspects.join(confirmed, "digest").where(~F.col(id_col).eqNullSafe(F.col("kept")))
            .groupBy(id_col).agg(F.collect_set("digest").alias("drops")))


def rebuilt_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = MIN_CHARS, **options) -> tuple[DataFrame, str, str]:
    """The documents with their texts rebuilt, and the names of two more columns: the
    numbers of lines before and of dropped lines."""
    lost = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, **options)
    drops, n_lines, n_dropped = (free_name(docs, x) for x in ("_drops", "n_lines", "n_dropped"))
    key = free_name(docs, "_lost_id")
    lost = lost.select(F.col(id_col).alias(key), F.col("drops").alias(drops))
    joined = docs.join(lost, docs[id_col].eqNullSafe(lost[key]), "left").select(*docs.columns, drops)
    schema = T.StructType([*docs.schema, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    out = joined.mapInArrow(partial(_rebuilt, text=docs.columns.index(text_col), drops=len(docs.columns),
                                    min_chars=min_chars, schema=arrow_schema(schema)), schema)
    return out, n_lines, n_dropped


def deduplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents without their repeated lines; columns as they came. A text that
    was null stays null."""
    return rebuilt_documents(docs, **options)[0].select(*docs.columns)
