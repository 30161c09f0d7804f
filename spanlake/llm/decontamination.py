"""Benchmark decontamination by n-gram windows.

A word is a run of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A
benchmark item's windows are its runs of ``n`` consecutive words; an item with fewer
words, but not none, is one window. A document word inside an occurrence of a window
is hit.

The windows' hashes are a sorted array behind a small bitmap, broadcast to tasks;
documents are scanned once, nothing of them is shuffled, and every hash that matches
is verified on the words themselves. The benchmark is the small side: its size is
checked (``max_benchmark_bytes``) before it is collected, and beyond that it is worked
off in blocks of items that each fit, so the broadcast stays bounded.

Null or empty texts have no words; null items and items without words have no
windows; a null item_id is reported as the empty string. Repeated documents are judged
each by itself, repeated item ids count once. Only the id and text columns are read by
:func:`contamination`; :func:`decontaminate` carries all others along, whatever their
names.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, free_name, written
from spanlake.llm.textarrays import (LOWER, Powers, covered, per_row, range_hashes,
                                     slices, table, word_bounds)

WORD_BYTES = table(lambda b: b >= 0x80 or chr(b).isalnum())
MAX_BENCHMARK_BYTES = 32 << 20
BITMAP_BITS = 22

REPORT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])


def text_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    s, e, _ = word_bounds(WORD_BYTES[data], np.array([0, len(data)]))
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(s, e)]


class Windows:
    """The benchmark's windows by number of words: hashes, bitmap, and exact texts."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = text_words(text)
            k = min(n, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                self.by_length.setdefault(k, {}).setdefault(b" ".join(words[i:i + k]), set()).add(item)
        powers = Powers()
        self.hashes = {k: np.unique(window_hashes(self._packed(w), k, powers)) for k, w in self.by_length.items()}
        self.bitmaps = {}
        for k, h in self.hashes.items():
            self.bitmaps[k] = np.zeros(1 << BITMAP_BITS, bool)
            self.bitmaps[k][h >> np.uint64(64 - BITMAP_BITS)] = True

    @staticmethod
    def _packed(windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(windows), np.uint8)
        return data, *word_bounds(WORD_BYTES[data], np.array([0, len(data)]))[:2]


def window_hashes(words, k: int, powers: Powers) -> np.ndarray:
    """Hashes of the windows of ``k`` words; words = (lower-cased bytes, starts, ends)."""
    data, s, e = words
    return grams(range_hashes(data, s, e, powers), k, powers)


def grams(word_hash: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    at = np.arange(max(0, len(word_hash) - k + 1))
    return range_hashes(word_hash, at, at + k, powers)


def _scan(batches, windows: Windows, text: int, emit):
    """Call ``emit(batch, first_row, results)`` per slice; a result per row."""
    powers = Powers()
    for batch in batches:
        out = []
        for lo, hi, data, offsets in slices(batch.column(text)):
            low = LOWER[data]
            s, e, rows = word_bounds(WORD_BYTES[data], offsets)
            word_hash = range_hashes(low, s, e, powers)
            hit = np.zeros(len(s), bool)
            items: dict[int, set[str]] = {}
            for k, hashes in windows.hashes.items():
                if len(s) < k:
                    continue
                h = grams(word_hash, k, powers)
                at = np.flatnonzero(windows.bitmaps[k][h >> np.uint64(64 - BITMAP_BITS)]
                                    & (rows[:len(h)] == rows[k - 1:]))
                if not len(at):
                    continue
                pos = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                at = at[hashes[pos] == h[at]]
                sure = []
                for j in at.tolist():  # few: verify the words themselves
                    words = b" ".join([low[a:b].tobytes() for a, b in zip(s[j:j + k], e[j:j + k])])
                    found = windows.by_length[k].get(words)
                    if found:
                        sure.append(j)
                        items.setdefault(int(rows[j]), set()).update(found)
                hit |= covered(len(s), np.array(sure, np.int64), np.full(len(sure), k))
            first = np.searchsorted(rows, np.arange(hi - lo + 1))
            n_hit = per_row(hit, first)
            for r in range(hi - lo):
                spans = []
                if n_hit[r]:
                    w = np.arange(first[r], first[r + 1])
                    on = hit[w]
                    begin = w[on & ~np.concatenate([[False], on[:-1]])]
                    end = w[on & ~np.concatenate([on[1:], [False]])]
                    doc = data[offsets[r]:offsets[r + 1]].tobytes()
                    points = lambda b, doc=doc, o=offsets[r]: len(doc[:b - o].decode())
                    spans = [(points(s[a]), points(e[b])) for a, b in zip(begin, end)]
                out.append((int(first[r + 1] - first[r]), int(n_hit[r]), sorted(items.get(r, ())), spans))
        yield emit(batch, out)


def _report(batches, windows: Windows, schema: pa.Schema):
    def emit(batch, found):
        ids = [x[2] for x in found]
        columns = [batch.column(0), pa.array([x[0] for x in found], pa.int64()),
                   pa.array([x[1] for x in found], pa.int64()),
                   pa.array([len(x) for x in ids], pa.int64()),
                   pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
                   pa.array([x[1] > 0 for x in found], pa.bool_()),
                   pa.array([[{"start": a, "end": b} for a, b in x[3]] for x in found], schema.field("hit_spans").type),
                   pa.array(ids, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)
    return _scan(batches, windows, 1, emit)


def _cleaned(batches, windows: Windows, text: int, mode: str):
    def emit(batch, found):
        if mode == "documents":
            return batch.filter(pa.array([not x[1] for x in found], pa.bool_()))
        texts = batch.column(text).to_pylist()
        for i, x in enumerate(found):
            for a, b in reversed(x[3]):
                texts[i] = texts[i][:a] + "\n" + texts[i][b:]
        return batch.set_column(text, batch.schema.field(text), pa.array(texts, batch.schema.field(text).type))
    return _scan(batches, windows, text, emit)


def _cut(batches, text: int):
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            spans = []
            for x in found:
                if spans and not len(text_words(texts[i][spans[-1][1]:x["start"]])):  # no word between them
                    spans[-1] = spans[-1][0], x["end"]
                else:
                    spans.append((x["start"], x["end"]))
            for a, b in reversed(spans):
                texts[i] = texts[i][:a] + "\n" + texts[i][b:]
        batch = batch.set_column(text, batch.schema.field(text), pa.array(texts, batch.schema.field(text).type))
        yield batch.select(list(range(batch.num_columns - 1)))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str,
                     max_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark's items, in blocks of bounded size if it is larger than that."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                             F.col(text_col).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = -(-size // max_bytes) if size else 0
    if blocks <= 1:
        return [[tuple(r) for r in items.collect()]]
    of = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    return [[tuple(r) for r in items.where(of == b).collect()] for b in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  n: int = 10, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256 (of the ids
    sorted as strings and joined by commas), contaminated, hit_spans (code points) and
    items. With a benchmark of several blocks the counts are those of the union."""
    blocks = benchmark_blocks(benchmark, item_col, item_text, max_benchmark_bytes)
    source = docs.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), *REPORT])
    arrow = arrow_schema(schema)

    def one(df: DataFrame, items) -> DataFrame:
        return df.mapInArrow(partial(_report, windows=Windows(items, n), schema=arrow), schema)

    if len(blocks) == 1:
        return one(source, blocks[0])
    return _union_blocks(source, one, blocks, id_col, schema)


def _union_blocks(source, one, blocks, id_col, schema) -> DataFrame:
    """Join the blocks' reports row by row on a row number carried as the id. The rows
    are written with their numbers, so that all blocks see the same ones."""
    numbered = written(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = None
    for items in blocks:
        part = one(numbered.select(F.col("_row").alias(id_col), source.columns[1]), items)
        parts = part if parts is None else parts.unionByName(part)
    spans = F.flatten(F.collect_list("hit_spans"))
    merged = parts.groupBy(F.col(id_col).alias("_row")).agg(
        F.max("n_words").alias("n_words"), spans.alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = numbered.join(merged, "_row")
    narrow = T.StructType([schema[0], *REPORT])
    arrow, text_name = arrow_schema(narrow), source.columns[1]

    def finish(batches):
        for batch in batches:
            out = {name: [] for name in arrow.names}
            for r in batch.to_pylist():
                spans = []
                for x in sorted((y["start"], y["end"]) for y in r["_spans"]):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], x[1]))
                    else:
                        spans.append(x)
                text = r[text_name] or ""
                hit = sum(len(text_words(text[a:b])) for a, b in spans)
                values = [r[id_col], r["n_words"], hit, len(r["items"]),
                          hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), hit > 0,
                          [{"start": a, "end": b} for a, b in spans], r["items"]]
                for name, v in zip(out, values):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)
    return rows.mapInArrow(finish, narrow)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", n: int = 10,
                  mode: str = "documents", max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The documents without contaminated ones (``mode="documents"``) or with every
    hit span replaced by a line break (``mode="spans"``); columns as they came."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    out, at = docs, docs.columns.index(text_col)
    blocks = benchmark_blocks(benchmark, item_col, item_text, max_benchmark_bytes)
    if mode == "spans" and len(blocks) > 1:
        # cut once, by the spans of all blocks: a cut would break other blocks' windows
        number, spans = free_name(docs, "_number"), free_name(docs, "_hit_spans")
        numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        found = contamination(numbered.select(number, F.col(text_col).alias("_text")), benchmark, id_col=number, text_col="_text",
                              item_col=item_col, item_text=item_text, n=n, max_benchmark_bytes=max_benchmark_bytes)
        found = found.select(number, F.col("hit_spans").alias(spans))
        cut = numbered.join(found, number).select(*docs.columns, spans)
        return cut.mapInArrow(partial(_cut, text=at), docs.schema)
    for items in blocks:
        out = out.mapInArrow(partial(_cleaned, windows=Windows(items, n), text=at, mode=mode), docs.schema)
    return out
