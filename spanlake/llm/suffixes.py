"""Suffix-array deduplication of byte strings.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a
smaller document, or further ahead in the same one) is removed; strings are judged on
the input and never cross documents.

A suffix array of all bytes would order mostly suffixes that equal no other. The work
is therefore done in two parts, both exact:

*Discarding.* Each string of ``length`` bytes has an anchor: of its ``GRAM``-byte
substrings the one of the least hash (the last of several). Equal strings have equal
anchors at equal places. The strings that share one anchor occurrence are a run of
starts, and their union is a context of ``length`` to ``2 * length - GRAM`` bytes. An
anchor is a sampled name of all its strings: names seen once in the corpus are
discarded (two Bloom filters first, so that only suspects are shuffled, then exact
counts), and of equal contexts only the earliest is kept for sorting, the strings of
the others all starting earlier elsewhere.

*Difference cover.* What is left are names with several different contexts. The
contexts are shuffled by name, and each task sorts the suffixes of its contexts, some
megabytes at a time, by the difference-cover algorithm modulo 3: sort the sampled
triples, name them, recurse on the names until all differ, sort the remaining suffixes
by their first symbol and the rank of the sampled one behind it, and merge. The first
``length`` bytes of neighbours in that order are compared; of each run of equal ones
the earliest stays and the others are removed.

A name with over ``name_limit`` contexts (the border of a passage that very many
documents share) is not given to one task: its strings are spread by their digests and
their earliest starts found by an aggregate.

Texts are UTF-8 bytes; null texts are empty. Ids order nulls first. Rows of one id and
one text are one document, losing the same bytes; rows of one id with different texts
are different documents, ordered by a hash of the text. Only the id and text columns
are read by :func:`removed_spans` and :func:`deduplicated_bytes`.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, written
from spanlake.llm.textarrays import MIX, Powers, prefix_sums, range_hashes, slices
from spanlake.llm.twice_seen import passes, twice_seen
from spanlake.operators.common import broadcast_if_small

LENGTH = 100
GRAM = 50
FILTER_BITS = 1 << 28
NAME_LIMIT = 5000
BLOCK_BYTES = 1 << 20
PART_BYTES = 1 << 18


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, powers: Powers):
    """The anchors' contexts in a slice: row, first start, number of starts, name and
    context hash."""
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = prefix_sums(data, powers)
    _, inverse = powers.upto(n + 1)
    grams = (sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1]
    # the hash's high bits, then the place from the end: the least is the last of equals
    place_bits = max(20, n.bit_length())
    places = np.uint64((1 << place_bits) - 1) - np.arange(len(grams), dtype=np.uint64)
    least = grams * MIX
    least >>= np.uint64(place_bits)
    least <<= np.uint64(place_bits)
    least |= places
    window = length - gram + 1
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[:size - window], least[window - size:])
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    start = np.flatnonzero(rows[:n - length + 1] == rows[length - 1:])
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    mask = np.uint64((1 << place_bits) - 1)
    anchor = (mask - (least[start] & mask)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo = start[first]
    return (rows[lo].astype(np.int64), lo, count, grams[anchor[first]],
            range_hashes(data, lo, lo + count + length - 1, powers, sums))


def ranks_by_place(pos: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 3, np.int64)
    out[pos] = rank
    return out


def suffix_order(symbols: np.ndarray, top: int) -> np.ndarray:
    """The suffixes of ``symbols`` (from 1 to ``top``) in order, by the difference cover
    modulo 3. ``top`` cubed and ``top`` squared times the length must fit 63 bits."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols, np.zeros(3, np.int64)])
    base = top + 1
    # sampled triples; the string ends in a sampled suffix of its own if n % 3 == 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = (s[sample] * base + s[sample + 1]) * base + s[sample + 2]
    order = np.argsort(triples, kind="stable")
    new = np.ones(len(sample), bool)
    new[1:] = triples[order[1:]] != triples[order[:-1]]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_order(names, int(new.sum()))
        names[order] = np.arange(1, len(sample) + 1)
    rank = ranks_by_place(sample, names, n)
    sampled = sample[order]
    sampled = sampled[sampled < n]

    rest = np.arange(0, n, 3)
    many = len(sample) + 2
    rest = rest[np.argsort(s[rest] * many + rank[rest + 1], kind="stable")]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = (np.searchsorted(s[ones] * many + rank[ones + 1], s[rest] * many + rank[rest + 1])
              + np.searchsorted((s[twos] * base + s[twos + 1]) * many + rank[twos + 2],
                                (s[rest] * base + s[rest + 1]) * many + rank[rest + 2]))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    others = np.ones(n, bool)
    others[at] = False
    out[others] = sampled
    return out


def repeated_starts(texts: list[bytes], first: np.ndarray, length: int) -> list[np.ndarray]:
    """For contexts whose strings start at the global places ``first`` + 0, 1, ...: the
    starts within each whose string occurs at a smaller place."""
    size = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    symbols = joined.astype(np.int64) + 2
    symbols[begin + size] = 1  # an end is less than every byte
    order = suffix_order(symbols, 257)
    of = np.repeat(np.arange(len(texts)), size + 1)
    within = np.arange(len(joined)) - begin[of]
    order = order[within[order] + length <= size[of[order]]]  # suffixes that hold a whole string
    same = np.zeros(len(order), bool)
    span = np.arange(length)
    for at in range(1, len(order), 1 << 14):
        now, before = order[at:at + (1 << 14)], order[at - 1:at - 1 + (1 << 14)]
        before = before[:len(now)]
        same[at:at + len(now)] = (joined[now[:, None] + span] == joined[before[:, None] + span]).all(axis=1)
    place = first[of[order]] + within[order]
    run = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(place, run) if len(run) else place
    later = order[place != np.repeat(earliest, np.diff(np.append(run, len(order))))]
    later.sort()
    cuts = np.searchsorted(later, begin)
    return [x - b for x, b in zip(np.split(later, cuts[1:]), begin)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(starts, cut) if len(x)]


def _anchors(batch, id_at: int, length: int, gram: int, powers: Powers, keep):
    """Columns (rows, start, count, name, context, slice data) of the contexts of a
    batch's text column that ``keep(names)`` selects, slice by slice."""
    for lo, _, data, offsets in slices(batch.column(id_at), PART_BYTES):
        rows, start, count, name, context = contexts(data, offsets, length, gram, powers)
        kept = keep(name)
        rows, start = rows[kept], start[kept]
        yield lo + rows, start - offsets[rows], count[kept], name[kept], context[kept], data, start


class Job:
    """What the tasks need to know, and the schemas of what they return."""

    def __init__(self, id_type: T.DataType, length: int, gram: int):
        self.length, self.gram = length, gram
        doc = [T.StructField("doc", id_type), T.StructField("version", T.IntegerType())]
        name = [T.StructField("name", T.LongType()), T.StructField("context", T.LongType())]
        where = [*doc, T.StructField("start", T.IntegerType())]
        self.suspects = T.StructType([*name, *where, T.StructField("count", T.IntegerType())])
        self.texts = T.StructType([*name, T.StructField("bytes", T.BinaryType())])
        self.spans = T.StructType([*where, T.StructField("end", T.IntegerType())])
        self.strings = T.StructType([T.StructField("digest", T.BinaryType()), *where])

    def hashes(self, batch):
        powers = Powers()
        for part in _anchors(batch, 0, self.length, self.gram, powers, lambda n: np.ones(len(n), bool)):
            yield part[3]

    def find(self, batches, seen: np.ndarray):
        """Documents (doc, version, text): contexts whose name the filter has."""
        powers, schema = Powers(), arrow_schema(self.suspects)
        for batch in batches:
            for rows, start, count, name, context, _, _ in _anchors(
                    batch, 2, self.length, self.gram, powers, lambda n: passes(seen, n)):
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(name.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(rows),
                    batch.column(1).take(rows), pa.array(start, pa.int32()), pa.array(count, pa.int32())], schema=schema)

    def fetch(self, batches, wanted: np.ndarray):
        """Documents' texts: the bytes of contexts that the filter has, once a task."""
        powers, schema, have = Powers(), arrow_schema(self.texts), np.empty(0, np.uint64)
        for batch in batches:
            for _, _, count, name, context, data, at in _anchors(
                    batch, 0, self.length, self.gram, powers, lambda n: passes(wanted, n)):
                key = name ^ context
                new, first = np.unique(key, return_index=True)
                first = first[~np.isin(new, have)]
                have = np.concatenate([have, key[first]])[-200_000:]
                texts = [data[a:a + n + self.length - 1].tobytes() for a, n in zip(at[first], count[first])]
                yield pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)),
                                                  pa.array(context[first].view(np.int64)),
                                                  pa.array(texts, pa.binary())], schema=schema)

    def sort(self, batches):
        """Contexts (name, bytes, doc, version, start) sorted by name: spans of the
        strings that start earlier. Works in blocks of whole names."""
        schema = arrow_schema(self.spans)
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield self._sorted(held, schema)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield self._sorted(held, schema)

    def _sorted(self, held, schema):
        keys = sorted({(d is not None, d, v) for _, _, d, v, _ in held}, key=lambda x: (x[0], x[1:] if x[0] else (0, x[2])))
        rank = {k: i << 32 for i, k in enumerate(keys)}
        first = np.array([rank[d is not None, d, v] + s for _, _, d, v, s in held], np.int64)
        later = repeated_starts([r[1] for r in held], first, self.length)
        out = [(d, v, s + a, s + b + self.length) for (_, _, d, v, s), x in zip(held, later) for a, b in _runs(x)]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def spread(self, batches):
        """The same contexts as their single strings' digests and starts."""
        schema = arrow_schema(self.strings)
        for batch in batches:
            for _, text, doc, version, start in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(text) - self.length + 1
                digests = [xxhash.xxh3_128_digest(text[i:i + self.length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(digests, pa.binary()), pa.array([doc] * n, schema.field("doc").type),
                    pa.array([version] * n, pa.int32()), pa.array(range(start, start + n), pa.int32())], schema=schema)


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  gram: int = GRAM, filter_bits: int = FILTER_BITS, name_limit: int = NAME_LIMIT) -> DataFrame:
    """``(doc, version, start, end)``: byte spans to remove, which may overlap.
    ``version`` is a hash of the text that tells apart rows of one id."""
    job = Job(docs.schema[id_col].dataType, length, gram)
    source = docs.select(F.col(id_col).alias("doc"), version(text_col).alias("version"), F.col(text_col).alias("text"))
    seen = twice_seen(source.select("text"), job.hashes, filter_bits)
    suspects = written(source.mapInArrow(partial(job.find, seen=seen), job.suspects), "suspect-strings")
    del seen
    place = F.struct("doc", "version", "start")
    kinds = written(suspects.groupBy("name", "context").agg(
        F.min(place).alias("first"), F.count("*").alias("n")), "contexts")
    copies = (suspects.join(kinds.where("n > 1").select("name", "context", "first"), ["name", "context"])
              .where(~place.eqNullSafe(F.col("first")))
              .select("doc", "version", "start", (F.col("start") + F.col("count") + length - 1).alias("end")))

    several = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    names = broadcast_if_small(several, "names")  # so that all contexts need not move again

    def name_hashes(batch):
        yield np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)  # in both filters

    wanted = twice_seen(names.select("name"), name_hashes, max(512, filter_bits >> 2))
    texts = source.select("text").mapInArrow(partial(job.fetch, wanted=wanted), job.texts)
    texts = texts.groupBy("name", "context").agg(F.first("bytes").alias("bytes"))
    to_sort = written(kinds.join(names, "name").join(texts, ["name", "context"])
                      .select("name", "bytes", "first.doc", "first.version", "first.start", "kinds"), "to-sort")
    columns = ["name", "bytes", "doc", "version", "start"]
    sorted_spans = (to_sort.where(F.col("kinds") <= name_limit).select(columns).repartition("name")
                    .sortWithinPartitions("name").mapInArrow(job.sort, job.spans))
    strings = to_sort.where(F.col("kinds") > name_limit).select(columns).mapInArrow(job.spread, job.strings)
    earliest = strings.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    spread_spans = (strings.join(earliest.where("n > 1"), "digest").where(~place.eqNullSafe(F.col("first")))
                    .select("doc", "version", "start", (F.col("start") + length).alias("end")))
    return copies.unionByName(sorted_spans).unionByName(spread_spans)


def version(text_col: str):
    return F.hash(F.coalesce(text_col, F.lit("")))


def union_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that spans cover; touching spans are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    last = np.append(new[1:], len(starts)) - 1
    return [(int(a), int(b)) for a, b in zip(starts[new], ends[last])]


RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
          T.StructField("kept", T.BinaryType())]


def deduplicated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       with_bytes: bool = True, **options) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked
    for, the bytes kept (which need not be UTF-8: a span may end within a character)."""
    spans = written(removed_spans(docs, id_col=id_col, text_col=text_col, **options), "spans")
    lists = spans.groupBy(F.col("doc").alias("_doc"), F.col("version").alias("_version")).agg(
        F.collect_list(F.struct("start", "end")).alias("_spans"))
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), version(text_col).alias("version"))
    joined = source.join(lists, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(RESULT if with_bytes else RESULT[:-1])])
    arrow = arrow_schema(schema)

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, runs = (text.as_py() or "").encode(), []
                if spans.is_valid:
                    fields = spans.values
                    runs = union_of(fields.field(0).to_numpy().astype(np.int64), fields.field(1).to_numpy().astype(np.int64))
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))],
                                             schema=arrow)

    return joined.select("doc", "text", "_spans").mapInArrow(cut, schema)
