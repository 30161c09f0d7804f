"""SimHash near-duplicate detection.

A text's fingerprint has 64 bits; a bit is set if over half of its shingles' XXH64
hashes (seed 42) have it. Shingles are ``shingle`` consecutive words (split at ASCII
white space, A-Z lower-cased) joined by a space, repeats included; a text of fewer
words is one shingle, and null or blank texts have the fingerprint zero, which links
like any other.

Links join fingerprints at ``max_bits`` or fewer differing bits. The work is done on
distinct fingerprints: the 64 bits are split into ``blocks`` blocks, and since a close
pair differs in at most ``max_bits`` blocks it agrees on some ``blocks - max_bits`` of
them. Each fingerprint is keyed by every such choice, rows with a key meet, and the
Hamming distance of those that meet is verified. Six blocks give 20 keys of 32 bits,
so a key's rows stay few at billions of documents.

From the rows of a key only a spanning forest of its links is emitted, never all
pairs. A key with over ``run_limit`` fingerprints is split into chunks, and each pair
of chunks is one bounded piece of work: no link is lost and no task holds the whole.

A component's id is the smallest id in it; null ids count for nothing there, so a
component without ids has the id null. Repeated rows share a fingerprint. Only the id
and text columns are read; :func:`deduplicate` carries all others along.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.components import components
from spanlake.llm.shared import arrow_schema, free_name, written
from spanlake.llm.textarrays import LOWER

LOWER_TABLE = LOWER.tobytes()
RUN_LIMIT = 4096
FEW = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k = min(shingle, len(words))
    starts = [0, *ends[:len(words) - k]]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e - 1], 42) for s, e in zip(starts, ends[k - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """``(id, fingerprint)`` per document, the fingerprint as a long."""
    source = docs.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType),
                           T.StructField("fingerprint", T.LongType())])
    arrow = arrow_schema(schema)

    def of(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], schema=arrow)

    return source.mapInArrow(of, schema)


def _masks(blocks: int, max_bits: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks - max_bits blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, blocks - max_bits)]


def _forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as stars."""
    rest, roots, others = prints, [], []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= max_bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                roots.append(np.full(len(found), root))
                others.append(found)
                queue.extend(found)
    if not roots:
        return prints[:0], prints[:0]
    return np.concatenate(roots), np.concatenate(others)


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                      T.StructField("chunk", T.IntegerType())])


def _link_runs(batches, max_bits: int, run_limit: int, schema: pa.Schema):
    """Rows (key, fingerprint) sorted by key: links within each run of a key; the rows
    of a longer run come out as (key, fingerprint, chunk) instead."""
    def out(a, b, chunk=None):
        a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
        kind = pa.nulls(len(a), pa.int32()) if chunk is None else pa.array(chunk, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), kind], schema=schema)

    def links(keys, prints):
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([begin, [len(keys)]]))
        few = np.repeat(size <= FEW, size)
        at = np.flatnonzero(few)
        for d in range(1, FEW):  # short runs: all at once, by distance in the run
            at = at[at + d < len(keys)]
            at = at[keys[at] == keys[at + d]]
            if not len(at):
                break
            near = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= max_bits]
            if len(near):
                yield out(prints[near], prints[near + d])
        for i in np.flatnonzero(size > FEW):
            a, b = _forest(prints[begin[i]:begin[i] + size[i]], max_bits)
            if len(a):
                yield out(a, b)

    held_k = held_p = np.empty(0, np.uint64)
    long_key, done = None, 0  # the key of a run over the limit, and its rows so far
    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy().view(np.uint64)])
        prints = np.concatenate([held_p, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
        if long_key is not None:
            n = int(np.searchsorted(keys.view(np.int64), long_key.view(np.int64), "right"))
            if n:
                yield out(keys[:n], prints[:n], (done + np.arange(n)) // run_limit)
            done += n
            keys, prints, cut = keys[n:], prints[n:], max(0, cut - n)
            if len(keys):
                long_key = None
        if cut:
            yield from _split(keys[:cut], prints[:cut], run_limit, out, links)
        held_k, held_p = keys[cut:], prints[cut:]
        if len(held_k) > run_limit:
            yield out(held_k, held_p, np.arange(len(held_k)) // run_limit)
            long_key, done = held_k[0], len(held_k)
            held_k = held_p = np.empty(0, np.uint64)
    if len(held_k):
        yield from links(held_k, held_p)


def _split(keys, prints, run_limit, out, links):
    """Whole runs: those over the limit come out as rows, the rest as links."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([begin, [len(keys)]]))
    for i in np.flatnonzero(size > run_limit):
        rows = slice(begin[i], begin[i] + size[i])
        yield out(keys[rows], prints[rows], np.arange(size[i]) // run_limit)
    short = np.repeat(size <= run_limit, size)
    if short.any():
        yield from links(keys[short], prints[short])


def links(prints: DataFrame, *, max_bits: int = 3, blocks: int = 6,
          run_limit: int = RUN_LIMIT) -> DataFrame:
    """Pairs ``(a, b)`` from a column ``fingerprint`` of distinct values. Each pair is
    linked, directly or through other fingerprints of a key they share, and the pairs
    connect all that is linked."""
    masks = _masks(blocks, max_bits)
    keyed = prints.select("fingerprint", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"))
    work = partial(_link_runs, max_bits=max_bits, run_limit=run_limit, schema=arrow_schema(LINKS))
    found = written(keyed.select("key", "fingerprint").repartition("key")
                    .sortWithinPartitions("key", "fingerprint").mapInArrow(work, LINKS), "simhash-links")
    hot = found.where("chunk is not null")
    chunks = hot.groupBy("a").agg((F.max("chunk") + 1).alias("n"))
    cells = (hot.join(chunks, "a")
             .select("b", "a", "chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
             .where("other != chunk")
             .select(F.xxhash64("a", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"),
                     F.col("b").alias("fingerprint")))
    cell_work = partial(_link_runs, max_bits=max_bits, run_limit=1 << 62, schema=arrow_schema(LINKS))
    more = cells.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(cell_work, LINKS)
    return found.where("chunk is null").unionByName(more).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3, blocks: int = 6,
                    run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row per document: id, fingerprint (long) and component_id, the smallest id
    that links reach."""
    of = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    least = written(of.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "simhash-distinct")
    found = components(links(least.select("fingerprint"), max_bits=max_bits, blocks=blocks,
                             run_limit=run_limit))
    grouped = (least.join(found, least["fingerprint"] == found["node"], "left")
               .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return (of.join(grouped.join(lowest, "root").select("fingerprint", "component_id"), "fingerprint")
            .select(id_col, "fingerprint", "component_id"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, columns as they came: that of the smallest id (rows
    without an id last), of several such rows the one whose text's hashes are smallest.
    So a component is never lost to another row of its id, and copies without ids go."""
    key, nth = free_name(docs, "_key"), free_name(docs, "_nth")
    of_row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                      F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g"))
    keyed = docs.withColumn(key, of_row)
    keep = (near_duplicates(keyed, id_col=key, text_col=text_col, **options)
            .select(F.col("component_id").alias("_kept")).distinct())
    # joined and numbered by the same key, so that texts are shuffled once
    first = Window.partitionBy(key).orderBy(F.lit(0))
    return (keyed.join(keep, keyed[key] == keep["_kept"], "left_semi")
            .withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns))
