"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Documents with equal texts are one indivisible group. Differencing keeps partial
partitions, each a vector of one sum per shard, and repeatedly combines the two with
the largest spread, oppositely ordered, so their differences cancel. A partial
partition is again an item that can be combined, so the work is a tree: groups are
dealt into buckets of about ``fan`` groups, each bucket is differenced by a task into
one partial partition, and these are the items of the next level, until one bucket is
left, which the driver differences (at most ``fan`` vectors). A group's shard follows
from the slots it and its buckets were given.

A text's bytes and its group are known before anything is shuffled, and groups are
sums of partial aggregates, so a text that a third of all documents share costs no
task more. Slots are ranks within a shard from salted counts. Null texts have size 1
and group with empty ones; repeated rows stand side by side. Only the id and text
columns are read.
"""

from __future__ import annotations

import heapq
from functools import partial
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, rank_within, written

SHARDS = 16
FAN = 20_000


def difference(items: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Difference vectors of sums. Returns the result's sums and, for each item, the
    result's slot of each of its slots (an item's empty slots go wherever is left)."""
    order = count()
    left, right = [], []  # nodes beyond the leaves; a leaf is (item, slot)
    leaves = [(i, s) for i, v in enumerate(items) for s in range(shards) if s < len(v) and v[s]]

    def join(a, b):
        if a is None or b is None:
            return a if b is None else b
        left.append(a)
        right.append(b)
        return len(leaves) + len(left) - 1

    heap, at = [], 0
    for v in items:
        vector = []
        for s in range(shards):
            if s < len(v) and v[s]:
                vector.append((v[s], at))
                at += 1
            else:
                vector.append((0, None))
        vector.sort(key=lambda x: -x[0])
        heap.append((vector[-1][0] - vector[0][0], next(order), vector))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x[0] + y[0], join(x[1], y[1])) for x, y in zip(a, reversed(b))]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], next(order), both))
    slots = [[-1] * shards for _ in items]
    final = heap[0][2] if heap else []
    for slot, (_, node) in enumerate(final):
        stack = [] if node is None else [node]
        while stack:
            x = stack.pop()
            if x < len(leaves):
                i, s = leaves[x]
                slots[i][s] = slot
            else:
                stack += (left[x - len(leaves)], right[x - len(leaves)])
    for own in slots:  # slots without bytes
        free = iter(sorted(set(range(shards)) - set(own)))
        own[:] = [s if s >= 0 else next(free) for s in own]
    return [x[0] for x in final], slots


DEALT = T.StructType([T.StructField("item", T.StringType()), T.StructField("bucket", T.StringType()),
                      T.StructField("slots", T.ArrayType(T.IntegerType())),
                      T.StructField("sums", T.ArrayType(T.LongType()))])


def _difference_buckets(batches, shards: int, schema: pa.Schema):
    """Rows (bucket, item, sums): a row per item with its slots, and one per bucket
    with its sums."""
    buckets: dict[str, list] = {}
    for batch in batches:
        for b, i, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
            buckets.setdefault(b, []).append((i, v))
    for b, rows in buckets.items():
        rows.sort(key=lambda x: (sorted(x[1], reverse=True), x[0]))
        sums, slots = difference([v for _, v in rows], shards)
        n = len(rows)
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows] + [None], pa.string()), pa.array([b] * (n + 1), pa.string()),
            pa.array([*slots, None], pa.list_(pa.int32())), pa.array([None] * n + [sums], pa.list_(pa.int64()))],
            schema=schema)


def deal(items: DataFrame, *, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """``(item, slots)`` for a frame ``(item string, sums array<long>)`` of distinct
    items: the shard of each of an item's slots."""
    n = items.count()
    if n <= fan:
        rows = sorted((r["item"], list(r["sums"])) for r in items.select("item", "sums").collect())
        rows.sort(key=lambda x: (sorted(x[1], reverse=True), x[0]))
        _, slots = difference([v for _, v in rows], shards)
        schema = T.StructType([DEALT["item"], DEALT["slots"]])
        return items.sparkSession.createDataFrame([(i, s) for (i, _), s in zip(rows, slots)], schema)
    buckets = -(-n // fan)
    keyed = items.select(F.pmod(F.xxhash64("item", F.lit(n)), F.lit(buckets)).cast("string").alias("bucket"), "item", "sums")
    done = written(keyed.repartition(buckets, "bucket").mapInArrow(
        partial(_difference_buckets, shards=shards, schema=arrow_schema(DEALT)), DEALT), "shards")
    above = deal(done.where("item is null").select(F.col("bucket").alias("item"), "sums"), shards=shards, fan=fan)
    above = above.select(F.col("item").alias("bucket"), F.col("slots").alias("to"))
    return (done.where("item is not null").join(above, "bucket")
            .select("item", F.transform("slots", lambda s: F.col("to")[s]).alias("slots")))


def shard_by_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 1), text_crc32,
    text_md5, shard and slot (gapless from 0 within the shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = written(docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5")), "sizes")
    groups = written(of.groupBy("text_md5").agg(F.sum("size").alias("bytes")), "groups")
    dealt = deal(groups.select(F.col("text_md5").alias("item"), F.array("bytes").alias("sums")), shards=shards, fan=fan)
    placed = of.join(dealt.select(F.col("item").alias("text_md5"), F.col("slots")[0].alias("shard")), "text_md5")
    return (rank_within(placed, "shard", [id_col, "text_md5"], "slot")
            .select(id_col, "size", "text_crc32", "text_md5", "shard", "slot"))
