"""Two Bloom filters over 64-bit hashes: those seen once and those seen twice.

Every task marks its hashes in both filters. The filters are cut into segments, which
are shuffled by segment and folded one after another: a bit is seen twice if a task
says so or two tasks have it. Hashes that occur twice always pass the twice-seen
filter; others pass it seldom, or more often if there are far more hashes than bits,
so what passes must be confirmed exactly. The filter's size is fixed, which bounds its
broadcast.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema

SEGMENT_BYTES = 1 << 17
FILTERS = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("once", T.BinaryType()),
                        T.StructField("twice", T.BinaryType())])


def _bits(hashes: np.ndarray, filter_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Byte and mask of each hash's two bits."""
    m = np.uint64(filter_bits)
    out = []
    for x in (hashes, (hashes >> np.uint64(20)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(3)):
        bit = x % m
        out.append(((bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)))
    return out


def passes(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in the filter."""
    (a, x), (b, y) = _bits(hashes, 8 * len(filter_bytes))
    return ((filter_bytes[a] & x) != 0) & ((filter_bytes[b] & y) != 0)


def _mark(batches, hashes_of, filter_bits: int, schema: pa.Schema):
    once, twice = np.zeros(filter_bits // 8, np.uint8), np.zeros(filter_bits // 8, np.uint8)
    for batch in batches:
        for hashes in hashes_of(batch):
            kinds, counts = np.unique(hashes, return_counts=True)
            again = (counts > 1) | passes(once, kinds)
            for at, mask in _bits(kinds, filter_bits):
                np.bitwise_or.at(twice, at[again], mask[again])
                np.bitwise_or.at(once, at, mask)
    for k, at in enumerate(range(0, len(once), SEGMENT_BYTES)):
        part = once[at:at + SEGMENT_BYTES]
        if part.any():
            yield pa.RecordBatch.from_arrays([
                pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                pa.array([twice[at:at + SEGMENT_BYTES].tobytes()], pa.binary())], schema=schema)


def _fold(batches, schema: pa.Schema):
    """Tasks' segments, in any order, into one per segment."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, o, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            o, t = np.frombuffer(o.as_py(), np.uint8), np.frombuffer(t.as_py(), np.uint8)
            if k in held:
                once, twice = held[k]
                held[k] = once | o, twice | t | (once & o)
            else:
                held[k] = o, t
    for k, (once, twice) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once.tobytes()], pa.binary()),
                                          pa.array([twice.tobytes()], pa.binary())], schema=schema)


def twice_seen(df: DataFrame, hashes_of, filter_bits: int) -> np.ndarray:
    """The twice-seen filter (``filter_bits`` / 8 bytes) of all hashes that
    ``hashes_of(batch)`` yields, as uint64 arrays, over the frame's Arrow batches."""
    schema = arrow_schema(FILTERS)
    marked = df.mapInArrow(partial(_mark, hashes_of=hashes_of, filter_bits=filter_bits, schema=schema), FILTERS)
    folded = marked.repartition("segment").mapInArrow(partial(_fold, schema=schema), FILTERS)
    out = np.zeros(filter_bits // 8, np.uint8)
    for r in folded.select("segment", "twice").collect():  # filter_bits / 8 bytes in all
        part = np.frombuffer(r["twice"], np.uint8)
        out[r["segment"] * SEGMENT_BYTES:][:len(part)] = part
    return out
