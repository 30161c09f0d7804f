"""Exact top-k search by inner product with a vector-approximation file.

Components are turned into whole numbers, the floor of ``scale`` times the component as
a double, and scores are whole numbers too. Equal vectors are one class; it keeps its
``k + 1`` first rows (by id, then row), which is all that a result can need of it, so
copies cost nothing.

The approximation file has, for each class, one cell of ``bits`` bits per dimension. A
dimension's cells are cut where its values are equally frequent, from quantiles of all
rows; the outer cells end at the least and greatest value, so a cell's bounds hold for
every vector in it. For each block of query vectors, which is broadcast:

1. The cells alone are scanned. With the middle and the radius of each cell, a query's
   score lies within ``q * middle`` plus or minus ``|q| * radius``. A vector stays if its
   upper bound reaches the ``k + 1``-th best lower bound; first within a task, which drops
   ties too if they come behind in the order of ids, then with the bound of all tasks.
2. Exact vectors are read in the order of their bounds: first the ``k + 1`` best of each
   query, whose scores give the bar; then those whose upper bound still reaches it. What
   is left can't be among the results, so they are certain.

Each query row then takes its ``k`` best rows, without itself, from the ``k + 1`` best
classes. The work is that of the query set against all rows, in blocks; what is shuffled
is the bounds and the vectors that are read.

Vectors that are null or hold a null, a NaN or an infinite component take no part, as
query or candidate. Vectors are compared to those of equal length only; an empty one
scores 0. Rows without an id are candidates, the last among ties, and queries if the
condition says so. Rows that repeat an id are rows of their own: a query row leaves out
itself alone. Whole numbers beyond 2**52, or such scores, are worked out with numbers of
any size; components and scores beyond the range of a long are given as its nearest
end. An empty table gives an empty result, a query without candidates no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, written

BITS = 6
BLOCK_BYTES = 16 << 20  # query vectors broadcast at once
ROWS_PER_TASK = 8_192  # classes that a task scans at least, if there are so many
BATCH = 4096  # classes compared at once
TILE = 512  # queries compared with a batch at once
EXACT = 1 << 52
LONG_MAX = (1 << 63) - 1


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    """The floor of ``scale`` times the values, kept within the range of a long."""
    x = np.floor(scale * values.astype(np.float64))
    out = np.clip(x, -2.0**63, np.nextafter(2.0**63, 0)).astype(np.int64)
    out[x >= 2.0**63] = LONG_MAX
    return out


def vectors(df: DataFrame, is_query: Column, *, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """_row, _id, is_query, dim, v (little-endian whole numbers) of the rows that take part."""
    source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                       F.coalesce(is_query, F.lit(False)).alias("is_query"),
                       F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    source = source.where(F.col("x").isNotNull() & finite)
    schema = T.StructType([*source.schema[:3], T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType())])
    arrow = arrow_schema(schema)

    def packed(batches):
        for batch in batches:
            x = batch.column(3)
            bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(x).to_numpy())])
            flat = whole_numbers(x.flatten().to_numpy(zero_copy_only=False), scale)
            raw = flat.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(bounds).astype(np.int32)),
                 pa.array([raw[8 * s:8 * e] for s, e in zip(bounds, bounds[1:])], pa.binary())], schema=arrow)

    return source.mapInArrow(packed, schema)


def matrix(column, dim: int) -> np.ndarray:
    """A binary column of vectors as one int64 row per vector."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


POINTS = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("point", T.LongType()),
                       T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])


def cell_bounds(base: DataFrame, dim: int, cells: int) -> np.ndarray:
    """``dim`` rows of ``cells + 1`` bounds: cell c of a dimension holds the whole numbers
    from bound c to the one before bound c + 1, the last cell its last bound too, the
    greatest value. Every batch of rows gives its own quantiles, which Spark merges, and its
    least and greatest values, which hold exactly."""
    arrow = arrow_schema(POINTS)

    def points(batches):
        for batch in batches:
            if not len(batch):
                continue
            m = np.sort(matrix(batch.column(0), dim), axis=0)
            at = np.linspace(0, len(m) - 1, min(len(m), 4 * cells + 1)).astype(int)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(dim, dtype=np.int32), n)), pa.array(m[at].T.ravel()),
                 pa.array(np.repeat(m[0], n)), pa.array(np.repeat(m[-1], n))], schema=arrow)

    shares = [c / cells for c in range(1, cells)]
    found = (base.where(F.col("dim") == dim).select("v").mapInArrow(points, POINTS)
             .groupBy("pos").agg(F.percentile_approx("point", shares, 1000).alias("inner"),
                                 F.min("low").alias("low"), F.max("high").alias("high")))
    out = np.zeros((dim, cells + 1), np.int64)
    for r in found.collect():  # dim rows of cells + 1 numbers
        out[r["pos"]] = np.sort([r["low"], *r["inner"], r["high"]])
    return out


def encode(m: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    cells = bounds.shape[1] - 1
    out = np.empty(m.shape, np.uint8)
    for j in range(m.shape[1]):
        out[:, j] = np.minimum(np.searchsorted(bounds[j, 1:-1], m[:, j], "right"), cells - 1)
    return out


def pack_cells(codes: np.ndarray, bits: int) -> list[bytes]:
    n, dim = codes.shape
    spread = np.unpackbits(codes[:, :, None], axis=2, bitorder="little")[:, :, :bits].reshape(n, dim * bits)
    packed = np.packbits(spread, axis=1, bitorder="little")
    width, raw = packed.shape[1], packed.tobytes()
    return [raw[i * width:(i + 1) * width] for i in range(n)]


def unpack_cells(column, dim: int, bits: int) -> np.ndarray:
    n = len(column)
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -(-dim * bits // 8))
    spread = np.unpackbits(packed, axis=1, count=dim * bits, bitorder="little").reshape(n, dim, bits)
    return np.packbits(spread, axis=2, bitorder="little")[:, :, 0] if dim else np.zeros((n, 0), np.uint8)


class CellSums:
    """Twice the middle and twice the radius of every cell, as numbers that the products
    with the queries can be summed in without rounding."""

    def __init__(self, queries: np.ndarray, bounds: np.ndarray):
        dim = bounds.shape[0]
        low, high = bounds[:, :-1].astype(object), bounds[:, 1:].astype(object)
        high[:, :-1] -= 1
        high = np.maximum(low, high)  # cells that no number can be in
        biggest = max([1, *map(abs, np.ravel(low).tolist()), *map(abs, np.ravel(high).tolist())])
        most = 2 * biggest * max([1, *(abs(int(x)) for x in (queries.min(), queries.max()))] if queries.size else [1]) * max(1, dim)
        self.type = np.float32 if 2 * most < 1 << 24 else np.float64 if 2 * most < EXACT else object
        self.middle, self.radius = (low + high).astype(self.type), (high - low).astype(self.type)
        self.queries = queries.astype(object).astype(self.type)
        self.sizes = abs(self.queries)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = np.arange(codes.shape[1])
        return self.middle[j, codes], self.radius[j, codes]

    def sums(self, lo: int, hi: int, middle: np.ndarray, radius: np.ndarray):
        """Twice the lower and upper bounds of the queries ``lo`` to ``hi``."""
        near, far = self.queries[lo:hi].dot(middle.T), self.sizes[lo:hi].dot(radius.T)
        low, high = near - far, near + far
        if self.type is object:  # scores are given within the range of a long
            low, high = (np.clip(x, -2 * LONG_MAX - 2, 2 * LONG_MAX) for x in (low, high))
        return low, high


def saturated(values) -> np.ndarray:
    """Numbers of any size as longs, those beyond as the nearest end."""
    a = np.asarray(values)
    if a.dtype != object:
        return a.astype(np.int64)
    return np.array([max(-LONG_MAX - 1, min(LONG_MAX, int(x))) for x in a.ravel()], np.int64).reshape(a.shape)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if max(abs(int(q.min())), abs(int(q.max()))) * max(abs(int(v.min())), abs(int(v.max()))) * q.shape[1] < 1 << 62:
        return (q * v).sum(axis=1)
    return saturated((q.astype(object) * v.astype(object)).sum(axis=1))


BOUNDS = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("class", T.LongType()),
                       T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])


class Bars:
    """The ``keep`` best lower bounds of each query that a task has seen, ascending."""

    def __init__(self, n: int, keep: int):
        self.best = [None] * n
        self.keep = keep

    def stays(self, i: int, low: np.ndarray, high: np.ndarray, behind: bool) -> np.ndarray:
        """Take in a tile's bounds; which of its vectors may be among the best. If they
        all come ``behind`` those seen, ties don't."""
        seen = self.best[i]
        if seen is not None and seen.shape[1] == self.keep:
            able = high > seen[:, :1] if behind else high >= seen[:, :1]
            better = np.flatnonzero((low > seen[:, :1]).any(axis=1))
            if len(better):
                seen[better] = self._last(np.concatenate([seen[better], low[better]], axis=1))
        else:
            able = np.ones(low.shape, bool)
            self.best[i] = seen = self._last(low if seen is None else np.concatenate([seen, low], axis=1))
        return able & (high >= seen[:, :1]) if seen.shape[1] == self.keep else able

    def _last(self, bounds: np.ndarray) -> np.ndarray:
        if bounds.shape[1] > self.keep and bounds.dtype != object:
            bounds = np.partition(bounds, bounds.shape[1] - self.keep, axis=1)[:, -self.keep:]
        return np.sort(bounds, axis=1)[:, -self.keep:]


def scan(file: DataFrame, held, dim: int, bits: int, keep: int) -> DataFrame:
    """q, class, low, high (the bounds of the score) of what can be among the ``keep``
    best as far as a task knows. ``held`` is the broadcast (queries, bounds)."""
    arrow = arrow_schema(BOUNDS)

    def bound(batches):
        queries, bounds = held.value
        cells = CellSums(queries, bounds)
        bars, last = Bars(-(-len(queries) // TILE), keep), -1
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                classes = part.column(0).to_numpy()
                behind = int(classes.min()) > last
                last = max(last, int(classes.max()))
                middle, radius = cells.of(unpack_cells(part.column(1), dim, bits))
                out = []
                for lo in range(0, len(queries), TILE):
                    low, high = cells.sums(lo, min(lo + TILE, len(queries)), middle, radius)
                    q, c = np.nonzero(bars.stays(lo // TILE, low, high, behind))
                    out.append((q + lo, classes[c], saturated(-(-low[q, c] // 2)), saturated(high[q, c] // 2)))
                q, c, low, high = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(c), pa.array(low), pa.array(high)],
                                                 schema=arrow)

    return file.select("class", "cells").mapInArrow(bound, BOUNDS)


def read_exact(pairs: DataFrame, file: DataFrame, held, dim: int) -> DataFrame:
    """q, class, members and the exact score of (q, class) pairs."""
    joined = pairs.select("q", "class").join(file.select("class", "v", "members"), "class")
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("class", T.LongType()),
                           file.schema["members"], T.StructField("score", T.LongType())])
    arrow = arrow_schema(schema)

    def score(batches):
        queries, _ = held.value
        for batch in batches:
            got = exact_scores(queries[batch.column(0).to_numpy()], matrix(batch.column(2), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(got)], schema=arrow)

    return joined.select("q", "class", "v", "members").mapInArrow(score, schema)


def approximation_file(base: DataFrame, dim: int, k: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """class, members, v and cells of the vectors of one length, and the cells' bounds.
    Classes are numbered in the order of their first rows."""
    bounds = cell_bounds(base, dim, 1 << bits)
    order = Window.partitionBy("v").orderBy(F.col("_id").asc_nulls_last(), "_row")
    first = (base.where(F.col("dim") == dim).select("v", "_id", "_row").withColumn("_n", F.row_number().over(order))
             .where(F.col("_n") <= k + 1))
    member = F.struct("_n", F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    classes = first.groupBy("v").agg(F.sort_array(F.collect_list(member)).alias("members"))
    tasks = max(1, math.ceil(base.count() / ROWS_PER_TASK))
    head = [F.col("members")[0][c] for c in ("no_id", "id", "row")]
    source = (classes.repartitionByRange(tasks, *head).sortWithinPartitions(*head)
              .select(F.monotonically_increasing_id().alias("class"), "members", "v"))
    schema = T.StructType([*source.schema, T.StructField("cells", T.BinaryType())])
    arrow = arrow_schema(schema)

    def coded(batches):
        for batch in batches:
            codes = encode(matrix(batch.column(2), dim), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack_cells(codes, bits), pa.binary())], schema=arrow)

    return written(source.mapInArrow(coded, schema), "va-file"), bounds


def by_rank(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order)))


def search_block(file: DataFrame, bounds: np.ndarray, block: DataFrame, dim: int, k: int, bits: int) -> DataFrame:
    """v (the query's) and its best classes as one array, of a block of distinct queries."""
    keep = k + 1
    queries = matrix(block.select("v").toArrow().column(0), dim)
    held = file.sparkSession.sparkContext.broadcast((queries, bounds))
    found = written(scan(file, held, dim, bits, keep), "va-bounds")
    bar = (by_rank(found.select("q", "low"), F.col("low").desc()).where(F.col("_n") <= keep)
           .groupBy("q").agg(F.min("low").alias("_bar"), F.count("*").alias("_have")))
    left = found.join(bar, "q").where((F.col("_have") < keep) | (F.col("high") >= F.col("_bar")))
    left = written(by_rank(left.select("q", "class", "high"), F.col("high").desc(), "class"), "va-candidates")
    first = written(read_exact(left.where(F.col("_n") <= keep), file, held, dim), "va-first")
    reached = first.groupBy("q").agg(F.min("score").alias("_bar"))
    rest = left.where(F.col("_n") > keep).join(reached, "q").where(F.col("high") >= F.col("_bar"))
    best = by_rank(first.unionByName(read_exact(rest, file, held, dim)), F.col("score").desc(), "class").where(F.col("_n") <= keep)
    lists = best.groupBy("q").agg(F.collect_list(F.struct("score", "members")).alias("best"))
    schema = T.StructType([T.StructField("v", T.BinaryType()), lists.schema["best"]])
    arrow = arrow_schema(schema)

    def named(batches):
        for batch in batches:
            raw = [held.value[0][q].tobytes() for q in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1)], schema=arrow)

    out = written(lists.select("q", "best").mapInArrow(named, schema), "va-best")
    held.destroy()
    return out


def exact_top_k(df: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: float = 256, bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), the found row's id (``id_col``) and score of the ``k``
    best rows for each row that ``is_query`` names."""
    base = written(vectors(df, is_query, id_col=id_col, vector_col=vector_col, scale=scale), "vectors")
    dims = [r["dim"] for r in base.where("is_query").groupBy("dim").count().collect()]  # lengths of vectors: few
    parts = []
    for dim in sorted(dims):
        file, bounds = approximation_file(base, dim, k, bits)
        asked = written(base.where((F.col("dim") == dim) & F.col("is_query")).select("v").distinct(), "va-queries")
        blocks = max(1, math.ceil(asked.count() * 8 * max(1, dim) / block_bytes))
        asked = asked.withColumn("_block", F.pmod(F.xxhash64("v"), F.lit(blocks)))
        parts += [search_block(file, bounds, asked.where(F.col("_block") == b), dim, k, bits) for b in range(blocks)]
    schema = f"query_id {base.schema['_id'].dataType.simpleString()}, rank int, {id_col} " \
             f"{base.schema['_id'].dataType.simpleString()}, score long"
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.unionByName(p)
    # the rows of all best classes but the query's own, best first
    rows = F.flatten(F.transform("best", lambda b: F.transform(b["members"], lambda m: F.struct(
        (-b["score"].cast("decimal(38,0)")).alias("down"), m["no_id"].alias("no_id"), m["id"].alias("id"), m["row"].alias("row"),
        b["score"].alias("score")))))
    lists = lists.select("v", rows.alias("rows"))
    joined = base.where("is_query").select("_row", "_id", "v").join(lists, "v")
    best = F.slice(F.array_sort(F.filter("rows", lambda r: r["row"] != F.col("_row"))), 1, k)
    return (joined.select("_id", F.posexplode(best).alias("n", "r"))
            .select(F.col("_id").alias("query_id"), (F.col("n") + 1).cast("int").alias("rank"),
                    F.col("r")["id"].alias(id_col), F.col("r")["score"].alias("score")))
