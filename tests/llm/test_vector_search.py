"""Exact top-k search against all pairs of whole numbers of any size."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.llm.vector_search import encode, exact_top_k, pack_cells, unpack_cells, whole_numbers

LONG = (1 << 63) - 1


def plain(rows, is_query, k=5, scale=256):
    """rows: (vec_id, vector); a row is its place in the list."""
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [max(-LONG - 1, min(LONG, math.floor(scale * x))) for x in v]
    ints = [whole(v) for _, v in rows]
    out = []
    for i, (qid, _) in enumerate(rows):
        if ints[i] is None or not is_query(qid):
            continue
        found = []
        for j, (vid, _) in enumerate(rows):
            if j != i and ints[j] is not None and len(ints[j]) == len(ints[i]):
                score = sum(a * b for a, b in zip(ints[i], ints[j]))
                found.append((-max(-LONG - 1, min(LONG, score)), vid is None, vid if vid is not None else 0))
        out += [(qid, n, None if none else vid, -down) for n, (down, none, vid) in enumerate(sorted(found)[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(3)


def compared(spark, rows, condition="vec_id % 50 = 0", is_query=lambda i: i is not None and i % 50 == 0, **kw):
    got = exact_top_k(table(spark, rows), F.expr(condition), **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, is_query, kw.get("k", 5)), key=key)


def random_rows(n, dim, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_random_vectors(spark, bits):
    compared(spark, random_rows(700, 16, bits), bits=bits)


def test_ties_copies_nulls_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.25, 1.0]) for i in range(200, 300)]  # a third are copies
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (550, [float("inf"), 0.0, 0.0, 0.0]),
             (600, []), (601, []), (650, [1.0]), (700, [0.0] * 4), (None, [1.0, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]),
             (50, [1.0, 0.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0, 0.0]), (0, [0.0, 0.0, 0.0, 0.0])]
    compared(spark, rows)
    compared(spark, rows, k=1)


def test_rows_without_an_id_may_be_queries(spark):
    rows = [(None, [1.0, 0.5]), (1, [1.0, 0.5]), (None, [1.0, 0.5]), (2, [0.0, 1.0])]
    compared(spark, rows, "vec_id is null", lambda i: i is None, k=3)


def test_several_blocks_of_queries(spark):
    compared(spark, random_rows(400, 8, 9), "vec_id % 3 = 0", lambda i: i % 3 == 0, block_bytes=2000, k=4)


def test_numbers_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e12, -3e11, 7.5, 0.0, 2.0**40]) for _ in range(3)]) for i in range(120)]
    compared(spark, rows)
    rows = [(i, [rng.choice([1e30, -1e300, 1e17, 5.0]) for _ in range(3)]) for i in range(120)]
    compared(spark, rows)


def test_one_large_component_among_small_ones(spark):
    rows = random_rows(300, 8, 5) + [(1000, [1e9] * 8), (1001, [-1e9, 0.1] + [0.0] * 6)]
    compared(spark, rows)


def test_empty_and_single(spark):
    compared(spark, [])
    compared(spark, [(0, [1.0, 2.0])])
    compared(spark, [(1, [1.0, 2.0]), (2, [0.0, 1.0])])
    compared(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])


def test_cells_hold_their_numbers():
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 50, (500, 5))
    bounds = np.sort(np.quantile(m, np.linspace(0, 1, 9), axis=0).astype(int).T, axis=1)
    codes = encode(m, bounds)
    for j in range(5):
        assert (bounds[j, codes[:, j]] <= m[:, j]).all() and (m[:, j] <= bounds[j, codes[:, j] + 1]).all()
    for bits in (3, 5, 8):
        assert (unpack_cells(pa.array(pack_cells(codes, bits), pa.binary()), 5, bits) == codes).all()


def test_whole_numbers_are_floors():
    assert whole_numbers(np.array([0.1, -0.1, 0.0, 1e300, -1e300, -1 / 256]), 256).tolist() == [25, -26, 0, LONG, -LONG - 1, -1]
