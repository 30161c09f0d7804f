"""Arrow batches worked on in slices.

A batch of Spark's holds up to 10,000 rows, whose tokens as Python objects take many times
the bytes of their texts. Work on a slice leaves Arrow arrays only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import ship_package

SLICE_BYTES = 1 << 19


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a text array, at least one, of about ``most`` bytes or one row."""
    if not len(texts):
        yield texts
        return
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
    for start, end in zip(cuts, cuts[1:]):
        yield texts.slice(start, end - start)


def sliced(texts: pa.Array, beside: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The slices of a text array, each with its rows of another array."""
    at = 0
    for part in slices(texts):
        yield part, beside.slice(at, len(part))
        at += len(part)


def in_slices(given: Column, kind: str, start: Callable[[], Callable[[pa.Array], pa.Array]],
              cuts: Callable[[pa.Array], Iterator[pa.Array]]) -> Column:
    """A column of type ``kind`` by the function that ``start()`` makes once per task. Each
    slice's result leaves the worker before the next slice is begun."""
    ship_package(SparkSession.active())

    @F.arrow_udf(kind)
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = start()
        for batch in batches:
            for part in cuts(batch):
                yield of(part)
    return work(given)


def _rows(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of structs of texts, of about ``SLICE_BYTES`` bytes or one row."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts.flatten())
    before = np.cumsum(size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
    for at, end in zip(cuts, cuts[1:]):
        yield texts.slice(at, end - at)


def with_made(df: DataFrame, columns: dict[str, str], kind: str, start: Callable[[], Callable[[list], pa.Array]]) -> DataFrame:
    """Add ``columns[c]``, of type ``kind``, made of text column ``c`` by the function that
    ``start()`` makes once per task; one Python worker of a task makes all of them."""
    names = list(columns.values())

    def begin():
        of = start()
        return lambda part: pa.StructArray.from_arrays([of(c.to_pylist()) for c in part.flatten()], names=names)
    given = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    made = in_slices(given, f"struct<{','.join(f'{name}:{kind}' for name in names)}>", begin, _rows)
    return df.withColumn("_made", made).withColumns({name: F.col(f"_made.{name}") for name in names}).drop("_made")
