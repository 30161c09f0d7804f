"""Global prefix sums and ordinals without a single-partition window.

``row_number() over (order by ...)`` without ``partitionBy`` moves every row into one
task. Here rows are range-partitioned on the order keys; a row's sum is its running
sum within its partition plus the sums of the partitions before it, of which there is
one row per partition. Callers pass the keys and weights only: wide rows join the
result back by their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import written


def prefix_sums(df: DataFrame, order_cols: list[str], name: str = "ordinal", weight: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before this one in the order
    (without a weight the 0-based ordinal). End the order with a unique key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, so that every later read sees the same partition of every row
    ranged = written(df.repartitionByRange(n, *order_cols).withColumn("_part", F.spark_partition_id()), "ordered")
    w = F.col(weight) if weight else F.lit(1)
    before = Window.partitionBy("_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(w).over(before), F.lit(0)))
    parts = ranged.groupBy("_part").agg(F.sum(w).alias("_sum"))
    # one row per partition: a window over all of them is bounded
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_earlier") + F.col("_local")).cast("bigint")).drop("_part", "_local", "_earlier"))
