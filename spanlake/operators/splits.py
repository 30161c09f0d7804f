"""Reproducible splits and folds (K1-K4).

Fold order is a seeded hash of the key (``md5(seed:id)``), so it is stable across
runs and engines. A row's position in that order is its rank within the rows that
share the hash's first digits, plus the number of rows with smaller ones: the hash
spreads keys evenly, so no bucket is large and nothing but counts is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def union_splits(*parts: DataFrame) -> DataFrame:
    """K1: concatenate datasets (by column name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


BUCKET_DIGITS = 4  # hex digits of the hash that name a bucket


def assign_folds(df: DataFrame, k: int = 5, seed: int = 10, key: str = "id") -> DataFrame:
    """K2: ``fold`` in ``0..k-1``; shuffled by the seeded hash; sizes differ by at
    most one, the bigger folds first (``ntile`` semantics)."""
    h = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substr("_h", F.lit(1), F.lit(BUCKET_DIGITS)))
    counts = h.groupBy("_b").agg(F.count("*").alias("_c"))
    # at most 16 ** BUCKET_DIGITS rows: the windows over all of them are bounded
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy()).alias("_n"))
    local = h.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    r = local.join(F.broadcast(offsets), "_b").withColumn("_r", F.col("_r") + F.col("_off"))
    n, rr = F.col("_n"), F.col("_r")
    q = F.floor(n / k)
    m = n - q * k
    fold = F.when(rr < m * (q + 1), F.floor(rr / (q + 1))).otherwise(F.floor((rr - m) / q))
    return r.withColumn("fold", fold.cast("int")).drop("_h", "_b", "_r", "_n", "_off")


def write_folds(folded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The rows once, in a folder per fold."""
    folded.write.mode(mode).partitionBy("fold").parquet(path)


def fold_part(spark: SparkSession, path: str, split_index: int, part: str) -> DataFrame:
    """K3: the part of split ``split_index`` from stored folds: ``validation`` is the
    fold itself, ``train`` all others. Only the part's folders are read."""
    rows = spark.read.parquet(path)
    own = F.col("fold") == split_index
    return rows.where(own if part == "validation" else ~own)


HASH_BITS = 60  # of the seeded hash, as a number


def hash_number(key: str, seed: int) -> Column:
    """The first 15 hex digits of the seeded hash as a bigint in ``[0, 2**60)``."""
    return F.conv(F.substr(seeded_hash(key, seed), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("bigint")


def seeded_sample(df: DataFrame, fraction: float, seed: int = 42, key: str = "id") -> DataFrame:
    """K4: keep a row when its seeded hash, as a share of the hash range, falls under
    ``fraction``; the same seed always keeps the same rows. 1 or more keeps all rows."""
    if fraction >= 1:
        return df
    return df.where(hash_number(key, seed) < F.lit(int(max(0.0, fraction) * 2 ** HASH_BITS)))
