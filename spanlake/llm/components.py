"""Connected components of an edge table by alternating large-star and small-star
steps (Kiveris et al., 2014): every step is a grouped minimum and a join, and no
group of neighbours is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_steps: int = 100) -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the component's
    smallest node. Loops, repeated and reversed edges change nothing."""
    stars = written(edges.where(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "stars")
    seen = _signature(stars)
    for _ in range(max_steps):
        if not seen[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = (large.join(low, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = written(moved.unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars")
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(stars: DataFrame):
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
