"""Parameter grid and best-setting selection.

A grid is not materialised by crossing lists: a setting id is decoded into its
parameter values by mixed-radix arithmetic, so any set of ids (a range, or the
ids named by a results table) maps to settings row-locally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.evaluate import metric_key

# The reference's sweep grid, in its order.
SWEEP_GRID = {
    "learning_rate": [1e-5, 2e-5, 3e-5, 4e-5, 5e-5],
    "num_train_epochs": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    "weight_decay": [0.01, 0.009, 0.008, 0.007, 0.006, 0.005, 0.004, 0.003, 0.002, 0.001],
    "pad_to_max_length": [True, False],
    "max_answer_length": [30, 40, 50, 60, 70, 80, 84],
    "max_seq_length": [200, 250, 300, 384, 400, 500, 512],
    "dropout": [0.0, 0.1, 0.2],
}


def grid_size(grid: dict = SWEEP_GRID) -> int:
    n = 1
    for v in grid.values():
        n *= len(v)
    return n


def decode_settings(df: DataFrame, id_col: str = "setting_id", grid: dict = SWEEP_GRID) -> DataFrame:
    """G1: add one column per parameter; the last parameter varies fastest."""
    names = list(grid)
    stride = 1
    strides = {}
    for name in reversed(names):
        strides[name] = stride
        stride *= len(grid[name])
    cols = {}
    for name in names:
        values = F.array(*[F.lit(v) for v in grid[name]])
        idx = F.expr(f"`{id_col}` div {strides[name]} % {len(grid[name])}").cast("int")
        cols[name] = F.get(values, idx)
    return df.withColumns(cols)


def full_grid(spark, grid: dict = SWEEP_GRID) -> DataFrame:
    """All settings: ``spark.range`` over the grid size, decoded in place."""
    return decode_settings(spark.range(grid_size(grid)).withColumnRenamed("id", "setting_id"), grid=grid)


def grid_results(spark, results: DataFrame, metric: str = "metric", id_col: str = "setting_id",
                 grid: dict = SWEEP_GRID) -> DataFrame:
    """Every setting of the grid with the number of its runs and its best (largest) and
    mean metric; a setting that was never run has 0 runs and null metrics."""
    m = F.col(metric).cast("double")
    m = F.when(~F.isnan(m), m)
    runs = results.groupBy(id_col).agg(F.count("*").alias("runs"), F.max(m).alias("best_metric"),
                                       F.avg(m).alias("mean_metric"))
    return (full_grid(spark, grid).join(runs.withColumnRenamed(id_col, "setting_id"), "setting_id", "left")
            .withColumn("runs", F.coalesce("runs", F.lit(0).cast("bigint"))))


def best_setting(results: DataFrame, metric: str = "metric", group: str | None = None,
                 maximize: bool = True, id_col: str = "setting_id") -> DataFrame:
    """The setting with the best metric (per ``group`` if given); direction is
    explicit; ties -> lowest setting id; NaN metrics are never the best."""
    best = F.max_by(F.struct(id_col, metric), metric_key(metric, maximize, id_col)).alias("b")
    g = results.groupBy(group) if group else results.groupBy()
    out = g.agg(best)
    keep = [group] if group else []
    return out.select(*keep, F.col(f"b.{id_col}").alias(id_col), F.col(f"b.{metric}").alias(metric))
