"""Small helpers of the operators: scratch tables in the shared folder, column names
that are free, and ranks within groups of any size."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.session import written  # noqa: F401  (used by the operators)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have."""
    have = {c.lower() for c in df.columns}
    return base if base not in have else f"{base}_{uuid.uuid4().hex[:8]}"


def kept_by_worker(job: str, make):
    """What ``make()`` returns, made once per Python worker and job: the tasks of one
    job that a worker runs after another share it. (Functions are pickled by value, so
    in a worker they have no module to keep it in.)"""
    held = getattr(sys, "_spanlake_kept", None)
    if held is None or held[0] != job:
        held = sys._spanlake_kept = None  # what an earlier job left goes first
        held = sys._spanlake_kept = (job, make())
    return held[1]


def forget_kept() -> None:
    """Free what an earlier job has left in this worker."""
    sys._spanlake_kept = None


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def rank_within(df: DataFrame, group: str, order: list[str], out: str, salts: int = 64) -> DataFrame:
    """Gapless ranks from 0 of the rows of each ``group``, however large a group is.

    Rows are ranked within (group, salt), the salt being a hash of the order columns,
    and shifted by the sizes of the group's earlier salts. Rows that tie in all order
    columns take their ranks in any order.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    local = salted.withColumn("_local", F.row_number().over(
        Window.partitionBy(group, "_salt").orderBy(*order)) - 1)
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (salted.groupBy(group, "_salt").count()
             .select(group, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift")))
    return (local.join(shift, [group, "_salt"])
            .withColumn(out, (F.col("_local") + F.col("_shift")).cast("long"))
            .drop("_salt", "_local", "_shift"))
