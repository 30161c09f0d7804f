"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.session import written

# Largest side (bytes of its values) that may be broadcast. A side is broadcast only
# after its size has been checked against this bound; above it the join shuffles and
# adaptive execution handles skewed keys.
MAX_BROADCAST_BYTES = 32 << 20
NESTED = (T.ArrayType, T.MapType, T.StructType)


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of the values, by one partially aggregated pass."""
    width = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("bigint") if isinstance(f.dataType, T.StringType)
             else F.lit(8).cast("bigint") for f in df.schema if not isinstance(f.dataType, NESTED)]
    width += [F.octet_length(F.to_json(F.struct(f.name))).cast("bigint") for f in df.schema if isinstance(f.dataType, NESTED)]
    total = width[0]
    for w in width[1:]:
        total = total + w
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def broadcast_if_small(df: DataFrame, name: str = "side", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df``, computed once into the shared folder, with a broadcast hint if its values
    take at most ``max_bytes`` bytes; otherwise unhinted, and the join shuffles."""
    side = written(df, name)
    return F.broadcast(side) if size_of(side)[1] <= max_bytes else side


def let(values: dict, body) -> Column:
    """Evaluate ``values`` once per row and use them in ``body``.

    Catalyst collapses projections by inlining a column's expression where it is
    used; inside a lambda of ``transform``/``filter``/``aggregate`` that means once
    per array element (a padded array rebuilt 200 times per row, say). The array
    argument of a higher-order function is evaluated once, so binding the values
    as the single element of a one-element array keeps them computed once:
    ``body`` receives a struct whose fields are the bound values.
    """
    bound = F.array(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, body), 0)


def explode_rows(df: DataFrame, arr: Column, keep, alias: str = "item") -> DataFrame:
    """``explode`` without the filter Catalyst infers for it.

    For ``explode(expr)`` the optimizer adds ``size(expr) > 0`` below the
    generator, which evaluates an expensive ``expr`` (a regex, an in-row sort)
    twice. ``explode_outer`` plus a null filter gives the same rows (for arrays
    without null elements) with one evaluation.
    """
    return df.select(*keep, F.explode_outer(arr).alias(alias)).where(F.col(alias).isNotNull())


def posexplode_rows(df: DataFrame, arr: Column, keep, pos: str = "pos", alias: str = "item") -> DataFrame:
    """``posexplode`` counterpart of ``explode_rows``."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, alias)).where(F.col(pos).isNotNull())


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; has {df.columns}")


def as_bigint(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c) -> Column:
    """Round to 6 places (scores are compared across engines at this precision)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)
