"""Ring buffers of frames as window expressions, and the statistics of a pool of buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring(column: str, size: int, keys: tuple[str, ...], order: str) -> dict[str, Column]:
    """What a ring of ``size`` frames shows after each push: the newest, the one before, the pair, the evicted, the fill."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = F.count(F.col(column)).over(w.rowsBetween(-(size - 1), 0))
    newest, before = F.col(column), F.lag(column, 1).over(w)
    shows_before = before if size > 1 else F.lit(None).cast("long")
    return {"current": newest, "previous": shows_before, "has_pair": shows_before.isNotNull() & newest.isNotNull(), "evicted": F.lag(column, size).over(w), "held": held, "is_full": held == size}


def held_at(column: str, k: int, size: int, keys: tuple[str, ...], order: str) -> Column:
    """The k-th most recent frame in a ring of ``size``, or null."""
    if not 0 <= k < size:
        return F.lit(None)
    return F.lag(column, k).over(Window.partitionBy(*keys).orderBy(order))


def pool_stats(buffers: DataFrame, size: str = "size", most: int = 4) -> DataFrame:
    """Buffers a size, at most ``most`` kept each, with their bytes; largest first."""
    kept = F.least(F.count("*"), F.lit(most))
    rows = buffers.groupBy(F.col(size).alias("size")).agg(kept.alias("buffers"))
    return rows.withColumn("total_bytes", F.col("size") * F.col("buffers")).orderBy(F.desc("size"))
