"""Joins that stay whole and even when a key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is hot; there are at most as many hot keys as the inverse.
HOT = 0.001
#: A table of at most so many rows is broadcast.
SMALL = 200_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, small: int = SMALL, hot: float = HOT) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has a row per key and otherwise other columns.

    A table of at most ``small`` rows is broadcast. Beyond that the hot keys of ``rows`` are (a thousand at most), so that
    their rows stay where they are, and the rest meets by a shuffle. Both sides are read more than once: pass written or
    plain tables. A null key meets nothing.
    """
    if table.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table), key, "left").select(*rows.columns, *[c for c in table.columns if c != key])
    n = rows.count()
    keys = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2, int(n * hot))).select(key)
    picked = F.broadcast(table.join(F.broadcast(keys), key, "left_semi").withColumn("_hot", F.lit(True)))
    extra = [c for c in table.columns if c != key]
    met = rows.join(picked, key, "left")
    large = met.where("_hot").select(*rows.columns, *extra)
    rest = met.where("_hot is null").select(*rows.columns).join(table, key, "left").select(*rows.columns, *extra)
    return large.unionByName(rest)
