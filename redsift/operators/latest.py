"""One row per key: the latest, the first or the last in a stated order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key (null orders lowest; ties: the greatest remaining columns).

    An aggregation with a partial step before the shuffle, so a key that holds a large share of all rows reduces to one
    row per task first. A null key is a key. Columns must be orderable (no maps). An empty table gives no rows.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])).alias("_best")
    got = df.groupBy(*[F.col(f"`{k}`").alias(k) for k in keys]).agg(best)
    return got.select(*[F.col(f"`{c}`") if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in ``order`` (nulls first, ties: the least remaining columns that have an order); a null key is
    a key. An aggregation with a partial step, so a hot key is one row per task before it is shuffled."""
    return _kept(df, keys, [F.col(c) for c in order], F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key in ``order``, where a null sorts last and therefore wins; otherwise as :func:`keep_first`."""
    return _kept(df, keys, [c for name in order for c in (F.col(name).isNull(), F.col(name))], F.max_by)


def _kept(df: DataFrame, keys: list[str], order: list[Column], pick: Callable) -> DataFrame:
    ties = [F.col(f"`{c}`") for c, t in df.dtypes if c not in keys and "map<" not in t and t not in ("variant", "void")]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick(whole, F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*order, *ties])])).alias("_best"))
    return got.select("_best.*")
