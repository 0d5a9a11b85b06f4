"""Exact ranks and percentiles within groups, without gathering a group.

Equal values of a group first become one row with their number. These rows are range-partitioned by group and value, so
a hot group spreads over tasks; running counts inside a partition plus the sums of the partitions before give each
value's ranks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsift.session import written


def same(left: str, right: str, by: list[str]) -> Column:
    """Equality of the keys of two aliased tables; nulls are equal, no keys are always."""
    return reduce(and_, [F.col(f"{left}.`{g}`").eqNullSafe(F.col(f"{right}.`{g}`")) for g in by], F.lit(True))


def cumulative(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` (a row per group and value) with ``cum``, the number up to and with the value, and ``total`` of its group.

    The rows are written once, since a second evaluation might draw other range bounds.
    """
    keys = [F.col(f"`{g}`") for g in by]
    got = written(counts.repartitionByRange(*[k.asc_nulls_first() for k in keys], F.col(value).asc()).withColumn("_p", F.spark_partition_id()), "ranks")
    # a row per partition and group that it holds
    parts = got.groupBy("_p", *keys).agg(F.sum(n).alias("_k"))
    of = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))
    parts = parts.withColumn("_skip", F.sum("_k").over(of.orderBy("_p")) - F.col("_k")).withColumn("total", F.sum("_k").over(of)).drop("_k")
    inside = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = same("l", "r", by) & (F.col("l._p") == F.col("r._p"))
    joined = got.withColumn("_c", F.sum(n).over(inside)).alias("l").join(parts.alias("r"), on)
    return joined.select(*[F.col(f"l.`{c}`") for c in counts.columns], (F.col("_c") + F.col("_skip")).alias("cum"), F.col("r.total").alias("total"))


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[float], out: str = "percentiles") -> DataFrame:
    """``(by, out array<double>, n)``: percentiles of the non-null values by linear interpolation between ranks.

    Groups without values have no row; NaN ranks above all numbers.
    """
    v = F.col(f"`{value}`").cast("double")
    counts = df.where(F.col(f"`{value}`").isNotNull()).groupBy(*[F.col(f"`{g}`") for g in by], v.alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    c = cumulative(counts, by, "_v")
    found = []
    for p in ps:
        at = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = (F.min(F.when(F.col("cum") > f(at), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.lit(float(p)) * (F.max("total") - 1)
        found.append(lo + (hi - lo) * (part - F.floor(part)))
    return c.groupBy(*[F.col(f"`{g}`") for g in by]).agg(F.array(*found).alias(out), F.max("total").alias("n")).where("n is not null")


def with_next(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "next", first: str = "first") -> DataFrame:
    """``df`` with the value of the next row of its group in ``order`` (null for the last) and whether a row is the first.

    Rows are range-partitioned by group and order, so a hot group spreads over tasks; what follows the last row of a
    group in a partition is the first one in the next partition that holds the group. Nulls come first; equal orders go by
    the value.
    """
    keys = [F.col(f"`{g}`") for g in by]
    by_order = [F.col(f"`{c}`").asc_nulls_first() for c in dict.fromkeys([*order, value])]
    got = written(df.repartitionByRange(*[k.asc_nulls_first() for k in keys], *by_order).withColumn("_p", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_p", *keys).orderBy(*by_order)
    got_next = got.withColumn("_v", F.lead(F.struct(F.col(f"`{value}`").alias("v"))).over(inside)).withColumn("_i", F.row_number().over(inside))
    # a row per partition and group that it holds
    heads = got_next.where("_i = 1").select("_p", *keys, F.col(f"`{value}`").alias("_head"))
    over = Window.partitionBy(*keys).orderBy("_p")
    heads = heads.withColumn("_after", F.lead(F.struct(F.col("_head").alias("v"))).over(over)).withColumn("_lead", F.row_number().over(over) == 1).drop("_head")
    j = got_next.alias("l").join(heads.alias("r"), same("l", "r", by) & (F.col("l._p") == F.col("r._p")))
    return j.select(*[F.col(f"l.`{c}`") for c in df.columns], F.coalesce(F.col("l._v"), F.col("r._after"))["v"].alias(out), ((F.col("l._i") == 1) & F.col("r._lead")).alias(first))
