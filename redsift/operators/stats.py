"""Moments, histograms, percentiles and summaries: built-in aggregates with partial steps, and small windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsift.operators.ranks import percentiles, same

BINS = 1024


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n, mean, m2, std (population), min, max`` of non-null values per group; the engine merges partial moments."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """One row per group from stored partial moments; parts without values change nothing."""
    p = parts.where("n > 0")
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    mean = s / n
    m2 = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    got = p.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))
    return got.withColumn("std", F.sqrt(F.col("m2") / F.col("n")))


def centred(df: DataFrame, group: list[str], value: str, out: str = "centred") -> DataFrame:
    """Value less the mean of its group. The means are aggregated first (with partial steps) and joined back, so a hot
    group is never gathered in one task."""
    mean = df.groupBy(*group).agg(F.avg(value).alias("_m"))
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    return df.alias("l").join(mean.alias("r"), on, "left").select("l.*", (F.col(f"l.{value}") - F.col("r._m")).alias(out))


def histogram(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    """``(by, bin, n)``: equal bins on [lo, hi], the last closed on the right, values outside ignored."""
    v = F.col(value)
    bin_ = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where((v >= lo) & (v <= hi)).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(hist: DataFrame, by: list[str], p: float, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    """``(by, value)``: the percentile by linear interpolation in the first bin whose cumulative count reaches it; a
    histogram without counts gives 0, also one without rows if it has no groups."""
    width = (hi - lo) / bins
    w = Window.partitionBy(*by).orderBy("bin") if by else Window.orderBy("bin")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    c = hist.withColumn("_c", F.sum("n").over(w)).withColumn("_t", F.sum("n").over(whole) * p)
    hit = c.where(F.col("_c") >= F.col("_t")).groupBy(*by).agg(F.min_by(F.struct("bin", "n", "_c", "_t"), "bin").alias("h"))
    h = F.col("h")
    inside = F.when(h["n"] > 0, (h["_t"] - (h["_c"] - h["n"])) / h["n"]).otherwise(0.0)
    empty = h["_t"] <= 0
    got = hit.select(*by, F.when(empty, 0.0).otherwise(lo + (h["bin"] + inside) * width).alias("value"))
    return got if by else got.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


def percentile_stretch(df: DataFrame, by: list[str], value: str, out: str = "stretched", least: int = 1) -> DataFrame:
    """Value between the 2nd and 98th percentile of the non-zero values of its group, in [0, 1]; zero where it was zero,
    where the group has fewer than ``least`` such values, or where the percentiles coincide."""
    v = F.col(value)
    p = percentiles(df.where(v != 0), by, value, [0.02, 0.98], "_p").withColumnRenamed("n", "_k")
    j = df.alias("l").join(p.alias("r"), same("l", "r", by), "left")
    x, lo, hi = F.col(f"l.{value}"), F.col("r._p")[0], F.col("r._p")[1]
    y = F.when((x == 0) | (F.coalesce(F.col("r._k"), F.lit(0)) < least) | (hi <= lo) | lo.isNull(), 0.0).otherwise(F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    return j.select("l.*", y.alias(out))


def minmax(df: DataFrame, by: list[str], value: str, lo: float = 0.0, hi: float = 1.0, out: str = "scaled") -> DataFrame:
    """Value scaled to [lo, hi] within its group; a flat group gives the middle."""
    r = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in by]
    x, a, b = F.col(f"l.{value}"), F.col("r._a"), F.col("r._b")
    return df.alias("l").join(r.alias("r"), on, "left").select("l.*", F.when(b > a, lo + (x - a) / (b - a) * (hi - lo)).otherwise(F.when(x.isNotNull(), (lo + hi) / 2)).alias(out))


def channel_stats(df: DataFrame, by: list[str], value: str, valid: Column) -> DataFrame:
    """Mean and standard deviation from sums over valid values; variance is at least 1e-12."""
    v, n = F.when(valid, F.col(value)), F.count(F.when(valid, F.col(value)))
    mean = F.sum(v) / n
    return df.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(v * v) / n - mean * mean, F.lit(1e-12))).alias("std"))


def unpivot_summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by, metric, n, mean, std, median, min, max)``; std is the sample's, the population's below two values."""
    by = by or []
    long = df.unpivot(by or [F.lit(0).alias("_k")], columns, "metric", "v")
    v, n = F.col("v"), F.count("v")
    std = F.when(n < 2, F.stddev_pop(v)).otherwise(F.stddev_samp(v))
    keys = [*by, "metric"]
    got = long.groupBy(*keys).agg(n.alias("n"), F.avg(v).alias("mean"), std.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    mid = percentiles(long, keys, "v", [0.5])
    return got.alias("l").join(mid.alias("r"), same("l", "r", keys), "left").select(*[f"l.{k}" for k in keys], "l.n", "mean", "std", F.col("percentiles")[0].alias("median"), "min", "max")


def ratio_metrics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Coefficient of variation and relative 2-98 range per group; NaN where the mean is zero."""
    v = F.col(value)
    got = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    p = percentiles(df, by, value, [0.02, 0.98], "_p").drop("n")
    got = got.alias("l").join(p.alias("r"), same("l", "r", by), "left").select("l.*", "_p")
    nan = F.lit(math.nan)
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(nan)
    drcr = F.when(F.col("mean") != 0, (F.col("_p")[1] - F.col("_p")[0]) / F.col("mean")).otherwise(nan)
    return got.select(*by, "mean", "std", cv.alias("cv"), drcr.alias("drcr"))


def clipping(hist: DataFrame, centre: str, n: str, thresholds: list[float]) -> DataFrame:
    """Per threshold the share of counts beyond it, the mean and the greatest error of clipping there.

    Thresholds are a list given by the caller: each histogram row meets each of them, a fixed small number."""
    t = hist.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    over = F.greatest(F.abs(F.col(centre)) - F.col("threshold"), F.lit(0.0))
    total = F.sum(n)
    return t.groupBy("threshold").agg((F.sum(F.when(over > 0, F.col(n)).otherwise(0)) / total).alias("saturation"), (F.sum(over * F.col(n)) / total).alias("mean_error"), F.max(F.when(F.col(n) > 0, over)).alias("max_error"))


def threshold_rejection(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Percentage of rows below each of a fixed list of thresholds."""
    t = df.where(F.col(value).isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return t.groupBy("threshold").agg(F.round(F.avg((F.col(value) < F.col("threshold")).cast("double")) * 100, 6).alias("rejected_pct"))


def shared_support(hist: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Density per group over the bins between the first and last that any group fills."""
    span = hist.where(F.col(n) > 0).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    inside = hist.join(F.broadcast(span)).where("bin between _a and _b").drop("_a", "_b")  # span is one row
    total = inside.groupBy(*by).agg(F.sum(n).alias("_t"))
    return inside.join(total, by).select(*by, "bin", (F.col(n) / F.col("_t")).alias("density"))


def mask_statistics(df: DataFrame, fraction: str) -> DataFrame:
    f = F.col(fraction)
    return df.agg(F.count_if(f >= 1).alias("full"), F.count_if((f > 0) & (f < 1)).alias("partial"), F.count_if(f <= 0).alias("empty"), F.round(F.avg(f) * 100, 6).alias("valid_pct"))


def plane_fit(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c per group, from sums; without two directions the mean (a = b = 0)."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    g = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.covar_pop(x, x).alias("sxx"), F.covar_pop(y, y).alias("syy"),
        F.covar_pop(x, y).alias("sxy"), F.covar_pop(x, z).alias("sxz"), F.covar_pop(y, z).alias("syz"),
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    flat = (F.col("n") < 3) | (det <= 1e-12 * F.col("sxx") * F.col("syy"))
    a = F.when(flat, 0.0).otherwise((F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / det)
    b = F.when(flat, 0.0).otherwise((F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / det)
    return g.withColumn("a", a).withColumn("b", b).select(*by, "n", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def plane_residual(df: DataFrame, by: list[str], x: str, y: str, z: str, out: str = "residual") -> DataFrame:
    """Value less the plane of its group."""
    p = plane_fit(df, by, x, y, z)
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in by]
    return df.alias("l").join(p.alias("r"), on, "left").select("l.*", (F.col(f"l.{z}") - (F.col("r.a") * F.col(f"l.{x}") + F.col("r.b") * F.col(f"l.{y}") + F.col("r.c"))).alias(out))


def affine_align(df: DataFrame, by: list[str], pred: str, truth: str) -> DataFrame:
    """Least-squares scale and shift of predictions to the truth; fewer than two rows, or constant ones: identity."""
    n = F.count(F.when(F.col(pred).isNotNull() & F.col(truth).isNotNull(), 1))
    s, o = F.regr_slope(truth, pred), F.regr_intercept(truth, pred)
    ok = (n >= 2) & s.isNotNull()
    return df.groupBy(*by).agg(n.alias("n"), F.when(ok, s).otherwise(1.0).alias("scale"), F.when(ok, o).otherwise(0.0).alias("shift"))


def pixel_metrics(df: DataFrame, by: list[str], pred: str, truth: str) -> DataFrame:
    """Errors of positive predictions against positive truth per group: relative, squared, logarithmic, thresholds."""
    p, t = F.col(pred), F.col(truth)
    ok = df.where((p > 0) & (t > 0))
    d, l = p - t, F.ln(p) - F.ln(t)  # noqa: E741
    ratio = F.greatest(p / t, t / p)
    silog = F.sqrt(F.greatest(F.avg(l * l) - F.avg(l) * F.avg(l), F.lit(0.0))) * 100
    deltas = [(F.avg((ratio < 1.25**k).cast("double")) * 100).alias(f"delta_{k}") for k in (1, 2, 3)]
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d) / t).alias("abs_rel"), F.avg(d * d / t).alias("sq_rel"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(l * l)).alias("rmse_log"), silog.alias("si_log"), *deltas)


def weighted_mse(df: DataFrame, by: list[str], pred: str, truth: str, weight: str) -> DataFrame:
    d = F.col(pred) - F.col(truth)
    return df.groupBy(*by).agg((F.sum(d * d * F.col(weight)) / F.sum(weight)).alias("loss"))


def correlation_loss(df: DataFrame, by: list[str], pred: str, truth: str) -> DataFrame:
    return df.groupBy(*by).agg((1 - F.corr(pred, truth)).alias("loss"))


def mad_scale(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation from the median."""
    m = percentiles(df, by, value, [0.5], "_m").drop("n")
    j = df.alias("l").join(m.alias("r"), same("l", "r", by)).select(*[F.col(f"l.{g}") for g in by], F.abs(F.col(f"l.{value}") - F.col("_m")[0]).alias("_d"))
    return percentiles(j, by, "_d", [0.5]).select(*by, (F.col("percentiles")[0] * 1.4826).alias("mad"))


def nodata_check(df: DataFrame, by: list[str], value: str, offset: float, tolerance: float = 1e-6) -> DataFrame:
    """Shares of values at zero and near the calibration offset; BUG when the latter prevail above 5 %, PASS when zeros
    are above 1 %, else UNCLEAR."""
    zero, near = F.avg((F.abs(F.col(value)) < tolerance).cast("double")), F.avg((F.abs(F.col(value) - offset) < tolerance).cast("double"))
    got = df.groupBy(*by).agg(F.round(zero, 6).alias("at_zero"), F.round(near, 6).alias("near_offset"))
    return got.withColumn("verdict", F.when((F.col("near_offset") > F.col("at_zero")) & (F.col("near_offset") > 0.05), "BUG").when(F.col("at_zero") > 0.01, "PASS").otherwise("UNCLEAR"))


def first_non_zero(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Mosaic: per cell the first value by ``pos`` that is neither zero nor NaN; zero where there is none."""
    v = F.col(value)
    good = (v != 0) & ~F.isnan(v)
    return df.groupBy(*by).agg(F.coalesce(F.min_by(F.when(good, v), F.when(good, F.col(pos))), F.lit(0.0)).alias(value))


def robust_blend(df: DataFrame, by: list[str], value: str, weight: str, k: float = 3.0) -> DataFrame:
    """Weighted mean per cell, again without values farther than k deviations (1.4826 times the weighted mean absolute
    deviation, at least 1e-3) from it."""
    w, v = F.col(weight), F.col(value)
    first = df.groupBy(*by).agg((F.sum(v * w) / F.sum(w)).alias("_m"))
    a = df.join(first, by)
    dev = a.groupBy(*by).agg(F.greatest(F.sum(F.abs(v - F.col("_m")) * w) / F.sum(w) * 1.4826, F.lit(1e-3)).alias("_d"))
    b = a.join(dev, by)
    keep = F.when(F.abs(v - F.col("_m")) <= k * F.col("_d"), w).otherwise(0.0)
    total = F.sum(keep)
    return b.groupBy(*by).agg(F.when(total > 0, F.sum(v * keep) / total).otherwise(F.max("_m")).alias("blended"), F.count(F.lit(1)).alias("n"))
