"""Paired experiments: long tables, deltas, tests, corrections, bootstrap, selections."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsift.operators.ranks import cumulative, percentiles, same


def runs(spark, variants: list[tuple[str, list[str]]], seeds: list[int], common: list[str]) -> DataFrame:
    """Every variant with every seed; overrides of the variant, then the common ones."""
    v = spark.createDataFrame(variants, "variant string, overrides array<string>")
    return v.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("overrides", F.concat("overrides", F.array(*[F.lit(c) for c in common]).cast("array<string>")))


def long_results(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    long = df.unpivot(by, metrics, "metric", "v")
    keys = [*by, "metric"]
    got = long.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    mid = percentiles(long, keys, "v", [0.5])
    return got.alias("l").join(mid.alias("r"), same("l", "r", keys), "left").select(*[f"l.{k}" for k in keys], "mean", F.col("percentiles")[0].alias("median"), "l.n")


def paired(df: DataFrame, variant: str, baseline: str, keys: list[str], value: str) -> DataFrame:
    """Rows of each other variant with the baseline's row of the same keys, and the difference. Keys without a partner
    or with a null key have none."""
    b = df.where(F.col(variant) == baseline).select(*keys, F.col(value).alias("value_b"))
    v = df.where(F.col(variant) != baseline).select(variant, *keys, F.col(value).alias("value_v"))
    return v.join(b, keys).withColumn("delta", F.col("value_v") - F.col("value_b"))


def track_summary(df: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """Mean and sample deviation over seeds of the means per seed; deviation 0 below two seeds."""
    per = df.groupBy(*by, seed).agg(F.avg(value).alias("m"))
    n = F.count("m")
    return per.groupBy(*by).agg(n.alias("n_seeds"), F.avg("m").alias("mean"), F.when(n < 2, 0.0).otherwise(F.stddev_samp("m")).alias("std"))


# ---------------------------------------------------------------- distributions in numpy


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_cf(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of a t statistic."""
    return float("nan") if math.isnan(t) else (0.0 if math.isinf(t) else beta_inc(df / 2, 0.5, df / (df + t * t)))


def chi2_sf_even(x: float, k: int) -> float:
    """Upper tail of chi-square with 2k degrees of freedom: a finite sum."""
    if k < 1 or math.isnan(x):
        return float("nan")
    half, total = x / 2, 0.0
    if half <= 0:
        return 1.0
    # terms are taken from their logarithms, block by block around the greatest, so that none of any k under- or overflows
    top = min(k - 1, int(half))
    peak = top * math.log(half) - math.lgamma(top + 1)
    reach = int(40 * math.sqrt(half + 1)) + 100
    i = np.arange(max(0, top - reach), min(k, top + reach), dtype=np.float64)
    logs = i * math.log(half) - _log_factorial(i) - peak
    total = math.log(float(np.exp(logs).sum())) + peak - half
    return min(1.0, math.exp(total))


def _log_factorial(i: np.ndarray) -> np.ndarray:
    """log i! of consecutive whole numbers."""
    return math.lgamma(i[0] + 1) + np.concatenate([[0.0], np.cumsum(np.log(i[1:]))])


def ttest(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """One-sample t test of the differences against 0; p is null below two values or without spread."""
    n, sd = F.count(delta), F.stddev_samp(delta)
    g = df.groupBy(*by).agg(n.alias("n"), F.avg(delta).alias("mean"), sd.alias("sd")).withColumn("t", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))))

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_sf2(a, k - 1) for a, k in zip(t, n, strict=True)], dtype="float64")

    return g.withColumn("p", p("t", F.col("n").cast("double"))).drop("sd")


def wilcoxon(values: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p: exact to 25 distinct differences, else normal with ties and continuity
    left out. Zeros are dropped; nothing left gives NaN."""
    d = values[~np.isnan(values) & (values != 0)]
    n = len(d)
    if not n:
        return math.nan, math.nan
    order = np.argsort(np.abs(d), kind="stable")
    a = np.abs(d)[order]
    _, first, count = np.unique(a, return_index=True, return_counts=True)
    ranks = np.empty(n)
    ranks[order] = np.repeat(first + (count + 1) / 2, count)
    plus = float(ranks[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and len(count) == n:
        return w, min(1.0, 2 * float(_ways(n)[int(w)]) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else math.nan
    return w, math.erfc(abs(z) / math.sqrt(2))


@lru_cache(maxsize=32)
def _ways(n: int) -> np.ndarray:
    """How many of the subsets of the ranks 1..n have each sum, cumulated."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return np.cumsum(ways)


def wilcoxon_test(df: DataFrame, by: list[str], delta: str, least: int = 10, exact: int = 25) -> DataFrame:
    """``(by, n, w, p)``: signed-rank test of the non-zero differences of each group, by distributed ranks.

    Equal absolute differences are counted and ranked over range partitions, so no group is gathered. Up to ``exact``
    differences without ties p is exact, else by normal approximation; fewer than ``least`` differences: null.
    """
    d = df.where(F.col(delta).isNotNull() & (F.col(delta) != 0) & ~F.isnan(delta)).groupBy(*by, F.abs(delta).alias("a")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(delta) > 0).alias("up"))
    d = cumulative(d, by, "a", "c").withColumn("rank", F.col("cum") - F.col("c") + (F.col("c") + 1) / 2)
    g = d.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    stat = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    g = g.withColumn("w", stat).withColumn("z", F.when(var > 0, (stat - n * (n + 1) / 4) / F.sqrt(var)))

    @F.pandas_udf("double")
    def tail(z: pd.Series, n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        def p(z: float, n: float, w: float, ties: float) -> float | None:
            if n < least or pd.isna(z):
                return None
            if n <= exact and not ties:
                return min(1.0, 2 * float(_ways(int(n))[int(w)]) / 2.0**n)
            return math.erfc(abs(z) / math.sqrt(2))

        return pd.Series([p(*x) for x in zip(z, n, w, ties, strict=True)], dtype="float64")

    return g.select(*by, "n", "w", tail("z", n, "w", "ties").alias("p"))


def fisher(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Fisher's combination of p values (at least 1e-300); nulls take no part."""
    g = df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), (-2 * F.sum(F.ln(F.greatest(F.col(p), F.lit(1e-300))))).alias("chi2"))

    @F.pandas_udf("double")
    def sf(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf_even(a, int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")

    return g.withColumn("p", sf("chi2", "k"))


def holm(df: DataFrame, by: list[str], p: Column, out: str = "holm_p") -> DataFrame:
    """Holm's correction within each family: (k - i) p in ascending order, running maximum, at most 1; null p stays null.

    A family is a set of compared variants, never a set of records."""
    d = df.withColumn("_p", p).withColumn("_q", F.when(F.col("_p").isNotNull(), F.lit(1)).otherwise(0))
    w = Window.partitionBy(*by).orderBy(F.col("_p").asc_nulls_last(), *[F.col(c) for c in df.columns if c not in by])
    k = F.sum("_q").over(Window.partitionBy(*by))
    d = d.withColumn("_a", (k - F.row_number().over(w) + 1) * F.col("_p"))
    run = F.least(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(1.0))
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), run)).drop("_p", "_q", "_a")


#: Fixed value: cumulated probabilities of a Poisson variable of mean one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(df: DataFrame, by: list[str], seed_col: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile interval (2.5, 97.5) of the mean difference: seeds are resampled, then values within each.

    Every draw of a seed's values needs their mean only, and a mean of a resample of n values has the same law when each
    value gets a Poisson(1) weight; so the resample is one pass of weighted sums per (seed, draw) with no group gathered.
    A weight is a hash of the row (all its columns) and the draw, so results do not change with partitions or batches;
    rows alike in all columns share their weights. Seeds (few) are then resampled on the sums. Null values take no part.
    """
    step = 100

    def sums(batches):
        for pdf in batches:
            for key, part in pdf.groupby(["_g", "_s"], sort=True):
                v, h = part["_v"].to_numpy(), part["_h"].to_numpy().view(np.uint64)
                for a in range(0, draws, step):
                    d = np.arange(a, min(a + step, draws))
                    x = _mixed(h[:, None] ^ _mixed(d.astype(np.uint64) + np.uint64(seed << 32))[None, :])
                    w = np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) * 2.0**-53, side="right").astype(float)
                    yield pd.DataFrame({"_g": key[0], "_s": key[1], "_d": d, "_w": w.sum(axis=0), "_x": v @ w})

    d = df.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*by)).alias("_g"), F.col(seed_col).cast("string").alias("_s"), F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_h"))
    parts = d.mapInPandas(sums, "_g string, _s string, _d long, _w double, _x double").groupBy("_g", "_s", "_d").agg(F.sum("_w").alias("_w"), F.sum("_x").alias("_x"))

    def intervals(pdf: pd.DataFrame) -> pd.DataFrame:
        m = (pdf.assign(m=pdf["_x"] / pdf["_w"].clip(lower=1))).pivot(index="_s", columns="_d", values="m").sort_index().to_numpy()
        rng = np.random.default_rng(seed)
        pick = rng.integers(0, m.shape[0], (m.shape[0], m.shape[1]))
        means = np.take_along_axis(m, pick, axis=0).mean(axis=0)
        lo, hi = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "mean": [float(m.mean())], "lo": [lo], "hi": [hi]})

    got = parts.groupBy("_g").applyInPandas(intervals, "_g string, mean double, lo double, hi double")  # draws x seeds rows per group
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*by).dtypes)
    return got.select(F.from_json("_g", schema).alias("_k"), "mean", "lo", "hi").select("_k.*", "mean", "lo", "hi")


# ---------------------------------------------------------------- selections


def best_by(df: DataFrame, by: list[str], value: str, pos: str, greatest: bool = False) -> DataFrame:
    """The row with the least (greatest) value per group, the first by ``pos`` on a tie; nulls and NaN never win."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    key = F.struct((-F.col(value) if greatest else F.col(value)).alias("v"), F.col(pos).alias("p"))
    rest = [c for c in df.columns if c not in by]
    return ok.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_b")).select(*by, "_b.*")


def extreme_k(df: DataFrame, value: str, pos: str, k: int = 10, greatest: bool = True) -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value) if greatest else F.asc(value), pos).limit(k)


def quantile_picks(df: DataFrame, value: str, key: str, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Rows at the given ranks of the sorted values."""
    from redsift.operators.splits import ranked

    ok = df.where(F.col(value).isNotNull())
    n = ok.count()
    wanted = sorted({min(n, int(q * (n - 1)) + 1) for q in quantiles}) if n else []
    return ranked(ok, [F.col(value), F.col(key)]).where(F.col("_r").isin(wanted)).drop("_r")


def curve(df: DataFrame, step: str, value: str) -> DataFrame:
    """Across runs the mean and population deviation per step; missing values take no part."""
    return df.groupBy(step).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def latest_step(names: DataFrame, name: str) -> DataFrame:
    """Step in the lexicographically last file name; one that holds none gives null."""
    return names.agg(F.max(name).alias("name")).select("name", F.expr(r"try_cast(regexp_extract(name, '([0-9]+)[^0-9]*$', 1) as int)").alias("step"))
