"""Deterministic splits: counts, percentages along an order, folds, manifests, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsift.session import written


def split_counts(n: int, train: float, val: float, test: float) -> tuple[int, int, int]:
    """Sizes with test and val rounded half to even and the rest in train; errors for bad fractions or no training data."""
    if min(train, val, test) < 0 or abs(train + val + test - 1) > 1e-6:
        raise ValueError("fractions must be non-negative and sum to one")
    n_test, n_val = max(0, round(n * test)), max(0, round(n * val))
    if n - n_test - n_val < 1:
        raise ValueError(f"no training data left of {n}")
    return n - n_test - n_val, n_val, n_test


def seeded_order(key: str, seed: int) -> list[Column]:
    """A reproducible random order that any engine can repeat: MD5 of ``seed:id``, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), F.col(key)]


def ranked(df: DataFrame, order: list[Column], rank: str = "_r") -> DataFrame:
    """``df`` with its global rank from 1, without a window over all rows.

    A range-partitioned sort gives each partition a contiguous stretch of the order; ranks within partitions plus the
    sizes of those before (one number per partition) are global ranks.
    """
    names = [f"_o{i}" for i in range(len(order))]
    srt = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*[F.col(n).asc_nulls_first() for n in names]).sortWithinPartitions(*[F.col(n).asc_nulls_first() for n in names])
    # the id is the partition in its upper bits and the row in it in the lower; written, since a second evaluation might
    # draw other range bounds
    got = written(srt.drop(*names).withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33)), "ranked")
    sizes = got.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.withColumn("_skip", F.sum("_k").over(Window.orderBy("_p")) - F.col("_k")).select("_p", "_skip")
    return got.join(F.broadcast(before), "_p").withColumn(rank, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_skip") + 1).drop("_id", "_p", "_skip")


def percent_split(df: DataFrame, order: list[Column], train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """``df`` with ``split``: along ``order`` first train, then val, then test (lowest coordinates train)."""
    n_train, n_val, _ = split_counts(df.count(), train, val, test)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    return ranked(df, order).withColumn("split", split).drop("_r")


def _fold(rank: Column, n: int, folds: int) -> Column:
    """Fold of a rank when the first ``n % folds`` folds get one more."""
    size, more = divmod(n, folds)
    edge = more * (size + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (size + 1))).otherwise(F.floor((rank - 1 - edge) / max(size, 1)) + more).cast("int")


def kfold_split(df: DataFrame, key: str, order: list[Column], folds: int, fold: int, val: float = 0.1, seed: int = 0) -> DataFrame:
    """``df`` with ``fold`` and ``split``: one fold is test; of the others a seeded share, at least one row, is val."""
    if not 0 <= fold < folds:
        raise ValueError(f"fold {fold} is out of range for {folds} folds")
    n = df.count()
    got = ranked(df, order).withColumn("fold", _fold(F.col("_r"), n, folds)).drop("_r")
    rest = got.where(F.col("fold") != fold)
    n_val = max(1, round(rest.count() * val))
    chosen = rest.select(F.col(key).alias("_v"), F.lit(True).alias("_is")).orderBy(*seeded_order("_v", seed + fold)).limit(n_val)
    split = F.when(F.col("fold") == fold, "test").when(F.col("_is"), "val").otherwise("train")
    return got.join(chosen, F.col(key) == F.col("_v"), "left").withColumn("split", split).drop("_v", "_is")


def split_manifest(patches: DataFrame, seed: int = 0, train: float = 0.7, val: float = 0.15, test: float = 0.15, folds: int = 5) -> DataFrame:
    """``(patch_id, patch_index, holdout_split, fold, is_test)``: seeded holdout, folds over what is not test (null there)."""
    n = patches.count()
    _, n_val, n_test = split_counts(n, train, val, test)
    r = F.col("_r")
    got = ranked(patches, seeded_order("patch_id", seed))
    split = F.when(r <= n_test, "test").when(r <= n_test + n_val, "val").otherwise("train")
    fold = F.when(r > n_test, _fold(r - n_test, n - n_test, folds))
    index = ranked(got.select("patch_id", "_r"), [F.col("patch_id")], "_i")
    return index.select("patch_id", (F.col("_i") - 1).alias("patch_index"), split.alias("holdout_split"), fold.alias("fold"), (r <= n_test).alias("is_test"))


def role_ids(manifest: DataFrame, role: str, mode: str = "holdout", fold: int = 0) -> DataFrame:
    """Patches of a role. holdout: by the split; kfold: test is fixed, val is the fold, train the other folds."""
    if role not in ("train", "val", "test") or mode not in ("holdout", "kfold"):
        raise ValueError(f"unknown role {role!r} or mode {mode!r}")
    if mode == "holdout":
        return manifest.where(F.lower(F.trim("holdout_split")) == role).select("patch_id")
    keep = {"test": F.col("is_test"), "val": ~F.col("is_test") & (F.col("fold") == fold), "train": ~F.col("is_test") & (F.col("fold") != fold)}[role]
    return manifest.where(keep).select("patch_id")


def missing_ids(manifest: DataFrame, patches: DataFrame) -> DataFrame:
    """Manifest patches that the records lack; a caller that needs all of them raises when there is one."""
    return manifest.select("patch_id").join(patches, "patch_id", "left_anti")


def subsets(patches: DataFrame, manifest: DataFrame, mode: str = "holdout", fold: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(patches.join(role_ids(manifest, role, mode, fold), "patch_id", "left_semi") for role in ("train", "val", "test"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    split = F.lower(F.trim("holdout_split"))
    n = F.count(F.lit(1))
    share = [F.round(F.count_if(split == s) / n, 6).alias(f"{s}_fraction") for s in ("train", "val", "test")]
    return manifest.agg(n.alias("n"), *[F.count_if(split == s).alias(f"n_{s}") for s in ("train", "val", "test")], *share, F.count_distinct("fold").alias("n_folds"))


def fold_counts(manifest: DataFrame) -> DataFrame:
    return manifest.where("fold is not null").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def split_totals(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split, zeros kept."""
    every = df.sparkSession.createDataFrame([("train",), ("val",), ("test",)], f"{split} string")
    n = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, split, "left").select(split, F.coalesce("n", F.lit(0)).alias("n"))


def block_split(df: DataFrame, order: list[Column], test: float = 0.2, seed: int = 0) -> DataFrame:
    """Equal blocks along ``order``; a seeded choice of whole blocks is test."""
    n = df.count()
    blocks = max(5, round(1 / test))
    chosen = [r[0] for r in df.sparkSession.range(blocks).orderBy(*seeded_order("id", seed)).limit(max(1, round(blocks * test))).collect()]
    got = ranked(df, order).withColumn("block", _fold(F.col("_r"), n, blocks)).drop("_r")
    return got.withColumn("split", F.when(F.col("block").isin(chosen), "test").otherwise("train"))


def draw(df: DataFrame, key: str, n: int, seed: int, replacement: bool = False) -> DataFrame:
    """A seeded sample of n rows: without replacement the first of a random order, with it ``n`` uniform draws."""
    if not replacement:
        return df.orderBy(*seeded_order(key, seed)).limit(n)
    total = df.count()
    picks = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))) + 1).alias("_r"))
    return ranked(df, [F.col(key)]).join(picks, "_r").drop("_r")
