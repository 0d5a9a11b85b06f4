"""Samples for training: records with their tiles, normalised, filled and chunked; batches; histories of runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.functions.masks import normalize_valid
from redsift.operators.splits import ranked, seeded_order
from redsift.operators.stats import moments

#: Fixed value: the least valid share of a usable patch.
VALID_FRACTION = 0.5


def patch_samples(records: DataFrame, tiles: DataFrame, observations: DataFrame, mean: float, std: float, least: float = VALID_FRACTION) -> DataFrame:
    """``(patch_id, image, valid, metadata)``: each record with its tile (patch_id, values) and its dominant observation.

    Pixels that are NaN, null or zero are invalid; the image is normalised over the valid ones and zero elsewhere. A
    record without a tile is left out, one without an observation keeps nulls in the metadata.
    """
    obs = observations.select(F.col("obs_id").alias("dominant_obs_id"), *[c for c in ("incidence_angle", "emission_angle", "map_scale") if c in observations.columns])
    rows = records.join(tiles.select("patch_id", "values"), "patch_id").join(obs, "dominant_obs_id", "left")
    valid = F.transform("values", lambda x: F.coalesce(~F.isnan(x) & (x != 0), F.lit(False)))
    share = F.aggregate("valid", F.lit(0), lambda a, v: a + v.cast("int")) / F.greatest(F.size("valid"), F.lit(1))
    rows = rows.withColumn("valid", valid).withColumn("overall_valid_fraction", share)
    seen = [c for c in ("incidence_angle", "emission_angle", "map_scale") if c in rows.columns]
    meta = F.struct("dominant_obs_id", "source_obs_count", "dominant_overlap_fraction", "overall_valid_fraction", (F.col("overall_valid_fraction") >= least).alias("is_patch_valid"), F.lit(least).alias("min_valid_fraction"), *seen)
    return rows.select("patch_id", normalize_valid(F.col("values"), F.col("valid"), mean, std).alias("image"), "valid", meta.alias("metadata"))


def filled(image: Column, valid: Column) -> Column:
    """Invalid pixels take the mean of the valid ones, zero if there is none."""
    both = F.arrays_zip(image.alias("x"), valid.alias("ok"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    total = F.aggregate(both, start, lambda a, p: F.struct((a["s"] + F.when(p["ok"], p["x"]).otherwise(0.0)).alias("s"), (a["n"] + p["ok"].cast("int")).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0))
    return F.zip_with(image, valid, lambda x, ok: F.when(ok, x).otherwise(total))


def chunked(samples: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """``samples`` with ``chunk`` and ``place``: stretches of ``size`` in the order of the key, or in a seeded one."""
    order = [F.col(key)] if seed is None else seeded_order(key, seed)
    return ranked(samples, order).withColumns({"chunk": F.floor((F.col("_r") - 1) / size), "place": ((F.col("_r") - 1) % size).cast("int")}).drop("_r")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A file per chunk, its rows in place; written by as many tasks as there are chunks."""
    chunks.repartition("chunk").sortWithinPartitions("chunk", "place").write.partitionBy("chunk").parquet(path)


def read_chunks(spark: SparkSession, path: str, epoch: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of all chunks with ``step``, their place in an epoch: as written, or chunks and their rows in a seeded order of
    the epoch."""
    rows = spark.read.parquet(path)
    if epoch is None:
        return ranked(rows, [F.col("chunk"), F.col("place")], "step")
    return ranked(rows, [F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), "chunk")), F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), "chunk", "place"))], "step")


def collated(rows: DataFrame, order: str, size: int, columns: list[str]) -> DataFrame:
    """``(batch, columns)``: each column of ``size`` consecutive rows as an array; the last batch may be short."""
    at = ranked(rows.select(F.col(order).alias("_o"), *columns), [F.col("_o")]).withColumn("batch", F.floor((F.col("_r") - 1) / size))
    got = at.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_r", *columns))).alias("_b"))  # ``size`` rows
    return got.select("batch", *[F.col(f"_b.`{c}`").alias(c) for c in columns])


# ---------------------------------------------------------------- statistics files


def channel_document(df: DataFrame, channels: list[str]) -> DataFrame:
    """``(channel, n, mean, std, min, max)`` of several columns, missing and NaN values left out."""
    long = df.unpivot([F.lit(0).alias("_k")], channels, "channel", "value").where("value is not null and not isnan(value)")
    return moments(long, ["channel"], "value").drop("m2")


def statistics_document(stats: DataFrame, channel: str = "channel") -> DataFrame:
    """One row whose column ``channels`` maps each channel to its statistics, a struct of the other columns. Of a channel that
    comes twice the first in order of the values counts; :func:`redsift.sources.writers.save_summary` writes it as JSON."""
    rest = F.struct(*[c for c in stats.columns if c != channel])
    once = stats.groupBy(F.col(channel).alias("_c")).agg(F.min(rest).alias("_s"))
    return once.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_s")))).alias("channels"))  # a few channels


def write_normalization(spark: SparkSession, path: str, mean: list[float], std: list[float], metadata: dict) -> None:
    """One JSON document of means and deviations per channel; lists of unequal length are an error."""
    if len(mean) != len(std):
        raise ValueError("a mean and a deviation are needed for each channel")
    spark.createDataFrame([(mean, std, json.dumps(metadata))], "mean array<double>, std array<double>, metadata string").coalesce(1).write.mode("overwrite").json(path)


def read_normalization(spark: SparkSession, path: str) -> tuple[list[float], list[float], dict]:
    r = spark.read.schema("mean array<double>, std array<double>, metadata string").json(path).first()  # one document
    if r is None or not r["mean"] or len(r["mean"]) != len(r["std"] or []):
        raise ValueError(f"no normalisation in {path}")
    return list(r["mean"]), list(r["std"]), json.loads(r["metadata"] or "{}")


# ---------------------------------------------------------------- histories of runs


def history(rows: DataFrame, step: str, keys: list[str]) -> DataFrame:
    """Rows with a value in at least one of the keys, in order of the step."""
    return rows.na.drop(how="all", subset=keys).orderBy(step)


def cooptimised(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means of several metrics per variant and seed."""
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def batch_means(batches: DataFrame, measures: list[str], limit: int | None = None, order: str = "batch") -> DataFrame:
    """Unweighted means over batches (the first ``limit`` by order, if given), zeros without any."""
    rows = batches if limit is None else batches.orderBy(order).limit(limit)
    return rows.agg(F.count(F.lit(1)).alias("n_batches"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures])


def solar_distribution(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """``df`` with ``azimuth`` (0..360) and ``elevation`` in degrees of its sun vector."""
    azimuth = F.pmod(F.degrees(F.atan2(F.col(y), F.col(x))), F.lit(360.0))
    return df.withColumns({"azimuth": azimuth, "elevation": F.degrees(F.asin(F.least(F.greatest(F.col(z), F.lit(-1.0)), F.lit(1.0))))})
