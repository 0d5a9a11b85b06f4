"""Patch records: numbered centres, the observations they overlap, the dominant one, flags and texts; summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsift.operators.pairs import box_overlaps, dedupe_centres, patch_summary
from redsift.operators.splits import kfold_split, percent_split, ranked, seeded_order

FLAGS = ("has_near_infrared", "has_red", "has_blue_green")


def patch_records(centres: DataFrame, footprints: DataFrame, metadata: DataFrame, size: tuple[float, float], digits: int = 12, cell: float = 1.0) -> DataFrame:
    """One row per centre whose patch (size: height and width) shares area with a footprint.

    centres: pos, cx, cy, t_start, t_stop; of equal centres (to ``digits``) the first by ``pos`` counts. footprints: id,
    west, south, east, north. metadata: obs_id, rationale_desc and the band flags. Centres are numbered in order of
    ``pos`` before any is left out, so numbers have gaps. Contributors come by area (to 15 decimals), ties by id, the first is dominant;
    fractions are of their summed area. A contributor without metadata counts as one without bands and text. Null
    centres and degenerate footprints overlap nothing.
    """
    h, w = size
    once = dedupe_centres(centres.where("cx is not null and cy is not null"), "cx", "cy", "pos", digits)
    box = {"west": F.col("cx") - w / 2, "south": F.col("cy") - h / 2, "east": F.col("cx") + w / 2, "north": F.col("cy") + h / 2}
    numbered = ranked(once, [F.col("pos")]).select((F.col("_r") - 1).alias("id"), "cx", "cy", "t_start", "t_stop", *[v.alias(k) for k, v in box.items()])
    known = metadata.select(F.col("obs_id").alias("box_id"), "rationale_desc", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS], F.lit(True).alias("known"))
    each = box_overlaps(numbered.select("id", *box), footprints, cell).where("area > 0").join(known, "box_id", "left")
    row = F.struct((-F.round("area", 15)).alias("k"), "box_id", "area", "rationale_desc", "known", *FLAGS)
    # as many as there are footprints over one patch
    got = each.groupBy(F.col("window_id").alias("id")).agg(F.sum("area").alias("total"), F.array_sort(F.collect_list(row)).alias("c"))
    has = lambda f: F.exists("c", lambda x: F.coalesce(x[f], F.lit(False)))
    out = numbered.join(got, "id")
    return out.select(
        F.format_string("patch_%06d", "id").alias("patch_id"), "t_start", "t_stop", F.col("west").alias("min_lon"), F.col("east").alias("max_lon"), F.col("south").alias("min_lat"), F.col("north").alias("max_lat"),
        F.col("cx").alias("centroid_lon"), F.col("cy").alias("centroid_lat"), F.lit(w).alias("patch_lon_span_deg"), F.lit(h).alias("patch_lat_span_deg"), F.lit(w * h).alias("patch_area_deg2"),
        F.col("c")[0]["box_id"].alias("dominant_obs_id"), F.transform("c", lambda x: x["box_id"]).alias("contributing_obs_ids"),
        F.transform(F.filter("c", lambda x: x["known"]), lambda x: x["rationale_desc"]).alias("contributing_rationales"),
        F.transform("c", lambda x: x["area"] / F.col("total")).alias("overlap_fractions"), (F.col("c")[0]["area"] / F.col("total")).alias("dominant_overlap_fraction"),
        F.size("c").alias("source_obs_count"), *[has(f).alias(f) for f in FLAGS], F.col("c")[0]["rationale_desc"].alias("rationale_raw"),
    )


def split_coordinate(axis: str, west: str = "min_lon", south: str = "min_lat", east: str = "max_lon", north: str = "max_lat") -> Column:
    """Where a record lies along ``longitude`` or ``latitude``: the middle of its box."""
    if axis not in ("longitude", "latitude"):
        raise ValueError(f"unknown axis {axis!r}")
    a, b = (west, east) if axis == "longitude" else (south, north)
    return (F.col(a) + F.col(b)) / 2


def sampler(records: DataFrame, key: str, coordinate: Column, split: str = "train", fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), method: str = "geographic", folds: int | None = None, fold: int = 0, seed: int = 42) -> DataFrame:
    """The records of a split (``all``: every one, with its ``split``): geographic along the coordinate, at random by a
    seeded order, or folds along the coordinate. Ties go by ``key``."""
    if split not in ("train", "val", "test", "all") or method not in ("geographic", "random", "kfold"):
        raise ValueError(f"unknown split {split!r} or method {method!r}")
    order = [coordinate, F.col(key)]
    if method == "kfold":
        if not folds:
            raise ValueError("folds are needed")
        got = kfold_split(records, key, order, folds, fold, fractions[1], seed).drop("fold")
    else:
        got = percent_split(records, order if method == "geographic" else seeded_order(key, seed), *fractions)
    return got if split == "all" else got.where(F.col("split") == split)


def centre_subset(centres: DataFrame, pos: str, first: int, last: int) -> DataFrame:
    """Centres number ``first`` to ``last`` (exclusive) in order of ``pos``."""
    return ranked(centres, [F.col(pos)]).where(F.col("_r").between(first + 1, last)).drop("_r")


def sample_summary(samples: DataFrame) -> DataFrame:
    """One row over samples (overall_valid_fraction, is_patch_valid, source_obs_count, dominant_overlap_fraction,
    band_valid_fraction of three, min_valid_fraction): counts, means and extremes, zeros when empty; the threshold is the
    least one."""
    z = lambda c, d=0.0: F.coalesce(c, F.lit(d))
    f = F.col("overall_valid_fraction")
    bands = F.array(*[z(F.avg(F.col("band_valid_fraction")[k])) for k in range(3)])
    return samples.agg(
        F.count(F.lit(1)).alias("num_samples"), F.count_if("is_patch_valid").alias("num_valid_patches"), z(F.avg(F.col("is_patch_valid").cast("double"))).alias("valid_patch_fraction"),
        z(F.avg(f)).alias("mean_overall_valid_fraction"), z(F.min(f)).alias("min_overall_valid_fraction"), z(F.max(f)).alias("max_overall_valid_fraction"),
        z(F.avg("source_obs_count")).alias("mean_source_obs_count"), z(F.avg("dominant_overlap_fraction")).alias("mean_dominant_overlap_fraction"),
        bands.alias("mean_band_valid_fraction"), F.min("min_valid_fraction").alias("min_valid_fraction_threshold"),
    )


def patch_report(records: DataFrame, samples: DataFrame) -> DataFrame:
    """Summary of the records beside that of the samples, one row."""
    left = patch_summary(records).withColumn("_k", F.lit(0))
    return left.join(F.broadcast(sample_summary(samples).withColumn("_k", F.lit(0))), "_k").drop("_k")  # one row each
