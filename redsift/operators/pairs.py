"""Many-to-many pairing of products: pair keys, ortho slots, completeness, alignment, overlap of windows and footprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_key(left: Column, right: Column) -> Column:
    return F.concat_ws("__", F.trim(left), F.trim(right))


def pair_members(pairs: DataFrame) -> DataFrame:
    """``(obs_id, pair_key)``: every pair under each of its observations, once when both are the same."""
    return pairs.select(F.explode(F.array_distinct(F.array(F.trim("left_obs"), F.trim("right_obs")))).alias("obs_id"), "pair_key").where("obs_id is not null").distinct()


def orthos_of_pairs(pairs: DataFrame, orthos: DataFrame) -> DataFrame:
    """Ortho rows once for each pair that contains their observation; unmatched ones drop out."""
    return orthos.join(pair_members(pairs), "obs_id")


def ortho_slots(pairs: DataFrame, rows: DataFrame, scale: str | None = None) -> DataFrame:
    """``(pair_key, slots)``: a map of side and type to path. The side follows from the observation; among candidates an
    exact scale letter wins, else the smallest letter, then the first by ``pos``."""
    r = rows.join(pairs.select("pair_key", F.trim("left_obs").alias("_l")), "pair_key")
    side = F.when(F.trim("obs_id") == F.col("_l"), "left").otherwise("right")
    exact = F.when(F.col("scale") == (scale or ""), 0).otherwise(1)
    best = r.groupBy("pair_key", F.concat_ws("_", side, "kind").alias("slot")).agg(F.min_by("path", F.struct(exact.alias("e"), "scale", "pos")).alias("path"))
    return best.groupBy("pair_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "path")))).alias("slots"))  # four slots at most


def complete_pairs(slots: DataFrame, kinds: list[str]) -> DataFrame:
    """Pairs with a left and a right path for every kind."""
    need = [f"{s}_{k}" for k in kinds for s in ("left", "right")]
    return slots.where(F.forall(F.array(*[F.lit(x) for x in need]), lambda x: F.try_element_at("slots", x).isNotNull()))


def aligned_pairs(pairs: DataFrame, orthos: DataFrame, least: float = 0.75, tol: float = 1e-6) -> DataFrame:
    """Pairs without a misaligned ortho (overlap ratio below ``least``, or scale 1 with offset 0)."""
    bad = orthos.where((F.col("overlap") < least) | ((F.abs(F.col("scale_factor") - 1) < tol) & (F.abs("offset") < tol))).select("pair_key").distinct()
    return pairs.join(bad, "pair_key", "left_anti")


def name_pairs(images: DataFrame, dtms: DataFrame, confidence: DataFrame | None = None, right: bool = True) -> DataFrame:
    """Images with the elevation file of the same stem (a trailing ``_L`` or ``_R`` dropped), and its confidence if any."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", ""), "_[LR]$", "")
    i = images.select(F.col("path").alias("image"), stem(F.col("path")).alias("stem"))
    if not right:
        i = i.where(~F.col("image").rlike(r"_R\.[^.]*$"))
    got = i.join(dtms.select(F.col("path").alias("dtm"), stem(F.col("path")).alias("stem")), "stem")
    if confidence is None:
        return got.withColumn("confidence", F.lit(None).cast("string"))
    return got.join(confidence.select(F.col("path").alias("confidence"), stem(F.col("path")).alias("stem")), "stem", "left")


def box_overlaps(windows: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """``(window_id, box_id, area)`` of windows and boxes that share area. Columns: id, west, south, east, north.

    Both sides are cut into grid cells and joined on the cell; a pair is kept in the cell of the corner where their
    intersection begins, so each comes once and no pair meets outside a shared cell.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        c = {k: F.col(k).cast("double") for k in ("west", "south", "east", "north")}
        d = df.where((c["west"] < c["east"]) & (c["south"] < c["north"])).select(F.col("id").alias(f"{p}_id"), *[v.alias(f"{p}{k[0]}") for k, v in c.items()])
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return d.withColumn("cy", F.explode(span(f"{p}s", f"{p}n"))).withColumn("cx", F.explode(span(f"{p}w", f"{p}e")))

    j = cells(windows, "window").join(cells(boxes, "box"), ["cx", "cy"])
    w, s = F.greatest("windoww", "boxw"), F.greatest("windows", "boxs")
    e, n = F.least("windowe", "boxe"), F.least("windown", "boxn")
    mine = (F.floor(w / cell) == F.col("cx")) & (F.floor(s / cell) == F.col("cy"))
    return j.where((w < e) & (s < n) & mine).select("window_id", "box_id", ((e - w) * (n - s)).alias("area"))


def dominant(overlaps: DataFrame) -> DataFrame:
    """Per window its contributors by area (ties by id) with their share of the summed overlap; the first is dominant."""
    total = overlaps.groupBy("window_id").agg(F.sum("area").alias("total"))
    w = Window.partitionBy("window_id").orderBy(F.desc("area"), "box_id")
    return overlaps.join(total, "window_id").withColumn("rank", F.row_number().over(w)).withColumn("fraction", F.col("area") / F.col("total")).drop("total")


def dedupe_centres(df: DataFrame, x: str, y: str, pos: str, digits: int = 12) -> DataFrame:
    """First row per centre rounded to ``digits``."""
    rest = [c for c in df.columns]
    return df.groupBy(F.bround(x, digits).alias("_x"), F.bround(y, digits).alias("_y")).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select("_r.*")


def patch_summary(patches: DataFrame) -> DataFrame:
    """Count, dominant observations, mean contributors and dominant share; zeros when empty."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return patches.agg(F.count(F.lit(1)).alias("n_patches"), F.count_distinct("dominant_obs_id").alias("n_observations"), F.round(z(F.avg("source_obs_count")), 6).alias("mean_sources"), F.round(z(F.avg("dominant_overlap_fraction")), 6).alias("mean_dominant"))


def quality_filter(df: DataFrame, valid: float = 0.5, residual: float = 0.1, tin: float = 0.95, merges: int = 1) -> DataFrame:
    """Patches good enough to train on; a null measure drops the row."""
    return df.where(F.col("is_valid") & (F.col("valid_ratio") >= valid) & (F.col("residual") >= residual) & (F.col("is_tin") <= tin) & (F.col("num_merges") == merges))


def grid_neighbours(df: DataFrame, key: str, row: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of grid patches at the offsets (0,1), (1,-1), (1,0), (1,1): an equi-join on exploded offsets. With ``by``
    each of its values is a grid of its own."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    a = df.select(*by, F.col(key).alias("a"), F.col(row).alias("r"), F.col(col).alias("c"), F.explode(offsets).alias("o"))
    a = a.select(*by, "a", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "o.dr", "o.dc")
    return a.join(df.select(*by, F.col(key).alias("b"), F.col(row).alias("r"), F.col(col).alias("c")), [*by, "r", "c"]).select(*by, "a", "b", "dr", "dc")


def candidate_grid(strips: DataFrame, size: float, stride: float, overlap: float = 0.5) -> DataFrame:
    """Centres on a grid over each strip's box (id, west, south, east, north) whose patch shares more than ``overlap`` of
    its area with the box."""
    xs = lambda a, b: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.col(b) - F.col(a)) / stride), F.lit(0))), lambda k: F.col(a) + k * stride)
    d = strips.where("west < east and south < north").withColumn("cx", F.explode(xs("west", "east"))).withColumn("cy", F.explode(xs("south", "north")))
    w = F.least(F.col("cx") + size / 2, F.col("east")) - F.greatest(F.col("cx") - size / 2, F.col("west"))
    h = F.least(F.col("cy") + size / 2, F.col("north")) - F.greatest(F.col("cy") - size / 2, F.col("south"))
    share = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / (size * size)
    return d.withColumn("overlap", share).where(F.col("overlap") > overlap).select("id", "cx", "cy", "overlap")
