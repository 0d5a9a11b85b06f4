"""Reading windows from a table of raster tiles: overlap join, resampling on the window's grid, first-value mosaics.

A tile is a row with its place, pixel size and flat row-major values; a window is a box with a pixel size. Everything is
a join and an aggregation of pixels, so a window may meet any number of tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsift.operators.pairs import box_overlaps

#: Fixed value: the order of channels in an assembled tile.
CHANNELS = ("NEAR-INFRARED", "RED", "BLUE-GREEN")


def require_channels(wanted: list[str], known: tuple[str, ...] = CHANNELS) -> list[str]:
    """Wanted channels in their canonical order; an unknown one is an error."""
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown channels {unknown}")
    return [c for c in known if c in wanted]


def footprint_file(*choices: Column) -> Column:
    """The first file that is there."""
    return F.coalesce(*choices)


def grid_shape(side: Column, res: Column) -> Column:
    """Pixels of a window's side: at least one, rounded to the nearest whole number."""
    return F.greatest(F.round(side / res), F.lit(1)).cast("int")


def window_pixels(windows: DataFrame, tiles: DataFrame, fill: float = 0.0, cell: float = 1.0) -> DataFrame:
    """``(window_id, channel, height, width, values)`` of every window and channel that meets a tile.

    windows: id, west, south, east, north, res. tiles: id, channel, pos, west, south, east, north, res, width, values,
    nodata, scale, offset. A window pixel takes the tile pixel at its centre (nearest); nodata, NaN and zero give way to
    the next tile by ``pos``; values are scaled, and what no tile has is ``fill``. Rows with null places meet nothing.
    """
    near = box_overlaps(windows, tiles, cell).select("window_id", "box_id")
    w = windows.select(F.col("id").alias("window_id"), F.col("west").alias("ww"), F.col("north").alias("wn"), F.col("res").alias("wr"), grid_shape(F.col("north") - F.col("south"), F.col("res")).alias("height"), grid_shape(F.col("east") - F.col("west"), F.col("res")).alias("width"))
    t = tiles.select(F.col("id").alias("box_id"), "channel", "pos", F.col("west").alias("tw"), F.col("north").alias("tn"), F.col("east").alias("te"), F.col("south").alias("ts"), F.col("res").alias("tr"), F.col("width").alias("tc"), "values", "nodata", "scale", "offset")
    pixels = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    each = near.join(w, "window_id").join(t, "box_id").withColumn("i", F.explode(pixels))
    x = F.col("ww") + (F.col("i") % F.col("width") + 0.5) * F.col("wr")
    y = F.col("wn") - (F.floor(F.col("i") / F.col("width")) + 0.5) * F.col("wr")
    inside = (x >= F.col("tw")) & (x < F.col("te")) & (y <= F.col("tn")) & (y > F.col("ts"))
    at = (F.floor((F.col("tn") - y) / F.col("tr")) * F.col("tc") + F.floor((x - F.col("tw")) / F.col("tr"))).cast("int")
    raw = F.get("values", at)
    good = inside & raw.isNotNull() & ~F.isnan(raw) & (raw != 0) & ~raw.eqNullSafe(F.col("nodata"))
    value = F.when(good, raw * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0)))
    keys = ["window_id", "channel", "height", "width"]
    best = each.select(*keys, "i", value.alias("v"), F.struct("pos", "box_id").alias("order")).groupBy(*keys, "i").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("order"))).alias("v"))
    body = F.array_sort(F.collect_list(F.struct("i", F.coalesce("v", F.lit(fill)).alias("v"))))  # the pixels of one window
    return best.groupBy(*keys).agg(F.transform(body, lambda p: p["v"]).alias("values"))


def assembled(pixels: DataFrame, channels: list[str], fill: float = 0.0) -> DataFrame:
    """``(window_id, height, width, tile)``: the channels of a window one after the other in canonical order; one that no
    file has is filled. RED comes from the RED file only if it alone is asked for, else from the COLOR file where there is
    one (``source`` names the file of a row)."""
    order = require_channels(channels)
    first = "RED" if order == ["RED"] else "COLOR"
    rank = F.when(F.col("source") == first, 0).otherwise(1)
    best = pixels.where(F.col("channel").isin(order)).groupBy("window_id", "height", "width", "channel").agg(F.min_by("values", rank).alias("values"))
    by = best.groupBy("window_id", "height", "width").agg(F.map_from_entries(F.collect_list(F.struct("channel", "values"))).alias("m"))  # a few channels
    blank = F.array_repeat(F.lit(fill), (F.col("height") * F.col("width")).cast("int"))
    return by.select("window_id", "height", "width", F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), blank) for c in order])).alias("tile"))


def merge_counts(windows: DataFrame, tiles: DataFrame, cell: float = 1.0) -> DataFrame:
    """``(window_id, num_merges)``: how many tiles a window is put together from; windows that meet none are left out."""
    return box_overlaps(windows, tiles, cell).groupBy("window_id").agg(F.count_distinct("box_id").alias("num_merges"))
