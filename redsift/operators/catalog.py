"""Catalogue operators: filters, observation records, footprints, coverage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redsift.functions.geo import closed_overlap, normalize_longitude
from redsift.functions.ids import product_observation, product_type
from redsift.functions.text import clean_text, parse_time
from redsift.operators.latest import keep_first

EPOCH = "2006-01-01 00:00:00"
EDGE_SLACK = 1e-5


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the missing columns in order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def text_filter(df: DataFrame, needle: str | None) -> DataFrame:
    """Rows in which any string column contains the text, literally and without case. Null matches nothing; no text: all."""
    if not needle:
        return df
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hits = [F.coalesce(F.lower(F.col(f"`{c}`")).contains(needle.lower()), F.lit(False)) for c in names]
    return df.where(reduce(or_, hits, F.lit(False)))


def bbox_filter(df: DataFrame, box: tuple[float, float, float, float] | None, west="min_longitude", south="min_latitude", east="max_longitude", north="max_latitude") -> DataFrame:
    """Rows whose closed box meets ``(west, south, east, north)``, longitudes normalised, no wrap-around. No box: all."""
    if box is None:
        return df
    return df.where(closed_overlap(box, normalize_longitude(west), F.col(south), normalize_longitude(east), F.col(north)))


def no_antimeridian(df: DataFrame, west="min_longitude", east="max_longitude") -> DataFrame:
    """Rows whose normalised box does not cross the antimeridian (a maximum of 180 normalises to -180 and does)."""
    return df.where(normalize_longitude(west) <= normalize_longitude(east))


def file_overlap(box: tuple[float, float, float, float], crs: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """May a file meet the box, within 1e-5 degrees; unknown reference or wrapped bounds count as yes."""
    w, s, e, n = box
    d = EDGE_SLACK
    return F.when(crs.isNull() | (west > east), F.lit(True)).otherwise((west <= e + d) & (east >= w - d) & (south <= n + d) & (north >= s - d))


def image_path(jp2: Column, tif: Column, prefer_cog: bool = True) -> Column:
    """The tif if wanted and there, else the jp2, else the tif, else null. Columns are null where a file is absent."""
    return F.coalesce(tif, jp2) if prefer_cog else F.coalesce(jp2, tif)


def local_path(root: str, spec: Column) -> Column:
    """Flat local place of an archive path."""
    return F.concat(F.lit(f"{root}/images/"), F.element_at(F.split(F.trim(spec), "/"), -1))


def local_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def index_cache_name(target: str | None, box: tuple[float, ...] | None, suffix: str, version: int) -> str:
    """File name of a spatial index; whole numbers are written without a fraction."""
    parts = [p for p in (target, "_".join(f"{int(v)}" if float(v).is_integer() else f"{v}" for v in box) if box else None, suffix, f"v{version}") if p]
    return "_".join(parts) + ".parquet"


def observation_records(index: DataFrame, box: tuple[float, float, float, float] | None = None, files: DataFrame | None = None, root: str = ".", require_local: bool = False, prefer_cog: bool = True) -> DataFrame:
    """One row per observation from its first COLOR product by ``pos``: ids, box, centre, spans, times, viewing.

    Order matters: type, box, first row per observation, then antimeridian. ``files`` (path) lists local files; without
    it no product is local. Null edges fail the box and the antimeridian test.
    """
    color = index.where(product_type("product_id") == "COLOR")
    first = keep_first(bbox_filter(color, box).withColumn("_obs", F.trim("observation_id")), ["_obs"], ["pos"])
    first = no_antimeridian(first)
    p, w, e = F.trim("product_id"), normalize_longitude("min_longitude"), normalize_longitude("max_longitude")
    s, n = F.col("min_latitude"), F.col("max_latitude")
    flag = F.upper(F.trim("stereo_flag"))
    out = first.select(
        F.col("_obs").alias("obs_id"), p.alias("product_id"), local_path(root, F.col("file_name_specification")).alias("_jp2"), F.concat(F.lit(f"{root}/images/"), p, F.lit(".tif")).alias("_tif"),
        clean_text("rationale_desc").alias("rationale_desc"), parse_time("start_time").alias("start_time"), parse_time("stop_time").alias("stop_time"),
        w.alias("min_lon"), e.alias("max_lon"), s.alias("min_lat"), n.alias("max_lat"), ((w + e) / 2).alias("centroid_lon"), ((s + n) / 2).alias("centroid_lat"),
        (e - w).alias("lon_span_deg"), (n - s).alias("lat_span_deg"), ((e - w) * (n - s)).alias("bbox_area_deg2"), "image_lines", "line_samples", "map_scale",
        "emission_angle", "incidence_angle", "phase_angle", "local_time", "solar_longitude", "north_azimuth", flag.alias("stereo_flag"), F.coalesce(flag == "YES", F.lit(False)).alias("is_stereo"),
        F.lit(True).alias("has_near_infrared"), F.lit(True).alias("has_red"), F.lit(True).alias("has_blue_green"), F.lit(3).alias("channel_count"),
    )
    if files is None:
        out = out.withColumn("_j", F.lit(None).cast("string")).withColumn("_t", F.lit(None).cast("string"))
    else:
        there = files.select("path").distinct()
        out = out.join(there.select(F.col("path").alias("_jp2"), F.col("path").alias("_j")), "_jp2", "left").join(there.select(F.col("path").alias("_tif"), F.col("path").alias("_t")), "_tif", "left")
    path = image_path(F.col("_j"), F.col("_t"), prefer_cog)
    out = out.withColumns({"image_path": path, "has_local_jp2": F.col("_j").isNotNull(), "has_local_tif": F.col("_t").isNotNull(), "has_local_image": F.coalesce("_j", "_t").isNotNull()})
    out = out.withColumn("image_format", F.lower(F.nullif(F.regexp_extract("image_path", r"\.([^./]*)$", 1), F.lit(""))))
    out = out.drop("_jp2", "_tif", "_j", "_t")
    return (out.where("has_local_image") if require_local else out).orderBy("obs_id")


def observation_metadata(index: DataFrame) -> DataFrame:
    """One row per observation from its COLOR product, else its first: channel flags 3 or 1, times, viewing."""
    obs = product_observation("product_id")
    kind = product_type("product_id")
    first = keep_first(index.withColumn("obs_id", obs).withColumn("_k", F.when(kind == "COLOR", 0).otherwise(1)), ["obs_id"], ["_k", "pos"])
    color = F.col("_k") == 0
    return first.select(
        "obs_id", F.trim("product_id").alias("product_id"), clean_text("rationale_desc").alias("rationale_desc"), color.alias("has_near_infrared"), F.lit(True).alias("has_red"), color.alias("has_blue_green"),
        F.when(color, 3).otherwise(1).alias("channel_count"), "map_scale", "emission_angle", "incidence_angle", "phase_angle", parse_time("start_time").alias("start_time"), (F.upper(F.trim("stereo_flag")) == "YES").alias("is_stereo"),
    )


def observation_groups(index: DataFrame) -> DataFrame:
    """Per observation its number of products, first COLOR and RED file by ``pos``, and times (a missing stop is the start)."""
    kind = product_type("product_id")
    pick = lambda k: F.min_by(F.when(kind == k, F.trim("file_name_specification")), F.when(kind == k, F.col("pos")))
    start = F.min_by(parse_time("start_time"), "pos")
    stop = F.min_by(F.coalesce(parse_time("stop_time"), parse_time("start_time")), "pos")
    return index.groupBy(product_observation("product_id").alias("obs_id")).agg(F.count(F.lit(1)).alias("n_products"), pick("COLOR").alias("color_path"), pick("RED").alias("red_path"), start.alias("t_start"), stop.alias("t_stop"), F.min("pos").alias("first_pos"))


def times_with_epoch(c: str) -> Column:
    """Time, or the epoch where it is missing or unusable."""
    return F.coalesce(parse_time(c), F.lit(EPOCH).cast("timestamp"))


def index_extent(index: DataFrame) -> DataFrame:
    w, e = normalize_longitude("min_longitude"), normalize_longitude("max_longitude")
    return index.agg(F.min(w).alias("min_lon"), F.max(e).alias("max_lon"), F.min("min_latitude").alias("min_lat"), F.max("max_latitude").alias("max_lat"), F.count(F.lit(1)).alias("n"))


def color_capable(df: DataFrame) -> DataFrame:
    """Rows with near-infrared and blue-green channels; no such row is an error only for the caller that needs one."""
    return require(df, "has_near_infrared", "has_blue_green").where("has_near_infrared and has_blue_green")


def color_patches(patches: DataFrame, allowed: DataFrame) -> DataFrame:
    """COLOR-capable patches whose dominant and all contributing observations are among ``allowed`` (obs_id).

    A null list fails, an empty one passes; a null element is no allowed observation.
    """
    ok = allowed.select(F.col("obs_id").alias("_ok")).where("_ok is not null").distinct()
    p = color_capable(require(patches, "patch_id", "dominant_obs_id", "contributing_obs_ids")).where("contributing_obs_ids is not null")
    p = p.join(ok, F.col("dominant_obs_id") == F.col("_ok"), "left_semi")
    each = p.select("patch_id", F.explode("contributing_obs_ids").alias("_obs"))
    bad = each.where("_obs is null").select("patch_id").unionByName(each.join(ok, F.col("_obs") == F.col("_ok"), "left_anti").select("patch_id"))
    return p.join(bad.distinct(), "patch_id", "left_anti")


def coverage_grid(boxes: DataFrame, resolution: float = 1.0, extent: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0), west="min_lon", south="min_lat", east="max_lon", north="max_lat") -> DataFrame:
    """``(row, col, n)``: how many boxes touch each cell. Boxes are clamped to the extent; reversed or null ones touch none."""
    x0, y0, x1, y1 = extent
    nx, ny = round((x1 - x0) / resolution), round((y1 - y0) / resolution)
    lo = lambda c, o, n: F.least(F.greatest(F.floor((F.col(c) - o) / resolution), F.lit(0)), F.lit(n))
    hi = lambda c, o, n: F.least(F.greatest(F.ceil((F.col(c) - o) / resolution), F.lit(0)), F.lit(n))
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))  # noqa: E731  # sequence would count down
    rows = boxes.select(F.explode(span(lo(south, y0, ny), hi(north, y0, ny))).alias("row"), span(lo(west, x0, nx), hi(east, x0, nx)).alias("cols"))
    return rows.select("row", F.explode("cols").alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


def coverage_summary(grid: DataFrame, n_cells: int) -> DataFrame:
    return grid.agg(F.count(F.lit(1)).alias("covered"), F.round(F.count(F.lit(1)) * 100.0 / n_cells, 6).alias("pct"), F.round(F.median("n"), 6).alias("median_n"), F.max("n").alias("max_n"), F.sum("n").alias("total"))


def coverage_marginals(grid: DataFrame) -> DataFrame:
    """Sums per row and per column in one pass (grouping sets)."""
    g = grid.groupingSets([[F.col("row")], [F.col("col")]], "row", "col").agg(F.sum("n").alias("n"))
    axis = F.when(F.col("row").isNotNull(), "row").otherwise("col")
    return g.select(axis.alias("axis"), F.coalesce("row", "col").alias("k"), "n")


def corner_ring(df: DataFrame) -> Column:
    """Ring of the four corners (``corner1_longitude`` ... ``corner4_latitude``), null where one is missing or not a number."""
    pts = [(normalize_longitude(f"corner{k}_longitude"), F.col(f"corner{k}_latitude")) for k in (1, 2, 3, 4)]
    ok = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for p in pts for c in p])
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])
    area = reduce(lambda a, b: a + b, [pts[k][0] * pts[(k + 1) % 4][1] - pts[(k + 1) % 4][0] * pts[k][1] for k in range(4)])
    return F.when(ok & (F.abs(area) > 1e-12), ring)


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north))])
    return F.when((west <= east) & (south <= north), ring)


def best_geometry(*rings: Column) -> Column:
    """First usable ring: hull of pixels, bounds of the file, corners, box."""
    return F.coalesce(*rings)
