"""Longitudes, feature vectors and coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_longitude(c: Column | str) -> Column:
    """Longitude in [-180, 180), by floored modulo: 180 becomes -180."""
    return F.pmod(_c(c) + 180.0, F.lit(360.0)) - 180.0


def cyclic(c: Column | str, period: float) -> list[Column]:
    angle = _c(c) * (2.0 * math.pi / period)
    return [F.sin(angle), F.cos(angle)]


def geo_features() -> Column:
    """Eight location features of a footprint row (min/max/centroid columns)."""
    scaled = [F.col(c) / k for c, k in (("min_lon", 180.0), ("max_lon", 180.0), ("min_lat", 90.0), ("max_lat", 90.0))]
    return F.array(*cyclic(F.col("centroid_lon") + 180.0, 360.0), *cyclic(F.col("centroid_lat") + 90.0, 180.0), *scaled)


def scale_features() -> Column:
    """Eight size features; lines and samples count as at least one."""
    lines, samples = [F.greatest(F.lit(1.0), F.col(c).cast("double")) for c in ("image_lines", "line_samples")]
    return F.array(F.col("map_scale"), F.col("map_resolution"), F.log1p(lines), F.log1p(samples), F.col("lon_span_deg"), F.col("lat_span_deg"), F.col("bbox_area_deg2"), samples / lines)


def viewing_features(extra: bool = True) -> Column:
    """Thirteen viewing features; with ``extra`` false, those of the columns every index has (ten)."""
    angles = [F.col(c) / 180.0 for c in ("emission_angle", "incidence_angle", "phase_angle")]
    turns = [*cyclic("local_time", 24.0), *cyclic("solar_longitude", 360.0), *(cyclic("sub_solar_azimuth", 360.0) if extra else []), *cyclic("north_azimuth", 360.0)]
    stereo = F.when(F.upper(F.trim("stereo_flag")) == "YES", 1.0).otherwise(0.0)
    return F.array(*angles, *turns, *([F.col("spacecraft_altitude")] if extra else []), stereo)


def patch_scale_features() -> Column:
    """Eight scale features of a patch joined to its observation; spans count as at least 1e-12."""
    lon, lat = [F.greatest(F.lit(1e-12), F.col(c)) for c in ("patch_lon_span_deg", "patch_lat_span_deg")]
    return F.array(F.col("map_scale"), F.col("map_resolution"), lon, lat, F.col("patch_area_deg2"), F.col("dominant_overlap_fraction"), F.col("source_obs_count").cast("double"), lon / lat)


def scale_encoding(c: Column | str, dim: int) -> Column:
    """Sine and cosine of a value at ``dim // 2`` geometric frequencies from 1 to 1e4."""
    half = dim // 2
    freq = [math.exp(-math.log(10000.0) * k / max(half - 1, 1)) for k in range(half)]
    v = _c(c)
    return F.array(*[F.sin(v * f) for f in freq], *[F.cos(v * f) for f in freq])


def obs_centre(west: str, east: str, south: str, north: str) -> list[Column]:
    """Mid longitude (of the closed box as given) and mid latitude."""
    return [((F.col(west) + F.col(east)) / 2).alias("mid_lon"), ((F.col(south) + F.col(north)) / 2).alias("mid_lat")]


def closed_overlap(box: tuple[float, float, float, float], west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed rectangles meet; no wrap-around."""
    w, s, e, n = box
    return (west <= e) & (east >= w) & (south <= n) & (north >= s)
