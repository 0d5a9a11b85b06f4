"""Polygon kernels in numpy and their operators. Rings are arrays of points without a repeated end; footprints are
convex (hulls of pixels), which every clip and sweep below relies on. A ring that is not convex is replaced by its hull."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redsift.session import parallelism


def area(ring: np.ndarray) -> float:
    """Signed area, positive counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def centroid(ring: np.ndarray) -> tuple[float, float]:
    x, y = (ring - ring[0]).T
    c = x * np.roll(y, -1) - np.roll(x, -1) * y
    a = c.sum() / 2
    if abs(a) < 1e-300:
        return tuple(ring.mean(axis=0))
    return float(ring[0, 0] + ((x + np.roll(x, -1)) * c).sum() / (6 * a)), float(ring[0, 1] + ((y + np.roll(y, -1)) * c).sum() / (6 * a))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise (monotone chain); fewer than three corners give an empty ring."""
    p = np.unique(points[np.isfinite(points).all(axis=1)], axis=0)
    if len(p) < 3:
        return np.zeros((0, 2))

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(chain(p) + chain(p[::-1]))
    return ring if len(ring) > 2 and area(ring) > 1e-12 else np.zeros((0, 2))


def clip_areas(ring: np.ndarray, west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> np.ndarray:
    """Area of a convex ring within each of many rectangles.

    Seen from the left, the ring lies between a lower and an upper chain, both piecewise linear in x. Between the
    abscissae at which either chain bends or meets an edge of the rectangle, the clipped height is linear, so the area is
    a sum of trapezoids.
    """
    ring = ring if area(ring) > 0 else ring[::-1]
    n = len(west)
    if len(ring) < 3:
        return np.zeros(n)
    left, right = int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), int(np.lexsort((-ring[:, 1], -ring[:, 0]))[0])
    k = len(ring)
    lower = ring[[(left + i) % k for i in range((right - left) % k + 1)]]
    upper = ring[[(right + i) % k for i in range((left - right) % k + 1)]][::-1]
    lower, upper = [c[np.concatenate([[True], np.diff(c[:, 0]) > 0])] if len(c) > 1 else c for c in (_vertical(lower, False), _vertical(upper, True))]
    x0, x1 = np.maximum(west, ring[:, 0].min()), np.minimum(east, ring[:, 0].max())
    knots = [np.broadcast_to(v, (n, 1)) for v in np.unique(ring[:, 0])]
    for c in (lower, upper):  # where a chain meets the bottom or top of a rectangle
        for a, b in zip(c[:-1], c[1:], strict=True):
            if abs(b[1] - a[1]) > 0:
                for level in (south, north):
                    t = (level - a[1]) / (b[1] - a[1])
                    knots.append(np.where((t > 0) & (t < 1), a[0] + t * (b[0] - a[0]), x0)[:, None])
    xs = np.sort(np.clip(np.concatenate([*knots, x0[:, None], x1[:, None]], axis=1), x0[:, None], np.maximum(x1, x0)[:, None]), axis=1)
    h = np.maximum(np.minimum(np.interp(xs, *upper.T), north[:, None]) - np.maximum(np.interp(xs, *lower.T), south[:, None]), 0)
    # a height that is cut off at zero within a step ends at a knot, as both bounds are knots there
    out = ((h[:, 1:] + h[:, :-1]) / 2 * np.diff(xs, axis=1)).sum(axis=1)
    return np.where(x1 > x0, out, 0.0)


def _vertical(chain: np.ndarray, top: bool) -> np.ndarray:
    """A chain with one point per abscissa: of a vertical side the inner end for the lower chain is its lowest, for the
    upper its highest."""
    out: dict[float, float] = {}
    for x, y in chain:
        out[x] = max(out.get(x, y), y) if top else min(out.get(x, y), y)
    return np.array(sorted(out.items()))


def union_area(west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> float:
    """Area of the union of rectangles: a sweep over compressed coordinates."""
    if not len(west):
        return 0.0
    xs, ys = np.unique(np.concatenate([west, east])), np.unique(np.concatenate([south, north]))
    grid = np.zeros((len(xs), len(ys)), dtype=np.int32)
    a, b, c, d = (np.searchsorted(xs, west), np.searchsorted(xs, east), np.searchsorted(ys, south), np.searchsorted(ys, north))
    for i, j, s in ((a, c, 1), (b, d, 1), (a, d, -1), (b, c, -1)):
        np.add.at(grid, (i, j), s)
    inside = grid.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0
    return float((inside * np.diff(xs)[:, None] * np.diff(ys)[None, :]).sum())


def patch_size(size: float | tuple[float, float]) -> tuple[float, float]:
    """(height, width)."""
    return (float(size[0]), float(size[1])) if isinstance(size, (tuple, list)) else (float(size), float(size))


def shares(ring: np.ndarray, x: np.ndarray, y: np.ndarray, size: float | tuple[float, float]) -> np.ndarray:
    """Share of a patch's area inside the ring, for many centres."""
    h, w = patch_size(size)
    return clip_areas(ring, x - w / 2, y - h / 2, x + w / 2, y + h / 2) / (h * w)


def valid_centres(ring: np.ndarray, size: float | tuple[float, float], overlap: float, rays: int = 3) -> np.ndarray:
    """Ring of the centres whose patch keeps at least ``overlap`` of its area inside, empty if there is none.

    Rays from the centroid through each corner and ``rays`` directions between are bisected at once, to 2^-42 of their
    length; the inner end is kept, so the guarantee holds.
    """
    if not 0 <= overlap <= 1:
        raise ValueError("overlap must be within [0, 1]")
    h, w = patch_size(size)
    if h <= 0 or w <= 0:
        raise ValueError("patch size must be positive")
    if len(ring) < 3:
        return np.zeros((0, 2))
    c = np.array(centroid(ring))
    if shares(ring, c[:1], c[1:], size)[0] < overlap:
        return np.zeros((0, 2))
    corner = np.sort(np.arctan2(*(ring - c).T[::-1]) % (2 * np.pi))
    gap = np.diff(np.append(corner, corner[0] + 2 * np.pi))
    angle = np.unique((corner[:, None] + gap[:, None] * np.arange(rays + 1) / (rays + 1)).ravel() % (2 * np.pi))
    step = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    lo, hi = np.zeros(len(angle)), np.full(len(angle), np.linalg.norm(ring - c, axis=1).max() + np.hypot(h, w))
    for _ in range(42):
        mid = (lo + hi) / 2
        at = c + step * mid[:, None]
        ok = shares(ring, at[:, 0], at[:, 1], size) >= overlap
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
    return hull(c + step * lo[:, None])


def _spans(ring: np.ndarray, at: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chord of a convex ring at each coordinate of an axis (0: at x, chords in y); NaN outside."""
    a, b = ring, np.roll(ring, -1, axis=0)
    p, q = a[:, axis][None, :], b[:, axis][None, :]
    t = np.divide(at[:, None] - p, q - p, out=np.full((len(at), len(a)), np.nan), where=q != p)
    other = a[:, 1 - axis] + t * (b[:, 1 - axis] - a[:, 1 - axis])
    hit = (t >= 0) & (t <= 1)
    flat = (p == q) & (np.abs(at[:, None] - p) <= 0)  # a side along the sweep
    lo = np.where(hit, other, np.inf).min(axis=1)
    hi = np.where(hit, other, -np.inf).max(axis=1)
    ends = np.stack([a[:, 1 - axis], b[:, 1 - axis]])
    lo = np.minimum(lo, np.where(flat, ends.min(axis=0), np.inf).min(axis=1))
    hi = np.maximum(hi, np.where(flat, ends.max(axis=0), -np.inf).max(axis=1))
    return np.where(lo <= hi, lo, np.nan), np.where(lo <= hi, hi, np.nan)


def pack_strips(region: np.ndarray, size: float | tuple[float, float], overlap: float = 0.0, phases: int = 20) -> np.ndarray:
    """Most centres of rows or columns a stride apart, each filled on its own; the first best phase, rows before columns."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be within [0, 1)")
    if len(region) < 3:
        return np.zeros((0, 2))
    h, w = patch_size(size)
    stride = (w * (1 - overlap), h * (1 - overlap))
    best = np.zeros((0, 2))
    for axis, across, along in ((1, stride[1], stride[0]), (0, stride[0], stride[1])):
        lo, hi = region[:, axis].min(), region[:, axis].max()
        for k in range(phases):
            at = lo + across * k / phases + across * np.arange(int(max(0.0, hi - lo - across * k / phases) / across) + 1)
            at = at[at <= hi]
            a, b = _spans(region, at, axis)
            ok = np.isfinite(a)
            at, a, b = at[ok], a[ok], b[ok]
            n = np.floor((b - a) / along).astype(int) + 1
            if n.sum() > len(best):
                first = a + ((b - a) - (n - 1) * along) / 2
                of = np.repeat(np.arange(len(at)), n)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                best = np.stack([first[of] + i * along, at[of]] if axis == 1 else [at[of], first[of] + i * along], axis=1)
    return best


def pack_grid(region: np.ndarray, size: float | tuple[float, float], overlap: float = 0.0, phases: int = 10) -> np.ndarray:
    """Most centres of one rigid grid over its phases in both directions."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be within [0, 1)")
    if len(region) < 3:
        return np.zeros((0, 2))
    h, w = patch_size(size)
    sx, sy = w * (1 - overlap), h * (1 - overlap)
    (x0, y0), (x1, y1) = region.min(axis=0), region.max(axis=0)
    best = np.zeros((0, 2))
    for i in range(phases):
        ys = np.arange(y0 + sy * i / phases, y1 + 1e-12, sy)
        a, b = _spans(region, ys, 1)
        for j in range(phases):
            xs = np.arange(x0 + sx * j / phases, x1 + 1e-12, sx)
            inside = (xs[None, :] >= a[:, None]) & (xs[None, :] <= b[:, None])
            if inside.sum() > len(best):
                r, c = np.nonzero(inside)
                best = np.stack([xs[c], ys[r]], axis=1)
    return best


def simple_centres(ring: np.ndarray, size: float | tuple[float, float], stride: float | tuple[float, float], overlap: float) -> np.ndarray:
    """Grid centres over the inset bounding box whose patch shares more than ``overlap`` with the ring."""
    h, w = patch_size(size)
    sy, sx = patch_size(stride)
    (x0, y0), (x1, y1) = ring.min(axis=0), ring.max(axis=0)
    g = np.meshgrid(np.arange(x0 + w / 2, x1 - w / 2 + 1e-12, sx), np.arange(y0 + h / 2, y1 - h / 2 + 1e-12, sy))
    x, y = g[0].ravel(), g[1].ravel()
    keep = shares(ring, x, y, size) > overlap if len(x) else np.zeros(0, dtype=bool)
    return np.stack([x[keep], y[keep]], axis=1)


# ---------------------------------------------------------------- operators over tables of rings


def _ring(value) -> np.ndarray:
    r = np.array([(p["x"], p["y"]) for p in (value if value is not None else [])], dtype=float).reshape(-1, 2)
    return hull(r)


def strip_centres(strips: DataFrame, size: float | tuple[float, float], overlap: float = 0.5, mode: str = "optimal", patch_overlap: float = 0.0, phases: int = 20, rays: int = 3) -> DataFrame:
    """``(id, k, cx, cy, share, reason)`` from ``(id, ring array<struct<x,y>>)``: the centres of each strip.

    optimal packs the region of valid centres (share >= overlap), simple takes a grid (share > overlap); a strip for
    which packing finds nothing falls back to simple. A strip without a usable ring or centre gives one row with null
    centre and its reason. Strips are independent; they are spread evenly first.
    """
    if mode not in ("simple", "optimal"):
        raise ValueError(f"unknown mode {mode!r}")
    h, w = patch_size(size)
    kind = dict(strips.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, value in zip(pdf["id"], pdf["ring"], strict=True):
                ring, reason = _ring(value), mode
                c = np.zeros((0, 2))
                if len(ring) < 3:
                    reason = "no footprint"
                elif mode == "optimal":
                    c = pack_strips(valid_centres(ring, size, overlap, rays), size, patch_overlap, phases)
                if len(ring) > 2 and not len(c):
                    c = simple_centres(ring, size, (h * (1 - patch_overlap), w * (1 - patch_overlap)), overlap)
                    reason = "simple" if len(c) else "no centre"
                n = max(1, len(c))
                yield pd.DataFrame({"id": [i] * n, "k": range(n), "cx": c[:, 0] if len(c) else [None], "cy": c[:, 1] if len(c) else [None], "share": shares(ring, c[:, 0], c[:, 1], size) if len(c) else [None], "reason": reason})

    # packing costs far more than moving a ring
    spread = strips.select("id", "ring").repartition(4 * parallelism(strips.sparkSession), "id")
    return spread.mapInPandas(run, f"id {kind}, k int, cx double, cy double, share double, reason string")


def ring_overlaps(pairs: DataFrame) -> DataFrame:
    """``pairs`` (ring, west, south, east, north) with ``area``: of the ring inside the window, null without a ring."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, *box in zip(pdf["ring"], pdf["west"], pdf["south"], pdf["east"], pdf["north"], strict=True):
                r = _ring(value)
                out.append(float(clip_areas(r, *[np.array([float(v)]) for v in box])[0]) if len(r) > 2 else None)
            yield pdf.drop(columns="ring").assign(area=pd.Series(out, index=pdf.index, dtype="float64"))

    rest = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes if c != "ring")
    return pairs.mapInPandas(run, f"{rest}, area double")


def ortho_overlap(pairs: DataFrame) -> DataFrame:
    """``pairs`` (ring, west, south, east, north, present, placed) with ``overlap``: the share of the ring's area that the
    image's box covers. The box's longitudes are brought to [-180, 180); one that then runs backward crosses that meridian
    and counts as two. No file or no area gives 0, a file without a reference system 1."""
    kept = [c for c in pairs.columns if c not in ("ring", "west", "south", "east", "north")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, w, s, e, n, there, placed in zip(*(pdf[c] for c in ("ring", "west", "south", "east", "north", "present", "placed")), strict=True):
                ring = _ring(value)
                whole = abs(area(ring)) if len(ring) > 2 else 0.0
                if not there or pd.isna(there):
                    out.append(0.0)
                elif not placed or pd.isna(placed):
                    out.append(1.0)
                elif whole == 0 or pd.isna([w, s, e, n]).any():
                    out.append(0.0)
                else:
                    w, e = ((float(v) + 180) % 360 - 180 for v in (w, e))
                    spans = [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
                    a, b = (np.array([x[k] for x in spans]) for k in (0, 1))
                    out.append(float(clip_areas(ring, a, np.full(len(a), float(s)), b, np.full(len(a), float(n))).sum()) / whole)
            yield pdf[kept].assign(overlap=pd.Series(out, index=pdf.index, dtype="float64"))

    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "overlap double"]))


def coverage_stats(centres: DataFrame, size: float | tuple[float, float]) -> DataFrame:
    """``(id, n, covered, total)`` per strip: centres, area of the union of their patches, summed area.

    Patches of one strip are bounded by its footprint, so a strip is a group of bounded size."""
    h, w = patch_size(size)
    kind = dict(centres.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.dropna(subset=["cx", "cy"])
        x, y = c["cx"].to_numpy(), c["cy"].to_numpy()
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "n": [len(c)], "covered": [union_area(x - w / 2, y - h / 2, x + w / 2, y + h / 2)], "total": [len(c) * h * w]})

    return centres.groupBy("id").applyInPandas(run, f"id {kind}, n long, covered double, total double")


def compared(strips: DataFrame, size: float | tuple[float, float], overlap: float = 0.5, patch_overlap: float = 0.0) -> DataFrame:
    """``(id, simple_n, optimal_n, gain_pct, simple_covered, optimal_covered)``: both ways to place centres, per strip."""
    sides = []
    for mode in ("simple", "optimal"):
        got = coverage_stats(strip_centres(strips, size, overlap, patch_overlap=patch_overlap, mode=mode), size)
        sides.append(got.select("id", F.col("n").alias(f"{mode}_n"), F.round("covered", 9).alias(f"{mode}_covered")))
    gain = (F.col("optimal_n") - F.col("simple_n")) / F.greatest(F.col("simple_n"), F.lit(1)) * 100
    return sides[0].join(sides[1], "id").select("id", "simple_n", "optimal_n", F.round(gain, 6).alias("gain_pct"), "simple_covered", "optimal_covered")


def synthetic_strips(n: int = 8, seed: int = 0, length: tuple[float, float] = (18.0, 35.0), width: tuple[float, float] = (3.0, 6.0), turn: tuple[float, float] = (-45.0, 45.0), chamfer: bool = True) -> list[list[tuple[float, float]]]:
    """Seeded rectangles turned about the origin, every second corner cut if ``chamfer``: fixtures for the packers."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b, th = rng.uniform(*length) / 2, rng.uniform(*width) / 2, np.radians(rng.uniform(*turn))
        corners = [(-a, -b), (a, -b), (a, b), (-a, b)]
        if chamfer:
            c = 0.3 * b
            corners = [(-a + c, -b), (a - c, -b), (a, -b + c), (a, b - c), (a - c, b), (-a + c, b), (-a, b - c), (-a, -b + c)]
        out.append([(float(x * np.cos(th) - y * np.sin(th)), float(x * np.sin(th) + y * np.cos(th))) for x, y in corners])
    return out
