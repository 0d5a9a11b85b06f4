"""Seams of mosaics in a tile: straight lines across which brightness or elevation jumps, and what sets them apart.

Fixed values: line length 41, 12 angles, sides 2 pixels away, weights 1 and 0.3, gate 0.1 to 3, and the thresholds below.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from redsift.operators.raster import box_sum, erode

LENGTH, ANGLES, OFFSET = 41, 12, 2
VALID_SHARE, MARGIN, LEAST_PIXELS = 0.6, 4, 100
IMAGE_WEIGHT, ELEVATION_WEIGHT, FLOOR, GATE = 1.0, 0.3, 0.1, (0.1, 3.0)
HOT, DENSE, CLOSING, BRIDGE = 0.25, 15.0, 9, 15
PROFILE, CORE = 50, 12
THRESHOLD = 2.4


def sharp_gradient(a: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Magnitude of forward differences, invalid pixels as zero and the last row and column as level."""
    b = np.where(valid, a, 0.0)
    gx, gy = np.diff(b, axis=1, append=b[:, -1:]), np.diff(b, axis=0, append=b[-1:])
    return np.sqrt(gx * gx + gy * gy + 1e-8)


def line_points(angle: float, shift: float, length: int) -> np.ndarray:
    """Distinct pixels (dy, dx) of a line through the origin moved sideways by ``shift``."""
    t = np.arange(length) - length // 2
    dx, dy = np.cos(angle), np.sin(angle)
    return np.unique(np.column_stack([np.rint(t * dy + shift * dx), np.rint(t * dx - shift * dy)]).astype(int), axis=0)


@lru_cache(maxsize=8)
def _kernels(h: int, w: int) -> tuple[tuple[int, int], int, np.ndarray]:
    """Size and margin of the transforms of a tile, and the transformed kernels: angle by (line, left, right)."""
    points = [[line_points(np.pi * k / ANGLES, s, LENGTH) for s in (0, -OFFSET, OFFSET)] for k in range(ANGLES)]
    r = max(int(np.abs(p).max()) for row in points for p in row)
    shape = (h + 2 * r, w + 2 * r)
    out = np.zeros((ANGLES, 3, *shape))
    for k, row in enumerate(points):
        for j, p in enumerate(row):
            out[k, j, -p[:, 0] % shape[0], -p[:, 1] % shape[1]] = 1.0  # sums over a + point: a correlation
    return shape, r, np.fft.rfft2(out)


def _sums(stack: np.ndarray, angle: int, which: int, size: tuple[int, int]) -> np.ndarray:
    """Sums of transformed layers over the points of a kernel around every pixel; outside counts as zero."""
    shape, _, kernels = _kernels(*size)
    return np.fft.irfft2(stack * kernels[angle, which], s=shape)[:, : size[0], : size[1]]


def _closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation, then erosion by a square of side ``k``; outside takes no part."""
    p = k // 2
    grown = box_sum(np.pad(mask, p), k) > 0
    return box_sum(np.pad(~grown, p), k) == 0


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the regions connected over edges and corners, 0 outside: least labels spread until none changes."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    none = mask.size + 1
    while True:
        b = np.pad(np.where(mask, lab, none), 1, constant_values=none)
        rows = np.minimum(np.minimum(b[:-2], b[1:-1]), b[2:])
        near = np.minimum(np.minimum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
        new = np.where(mask, near, 0)
        new = np.where(mask, new.ravel()[np.maximum(new, 1) - 1], 0)  # the label's own label
        if (new == lab).all():
            return np.unique(lab, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones_like(lab)
        lab = new


def multipliers(heat: np.ndarray, valid: np.ndarray, threshold: float = HOT) -> tuple[float, float]:
    """(span, sparsity): how much of the tile the largest hot region crosses, and how few of its pixels are hot."""
    top = heat.max(initial=0.0)
    if top <= 0:
        return 0.0, 1.0
    hot = heat > top * threshold
    sparsity = float(np.exp(-DENSE * (hot & valid).sum() / max(int(valid.sum()), 1)))
    lab = components(_closed(hot, CLOSING))
    span = 0.0
    for k in range(1, int(lab.max(initial=0)) + 1):
        y, x = np.nonzero(lab == k)
        span = max(span, float(np.hypot(np.ptp(y) + 1, np.ptp(x) + 1)))
    return min(span / max(heat.shape), 1.0), sparsity


def linearity(heat: np.ndarray, threshold: float = HOT, votes: int = 50, least: int = 40, gap: int = 30) -> float:
    """Share of the hot pixels that lie on straight segments: a Hough transform of the outline of the closed hot area, its
    strongest lines first, each cut into runs without gaps. Deterministic, where the usual form draws at random."""
    lo, hi = heat.min(initial=0.0), heat.max(initial=0.0)
    if hi <= lo:
        return 0.0
    hot = (heat - lo) / (hi - lo) > threshold
    area = _closed(hot, BRIDGE)
    y, x = np.nonzero(area & (box_sum(np.pad(~area, 1, constant_values=True), 3) > 0))
    line = np.zeros_like(hot)
    th = np.radians(np.arange(180))
    yy, xx = np.mgrid[: heat.shape[0], : heat.shape[1]]
    while len(y) >= votes:
        rho = np.rint((x[:, None] * np.cos(th) + y[:, None] * np.sin(th)) / 2).astype(int)
        low = int(rho.min())
        table = np.bincount(((rho - low) * 180 + np.arange(180)).ravel(), minlength=1)
        best = int(table.argmax())
        if table[best] < votes:
            break
        k, r = best % 180, best // 180 + low
        on = rho[:, k] == r
        c, s = np.cos(th[k]), np.sin(th[k])
        along = np.sort(y[on] * c - x[on] * s)
        for run in np.split(along, np.flatnonzero(np.diff(along) > gap) + 1):
            if run[-1] - run[0] >= least:
                far, place = np.abs(xx * c + yy * s - 2 * r), yy * c - xx * s
                line |= (far <= 2) & (place >= run[0] - 2) & (place <= run[-1] + 2)
        y, x = y[~on], x[~on]
    return float((hot & line).sum() / max(int(hot.sum()), 1))


def isolation(score: np.ndarray, valid: np.ndarray, y: int, x: int, angle: float) -> float:
    """Peak of a profile across the line over the mean of what lies beside it; 5 if nothing does, 20 if that is zero."""
    h, w = score.shape
    t = np.arange(-PROFILE, PROFILE + 1, dtype=float)
    px, py = x - t * np.sin(angle), y + t * np.cos(angle)
    ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    t, px, py = t[ok], px[ok], py[ok]
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    fx, fy = px - x0, py - y0
    pad = np.pad(score, ((0, 1), (0, 1)))  # beyond the last pixel counts as zero
    value = (pad[y0, x0] * (1 - fx) + pad[y0, x0 + 1] * fx) * (1 - fy) + (pad[y0 + 1, x0] * (1 - fx) + pad[y0 + 1, x0 + 1] * fx) * fy
    use = valid[np.minimum(np.rint(py).astype(int), h - 1), np.minimum(np.rint(px).astype(int), w - 1)]
    core, rest = use & (np.abs(t) <= CORE), use & (np.abs(t) > CORE)
    if not core.any():
        return 0.0
    if not rest.any():
        return 5.0
    around = float(value[rest].mean())
    return 20.0 if around < 1e-6 else float(value[core].max()) / around


def detect_seam(image: np.ndarray, elevation: np.ndarray, valid: np.ndarray) -> dict:
    """The strongest seam of a tile: gradients along a line, relative to the tile's, times the gated jump between the
    sides of the line (Cohen's d of brightness or elevation); the composite also weighs span, sparsity, linearity and
    isolation. Too few valid pixels or lines give zeros and the middle of the tile."""
    valid = valid & np.isfinite(image) & np.isfinite(elevation)
    image, elevation = np.where(valid, image, 0.0), np.where(valid, elevation, 0.0)
    h, w = image.shape
    out = {"seam": 0.0, "image_score": 0.0, "elevation_score": 0.0, "cohens_d": 0.0, "angle": 0.0, "row": h // 2, "col": w // 2, "span": 0.0, "sparsity": 0.0, "linearity": 0.0, "isolation": 0.0, "composite": 0.0, "is_seam": False}
    deep = erode(valid, MARGIN)
    if deep.sum() < LEAST_PIXELS:
        return out
    f = deep.astype(float)
    gi, ge = sharp_gradient(image, valid), sharp_gradient(elevation, valid)
    base = [max(float((g * f).sum() / f.sum()), 1e-6) for g in (gi, ge)]
    floor = [FLOOR * max(float(a[valid].std(ddof=1)), 1e-4) for a in (image, elevation)]
    # values are taken from their means, which moves no difference and keeps the sums of squares exact
    image, elevation = (np.where(valid, a - a[valid].mean(), 0.0) for a in (image, elevation))
    lines = np.fft.rfft2(np.stack([f, gi * f, ge * f]), s=_kernels(h, w)[0])
    sides = np.fft.rfft2(np.stack([f, image * f, image**2 * f, elevation * f, elevation**2 * f]), s=_kernels(h, w)[0])
    scores, parts = [], []
    for k in range(ANGLES):
        n, *g = _sums(lines, k, 0, (h, w))
        left, right = (_sums(sides, k, j, (h, w)) for j in (1, 2))
        n, left[0], right[0] = np.rint(n), np.rint(left[0]), np.rint(right[0])  # numbers of pixels
        jumps = []
        for c, least in zip((1, 3), floor, strict=True):
            mean = [s[c] / np.maximum(s[0], 1) for s in (left, right)]
            var = [np.maximum(s[c + 1] / np.maximum(s[0], 1) - m * m, 0) for s, m in zip((left, right), mean, strict=True)]
            jumps.append(np.abs(mean[0] - mean[1]) / (np.sqrt((var[0] + var[1]) / 2) + least))
        ok = (n >= VALID_SHARE * LENGTH) & (np.minimum(left[0], right[0]) >= VALID_SHARE * LENGTH / 2)
        a, b = (x / np.maximum(n, 1) / y for x, y in zip(g, base, strict=True))
        total = (IMAGE_WEIGHT * a + ELEVATION_WEIGHT * b) * np.clip(np.maximum(*jumps), *GATE)
        scores.append(np.where(ok, total, -np.inf))
        parts.append([np.where(ok, v, -np.inf).max() for v in (a, b)] + [np.where(ok, jumps[0], 0).max()])
    score = np.stack(scores)
    if not np.isfinite(score).any():
        return out
    k, y, x = np.unravel_index(int(score.argmax()), score.shape)
    best = score.max(axis=0)
    heat = np.where(best > 0, best, 0.0)
    a, b, d = np.max(parts, axis=0)
    span, sparsity = multipliers(heat, deep)
    line, alone = linearity(heat), isolation(np.where(np.isfinite(best), best, -1e10), deep, int(y), int(x), np.pi * k / ANGLES)
    seam = float(score.max())
    composite = seam * (0.5 + 0.5 * span) * sparsity * line * min(max((alone - 1.5) / 1.5, 0.0), 1.0)
    return out | {"seam": seam, "image_score": float(a), "elevation_score": float(b), "cohens_d": float(d), "angle": float(np.pi * k / ANGLES), "row": int(y), "col": int(x), "span": span, "sparsity": sparsity, "linearity": line, "isolation": alone, "composite": composite, "is_seam": composite > THRESHOLD}


SEAM = "seam double, image_score double, elevation_score double, cohens_d double, angle double, row int, col int, span double, sparsity double, linearity double, isolation double, composite double, is_seam boolean, error string"
