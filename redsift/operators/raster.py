"""Kernels on dense tiles in numpy, and the operator that maps them over rows.

A tile is a row with ``height``, ``width`` and flat row-major arrays. Kernels take two-dimensional arrays and a mask of
valid pixels; a tile is one row's size, so a map needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_tiles(df: DataFrame, arrays: list[str], kernel: Callable[..., dict], schema: str, keep: list[str] | None = None) -> DataFrame:
    """One row per tile: the ``keep`` columns and what ``kernel(*arrays)`` returns by name, each array two-dimensional.

    ``error`` (string) must be in the schema: a failing kernel gives nulls and its message, so one bad tile stops
    nothing. Null arrays fail alike.
    """
    keep = keep or [c for c in df.columns if c not in (*arrays, "height", "width")]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                out = dict.fromkeys(names) | {k: r[k] for k in keep}
                try:
                    tiles = [np.asarray(r[a], dtype=bool if kinds[a] == "array<boolean>" else float).reshape(int(r["height"]), int(r["width"])) for a in arrays]
                    got = kernel(*tiles)
                    out |= {k: (v.ravel().tolist() if isinstance(v, np.ndarray) else v) for k, v in got.items()}
                except Exception as e:  # noqa: BLE001
                    out["error"] = f"{type(e).__name__}: {e}"
                rows.append(out)
            yield pd.DataFrame(rows, columns=[*keep, *names])

    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return df.select(*keep, "height", "width", *arrays).mapInPandas(run, f"{kept}, {schema}" if kept else schema)


# ---------------------------------------------------------------- stencils


def _shift(a: np.ndarray, dy: int, dx: int, mode: str = "edge") -> np.ndarray:
    """a moved so that out[i, j] = a[i + dy, j + dx]."""
    p = max(abs(dy), abs(dx))
    b = np.pad(a, p, mode="edge") if mode == "edge" else np.pad(a, p)
    return b[p + dy : p + dy + a.shape[0], p + dx : p + dx + a.shape[1]]


def _around(a: np.ndarray, mode: str = "edge"):
    """(dy, dx) -> a moved by at most one pixel; the border is made once."""
    b = np.empty((a.shape[0] + 2, a.shape[1] + 2), dtype=a.dtype)
    b[1:-1, 1:-1] = a
    if mode == "edge":
        b[0, 1:-1], b[-1, 1:-1] = a[0], a[-1]
        b[:, 0], b[:, -1] = b[:, 1], b[:, -2]
    else:
        b[0], b[-1], b[:, 0], b[:, -1] = 0, 0, 0, 0
    return lambda dy, dx: b[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]


def box_sum(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over all k x k windows inside the tile, by an integral image."""
    s = np.pad(a.astype(float).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def erode(valid: np.ndarray, radius: int = 1) -> np.ndarray:
    """Valid pixels without an invalid one in the square around; outside counts as valid."""
    bad = np.pad(~valid, radius)
    return box_sum(bad, 2 * radius + 1) == 0


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives along x and y, edges replicated."""
    at = _around(a)
    s = {(i, j): at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    gx = (s[-1, 1] + 2 * s[0, 1] + s[1, 1] - s[-1, -1] - 2 * s[0, -1] - s[1, -1]) / 8
    gy = (s[1, -1] + 2 * s[1, 0] + s[1, 1] - s[-1, -1] - 2 * s[-1, 0] - s[-1, 1]) / 8
    return gx, gy


def sobel_magnitude(a: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return np.where(valid, np.hypot(*gradients(np.where(valid, a, 0.0))), 0.0)


def forward_magnitude(a: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """One-pixel differences; zero where either pixel is invalid."""
    dx, dy = _shift(a, 0, 1) - a, _shift(a, 1, 0) - a
    return np.where(valid & _shift(valid, 0, 1) & _shift(valid, 1, 0), np.hypot(dx, dy), 0.0)


def laplacian(a: np.ndarray) -> np.ndarray:
    """Five-point Laplacian, zero outside."""
    at = _around(a, "zero")
    return at(0, 1) + at(0, -1) + at(1, 0) + at(-1, 0) - 4 * a


def smooth(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Separable Gaussian to four deviations, edges reflected."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if x == axis else (0, 0) for x in (0, 1)]
        a = np.apply_along_axis(np.convolve, axis, np.pad(a, pad, mode="symmetric"), k, mode="valid")
    return a


# ---------------------------------------------------------------- planes, artefacts, quality


def plane(a: np.ndarray, valid: np.ndarray, least: int = 10) -> tuple[float, float, float]:
    """Least-squares plane over coordinates in [-1, 1]; below ``least`` pixels the mean."""
    n = int(valid.sum())
    if n < least:
        return 0.0, 0.0, float(a[valid].mean()) if n else 0.0
    y, x = np.meshgrid(np.linspace(-1, 1, a.shape[0]), np.linspace(-1, 1, a.shape[1]), indexing="ij")
    p, *_ = np.linalg.lstsq(np.stack([x[valid], y[valid], np.ones(n)], axis=1), a[valid], rcond=None)
    return tuple(map(float, p))


def plane_values(p: tuple[float, float, float], shape: tuple[int, int]) -> np.ndarray:
    y, x = np.meshgrid(np.linspace(-1, 1, shape[0]), np.linspace(-1, 1, shape[1]), indexing="ij")
    return p[0] * x + p[1] * y + p[2]


def detrended(a: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Absolute residuals of the valid pixels."""
    return np.abs(a - plane_values(plane(a, valid, 3), a.shape))[valid]


def topographic_residual(a: np.ndarray, valid: np.ndarray) -> float:
    r = detrended(a, valid)
    return float(np.sqrt(np.mean(r * r))) if len(r) else 0.0


def tin_score(a: np.ndarray, valid: np.ndarray, k: int = 32) -> float:
    """Greatest share of flat curvature in a k x k window that is at least half valid; 0 without one."""
    k = min(k, *a.shape)
    deep = erode(valid)
    flat = (np.abs(laplacian(np.where(valid, a, 0.0))) < 1e-2) & deep
    good = box_sum(deep, k) / (k * k)
    ok = good >= 0.5
    return float((box_sum(flat, k)[ok] / (k * k) / np.maximum(good[ok], 1e-6)).max()) if ok.any() else 0.0


def sun_vector(elevation: np.ndarray, image: np.ndarray, valid: np.ndarray, robust: bool = False, rounds: int = 15) -> dict:
    """Sun direction, intensity and ambient light by regressing brightness on surface normals.

    Plain: least squares with a constant, without the darkest 5 %. Robust: ambient is the 1st percentile, Huber weights,
    upward light. Fewer than 100 pixels give a default.
    """
    default = {"sun_x": 0.4082483, "sun_y": -0.4082483, "sun_z": 0.8164966, "intensity": 1.0, "ambient": 0.3}
    if valid.sum() < 100:
        return default
    gx, gy = gradients(elevation)
    s = max(elevation.shape) / 2
    n = np.stack([-gx * s, -gy * s, np.ones_like(gx)], axis=-1)
    n /= np.linalg.norm(n, axis=-1, keepdims=True)
    use = valid & (image > np.quantile(image[valid], 0.05)) if not robust else valid
    if use.sum() < 100:
        return default
    a, y = n[use], image[use]
    if not robust:
        k, *_ = np.linalg.lstsq(np.column_stack([a, np.ones(len(a))]), y, rcond=None)
        light, ambient = k[:3], float(k[3])
    else:
        ambient = float(np.quantile(y, 0.01))
        w, light = np.ones(len(y)), np.zeros(3)
        for _ in range(rounds):
            q = np.sqrt(w)[:, None]
            new, *_ = np.linalg.lstsq(a * q, (y - ambient) * q[:, 0], rcond=None)
            r = np.abs(y - ambient - a @ new)
            sc = 1.4826 * np.median(r) + 1e-9
            w = np.minimum(1, 1.345 * sc / np.maximum(r, 1e-12))
            done = np.linalg.norm(new - light) < 1e-4
            light = new
            if done:
                break
        light[2] = max(light[2], 0)
    size = float(np.linalg.norm(light))
    u = light / size if size > 1e-12 else np.array([0, 0, 1.0])
    return {"sun_x": float(u[0]), "sun_y": float(u[1]), "sun_z": float(u[2]), "intensity": size, "ambient": ambient}


def patch_quality(elevation: np.ndarray, image: np.ndarray, valid: np.ndarray) -> dict:
    """Quality of one patch: valid share, residual, flat-triangle score, sun vector."""
    valid = valid & np.isfinite(elevation) & np.isfinite(image)
    e, i = np.where(valid, elevation, 0.0), np.where(valid, image, 0.0)
    return {"is_valid": bool(valid.any()), "valid_ratio": float(valid.mean()), "residual": topographic_residual(e, valid), "is_tin": tin_score(e, valid)} | sun_vector(e, i, valid, robust=True)


QUALITY = "is_valid boolean, valid_ratio double, residual double, is_tin double, sun_x double, sun_y double, sun_z double, intensity double, ambient double, error string"


# ---------------------------------------------------------------- filling


def nearest_fill(a: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Invalid pixels get the value of the nearest valid one: exact distances, a pass per axis over the lower envelope
    of columns (rows of a column's nearest valid pixel)."""
    if valid.all() or not valid.any():
        return a.copy()
    h, w = a.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(valid, rows, -(10**6)), axis=0)
    down = np.minimum.accumulate(np.where(valid, rows, 10**6)[::-1], axis=0)[::-1]
    near = np.where(rows - up <= down - rows, up, down)
    d2 = (near - rows).astype(float) ** 2
    cols = np.arange(w)
    cost = d2[:, None, :] + (cols[:, None] - cols[None, :])[None] ** 2  # row, target column, source column
    src = cost.argmin(axis=2)
    r = np.clip(np.take_along_axis(near, src, axis=1), 0, h - 1)
    return np.where(valid, a, a[r, src])


def diffusion_fill(a: np.ndarray, valid: np.ndarray, rounds: int = 64, radius: int = 2) -> np.ndarray:
    """Invalid pixels start at the mean and are blurred 3 x 3 while the safely valid ones stay."""
    keep = erode(valid, radius) if erode(valid, radius).any() else valid
    if not keep.any():
        return a.copy()
    out = np.where(keep, a, a[keep].mean())
    for _ in range(rounds):
        at = _around(out)
        rows = at(-1, 0) + out + at(1, 0)
        side = _around(rows)
        blur = (side(0, -1) + rows + side(0, 1)) / 9
        out = np.where(keep, a, blur)
    return out


def harmonic_fill(a: np.ndarray, valid: np.ndarray, connectivity: int = 4, nugget: float = 1e-6, rounds: int = 2000) -> np.ndarray:
    """Smoothest filling: the graph Laplacian of the grid solved on invalid pixels by conjugate gradients."""
    if valid.all() or not valid.any():
        return a.copy()
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    degree = sum(_shift(np.ones_like(a, dtype=float), *s, "zero") for s in steps) + nugget
    free = ~valid

    def apply(x: np.ndarray) -> np.ndarray:
        at = _around(x, "zero")
        return np.where(free, degree * x - sum(at(*s) for s in steps), 0.0)

    known = np.where(valid, a, 0.0)
    b = np.where(free, sum(_shift(known, *s, "zero") for s in steps), 0.0)
    x = np.where(free, known[valid].mean(), 0.0)
    r = b - apply(x)
    p, rr = r.copy(), float((r * r).sum())
    scale = max(float((b * b).sum()), 1e-30)
    for _ in range(rounds):
        if rr < 1e-12 * scale:
            break
        q = apply(p)
        alpha = rr / float((p * q).sum())
        x, r = x + alpha * p, r - alpha * q
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return np.where(valid, a, x)


def kriging_fill(a: np.ndarray, valid: np.ndarray, drift: bool = True, points: int = 2500, seed: int = 42, least: int = 6) -> np.ndarray:
    """Invalid pixels by kriging with a linear variogram from at most ``points`` valid ones (a documented bound of the
    method), with a linear trend if ``drift``. Fewer than ``least`` valid pixels: unchanged."""
    y, x = np.nonzero(valid)
    if valid.all() or len(y) < least:
        return a.copy()
    if len(y) > points:
        k = np.random.default_rng(seed).choice(len(y), points, replace=False)
        y, x = y[k], x[k]
    ty, tx = np.nonzero(~valid)
    scale = max(a.shape)
    known, wanted = (np.column_stack([v / scale for v in p]) for p in ((y, x), (ty, tx)))
    trend = lambda p: np.column_stack([np.ones(len(p)), p] if drift else [np.ones(len(p))])
    far = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    t = trend(known)
    system = np.block([[-far(known, known), t], [t.T, np.zeros((t.shape[1], t.shape[1]))]])
    weights = np.linalg.lstsq(system, np.concatenate([a[y, x], np.zeros(t.shape[1])]), rcond=None)[0]
    out = a.astype(float).copy()
    for i in range(0, len(ty), 4096):
        w = wanted[i : i + 4096]
        out[ty[i : i + 4096], tx[i : i + 4096]] = np.column_stack([-far(w, known), trend(w)]) @ weights
    return out


# ---------------------------------------------------------------- shapes and augmentation


def resize(a: np.ndarray, h: int, w: int, nearest: bool = False) -> np.ndarray:
    """Bilinear (pixel centres aligned) or nearest."""
    y = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    if nearest:
        return a[np.floor(y + 0.5).astype(int)][:, np.floor(x + 0.5).astype(int)]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def resize_valid(a: np.ndarray, valid: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear over valid pixels only; NaN where none contributes."""
    n, d = resize(np.where(valid, a, 0.0), h, w), resize(valid.astype(float), h, w)
    return np.divide(n, d, out=np.full((h, w), np.nan), where=d > 1e-6)


def patchify(a: np.ndarray, p: int) -> np.ndarray:
    h, w = a.shape
    return a.reshape(h // p, p, w // p, p).swapaxes(1, 2).reshape(-1, p * p)


def unpatchify(patches: np.ndarray, p: int, h: int, w: int) -> np.ndarray:
    return patches.reshape(h // p, w // p, p, p).swapaxes(1, 2).reshape(h, w)


def expand_mask(mask: np.ndarray, p: int) -> np.ndarray:
    return np.kron(mask, np.ones((p, p), dtype=mask.dtype))


def patch_valid_fraction(valid: np.ndarray, p: int) -> np.ndarray:
    return patchify(valid.astype(float), p).mean(axis=1).reshape(valid.shape[0] // p, -1)


def visible_patches(ok: np.ndarray, ratio: float, seed: int) -> np.ndarray:
    """ceil(n (1 - ratio)), at least one, of the valid patches, seeded."""
    at = np.flatnonzero(ok.ravel())
    n = max(1, int(np.ceil(len(at) * (1 - ratio)))) if len(at) else 0
    out = np.zeros(ok.size, dtype=bool)
    out[np.random.default_rng(seed).permutation(at)[:n]] = True
    return out.reshape(ok.shape)


def augment(image: np.ndarray, elevation: np.ndarray, sun: tuple[float, float, float], seed: int, jitter: float = 0.1) -> dict:
    """Seeded flips and quarter turns, the sun turned alike, and brightness changed."""
    rng = np.random.default_rng(seed)
    x, y, z = sun
    if rng.random() < 0.5:
        image, elevation, x = image[:, ::-1], elevation[:, ::-1], -x
    if rng.random() < 0.5:
        image, elevation, y = image[::-1], elevation[::-1], -y
    for _ in range(int(rng.integers(0, 4))):
        image, elevation, (x, y) = np.rot90(image), np.rot90(elevation), (y, -x)
    return {"image": np.clip(image * (1 + rng.uniform(-jitter, jitter)), -1, 1), "elevation": elevation.copy(), "sun_x": x, "sun_y": y, "sun_z": z}


def random_crop(seed: int, size: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The same window of each; smaller arrays are enlarged first."""
    h, w = arrays[0].shape
    if min(h, w) < size:
        k = size / min(h, w)
        h, w = max(size, round(h * k)), max(size, round(w * k))
        arrays = tuple(resize(a, h, w) for a in arrays)
    rng = np.random.default_rng(seed)
    y, x = int(rng.integers(0, h - size + 1)), int(rng.integers(0, w - size + 1))
    return [a[y : y + size, x : x + size] for a in arrays]


def normalize_files(a: np.ndarray, valid: np.ndarray, method: str = "minmax") -> np.ndarray:
    """Elevation to [-1, 1], by range or log range; invalid and flat give 0."""
    if method not in ("minmax", "log"):
        raise ValueError(f"unknown method {method!r}")
    if not valid.any():
        return np.zeros_like(a)
    v = np.log(np.where(valid, a - a[valid].min() + 1, 1.0)) if method == "log" else a
    lo, hi = v[valid].min(), v[valid].max()
    return np.where(valid, (v - lo) / (hi - lo) * 2 - 1, 0.0) if hi > lo else np.zeros_like(a)


def relative_residual(a: np.ndarray, valid: np.ndarray, fallback: float) -> np.ndarray:
    """Centred, divided by its greatest magnitude (or a fallback), zero where invalid."""
    if not valid.any():
        return np.zeros_like(a)
    c = a - a[valid].mean()
    m = np.abs(c[valid]).max()
    return np.where(valid, c / (m if m > 1e-9 else fallback), 0.0)


def mosaic(tiles: list[np.ndarray]) -> np.ndarray:
    """First value that is neither zero nor NaN; tiles are padded with zeros to a common size."""
    h, w = max(t.shape[0] for t in tiles), max(t.shape[1] for t in tiles)
    out = np.zeros((h, w))
    for t in tiles:
        p = np.pad(np.nan_to_num(t), ((0, h - t.shape[0]), (0, w - t.shape[1])))
        out = np.where(out == 0, p, out)
    return out


def hillshade(a: np.ndarray, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0) -> np.ndarray:
    gy, gx = np.gradient(a * z)
    slope, aspect = np.arctan(np.hypot(gx, gy)), np.arctan2(-gx, gy)
    zen, az = np.radians(90 - altitude), np.radians((360 - azimuth + 90) % 360)
    return np.clip(np.cos(zen) * np.cos(slope) + np.sin(zen) * np.sin(slope) * np.cos(az - np.pi / 2 - aspect), 0, 1)


def slope_proxy(a: np.ndarray, valid: np.ndarray) -> float:
    gy, gx = np.gradient(a)
    return float(np.hypot(gx, gy)[valid].std()) if valid.any() else 0.0


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Of two samples (rows are observations)."""

    def centre(v: np.ndarray) -> np.ndarray:
        v = v.reshape(len(v), -1)
        d = np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(axis=2), 0))
        return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()

    a, b = centre(x), centre(y)
    v = np.sqrt(max((a * a).mean() * (b * b).mean(), 0))
    return float(np.sqrt(max((a * b).mean(), 0) / v)) if v > 0 else 0.0


def residual_features(r: np.ndarray, bins: int = 30) -> np.ndarray:
    """Quantiles of the residual and of its gradient magnitude."""
    q = np.linspace(0, 1, bins)
    return np.concatenate([np.quantile(r, q), np.quantile(np.hypot(*np.gradient(r)), q)])
