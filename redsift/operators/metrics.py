"""Quality of predicted elevations per tile: errors, structure, spectrum, rendering. Kernels for :func:`raster.map_tiles`."""

from __future__ import annotations

import numpy as np

from redsift.operators.raster import box_sum, erode, nearest_fill, resize, smooth


def align(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Prediction with least-squares scale and shift; fewer than two pixels or constant ones: unchanged."""
    p, t = pred[valid], truth[valid]
    if len(p) < 2 or p.std() < 1e-12:
        return pred, 1.0, 0.0
    s = float(((p - p.mean()) * (t - t.mean())).mean() / p.var())
    return pred * s + (t.mean() - s * p.mean()), s, float(t.mean() - s * p.mean())


def errors(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> dict:
    """Relative, squared, logarithmic errors and threshold shares; logarithms over positive pairs."""
    p, t = pred[valid], truth[valid]
    if not len(p):
        return dict.fromkeys(("abs_rel", "sq_rel", "rmse", "rmse_log", "si_log", "delta_1", "delta_2", "delta_3"), 0.0)
    d, size = p - t, np.maximum(np.abs(t), 1e-6)
    both = (p > 0) & (t > 0)
    g = np.log(p[both]) - np.log(t[both]) if both.any() else np.zeros(1)
    ratio = np.maximum(p[both] / t[both], t[both] / p[both]) if both.any() else np.full(1, np.inf)
    return {
        "abs_rel": float(np.mean(np.abs(d) / size)), "sq_rel": float(np.mean(d * d / size)), "rmse": float(np.sqrt(np.mean(d * d))), "rmse_log": float(np.sqrt(np.mean(g * g))),
        "si_log": float(np.sqrt(max(np.mean(g * g) - np.mean(g) ** 2, 0)) * 100), **{f"delta_{k}": float(np.mean(ratio < 1.25**k) * 100) for k in (1, 2, 3)},
    }


def _dilate(edges: np.ndarray, radius: float) -> np.ndarray:
    """Pixels within ``radius`` of an edge."""
    r = int(radius)
    out = np.zeros_like(edges)
    p = np.pad(edges, r)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= radius * radius:
                out |= p[r + dy : r + dy + edges.shape[0], r + dx : r + dx + edges.shape[1]]
    return out


def boundary_fscore(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray, percentile: float = 85.0, tolerance: float = 2.0) -> float:
    """Agreement of the steepest places, to two pixels; the truth sets the threshold."""
    if not valid.any():
        return 0.0
    gp, gt = [np.where(valid, np.hypot(*np.gradient(a)), 0.0) for a in (pred, truth)]
    level = np.percentile(gt[valid], percentile)
    ep, et = gp > level, gt > level
    if level <= 1e-6 or not ep.any() or not et.any():
        return 0.0
    precision, recall = (ep & _dilate(et, tolerance)).sum() / ep.sum(), (et & _dilate(ep, tolerance)).sum() / et.sum()
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


def _inner(valid: np.ndarray, edge: int) -> np.ndarray:
    out = np.zeros_like(valid)
    out[edge:-edge, edge:-edge] = valid[edge:-edge, edge:-edge]
    return out


def curvature_rmse(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    def curve(a: np.ndarray) -> np.ndarray:
        gy, gx = np.gradient(smooth(a))
        return np.gradient(gx, axis=1) + np.gradient(gy, axis=0)

    m = _inner(valid, 2)
    return float(np.sqrt(np.mean((curve(pred) - curve(truth))[m] ** 2))) if m.any() else 0.0


def ssim(a: np.ndarray, b: np.ndarray, k: int = 7) -> float:
    """Mean structural similarity over k x k windows, values in [0, 1], sample covariances."""
    n = k * k
    ma, mb = box_sum(a, k) / n, box_sum(b, k) / n
    va, vb, cov = [(box_sum(x, k) / n - y) * n / (n - 1) for x, y in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb))]
    c1, c2 = 0.01**2, 0.03**2
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))))


def ms_ssim(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    """Structural similarity over three scales. The weights are fixed values."""
    if not valid.any():
        return 0.0
    lo, hi = truth[valid].min(), truth[valid].max()
    if hi - lo < 1e-6:
        return 1.0
    a, b = [np.where(valid, np.clip((v - lo) / (hi - lo), 0, 1), 0.0) for v in (pred, truth)]
    a, b = np.where(valid, a, a[valid].mean()), np.where(valid, b, b[valid].mean())
    total = used = 0.0
    for i, w in enumerate((0.0448, 0.2856, 0.3001)):
        if i:
            a, b = [resize(smooth(v, 0.5), v.shape[0] // 2, v.shape[1] // 2) for v in (a, b)]
        k = min(7, *a.shape)
        k -= 1 - k % 2
        if k < 3:
            break
        total, used = total + w * ssim(a, b, k), used + w
    return total / used if used else 0.0


def patch_swd(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray, size: int = 7, projections: int = 128, seed: int = 0) -> float:
    """Sliced Wasserstein distance of small windows on seeded projections."""
    win = np.lib.stride_tricks.sliding_window_view
    ok = win(valid, (size, size)).all(axis=(2, 3))
    if not ok.any():
        return 0.0
    a, b = [win(v, (size, size))[ok].reshape(-1, size * size) for v in (pred, truth)]
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    q = np.random.default_rng(seed).standard_normal((size * size, projections))
    q /= np.linalg.norm(q, axis=0)
    return float(np.abs(np.sort(a @ q, axis=0) - np.sort(b @ q, axis=0)).mean())


def _normals(a: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(a)
    n = np.stack([-gx, -gy, np.ones_like(a)], axis=-1)
    return n / np.linalg.norm(n, axis=-1, keepdims=True)


def normal_error(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    """Mean angle of surface normals in degrees."""
    m = _inner(valid, 1)
    return float(np.degrees(np.arccos(np.clip((_normals(pred) * _normals(truth)).sum(axis=-1), -1, 1)))[m].mean()) if m.any() else 0.0


def slope_rmse(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    m = _inner(valid, 1)
    s = [np.degrees(np.arctan(np.hypot(*np.gradient(a)))) for a in (pred, truth)]
    return float(np.sqrt(np.mean((s[0] - s[1])[m] ** 2))) if m.any() else 0.0


def psd_slope(a: np.ndarray) -> float:
    """Slope of radial power against frequency, both in logarithms."""
    h, w = a.shape
    win = np.outer(np.hanning(h), np.hanning(w))
    power = np.abs(np.fft.fftshift(np.fft.fft2((a - a.mean()) * win))) ** 2
    y, x = np.indices(a.shape)
    r = np.hypot(y - h // 2, x - w // 2).astype(int)
    p = np.bincount(r.ravel(), weights=power.ravel()) / np.maximum(np.bincount(r.ravel()), 1)
    k = np.arange(1, min(h, w) // 2)
    ok = p[k] > 0
    return float(np.polyfit(np.log(k[ok]), np.log(p[k][ok]), 1)[0]) if ok.sum() > 2 else 0.0


def psd_ratio(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    a, b = [psd_slope(nearest_fill(v, valid)) for v in (pred, truth)] if valid.any() else (0.0, 0.0)
    return a / b if abs(b) > 1e-9 else 0.0


def render(elevation: np.ndarray, sun: tuple[float, float, float], intensity: float = 1.0, ambient: float = 0.0, lunar: float = 0.5) -> np.ndarray:
    """Lunar-Lambert brightness under a distant sun, seen from above."""
    n = _normals(elevation)
    s = np.array(sun) / (np.linalg.norm(sun) or 1.0)
    mu0, mu = np.maximum((n * s).sum(axis=-1), 0), n[..., 2]
    return intensity * (2 * lunar * mu0 / np.maximum(mu0 + mu, 1e-6) + (1 - lunar) * mu0) + ambient


def photo_consistency(pred: np.ndarray, image: np.ndarray, valid: np.ndarray, sun: tuple[float, float, float] = (0.5, -0.5, 1.0)) -> float:
    """Structural similarity of the rendered prediction and the image, both stretched between their 2nd and 98th percentile."""
    if not valid.any():
        return 0.0

    def stretch(a: np.ndarray) -> np.ndarray:
        lo, hi = np.percentile(a[valid], [2, 98])
        return np.where(valid, np.clip((a - lo) / (hi - lo), 0, 1), 0.0) if hi > lo else np.zeros_like(a)

    k = min(7, *pred.shape)
    return ssim(stretch(render(pred, sun)), stretch(image), k - (1 - k % 2))


def all_metrics(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray, aligned: bool = True) -> dict:
    """Every measure of one tile; without a valid pixel all are zero."""
    valid = valid & np.isfinite(pred) & np.isfinite(truth)
    p, t = np.where(valid, pred, 0.0), np.where(valid, truth, 0.0)
    scale, shift = 1.0, 0.0
    if aligned:
        p, scale, shift = align(p, t, valid)
        p = np.where(valid, p, 0.0)
    named = {"normal_error": normal_error, "slope_rmse": slope_rmse, "psd_ratio": psd_ratio, "boundary_fscore": boundary_fscore, "curvature_rmse": curvature_rmse, "ms_ssim": ms_ssim, "patch_swd": patch_swd}
    return errors(p, t, valid) | {k: f(p, t, valid) for k, f in named.items()} | {"scale": scale, "shift": shift}


METRICS = "abs_rel double, sq_rel double, rmse double, rmse_log double, si_log double, delta_1 double, delta_2 double, delta_3 double, normal_error double, slope_rmse double, psd_ratio double, boundary_fscore double, curvature_rmse double, ms_ssim double, patch_swd double, scale double, shift double, error string"


# ---------------------------------------------------------------- losses of one tile


def gradient_loss(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray, scales: tuple[int, ...] = (1, 2, 4)) -> float:
    """Mean absolute gradient difference of block means at each scale."""
    out = []
    for s in scales:
        h, w = pred.shape[0] // s, pred.shape[1] // s
        cut = lambda a, h=h, w=w, s=s: a[: h * s, : w * s].reshape(h, s, w, s).mean(axis=(1, 3))
        d, m = cut(pred - truth), cut(valid.astype(float)) >= 1
        for axis in (0, 1):
            both = (m[1:] & m[:-1]) if axis == 0 else (m[:, 1:] & m[:, :-1])
            out.append(np.abs(np.diff(d, axis=axis))[both].mean() if both.any() else 0.0)
    return float(np.sum(out) / len(scales))


def laplacian_loss(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    from redsift.operators.raster import laplacian

    m = _inner(erode(valid), 1)
    return float(np.abs(laplacian(pred - truth))[m].mean()) if m.any() else 0.0


def normals_loss(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> float:
    m = erode(valid)
    return float(1 - (_normals(pred) * _normals(truth)).sum(axis=-1)[m].mean()) if m.any() else 0.0


def photoclinometric_loss(pred: np.ndarray, image: np.ndarray, weight: float = 0.5, scales: tuple[int, ...] = (1, 2, 4)) -> float:
    """Mix of one minus correlation and one minus structural similarity of shading and image, over scales."""
    out = []
    for s in scales:
        a, b = [resize(v, max(3, v.shape[0] // s), max(3, v.shape[1] // s)) for v in (pred, image)]
        unit = lambda v: (v - v.min()) / (np.ptp(v) or 1.0)
        c = np.corrcoef(a.ravel(), b.ravel())[0, 1] if a.std() > 0 and b.std() > 0 else 0.0
        k = min(7, *a.shape)
        out.append((1 - weight) * (1 - c) + weight * (1 - ssim(unit(a), unit(b), k - (1 - k % 2))))
    return float(np.mean(out))


def ordinal_loss(pred: np.ndarray, truth: np.ndarray, valid: np.ndarray, margin: float = 0.02, pairs: int = 10_000, seed: int = 0) -> float:
    """Hinge over seeded pairs whose truth differs by more than the margin."""
    p, t = pred[valid], truth[valid]
    if len(p) < 2:
        return 0.0
    i, j = np.random.default_rng(seed).integers(0, len(p), (2, pairs))
    d = t[i] - t[j]
    on = np.abs(d) > margin
    return float(np.maximum(0, margin - np.sign(d[on]) * (p[i] - p[j])[on]).mean()) if on.any() else 0.0


def combined_loss(parts: dict[str, float], weights: dict[str, float], starts: dict[str, int], step: int) -> float:
    """Weighted sum of the parts whose start has come."""
    return sum(weights.get(k, 0.0) * v for k, v in parts.items() if step >= starts.get(k, 0))
