"""Value scalings as column expressions: ranges, residuals, logarithms, noise schedules, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo: float, hi: float) -> Column:
    """Null stays null (``greatest`` alone would drop it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def calibrate(dn: Column | str, scale: float, offset: float) -> Column:
    """Reflectance from counts, in [0, 1]; the no-data count 0 stays 0."""
    return F.when(_c(dn) == 0, 0.0).otherwise(clip(_c(dn) * scale + offset, 0, 1))


def range_scale(c: Column | str, p02: float, p98: float) -> Column:
    """To [-1, 1] between two percentiles; an empty range counts as [0, 1]."""
    lo, hi = (p02, p98) if p98 > p02 else (0.0, 1.0)
    return clip((_c(c) - lo) / (hi - lo) * 2.0 - 1.0, -1, 1)


def range_unscale(c: Column | str, p02: float, p98: float) -> Column:
    lo, hi = (p02, p98) if p98 > p02 else (0.0, 1.0)
    return (_c(c) + 1.0) / 2.0 * (hi - lo) + lo


def fixed_residual(c: Column | str, scale: float) -> Column:
    return clip(_c(c) / scale, -1, 1)


def log_residual(c: Column | str, ref: float, clipped: bool = False) -> Column:
    """sign * log2(1 + abs / ref); its exact inverse is :func:`log_unresidual`."""
    y = F.signum(_c(c)) * F.log1p(F.abs(_c(c)) / ref) / math.log(2.0)
    return clip(y, -1, 1) if clipped else y


def log_unresidual(c: Column | str, ref: float) -> Column:
    return F.signum(_c(c)) * ref * F.expm1(F.abs(_c(c)) * math.log(2.0))


def adaptive_residual(c: Column | str, p98: Column, floor: float = 0.1) -> Column:
    return clip(_c(c) / F.greatest(p98, F.lit(floor)), -1, 1)


def log_scale_target(p98: Column, floor: float = 0.1, mean: float = 1.5, std: float = 1.0) -> Column:
    return (F.ln(F.greatest(p98, F.lit(floor))) - mean) / std


def linear_scaling(c: Column | str, most: float, clipped: bool = True) -> Column:
    y = _c(c) / most
    return clip(y, -1, 1) if clipped else y


def log_scaling(c: Column | str, ref: float, clipped: bool = True) -> Column:
    y = F.log2(1.0 + _c(c) / ref)
    return clip(y, -1, 1) if clipped else y


def log_scaling_slope(c: Column | str, ref: float, clipped: bool = True) -> Column:
    """Derivative of :func:`log_scaling`; zero where clipped."""
    y = 1.0 / ((_c(c) + ref) * math.log(2.0))
    return F.when(_c(c) > ref, 0.0).otherwise(y) if clipped else y


def zscore(c: Column | str, mean: float, std: float) -> Column:
    """No data (0) stays 0."""
    return F.when(_c(c) == 0, 0.0).otherwise((_c(c) - mean) / std)


def cosine_log_snr(t: Column | str) -> Column:
    return -2.0 * F.ln(F.tan(_c(t) * (math.pi / 2)))


def cosine_alpha_bar(t: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-cosine_log_snr(t)))


def noised(x: Column | str, t: Column | str, noise: Column) -> Column:
    """Forward diffusion of a value at time t in (0, 1)."""
    a = cosine_alpha_bar(t)
    return F.sqrt(a) * _c(x) + F.sqrt(1.0 - a) * noise


def saturation_confidence(c: Column | str, margin: float = 0.05) -> Column:
    """1 inside, falling to 0 over ``margin`` at either end of [-1, 1]."""
    return clip((1.0 - F.abs(_c(c))) / margin, 0, 1)


def huber(residual: Column, delta: float = 0.1) -> Column:
    a = F.abs(residual)
    return F.when(a <= delta, 0.5 * residual * residual).otherwise(delta * (a - 0.5 * delta))
