"""Images and their patch tokens as arrays: normalising, hiding, composing and packing, all JVM expressions.

An image is a flat array; tokens are an array of patches, each an array of values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def normalize_valid(image: Column, valid: Column, mean: float, std: float, eps: float = EPS) -> Column:
    """Z-scores of the valid pixels, zero elsewhere."""
    return F.zip_with(image, valid, lambda x, ok: F.when(ok, (x - mean) / max(std, eps)).otherwise(0.0))


def denormalize(image: Column, mean: float, std: float, eps: float = EPS) -> Column:
    return F.transform(image, lambda x: x * max(std, eps) + mean)


def masked_tokens(tokens: Column, valid: Column, visible: Column) -> Column:
    """Tokens with the hidden and the invalid ones set to zero."""
    keep = F.zip_with(valid, visible, lambda a, b: a & b)
    return F.zip_with(tokens, keep, lambda t, k: F.when(k, t).otherwise(F.transform(t, lambda x: x * 0.0)))


def composite(tokens: Column, rebuilt: Column, valid: Column, visible: Column) -> Column:
    """The original where a token is visible, the rebuilt one where it is hidden, zero where it is invalid."""
    side = F.zip_with(valid, visible, lambda a, b: F.when(~a, 0).when(b, 1).otherwise(2))
    pick = F.zip_with(tokens, rebuilt, lambda t, r: F.struct(t.alias("t"), r.alias("r")))
    return F.zip_with(pick, side, lambda p, s: F.when(s == 1, p["t"]).when(s == 2, p["r"]).otherwise(F.transform(p["t"], lambda x: x * 0.0)))


def pack_visible(tokens: Column, visible: Column, length: int) -> Column:
    """The visible tokens in order, filled with zero tokens to ``length``."""
    pairs = F.zip_with(tokens, visible, lambda t, v: F.struct(t.alias("t"), v.alias("v")))
    kept = F.transform(F.filter(pairs, lambda p: p["v"]), lambda p: p["t"])
    blank = F.transform(F.element_at(tokens, 1), lambda x: x * 0.0)
    return F.concat(kept, F.array_repeat(blank, F.greatest(F.lit(length) - F.size(kept), F.lit(0))))


def three_channels(channels: Column) -> Column:
    """The first three of an array of channels; a single one three times."""
    return F.when(F.size(channels) == 1, F.array_repeat(channels[0], 3)).otherwise(F.slice(channels, 1, 3))
