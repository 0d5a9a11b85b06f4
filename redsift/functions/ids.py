"""Identifiers of observations and products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^[\s\p{Z}]*([A-Za-z]{3})[^A-Za-z0-9]*([0-9]{6})[^A-Za-z0-9]*([0-9]{4})(?:[^A-Za-z0-9].*)?$"


def plain_obs_id(col: Column | str) -> Column:
    """Observation id in its plain form ``AAA_NNNNNN_NNNN``.

    Letter case, surrounding white space, the choice of separator and a product suffix are dropped. Text of another
    shape is kept in upper case, without surrounding white space. Null or blank gives null.
    """
    c = F.col(col) if isinstance(col, str) else col
    usual = F.regexp_replace(F.upper(c), _PLAIN, "$1_$2_$3")
    return F.nullif(F.regexp_replace(usual, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def product_type(col: Column | str) -> Column:
    """``COLOR`` or ``RED`` from the end of a product id, else null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(c, r"_(COLOR|RED)\s*$", 1), F.lit(""))


def product_observation(col: Column | str) -> Column:
    """Observation part of a product id (the type suffix removed)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.trim(c), r"_(COLOR|RED)$", "")
