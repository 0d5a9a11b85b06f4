"""Counts over texts: tokens, pairs, named features, themes, vocabularies and their maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsift.fixed import GEO_FEATURES, THEMES  # noqa: F401
from redsift.functions.text import bigrams, science_tokens, word_tokens

#: Right-closed latitude bands.
BANDS = [(-90.0, -65.0), (-65.0, -30.0), (-30.0, 30.0), (30.0, 65.0), (65.0, 90.0)]


def token_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(science_tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(bigrams(science_tokens(text))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, text: str, pos: str, n: int = 20, pairs: bool = False) -> DataFrame:
    """Top n tokens or pairs; ties go to the one seen first (by ``pos``, then place in the text)."""
    t = science_tokens(text)
    each = df.select(F.col(pos).alias("_p"), F.posexplode(bigrams(t) if pairs else t).alias("_k", "token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_p", "_k")).alias("_first")).orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def mentions(df: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows that mention each word, whole and without case; words never mentioned are left out. One pass: the row's own
    words are matched, no row meets the list."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1)), lambda w: w.isin(words)))
    return df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def themes(text: Column | str, table: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names of the themes of which a keyword occurs whole, in the table's order; ``Other`` without any. Null: Other."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    hits = [F.when(low.rlike(r"\b(" + "|".join(re.escape(k.lower()) for k in keys) + r")\b"), F.lit(name)) for name, keys in (table or THEMES).items()]
    got = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("Other")))


def theme_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(themes(text)).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


def primary_themes(df: DataFrame, text: str) -> DataFrame:
    return df.select(themes(text)[0].alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


def band(lat: Column) -> Column:
    """Right-closed band; the lowest edge itself has none."""
    out = F.when(F.lit(False), F.lit(""))
    for lo, hi in BANDS:
        out = out.when((lat > lo) & (lat <= hi), F.lit(f"({lo:g}, {hi:g}]"))
    return out


def band_theme_crosstab(df: DataFrame, text: str, lat: Column) -> DataFrame:
    each = df.select(band(lat).alias("band"), F.explode(themes(text)).alias("theme")).where("band is not null")
    return each.groupBy("band").pivot("theme", [*THEMES, "Other"]).count().na.fill(0)


def dominant_theme_cells(df: DataFrame, text: str, lon: Column, lat: Column, nx: int = 180, ny: int = 90) -> DataFrame:
    """Per cell of a lon/lat grid the theme with most rows (ties: the more popular, then the name) and log density."""
    cx = F.least(F.greatest(F.floor((lon + 180.0) / (360.0 / nx)), F.lit(0)), F.lit(nx - 1))
    cy = F.least(F.greatest(F.floor((lat + 90.0) / (180.0 / ny)), F.lit(0)), F.lit(ny - 1))
    each = df.where(lon.isNotNull() & lat.isNotNull()).select(cx.alias("cx"), cy.alias("cy"), F.explode(themes(text)).alias("theme"))
    cells = each.groupBy("cx", "cy", "theme").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("theme").agg(F.sum("n").alias("total"))  # as many rows as there are themes
    ranked = cells.join(F.broadcast(total), "theme")
    best = F.max(F.struct("n", "total", F.col("theme").alias("name"))).alias("b")
    return ranked.groupBy("cx", "cy").agg(best, F.round(F.log1p(F.sum("n")), 6).alias("log_density")).select("cx", "cy", F.col("b.name").alias("theme"), "log_density")


def hex_cells(df: DataFrame, x: Column, y: Column, nx: int = 45, ny: int = 22, extent: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """Hexagonal bin counts: of two offset lattices the nearer centre."""
    x0, y0, x1, y1 = extent
    sx, sy = (x - x0) / ((x1 - x0) / nx), (y - y0) / ((y1 - y0) / ny)
    ax, ay, bx, by = F.round(sx), F.round(sy), F.floor(sx), F.floor(sy)
    d1 = (sx - ax) * (sx - ax) + 3.0 * (sy - ay) * (sy - ay)
    d2 = (sx - bx - 0.5) * (sx - bx - 0.5) + 3.0 * (sy - by - 0.5) * (sy - by - 0.5)
    first = d1 < d2
    cell = df.where(x.isNotNull() & y.isNotNull()).select(F.when(first, ax).otherwise(bx + 0.5).cast("double").alias("hx"), F.when(first, ay).otherwise(by + 0.5).cast("double").alias("hy"))
    return cell.groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, text: Column | str, least: int = 1) -> DataFrame:
    """``(token, n, id)``: tokens of ``least`` occurrences or more, ids from 4 in lexicographic order (0 to 3 are reserved)."""
    c = F.col(text) if isinstance(text, str) else text
    n = df.select(F.explode(word_tokens(c)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    from redsift.operators.splits import ranked

    return ranked(n, [F.col("token")]).select("token", "n", (F.col("_r") + 3).alias("id"))


def encoded(df: DataFrame, key: str, text: str, vocab: DataFrame, width: int) -> DataFrame:
    """``(key, ids)``: padded ids of each text. Only the first ``width`` tokens can appear in the result, and they are
    joined to the vocabulary, so it may be of any size."""
    tok = df.select(F.col(key).alias("_k"), F.posexplode_outer(F.slice(word_tokens(text), 1, width)).alias("_p", "token"))
    ids = tok.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(1))))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("_p", "id")))), lambda s: s["id"].cast("long"))
    got = ids.groupBy("_k").agg(body.alias("b"))  # at most ``width`` per text
    full = F.slice(F.concat(F.array(F.lit(2).cast("long")), F.col("b"), F.array(F.lit(3).cast("long"))), 1, width)
    return got.select(F.col("_k").alias(key), F.concat(full, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(full))).alias("ids"))
