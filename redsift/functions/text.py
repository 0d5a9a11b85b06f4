"""Text as column expressions. Null text stays null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redsift.fixed import STOPWORDS

#: Fixed value: a science token, hyphenated words whole.
SCIENCE = r"([a-z][a-z\-]+[a-z]|[a-z])"
#: Fixed value: a vocabulary word.
WORD = r"([A-Za-z0-9][A-Za-z0-9_\-/:.]*)"
#: The reserved ids of a vocabulary.
PAD, UNK, BOS, EOS = 0, 1, 2, 3


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """White space runs become one space, none at the ends. Spark's ``trim`` strips spaces only, so they collapse first."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def render_prompt(template: str, c: Column | str) -> Column:
    """``{rationale}`` in the template replaced by the cleaned text, null as empty."""
    return F.replace(F.lit(template), F.lit("{rationale}"), F.coalesce(clean_text(c), F.lit("")))


def compose_text(raw: Column | str, expanded: Column | str, mode: str = "raw_plus_expanded") -> Column:
    """``raw``, ``expanded`` (raw where missing) or both. A missing or empty expansion adds nothing; a null raw is empty."""
    r = F.coalesce(clean_text(raw), F.lit(""))
    e = F.coalesce(clean_text(expanded), F.lit(""))
    if mode == "raw":
        return r
    if mode == "expanded":
        return F.when(e == "", r).otherwise(e)
    if mode == "raw_plus_expanded":
        return F.when(e == "", r).when(r == "", e).otherwise(F.concat(r, F.lit("\nExpanded context: "), e))
    raise ValueError(f"unknown text mode {mode!r}")


def word_tokens(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(c), F.lit(WORD), F.lit(1)), F.lower)


def science_tokens(c: Column | str) -> Column:
    """Lower-case tokens of three letters or more that are no stop words."""
    every = F.regexp_extract_all(F.lower(_c(c)), F.lit(SCIENCE), F.lit(1))
    return F.filter(every, lambda t: (F.length(t) > 2) & ~t.isin(list(STOPWORDS)))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs, joined by a space; fewer than two tokens give none."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(1))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def encode(tokens: Column, ids: Column, width: int) -> Column:
    """Ids framed by BOS and EOS, cut to ``width`` (EOS may go) and padded. ids: map of token to id."""
    body = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(UNK)))
    full = F.slice(F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS))), 1, width)
    return F.concat(full, F.array_repeat(F.lit(PAD), F.lit(width) - F.size(full)))


def mask(encoded: Column) -> Column:
    return F.transform(encoded, lambda x: (x != PAD).cast("int"))


def parse_time(c: Column | str) -> Column:
    """UTC timestamp; unusable text is null."""
    return F.try_to_timestamp(F.trim(_c(c)))
