"""Text cut off by field limits or broken transfers: a hashed logistic regression on how values close.

There are no labels. Intact values of a bounded sample are cut artificially to make positives; the intact ones are the
negatives. Features are hashed: closing characters, closing words and their classes, punctuation, how often the closing
word occurs, goes on to longer words and stands before a full stop, and the length against the limit of the source. Every
record is scored.

Counted over all data, exactly: words and their continuations, closing words, lengths per source, and the scores from
which the share of cut values follows. Only the weights are fitted on a sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redsift.operators.joins import hot_join
from redsift.session import dropped, written

#: Size of the sample that the model is fitted on (rows with the least hashes), a documented bound.
SAMPLE_ROWS = 20_000
DIM = 1 << 17
#: A length of a source is a limit where it is this many times as frequent as those around it, and at least so often.
SPIKE, SPIKE_ROWS, AROUND = 4.0, 5, 5
#: A word that closes less than this share of the values in which it occurs marks a value that may be cut.
SAMPLE_SHARE = 0.01
#: A word that occurs at the end only is taken for whole if it closes at least this share of all values.
CLOSING = 0.02
#: A word so frequent that stands before a full stop in less than this share of its occurrences closes no statement; asked
#: only where at least this share of all values ends with a full stop.
FREQUENT, STOPPED, STOPS = 20, 0.002, 0.05
#: Width of a bin of scores from which the share of cut values is estimated.
BIN = 0.05
#: What stands for a missing statement.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "unk", "null", "none", "unknown", "tbd")


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode(), 42)


# ---------------------------------------------------------------- statistics over all rows


def _words(text: str):
    """Words of a value in lower case, and whether it ends with a full stop or bracket (and no ellipsis)."""
    t = F.regexp_replace(F.lower(text), r"\s+$", "")
    return F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'&-]*)"), F.lit(1)), t.rlike(r"[.!?)]$") & ~t.rlike(r"\.\.$")


def word_table(rows: DataFrame) -> DataFrame:
    """``(w, n, s)`` of every whole word of the column text: its occurrences, and those before a closing full stop. A word
    counts as whole unless it is the last one of a value that ends without a full stop or bracket."""
    words, closed = _words("text")
    values = rows.where("text is not null").select(words.alias("w"), closed.alias("closed"))
    whole = F.when(F.col("closed"), F.col("w")).otherwise(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
    marked = F.transform(whole, lambda w, i: F.struct(w.alias("w"), (F.col("closed") & (i == F.size("w") - 1)).cast("long").alias("s")))
    # equal words first become one row per task
    return values.select(F.explode(marked).alias("m")).groupBy("m.w").agg(F.count(F.lit(1)).alias("n"), F.sum("m.s").alias("s"))


def closing_table(words: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (lw, ends, a row per word) with own, more and stop: how often the word occurs whole, how often longer words
    that begin with it do, and how often it stands before a full stop."""
    # only beginnings as long as one of the words can be one; there are few such lengths
    lengths = [r[0] for r in asked.select(F.length("lw").alias("k")).distinct().collect()]
    heads = F.transform(F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k < F.length("w")), lambda k: F.substring(F.col("w"), F.lit(1), k))
    more = words.select(F.explode(heads).alias("lw"), "n").join(asked.select("lw"), "lw", "left_semi").groupBy("lw").agg(F.sum("n").alias("more"))
    own = words.select(F.col("w").alias("lw"), F.col("n").alias("own"), F.col("s").alias("stop"))
    return asked.join(own, "lw", "left").join(more, "lw", "left").na.fill(0).select("lw", "ends", "own", "more", "stop")


def with_limits(df: DataFrame, text: str, source: str) -> DataFrame:
    """``df`` with ``_at_limit``: the value fills a length that is a limit of its source (padding does not fill)."""
    n = F.length(text)
    per = df.where(F.col(text).isNotNull()).groupBy(F.col(source).alias("_s"), n.alias("_n")).agg(F.count(F.lit(1)).alias("_k"))
    around = F.sum("_k").over(Window.partitionBy("_s").orderBy("_n").rangeBetween(-AROUND, AROUND)) - F.col("_k")
    spike = per.withColumn("_spike", (F.col("_k") >= SPIKE_ROWS) & (F.col("_k") >= SPIKE * around / (2 * AROUND))).where("_spike").select("_s", "_n", "_spike")
    full = F.length(F.regexp_replace(text, r"\s+$", "")) >= n - 1
    joined = df.join(spike, F.col(source).eqNullSafe(F.col("_s")) & (n == F.col("_n")), "left")
    return joined.withColumn("_at_limit", F.coalesce(F.col("_spike") & full, F.lit(False))).drop("_s", "_n", "_spike")


# ---------------------------------------------------------------- features and model


def _class(w: str) -> str:
    if not w:
        return "none"
    if w[0].isdigit() or (len(w) > 1 and w[1].isdigit()):
        return "n" + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", w))[:8]
    return ("U" if w.isupper() and len(w) > 1 else "A" if w[0].isupper() else "a") + ("-" if "-" in w else "")


def _level(n: float) -> int:
    return int(np.log2(n + 1) + 0.5)


def _last(t: str) -> str:
    m = re.search(r"[^\W_][\w'&-]*(?=[^\w]*$)", t[-200:])
    return m.group(0) if m else ""


def features(text: str, at_limit: bool, own: float, more: float, stop: float) -> list[int]:
    """Hashed features of a value (white space at its end removed). own, more, stop: as in :func:`closing_table`."""
    t = text.rstrip()
    end = t[-1:] if t else ""
    kind = "l" if end.isalpha() else "d" if end.isdigit() else "…" if t.endswith("..") else end
    low = t[-200:].lower()
    words = re.findall(r"[^\W_](?:[\w'&-]*[^\W_])?", t[-200:])
    last = _last(t)
    lw = last.lower()
    prev = words[-2].lower() if len(words) > 1 else "^"
    prev2 = words[-3].lower() if len(words) > 2 else "^"
    upper = t[-200:].isupper()
    cls = "U" if upper and last.isalpha() else _class(last)
    wholeness = f"{_level(own)}:{_level(more)}"
    closed = kind in (".", "!", "?", ")")
    manner = "alnum" if kind in ("l", "d") else "closed" if closed else "open"
    open_ = low.count("(") > low.count(")")
    closes = min(_level(1000 * stop / (own + 1)), 9) if own >= FREQUENT else -1
    f = [
        "bias", f"k={kind}", f"c3={low.rstrip()[-3:]}", f"c2={low.rstrip()[-2:]}", f"w={lw}:{manner}", f"w2={prev}|{lw}", f"p={prev}|{cls}", f"p2={prev2}|{prev}|{cls}",
        f"cls={cls}", f"own={_level(own)}:{manner}", f"more={_level(more)}:{manner}", f"who={wholeness}:{manner}", f"whoc={wholeness}:{cls[:1]}:{manner}", f"lim={at_limit}", f"limk={at_limit}:{kind}",
        f"limw={at_limit}:{_level(own)}", f"limwho={at_limit}:{wholeness}", f"open={open_}", f"manner={manner}", f"manner2={manner}:{at_limit}", f"manner3={manner}:{open_}", f"n={min(len(words), 12)}:{manner}", f"short={min(len(lw), 6)}:{own > more}:{manner}", f"ratio={_level(more) - _level(own)}:{cls[:1]}",
        f"np={min(len(words), 8)}:{prev}", f"known={own > 0}:{prev}:{cls[:1]}", f"closes={closes}:{manner}", f"closes2={closes}:{cls[:1]}:{at_limit}",
    ]
    return [_h(x) % DIM for x in f]


def _is_placeholder(t: str) -> bool:
    return t.strip().lower() in PLACEHOLDERS


def _fit(rows: list[list[int]], y: np.ndarray, rounds: int = 25, ridge: float = 2e-5) -> np.ndarray:
    """Logistic regression by adaptive gradient steps over shuffled blocks."""
    x = np.array(rows, dtype=np.int64)
    w, g2 = np.zeros(DIM), np.full(DIM, 1e-6)
    rng = np.random.default_rng(0)
    block = max(256, len(x) // 200)
    for r in range(rounds):
        order = rng.permutation(len(x))
        rate = 0.3 / (1 + r / 8)
        for i in range(0, len(order), block):
            k = order[i : i + block]
            p = 1 / (1 + np.exp(-w[x[k]].sum(axis=1)))
            at = x[k].ravel()
            used, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, weights=np.repeat(p - y[k], x.shape[1])) / len(k) + ridge * w[used]
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
    return w


class Sample:
    """What a bounded sample of values teaches: rows (value, at limit, ends, own, more, stop), totals over all data."""

    def __init__(self, rows: list[tuple], limits: list[int], totals: dict[str, int], seed: int = 0) -> None:
        self.n = max(totals["n_values"], 1)
        self.share = SAMPLE_SHARE * self.n / max(totals["n_words"] / 6, self.n)
        self.stops = totals["n_stopped"] >= STOPS * self.n
        rng = np.random.default_rng(seed)
        self.good: list[tuple] = []  # intact values, at a limit or not, and the statistics of their closing words
        self.cuts: list[tuple] = []  # what is left of them, at a limit or not, the closing word, whether it is whole
        for t, lim, ends, own, more, stop in ((r[0].rstrip(), *r[1:]) for r in rows if r[0] and not _is_placeholder(r[0])):
            if not self._intact(t, lim, ends, own, more, stop):
                continue
            bare = t.rstrip(".!?")
            self.good.append((t, bool(rng.random() < 0.15), own, more, stop))
            fits = [k for k in limits if 8 < k < len(bare)]
            for _ in range(2):
                at = bool(fits) and rng.random() < 0.6
                k = int(rng.choice(fits)) if at else int(rng.integers(max(6, len(bare) // 4), max(len(bare), 7)))
                if not at and rng.random() < 0.3:  # on to a boundary of words
                    k += next((i for i, c in enumerate(bare[k:]) if not c.isalnum()), 0) + int(rng.integers(0, 2))
                marks = [m.end() for m in re.finditer(r"[,;:(/]", bare[:-1][-2000:])] if not at and rng.random() < 0.3 else []
                if marks:  # behind a mark after which a sentence goes on
                    k = int(rng.choice(marks)) + max(len(bare) - 1 - 2000, 0)
                left = bare[:k].rstrip()
                if k >= len(bare) or not left:
                    continue
                whole = not (bare[k - 1].isalnum() and bare[k].isalnum()) and left[-1] not in ",(-/"
                sign = str(rng.choice(["…", "\ufffd", "..."])) if not at and rng.random() < 0.15 else ""
                self.cuts.append((left + sign, at, _last(left).lower(), whole))

    def _may_close(self, ends: float, own: float, stop: float) -> bool:
        return not (self.stops and own >= FREQUENT and stop < STOPPED * own) and ends + stop >= self.share * own

    def _intact(self, t: str, lim: bool, ends: float, own: float, more: float, stop: float) -> bool:
        if t[-1] in ".!?)":
            return not t.endswith("..")
        if own < 2 and ends >= CLOSING * self.n:
            return not lim  # never elsewhere, but what closes so many values is a word
        if lim or not self._may_close(ends, own, stop) or not (t[-1].isalpha() or t[-1].isdigit()):
            return False
        return own >= 2 and own * 3 >= more or any(c.isdigit() for c in _last(t))

    def train(self, table: dict[str, tuple]) -> tuple[np.ndarray, float]:
        """Weights, and the log-odds of a cut value among the training rows. table: (ends, own, more, stop) of the words
        that close the cuts. Too few intact values: a model that says no."""
        if len(self.good) < 10:
            return np.zeros(DIM), 0.0
        rows, y = [features(*g) for g in self.good], [0] * len(self.good)
        for t, lim, w, whole in self.cuts:
            ends, own, more, stop = table.get(w, (0, 0, 0, 0))
            if whole and self._may_close(ends, own, stop) and ends + stop >= max(3, self.n // 2000):
                continue  # what is left may be a complete statement
            rows.append(features(t, lim, own, more, stop))
            y.append(1)
        share = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
        return _fit(rows, np.array(y, dtype=float)), float(np.log(share / (1 - share)))


def _shift(bins: list[tuple[float, int]], old: float) -> float:
    """Log-odds to subtract from a score: the share of cut values among all, by expectation maximisation over a histogram
    of the scores of all rows. ``old``: the log-odds among the training rows."""
    if not bins:
        return 0.0
    z, n = (np.array(x, dtype=float) for x in zip(*bins, strict=True))
    prior = 1 / (1 + np.exp(-old))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z - old + np.log(prior / (1 - prior)))))
        prior = min(max(float((p * n).sum() / n.sum()), 1e-3), 0.9)
    return float(old - np.log(prior / (1 - prior)))


def cut_rows(df: DataFrame, key: str, text: str, source: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(key, source, cut boolean, score double)`` for every row; score: log-odds that the value is cut.

    Null values and placeholders are never cut (score null). Repeated values score alike at equal length against the
    limit. Values of any length are read; features look at the closing 200 characters, where a cut shows.
    """
    spark = df.sparkSession
    tokens, closed = _words("text")
    rows = with_limits(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), "text", "source")
    rows = written(rows.select("key", "text", "source", "_at_limit", F.try_element_at(tokens, F.lit(-1)).alias("lw"), F.size(tokens).alias("_n"), closed.alias("_closed")), "values")
    total = rows.where("text is not null").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("_closed").alias("n_stopped"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_words")).first().asDict()
    words = written(word_table(rows), "words")
    ends = written(rows.where("lw is not null").groupBy("lw").agg(F.count_if(~F.col("_at_limit")).alias("ends")), "ends")
    closers = written(closing_table(words, ends), "closers")
    # a bounded sample: the rows with the least hashes of their values, each value once per state
    distinct = rows.where("text is not null").groupBy("text", "_at_limit").agg(F.max("lw").alias("lw")).orderBy(F.xxhash64("text"), "text", "_at_limit").limit(sample_rows)
    sample = [tuple(r) for r in distinct.join(closers, "lw", "left").na.fill(0).select("text", "_at_limit", "ends", "own", "more", "stop").collect()]
    limits = [r[0] for r in rows.where("_at_limit").select(F.length("text").alias("n")).distinct().orderBy("n").collect()]
    taught = Sample(sorted(sample, key=lambda r: (_h(r[0]), r[1])), limits, total)
    # two words for each sampled value at most
    asked = spark.createDataFrame([(w,) for w in sorted({c[2] for c in taught.cuts})], "lw string").join(ends, "lw", "left").na.fill(0)
    weights, old = taught.train({r[0]: tuple(r[1:]) for r in closing_table(words, asked).collect()})
    model = spark.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = model.value, {}
        for b in batches:
            out = []
            for t, lim, *n in zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True):
                if t is None or _is_placeholder(t):
                    out.append(None)
                    continue
                at = (t.rstrip()[-200:], lim) if len(t) <= 1000 else None
                s = seen.get(at)
                if s is None:
                    s = float(w[features(t, lim, *(x or 0 for x in n))].sum())
                    if at and len(seen) < 50_000:
                        seen[at] = s
                out.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["key", "source", "z"])

    kinds = dict(df.dtypes)
    asked = hot_join(rows, closers, "lw").select("key", "source", "text", "_at_limit", "own", "more", "stop")
    scored = written(asked.mapInArrow(score, f"key {kinds[key]}, source {kinds[source]}, z double"), "scores")
    dropped(spark, rows, words, ends, closers)
    # a few thousand bins
    bins = [(r[0] * BIN, r[1]) for r in scored.where("z is not null").groupBy(F.round(F.col("z") / BIN).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]
    minus = _shift(bins, old)
    return scored.select("key", "source", F.coalesce(F.col("z") > minus, F.lit(False)).alias("cut"), (F.col("z") - minus).alias("score"))


def cut_shares(scored: DataFrame) -> DataFrame:
    """Per source the rows with a value, the cut ones and their share."""
    n, cut = F.count("score"), F.count_if("cut")
    return scored.groupBy("source").agg(n.alias("n_values"), cut.alias("n_cut"), F.when(n > 0, F.round(cut / n, 6)).alias("cut_share"))
