"""Same or almost same records across splits: an index of evaluation shards, training streamed through it.

A record is a place and a set of contributors. Records of the evaluation splits are put into shards by place; in a shard
each distinct one is a short document of symbols (a grid cell with a contributor, in a common order), indexed as compressed
full text. Training records are streamed through backward search, batch by batch, against the cells around them: maximal
matches come out, their spans are merged per pair of records, and the merged length is the size of the intersection, so the
similarity of the sets follows exactly. An exact test of the distance ends it. Equal records are searched once, and their
pairs are written out last, in portions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsift.functions.ids import plain_obs_id
from redsift.llm.fm_index import FMIndex
from redsift.operators.latest import latest
from redsift.operators.spatial_join import _cell, _plan, _ranges, lon360
from redsift.session import parallelism, written

#: Fixed values of the problem: how far centres may differ in either coordinate, and the least set similarity.
NEAR_DEG = 0.000505
SIMILAR = 0.75
PER_TASK = 150_000
OUT_ROWS = 100_000
#: Occurrences of contributors that a portion of queries expands at once, unless one query alone has more.
EXPANDED = 4_000_000
#: Grid cells are a little over twice the distance, so the window around a centre touches at most four.
GRID = 0.00102


def obs_code(p: Column) -> Column:
    """Injective long of an observation id in plain form; ids of another shape get a negative hash."""
    usual = p.rlike("^[A-Z]{3}_[0-9]{6}_[0-9]{4}$")
    letters = sum(((F.ascii(F.substring(p, k, 1)) - 65) * w for k, w in ((1, 676), (2, 26), (3, 1))), F.lit(0)).cast("long")
    digits = F.concat(F.substring(p, 5, 6), F.substring(p, 12, 4)).cast("long")
    return F.when(usual, letters * 10_000_000_000 + digits).otherwise(-F.abs(F.xxhash64(p)) - 1)


def records(patches: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(patch_id, part, x, y, obs)``: patches with a centre, a manifest row and contributors; obs: sorted distinct codes.

    part: 0 train, 1 val, 2 test; splits are compared without case and surrounding space, other values take no part.
    A patch written twice counts once (its latest row), as does a manifest row (the greatest split name).
    """
    p = latest(patches.select("patch_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("y"), "contributing_obs_ids", "built_at").where("patch_id is not null"), ["patch_id"], ["built_at"])
    p = p.where("lon is not null and y is not null and not isnan(lon) and not isnan(y)")
    # one transform per step: a lambda evaluates its argument's expression wherever it is used
    ids = F.array_compact(F.transform("contributing_obs_ids", plain_obs_id))
    obs = F.array_sort(F.array_distinct(F.transform(ids, obs_code)))
    name = F.lower(F.regexp_replace("holdout_split", r"(?U)^\s+|\s+$", ""))
    part = F.when(name == "train", 0).when(name == "val", 1).when(name == "test", 2)
    m = manifest.select("patch_id", part.alias("part")).where("part is not null and patch_id is not null").groupBy("patch_id").agg(F.max("part").alias("part"))
    return p.select("patch_id", lon360(F.col("lon")).alias("x"), "y", obs.alias("obs")).where(F.size("obs") > 0).join(m, "patch_id")


def _classes(x: np.ndarray, y: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each class of equal records, and the class of every record (by 128 bits of hash)."""
    n = len(x)
    size = np.diff(offsets)
    place = np.arange(len(values)) - np.repeat(offsets[:-1], size)
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        with np.errstate(over="ignore"):
            h = _mixed(values.view(np.uint64) ^ _mixed(place.astype(np.uint64) + np.uint64(salt)))
            total = np.add.reduceat(h, offsets[:-1]) if n else np.zeros(0, dtype=np.uint64)  # no record is without contributors
            keys.append(_mixed(total + _mixed(x.view(np.uint64) ^ np.uint64(salt)) * np.uint64(3) + _mixed(y.view(np.uint64) + np.uint64(salt))))
    _, first, of = np.unique(np.stack(keys, axis=1), axis=0, return_index=True, return_inverse=True)
    return first, of.ravel()


def _mixed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _cell_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ncol = int(np.ceil(360 / GRID)) + 2
    return np.floor((y + 90) / GRID).astype(np.int64) * ncol + np.floor(x / GRID).astype(np.int64)


class Shard:
    """Evaluation records of a place, indexed. values, offsets: their contributors, ascending, one record after the other."""

    def __init__(self, x: np.ndarray, y: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> None:
        self.x, self.y, self.size = x, y, np.diff(offsets)
        self.codes, code = np.unique(values, return_inverse=True)
        cells = _cell_of(x, y)
        self.known = np.unique(cells)
        # a symbol: a cell known to the shard with a contributor
        pair = np.repeat(np.searchsorted(self.known, cells), self.size) * len(self.codes) + code
        self.table, symbol = np.unique(pair, return_inverse=True)
        self.text = np.zeros(len(pair) + len(x), dtype=np.int64)
        self.text[np.arange(len(pair)) + np.repeat(np.arange(len(x)), self.size)] = symbol + 1
        self.index = FMIndex(self.text, len(self.table) + 1)
        self.starts = offsets[:-1] + np.arange(len(x))

    def search(self, x: np.ndarray, y: np.ndarray, values: np.ndarray, offsets: np.ndarray, most: int = EXPANDED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (evaluation, training) that are near and similar, in portions of about ``most`` occurrences."""
        # training records against each known cell that their window touches; longitudes wrap
        which, at = [], []
        for a in (-1, 1):
            for b in (-1, 1):
                for turn in (-360.0, 0.0, 360.0):
                    shifted = x + a * NEAR_DEG + turn
                    on = (shifted > -2 * GRID) & (shifted < 360 + 2 * GRID)
                    if turn:
                        on &= (x < 2 * GRID) | (x > 360 - 2 * GRID)
                    which.append(np.flatnonzero(on))
                    at.append(_cell_of(shifted[on], y[on] + b * NEAR_DEG))
        which, at = np.concatenate(which), np.concatenate(at)
        k = np.minimum(np.searchsorted(self.known, at), len(self.known) - 1)
        hit = self.known[k] == at
        t, c = np.unique(np.stack([which[hit], k[hit]]), axis=1)
        if not len(t):
            return
        # a row per training record, cell and contributor; its symbol, -1 if the shard has none
        code = np.minimum(np.searchsorted(self.codes, values), len(self.codes) - 1)
        code = np.where(self.codes[code] == values, code, -1)
        of, item = _ranges(offsets[t], offsets[t + 1])
        want = np.where(code[item] >= 0, c[of] * len(self.codes) + code[item], -1)
        s = np.minimum(np.searchsorted(self.table, want), len(self.table) - 1)
        symbols = np.where(self.table[s] == want, s + 1, -1)
        # how often its symbols occur bounds what a query can meet: portions follow that bound, and a query is never cut
        n = np.where(symbols > 0, self.index.first[np.maximum(symbols, 0) + 1] - self.index.first[np.maximum(symbols, 0)], 0)
        portion = np.cumsum(np.bincount(of, weights=n, minlength=len(t))).astype(np.int64) // most
        cuts = np.flatnonzero(np.concatenate([[True], portion[1:] != portion[:-1], [True]]))
        row = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(t)))])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = slice(row[a], row[b])
            i, j, common = self._intersections(t, of[r], item[r], symbols[r], offsets)
            if not len(i):
                continue
            union = self.size[i] + (offsets[j + 1] - offsets[j]) - common
            gap = np.abs(self.x[i] - x[j])
            ok = (common >= SIMILAR * union) & (np.abs(self.y[i] - y[j]) < NEAR_DEG) & (np.minimum(gap, 360 - gap) < NEAR_DEG)
            yield i[ok], j[ok]

    def _intersections(self, t: np.ndarray, of: np.ndarray, item: np.ndarray, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(evaluation, training, size of the intersection) of the queries of a portion; ``of``: query of each row."""
        index, text = self.index, self.text
        first, last = item == offsets[t[of]], item == offsets[t[of] + 1] - 1
        # backward search from every contributor at which a match may end; rows that cannot go on are maximal
        now = np.flatnonzero(symbols > 0)
        lo, hi = index.step(symbols[now], np.zeros(len(now), dtype=np.int64), np.full(len(now), index.n, dtype=np.int64))
        end, length, got = now.copy(), 1, []
        while len(now):
            live = lo < hi
            now, end, lo, hi = now[live], end[live], lo[live], hi[live]
            if not len(now):
                break
            before = np.where(first[now], -1, symbols[np.maximum(now - 1, 0)])
            row_of, rows = _ranges(lo, hi)
            stuck = index.tree.access(rows) != before[row_of]
            row_of, rows = row_of[stuck], rows[stuck]
            where = index.locate(rows)
            # not maximal to the right: the next symbols agree too, a longer match covers it
            e = end[row_of]
            after = np.where(last[e], -1, symbols[np.minimum(e + 1, len(symbols) - 1)])
            keep = text[where + length] != after
            got.append((of[e[keep]], np.searchsorted(self.starts, where[keep], side="right") - 1, np.full(int(keep.sum()), length)))
            on = np.flatnonzero(before > 0)
            now, end = now[on] - 1, end[on]
            lo, hi = index.step(before[on], lo[on], hi[on])
            length += 1
        if not got:
            return (np.zeros(0, dtype=np.int64),) * 3
        q, doc, n = (np.concatenate(v) for v in zip(*got, strict=True))
        # merge the spans of each pair (they are disjoint runs of sorted sets)
        key, inverse = np.unique(t[q] * len(self.x) + doc, return_inverse=True)
        return key % len(self.x), key // len(self.x), np.bincount(inverse, weights=n)


class _Side:
    """Records of a side as arrays, and the first of each class of equal ones."""

    def __init__(self, t: pa.Table) -> None:
        lists = t["obs"].combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        x, y, values = t["x"].to_numpy(), t["y"].to_numpy(), lists.flatten().to_numpy()
        self.ids, self.part = t["patch_id"].combine_chunks(), t["part"].to_numpy()
        first, of = _classes(x, y, values, ends - ends[0])
        order = np.argsort(of, kind="stable")
        self.members, self.begin = order, np.searchsorted(of[order], np.arange(len(first) + 1))
        size = np.diff(ends)[first]
        _, item = _ranges((ends - ends[0])[first], (ends - ends[0])[first + 1])
        self.arrays = x[first], y[first], values[item], np.concatenate([[0], np.cumsum(size)])


def _expanded(e: _Side, r: _Side, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All pairs of members of pairs of classes, OUT_ROWS at a time."""
    n, m = (np.diff(s.begin)[k] for s, k in ((e, i), (r, j)))
    ends = np.cumsum(n * m)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, OUT_ROWS):
        k = np.arange(a, min(a + OUT_ROWS, total))
        pair = np.searchsorted(ends, k, side="right")
        inner = k - (ends - n * m)[pair]
        left = e.members[e.begin[i[pair]] + inner // m[pair]]
        right = r.members[r.begin[j[pair]] + inner % m[pair]]
        yield pa.RecordBatch.from_arrays([e.ids.take(pa.array(left)), r.ids.take(pa.array(right)), pa.array(e.part[left])], names=["eval_id", "train_id", "part"])


def overlaps(recs: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """``(eval_id, train_id, part)`` of all pairs of an evaluation and a training record that are near and similar.

    ``recs`` as :func:`records` gives. Shards follow place; a place with very many records is cut into a grid of tasks
    (some of its evaluation records against some of its training records), so that no task holds all of it.
    """
    spark = recs.sparkSession
    recs = written(recs, "records")  # read twice: for the counts and for the shards
    x, y, d = F.col("x"), F.col("y"), F.lit(NEAR_DEG)
    window = F.array_distinct(F.array(*[_cell(lon360(x + a * d), y + b * d) for a in (-1, 1) for b in (-1, 1)]))
    placed = recs.select("patch_id", "part", "x", "y", "obs", F.when(F.col("part") == 0, window).otherwise(F.array(_cell(x, y))).alias("cells"))
    placed = placed.select("patch_id", "part", "x", "y", "obs", F.explode("cells").alias("cell"))
    # at most 64,800 cells: a bounded collect
    counts = placed.groupBy("cell").agg(F.count_if(F.col("part") > 0).alias("e"), F.count_if(F.col("part") == 0).alias("t")).where("e > 0 and t > 0").collect()
    plan, tasks = _plan([(r["cell"], r["e"]) for r in counts], [(r["cell"], r["t"]) for r in counts], max(parallelism(spark), 2), per_task)
    at = F.broadcast(spark.createDataFrame(plan, "cell int, first int, ni int, nj int"))
    i, j = [F.pmod(F.xxhash64("patch_id"), F.col(c)).cast("int") for c in ("ni", "nj")]
    mine = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda k: F.col("first") + i * F.col("nj") + k)
    theirs = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda k: F.col("first") + k * F.col("nj") + j)
    sent = placed.join(at, "cell").withColumn("task", F.explode(F.when(F.col("part") > 0, mine).otherwise(theirs)))
    # evaluation records come first in a task, so that its index stands before training records stream through it
    sent = sent.select("task", "patch_id", "part", "x", "y", "obs").repartitionById(tasks, F.col("task")).sortWithinPartitions(F.desc(F.col("part") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        side = shard = None
        for b in batches:
            t = pa.Table.from_batches([b])
            train = t["part"].to_numpy() == 0
            if not train.all():
                held.append(t.filter(pa.array(~train)))
            if not train.any() or not held:
                continue
            if shard is None:
                side = _Side(pa.concat_tables(held).combine_chunks())
                shard = Shard(*side.arrays)
            rest = _Side(t.filter(pa.array(train)).combine_chunks())
            for i, j in shard.search(*rest.arrays):
                yield from _expanded(side, rest, i, j)

    return sent.mapInArrow(run, "eval_id string, train_id string, part int").distinct()
