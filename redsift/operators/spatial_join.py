"""Points near other points or inside regions: a dual-tree join in distributed tasks.

The plane is cut at its roots into one-degree cells (at most 64,800, a bound of the sphere, not of the data). Nodes with
too many points are cut into 4 x 4 children, level by level, and regions go to the nodes that they touch; a node without
both sides is discarded. Counts per node let the driver pack neighbouring nodes into tasks of about equal load; only what
stays hot at the deepest level, such as points at one place, is cut by hash into a grid of tasks (some of its points
against some of its regions), so no task grows with the hottest place. Each task builds a
tree over its points and one over its regions and descends both at once: node pairs that cannot meet are discarded,
pairs that certainly meet are accepted wholesale, and uncertain ones are refined down to leaves that are tested exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsift.session import parallelism

#: Longitudes are compared modulo 360; the sum of a longitude and 360 is rounded, by less than this.
LON_SLACK = 1e-10
PER_TASK = 200_000
POINT_LEAF, REGION_LEAF, FAN = 16, 4, 4
OUT_ROWS = 100_000
#: Levels below the one-degree cells, and children along either side of a node.
DEEPEST, SIDE = 4, 4


# ---------------------------------------------------------------- trees in a task


def _levels(parts: list[np.ndarray], ops: list[np.ufunc], leaf: int) -> list[list[np.ndarray]]:
    """Bounds of the nodes, root level first: parts reduced by ops over leaves of ``leaf`` items, then FAN nodes each."""
    starts = np.arange(0, len(parts[0]), leaf)
    levels = [[op.reduceat(p, starts) for op, p in zip(ops, parts, strict=True)]]
    while len(levels[0][0]) > 1:
        starts = np.arange(0, len(levels[0][0]), FAN)
        levels.insert(0, [op.reduceat(p, starts) for op, p in zip(ops, levels[0], strict=True)])
    return levels


def _order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Z-order of points in the plane, 16 bits a side."""

    def spread(v: np.ndarray) -> np.ndarray:
        lo, hi = (v.min(), v.max()) if len(v) else (0.0, 0.0)
        k = ((v - lo) / (hi - lo or 1.0) * 65535).astype(np.uint64)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            k = (k | (k << np.uint64(shift))) & np.uint64(mask)
        return k

    return np.argsort(spread(x) | (spread(y) << np.uint64(1)), kind="stable")


def _children(at: np.ndarray, deeper: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node its children's numbers; the index of the parent of each."""
    first, last = at * FAN, np.minimum(at * FAN + FAN, deeper)
    return _ranges(first, last)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = last - first
    of = np.repeat(np.arange(len(first)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _descend(points: list, regions: list, n_points: int, n_regions: int, judge, exact) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (point, region) that meet. judge: of node pairs (apart, certain); exact: of item pairs."""
    a = b = np.zeros(1, dtype=np.int64)
    la = lb = 0
    spans = lambda levels, level, leaf: leaf * FAN ** (len(levels) - 1 - level)
    while len(a):
        apart, certain = judge([v[a] for v in points[la]], [v[b] for v in regions[lb]])
        sa, sb = spans(points, la, POINT_LEAF), spans(regions, lb, REGION_LEAF)
        for whole, test in ((np.flatnonzero(certain & ~apart), False), (np.flatnonzero(~certain & ~apart), True)):
            bottom = la == len(points) - 1 and lb == len(regions) - 1
            if test and not bottom:
                continue
            # items of the node pairs, a bounded number at a time
            size = max(1, 2_000_000 // (sa * sb))
            for at in range(0, len(whole), size):
                k = whole[at : at + size]
                of, p = _ranges(a[k] * sa, np.minimum(a[k] * sa + sa, n_points))
                of2, r = _ranges((b[k] * sb)[of], np.minimum(b[k] * sb + sb, n_regions)[of])
                p = p[of2]
                if test:
                    ok = exact(p, r)
                    p, r = p[ok], r[ok]
                if len(p):
                    yield p, r
        left = np.flatnonzero(~certain & ~apart)
        a, b = a[left], b[left]
        if la == len(points) - 1 and lb == len(regions) - 1:
            return
        if la < len(points) - 1:
            la += 1
            of, a = _children(a, len(points[la][0]))
            b = b[of]
        if lb < len(regions) - 1:
            lb += 1
            of, b = _children(b, len(regions[lb][0]))
            a = a[of]


def join_boxes(x: np.ndarray, y: np.ndarray, w: np.ndarray, e: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of points (x, y) inside closed boxes [w, e] x [s, n]."""
    if not len(x) or not len(w):
        return
    po, ro = _order(x, y), _order((w + e) / 2, (s + n) / 2)
    px, py, rw, re, rs, rn = x[po], y[po], w[ro], e[ro], s[ro], n[ro]
    lo, hi = np.minimum, np.maximum
    points = _levels([px, px, py, py], [lo, hi, lo, hi], POINT_LEAF)
    # of a node of boxes: the hull, and the box common to all
    regions = _levels([rw, re, rs, rn, rw, re, rs, rn], [lo, hi, lo, hi, hi, lo, hi, lo], REGION_LEAF)

    def judge(p: list[np.ndarray], r: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        apart = (p[1] < r[0]) | (p[0] > r[1]) | (p[3] < r[2]) | (p[2] > r[3])
        return apart, (p[0] >= r[4]) & (p[1] <= r[5]) & (p[2] >= r[6]) & (p[3] <= r[7])

    def exact(p: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (px[p] >= rw[r]) & (px[p] <= re[r]) & (py[p] >= rs[r]) & (py[p] <= rn[r])

    for p, r in _descend(points, regions, len(px), len(rw), judge, exact):
        yield po[p], ro[r]


def haversine(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, radius: float) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(h, 1)))


def join_discs(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, km: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of points within ``km`` of centres, along great circles. The trees hold unit vectors and chords."""
    if not len(x) or not len(cx):
        return

    def unit(lon: np.ndarray, lat: np.ndarray) -> list[np.ndarray]:
        a, b = np.radians(lon), np.radians(lat)
        return [np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)]

    po, ro = _order(x, y), _order(cx, cy)
    px, py, rx, ry, rk = x[po], y[po], cx[ro], cy[ro], km[ro]
    chord = 2 * np.sin(np.minimum(rk / (2 * radius), math.pi / 2))
    lo, hi = np.minimum, np.maximum
    up, ur = unit(px, py), unit(rx, ry)
    points = _levels([*up, *up], [lo] * 3 + [hi] * 3, POINT_LEAF)
    regions = _levels([*ur, *ur, chord, chord], [lo] * 3 + [hi] * 3 + [lo, hi], REGION_LEAF)

    def judge(p: list[np.ndarray], r: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        least = sum(np.maximum(0, np.maximum(p[k] - r[k + 3], r[k] - p[k + 3])) ** 2 for k in range(3))
        most = sum(np.maximum(p[k + 3] - r[k], r[k + 3] - p[k]) ** 2 for k in range(3))
        return np.sqrt(least) > r[7] + 1e-9, np.sqrt(most) < r[6] - 1e-9

    def exact(p: np.ndarray, r: np.ndarray) -> np.ndarray:
        return haversine(px[p], py[p], rx[r], ry[r], radius) <= rk[r]

    for p, r in _descend(points, regions, len(px), len(rx), judge, exact):
        yield po[p], ro[r]


# ---------------------------------------------------------------- the distributed join


def _cell(x: Column, y: Column) -> Column:
    return (F.least(F.greatest(F.floor(y) + 90, F.lit(0)), F.lit(179)) * 360 + F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(359))).cast("int")


def lon360(c: Column) -> Column:
    """Longitude modulo 360 in [0, 360)."""
    m = F.pmod(c, F.lit(360.0))
    return F.when(m >= 360.0, F.lit(0.0)).otherwise(m)


def boxes(df: DataFrame, name: str, west: str, east: str, south: str, north: str) -> DataFrame:
    """Regions from closed boxes, one row for each side of the 0 meridian. A box with a null or NaN edge, or whose
    south edge exceeds its north, contains nothing and is left out; west > east crosses the 0 meridian."""
    e = [F.col(c).cast("double") for c in (west, east, south, north)]
    ok = (e[2] <= e[3]) & reduce(and_, [c.isNotNull() & ~F.isnan(c) for c in e])
    width = F.when(e[1] - e[0] >= 360 - 2 * LON_SLACK, F.lit(360.0)).otherwise(F.pmod(e[1] - e[0], F.lit(360.0)))
    d = df.where(ok).select(F.col(name).alias("rid"), lon360(e[0]).alias("w"), width.alias("n"), e[2].alias("c"), e[3].alias("d"))
    slack = F.lit(LON_SLACK)
    piece = lambda a, b: F.struct((a - slack).alias("a"), (b + slack).alias("b"))
    full = F.col("n") >= 360.0
    over = F.col("w") + F.col("n") >= 360.0
    parts = (
        F.when(full, F.array(piece(F.lit(0.0), F.lit(360.0))))
        .when(over, F.array(piece(F.col("w"), F.lit(360.0)), piece(F.lit(0.0), F.col("w") + F.col("n") - 360.0)))
        .otherwise(F.array(piece(F.col("w"), F.col("w") + F.col("n"))))
    )
    d = d.select("rid", F.explode(parts).alias("p"), "c", "d")
    return d.select(F.lit(1).alias("kind"), "rid", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "c", "d", F.col("p.a").alias("w"), F.col("p.b").alias("e"), F.col("c").alias("s"), F.col("d").alias("n"))


def discs(df: DataFrame, name: str, lon: str, lat: str, km: float, radius: float) -> DataFrame:
    """Regions from centres and a distance; a centre that is null, NaN or beyond a pole is left out."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    reach = math.degrees(km / radius) * (1 + 1e-9) + 1e-9
    d = df.where((y >= -90) & (y <= 90) & ~F.isnan(x) & x.isNotNull()).select(F.col(name).alias("rid"), lon360(x).alias("a"), y.alias("b"))
    polar = F.abs(F.col("b")) + reach >= 90
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(90.0, reach)))) / F.cos(F.radians(F.col("b")))))) + 1e-6)
    d = d.withColumn("h", half)
    span = lambda a, b: F.struct(a.alias("w"), b.alias("e"))
    w, e = F.col("a") - F.col("h"), F.col("a") + F.col("h")
    parts = (
        F.when(F.col("h") >= 180.0, F.array(span(F.lit(0.0), F.lit(360.0))))
        .when(w < 0, F.array(span(w + 360.0, F.lit(360.0)), span(F.lit(0.0), e)))
        .when(e >= 360, F.array(span(w, F.lit(360.0)), span(F.lit(0.0), e - 360.0)))
        .otherwise(F.array(span(w, e)))
    )
    d = d.select("rid", "a", "b", F.explode(parts).alias("p"))
    return d.select(F.lit(2).alias("kind"), "rid", "a", "b", F.lit(float(km)).alias("c"), F.lit(float(radius)).alias("d"), F.col("p.w").alias("w"), F.col("p.e").alias("e"), (F.col("b") - reach).alias("s"), (F.col("b") + reach).alias("n"))


def _plan(points: list[tuple[int, int]], regions: list[tuple[int, int]], tasks: int, per_task: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Tasks of the cells: (cell, first task, splits of its points, splits of its regions)."""
    p, r = dict(points), dict(regions)
    cells = sorted(c for c in p if c in r)
    return _packed([(int(c), float(c % 360), float(c // 360), p[c], r[c]) for c in cells], tasks, per_task)


def _packed(nodes: list[tuple[int, float, float, int, int]], tasks: int, per_task: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Tasks of nodes (id, x, y, points, regions): in Z-order they fill tasks until each has its share; a node above it
    gets tasks of its own. (id, first task, splits of its points, splits of its regions), and the number of tasks."""
    if not nodes:
        return [], 1
    share = _share(sum(p + r for *_, p, r in nodes), tasks, per_task)
    out, now, room = [], -1, 0
    for k in _order(np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes])):
        name, _, _, p, r = nodes[k]
        if p + r > share:
            i, j = math.ceil(p / share), math.ceil(r / share)
            out.append((name, now + 1, i, j))
            now, room = now + i * j, 0
        else:
            if p + r > room:
                now, room = now + 1, share
            out.append((name, now, 1, 1))
            room -= p + r
    return out, now + 1


def _share(total: int, tasks: int, per_task: int) -> int:
    return min(per_task, max(1, math.ceil(total / tasks)))


def _node(x: Column, y: Column, level: int) -> Column:
    """Number of the node of a level: the cell, then the row and the column of the node in it."""
    cell, n = _cell(x, y).cast("long"), SIDE**level
    inside = lambda v, first: F.least(F.greatest(F.floor((v - first) * n), F.lit(0)), F.lit(n - 1))
    return (cell * n + inside(y, F.floor(cell / 360) - 90)) * n + inside(x, cell % 360)


def _bounds(level: int, node: int) -> tuple[int, float, float, float, float]:
    """Cell of a node, and its west, south, east and north edge. Clamped points lie on or beyond the outermost edges."""
    n = SIDE**level
    cell, row, col = node // (n * n), node // n % n, node % n
    w, s = cell % 360 + col / n, cell // 360 - 90 + row / n
    return cell, w, s if cell // 360 or row else -1e9, w + 1 / n, s + 1 / n if cell // 360 < 179 or row < n - 1 else 1e9


def dual_tree_join(points: DataFrame, pid: str, lon: str, lat: str, regions: DataFrame, per_task: int = PER_TASK, counted: DataFrame | None = None) -> DataFrame:
    """Every pair of a point and a region (of :func:`boxes`, :func:`discs` or their union) that meet.

    Rows ``(kind int, pid string, rid string)``, kind 1 for boxes and 2 for discs, each pair once as long as ids are
    unique. Points with a null or NaN coordinate meet nothing. ``counted``: a table with the same coordinates, cheaper
    to scan, for the counts that plan the tasks (they affect balance only). An empty side gives no rows.
    """
    spark = points.sparkSession
    x, y = F.col(f"`{lon}`").cast("double"), F.col(f"`{lat}`").cast("double")
    real = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    source = counted if counted is not None else points
    # both counts have at most 64,800 rows, the number of cells
    per_cell = source.where(real).groupBy(_cell(lon360(x), y).alias("cell")).count().collect()
    row, col = [F.least(F.greatest(F.floor(F.col(c)) + 90, F.lit(0)), F.lit(179)) for c in "sn"], [F.least(F.greatest(F.floor(F.col(c)), F.lit(0)), F.lit(359)) for c in "we"]
    in_cells = regions.withColumn("cy", F.explode(F.sequence(*row))).withColumn("cx", F.explode(F.sequence(*col))).withColumn("cell", (F.col("cy") * 360 + F.col("cx")).cast("int"))
    regions_per_cell = in_cells.groupBy("cell").count().collect()
    p, r = dict(map(tuple, per_cell)), dict(map(tuple, regions_per_cell))
    width = max(parallelism(spark), 2)
    share = _share(sum(p[c] + r[c] for c in p if c in r), width, per_task)
    # nodes with more than twice a task's share of points are cut further; a level has SIDE * SIDE children of each such node
    nodes = {(0, c): (p[c], r[c]) for c in p if c in r}
    hot, placed = sorted(c for (_, c), (n, _) in nodes.items() if n > 2 * share), source.where(real).select(lon360(x).alias("x"), y.alias("y"))
    deep: dict[tuple[int, int], int] = {}
    for level in range(1, DEEPEST + 1):
        if not hot:
            break
        parents = F.broadcast(spark.createDataFrame([(int(k),) for k in hot], "parent long"))
        below = placed.select(_node(F.col("x"), F.col("y"), level - 1).alias("parent"), _node(F.col("x"), F.col("y"), level).alias("node")).join(parents, "parent").groupBy("node").count().collect()
        if level == 1:
            nodes = {k: v for k, v in nodes.items() if k[1] not in set(hot)}
        hot = sorted(k for k, n in below if n > 2 * share and level < DEEPEST)
        deep |= {(level, k): n for k, n in below if n <= 2 * share or level == DEEPEST}
    leaf = "cell int, level int, node long, nw double, ns double, ne double, nn double"
    leaves = spark.createDataFrame([(int(_bounds(*k)[0]), k[0], int(k[1]), *map(float, _bounds(*k)[1:])) for k in deep], leaf)
    touching = in_cells.join(F.broadcast(leaves), "cell").where((F.col("w") <= F.col("ne")) & (F.col("e") >= F.col("nw")) & (F.col("s") <= F.col("nn")) & (F.col("n") >= F.col("ns")))
    if deep:
        met = {(k[0], k[1]): k[2] for k in touching.groupBy("level", "node").count().collect()}
        nodes |= {k: (n, met[k]) for k, n in deep.items() if k in met}
    names = sorted(nodes)
    packed, tasks = _packed([(i, *_bounds(*k)[1:3], *nodes[k]) for i, k in enumerate(names)], width, per_task)
    plan = [(names[i][0], int(names[i][1]), int(first), ni, nj) for i, first, ni, nj in packed]
    at = F.broadcast(spark.createDataFrame(plan, "level int, node long, first int, ni int, nj int"))
    names = ["kind", "id", "a", "b", "c", "d"]
    here = points.where(real).select(F.col(f"`{pid}`").cast("string").alias("id"), lon360(x).alias("a"), y.alias("b"))
    # a point lies in one node of the plan; without deep ones there is one level to look at
    levels = sorted({k[0] for k in nodes} | {0})
    mine = F.array(*[F.struct(F.lit(k).alias("level"), _node(F.col("a"), F.col("b"), k).alias("node")) for k in levels])
    here = here.withColumn("k", F.explode(mine)) if len(levels) > 1 else here.withColumn("k", mine[0])
    here = here.select("id", "a", "b", "k.level", "k.node").join(at, ["level", "node"])
    i = F.pmod(F.xxhash64("id"), F.col("ni")).cast("int")
    here = here.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.col("first") + i * F.col("nj") + j)))
    here = here.select("task", F.lit(0).alias("kind"), "id", "a", "b", F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    j = F.pmod(F.xxhash64("rid", "a"), F.col("nj")).cast("int")
    told = ["kind", "rid", "a", "b", "c", "d", "level", "node"]
    there = in_cells.withColumns({"level": F.lit(0), "node": F.col("cell").cast("long")}).select(told)
    there = (there.unionByName(touching.select(told)) if deep else there).join(at, ["level", "node"])
    there = there.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.col("first") + i * F.col("nj") + j)))
    there = there.select("task", "kind", F.col("rid").cast("string").alias("id"), "a", "b", "c", "d")
    both = here.unionByName(there).repartitionById(tasks, F.col("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        kind = t["kind"].to_numpy()
        v = {c: t[c].to_numpy() for c in "abcd"}
        mine = np.flatnonzero(kind == 0)
        ids = t["id"].combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        px, py = v["a"][mine], v["b"][mine]
        for k in (1, 2):
            those = np.flatnonzero(kind == k)
            if not len(those) or not len(mine):
                continue
            code = ids.take(pa.array(those)).dictionary_encode().indices.to_numpy()
            _, once = np.unique(np.stack([code.astype(np.float64), v["a"][those]]), axis=1, return_index=True)
            those = those[once]  # a region that touches several cells of the task
            g = [v[c][those] for c in "abcd"]
            pairs = join_boxes(px, py, *g) if k == 1 else join_discs(px, py, g[0], g[1], g[2], float(g[3][0]))
            for p, r in pairs:
                for at in range(0, len(p), OUT_ROWS):
                    q = p[at : at + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), k, dtype=np.int32)), ids.take(pa.array(mine[q])), ids.take(pa.array(those[r[at : at + OUT_ROWS]]))], names=["kind", "pid", "rid"]
                    )

    return both.select("task", *names).mapInArrow(run, "kind int, pid string, rid string")
