import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from redsift.operators import spatial_join as sj

R = 3396.19


def pairs(gen):
    return sorted((int(p), int(r)) for a, b in gen for p, r in zip(a, b, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300), st.integers(0, 60), st.sampled_from([1.0, 0.01, 0.0]))
def test_box_trees_equal_brute_force(seed, n, m, spread):
    g = np.random.default_rng(seed)
    x, y = np.round(g.random(n) * spread, 3), np.round(g.random(n) * spread, 3)
    w, s = np.round(g.random(m) * spread, 3), np.round(g.random(m) * spread, 3)
    e, t = w + np.round(g.random(m) * 0.3, 3), s + np.round(g.random(m) * 0.3, 3)
    want = sorted((i, j) for i in range(n) for j in range(m) if w[j] <= x[i] <= e[j] and s[j] <= y[i] <= t[j])
    assert pairs(sj.join_boxes(x, y, w, e, s, t)) == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 200), st.integers(0, 40))
def test_disc_trees_equal_brute_force(seed, n, m):
    g = np.random.default_rng(seed)
    x, y = g.random(n) * 360, np.degrees(np.arcsin(g.random(n) * 2 - 1))
    cx, cy, km = g.random(m) * 360, np.degrees(np.arcsin(g.random(m) * 2 - 1)), g.random(m) * 4000
    want = sorted((i, j) for i in range(n) for j in range(m) if sj.haversine(x[i], y[i], cx[j], cy[j], R) <= km[j])
    assert pairs(sj.join_discs(x, y, cx, cy, km, R)) == want


def joined(spark, points, boxes=(), discs=(), km=25.0, per_task=sj.PER_TASK):
    p = spark.createDataFrame(points, "id string, x double, y double, kind string")
    b = sj.boxes(spark.createDataFrame(list(boxes), "rid string, a double, b double, s double, n double"), "rid", "a", "b", "s", "n")
    d = sj.discs(spark.createDataFrame(list(discs), "rid string, x double, y double"), "rid", "x", "y", km, R)
    return sorted((tuple(r)[1:] for r in sj.dual_tree_join(p, "id", "x", "y", b.unionByName(d), per_task).collect()), key=str)


def test_meridian_poles_nulls(spark):
    points = [("a", 0.0, 0.0, "k"), ("b", 359.5, 1.0, "k"), ("c", -0.5, 1.0, "k"), ("d", None, 1.0, None), ("e", float("nan"), 1.0, None), ("f", 10.0, 89.9, None), ("g", 190.0, 89.9, None), (None, 5.0, 5.0, None)]
    boxes = [("w", 350.0, 10.0, -5.0, 5.0), ("e", 350.0, 360.0, 0.0, 0.0), ("rev", 0.0, 1.0, 5.0, -5.0), ("nul", None, 1.0, 0.0, 1.0), ("nan", float("nan"), 1.0, 0.0, 1.0), ("all", 0.0, 360.0, -90.0, 90.0)]
    got = joined(spark, points, boxes, [("pole", 0.0, 90.0), ("nul", None, 0.0)])
    assert {p for p, r in got if r == "w"} == {"a", "b", "c", None}  # (5, 5) is on the closed corner side; a null id is kept
    assert {p for p, r in got if r == "e"} == {"a"}
    assert {p for p, r in got if r == "pole"} == {"f", "g"}
    assert {r for _, r in got} == {"w", "e", "all", "pole"}
    assert sum(r == "all" for _, r in got) == 6


def test_hot_place_is_cut_into_a_grid_of_tasks(spark):
    points = [(f"p{i}", 10.5, 10.5, None) for i in range(300)] + [(f"q{i}", float(i % 360), 0.0, None) for i in range(50)]
    boxes = [(f"b{i}", 10.0, 11.0, 10.0, 11.0) for i in range(40)]
    assert len(joined(spark, points, boxes, per_task=25)) == len(set(joined(spark, points, boxes))) == 300 * 40


def test_empty_sides(spark):
    assert joined(spark, [], [("b", 0.0, 1.0, 0.0, 1.0)]) == []
    assert joined(spark, [("a", 0.0, 0.0, None)], [], []) == []


def test_hot_cells_are_cut_by_place(spark):
    g = np.random.default_rng(8)
    near = lambda n, s: 20.5 + g.normal(0, s, n)
    x, y = np.concatenate([near(700, 0.05), near(200, 0.3), g.random(100) * 360]), np.concatenate([near(700, 0.05), near(200, 0.3), g.random(100) * 180 - 90])
    x[:40], y[:40] = np.round(x[:40] * 64) / 64, np.round(y[:40] * 64) / 64  # on the edges of nodes
    w, s = np.concatenate([near(60, 0.1), [0.0, 20.5]]), np.concatenate([near(60, 0.1), [-90.0, 20.5]])
    e, n = w + np.concatenate([g.random(60) * 0.1, [360.0, 0.25]]), s + np.concatenate([g.random(60) * 0.1, [180.0, 0.25]])
    x[0], y[0] = 20.75, 20.75
    points = [(f"p{i}", float(a), float(b), None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    boxes = [(f"b{i}", float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(w, e, s, n, strict=True))]
    discs = [(f"d{i}", float(x[i]), float(y[i])) for i in range(0, 400, 10)]
    want = sorted((f"p{i}", f"b{j}") for i in range(len(x)) for j in range(len(w)) if w[j] - sj.LON_SLACK <= x[i] <= e[j] + sj.LON_SLACK and s[j] <= y[i] <= n[j])
    want += sorted((f"p{i}", f"d{j}") for i in range(len(x)) for j in range(0, 400, 10) if sj.haversine(x[i], y[i], x[j], y[j], R) <= 2.0)
    for per_task in (20, 150, sj.PER_TASK):
        got = joined(spark, points, boxes, discs, 2.0, per_task)
        assert len(got) == len(set(got)) and set(got) == set(want)
