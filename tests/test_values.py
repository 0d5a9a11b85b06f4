"""Hand-computed values and invariants of the reference operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redsift.functions import geo, scale
from redsift.functions import text as tx
from redsift.functions.ids import plain_obs_id, product_type
from redsift.operators import cache, catalog, experiments, geometry, metrics, pairs, raster, reconstruct, splits, stats


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_longitudes_and_text(spark):
    assert values(spark, geo.normalize_longitude("x"), [(224.0,), (180.0,), (360.0,), (-190.0,), (None,)], "x double") == [-136.0, -180.0, 0.0, 170.0, None]
    assert values(spark, tx.clean_text("t"), [("  Olympus   Mons \n lava  ",), (None,), ("",)], "t string") == ["Olympus Mons lava", None, ""]
    assert values(spark, plain_obs_id("t"), [(" esp_012345_1234 ",), ("ESP-012345-1234",), ("ESP 012345 1234 ",), ("ESP_012345_1234_COLOR",), ("odd",), (" ",), (None,)], "t string") == ["ESP_012345_1234"] * 4 + ["ODD", None, None]
    assert values(spark, product_type("t"), [("A_COLOR ",), ("A_RED",), ("A",), (None,)], "t string") == ["COLOR", "RED", None, None]


def test_encode_frames_and_pads(spark):
    ids = F.create_map(F.lit("a"), F.lit(4), F.lit("b"), F.lit(5))
    got = values(spark, tx.encode(tx.word_tokens("t"), ids, 8), [("a B zz",), ("",), ("a " * 20,)], "t string")
    assert got[0] == [2, 4, 5, 1, 3, 0, 0, 0] and got[1] == [2, 3] + [0] * 6 and got[2] == [2] + [4] * 7


def test_scalings_invert(spark):
    df = spark.createDataFrame([(float(x),) for x in (-120, -1, 0, 0.5, 99)], "x double")
    for f in (scale.log_unresidual(scale.log_residual("x", 45.9), 45.9), scale.range_unscale((F.col("x") + 200) / 200 - 1, -200.0, 200.0)):
        got = [r for r in df.select("x", f.alias("y")).collect()]
        assert len(got) == 5
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select("x", scale.log_unresidual(scale.log_residual("x", 45.9), 45.9)).collect())


def test_histogram_percentile(spark):
    for counts, p, want in (([25, 25, 25, 25], 0.5, 2.0), ([10, 0, 10], 0.5, 1.0), ([10, 20, 30], 1.0, 3.0)):
        h = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "bin int, n long")
        assert stats.histogram_percentile(h, [], p, 0.0, float(len(counts)), len(counts)).first()["value"] == pytest.approx(want)


def test_merge_moments(spark):
    parts = spark.createDataFrame([("a", 100, 10.0, 50.0, 5.0, 20.0), ("a", 50, 20.0, 10.0, 8.0, 25.0), ("a", 0, 0.0, 0.0, 0.0, 0.0)], "k string, n long, mean double, m2 double, min double, max double")
    r = stats.merge_moments(parts, ["k"]).first()
    assert (r["n"], round(r["mean"], 2), r["min"], r["max"]) == (150, 13.33, 5.0, 25.0)


@pytest.mark.parametrize(("n", "folds"), [(11, 5), (10, 5), (3, 5), (0, 4)])
def test_fold_sizes(spark, n, folds):
    df = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = splits.ranked(df, [F.col("id")]).withColumn("fold", splits._fold(F.col("_r"), n, folds)).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in got) == [(f, n // folds + (f < n % folds)) for f in range(folds) if n // folds + (f < n % folds)]


def test_split_counts_and_manifest(spark):
    assert splits.split_counts(100, 0.8, 0.1, 0.1) == (80, 10, 10)
    with pytest.raises(ValueError, match="sum to one"):
        splits.split_counts(10, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError, match="training"):
        splits.split_counts(10, 0.0, 0.5, 0.5)  # rounds half to even, so one row alone would stay in train
    p = spark.createDataFrame([(f"patch_{i}",) for i in range(20)], "patch_id string")
    a, b = [sorted(map(tuple, splits.split_manifest(p, 7).collect())) for _ in range(2)]
    assert a == b and len(a) == 20 and sum(x[4] for x in a) == 3
    assert all((x[3] is None) == x[4] for x in a)


def test_ranks_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r["_r"] for r in splits.ranked(df, [F.col("v")]).orderBy("v").collect()] == list(range(1, 1001))


def test_pair_of_window_and_boxes(spark):
    w = spark.createDataFrame([("c", -0.25, 0.5, 0.75, 1.5)], "id string, west double, south double, east double, north double")
    b = spark.createDataFrame([("o0", -1.0, 0.0, 1.0, 2.0), ("o1", 0.0, 0.0, 2.0, 2.0), ("far", 9.0, 9.0, 10.0, 10.0), ("nul", None, 0.0, 1.0, 1.0)], "id string, west double, south double, east double, north double")
    got = {r["box_id"]: r for r in pairs.dominant(pairs.box_overlaps(w, b)).collect()}
    assert set(got) == {"o0", "o1"} and got["o0"]["rank"] == 1 and got["o0"]["fraction"] == pytest.approx(1 / 1.75)


def test_statistics_of_experiments():
    assert experiments.t_sf2(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert experiments.t_sf2(0.0, 3) == pytest.approx(1.0)
    assert experiments.chi2_sf_even(5.991464547, 1) == pytest.approx(0.05, abs=1e-9)
    assert experiments.wilcoxon(np.array([1.0, 2, 3, 4, 5]))[1] == pytest.approx(2 / 32)
    assert math.isnan(experiments.wilcoxon(np.zeros(3))[1])


def test_holm_handles_nulls(spark):
    df = spark.createDataFrame([("m", "a", 0.01), ("m", "b", 0.04), ("m", "c", 0.03), ("m", "d", None)], "metric string, v string, p double")
    got = {r["v"]: r["holm_p"] for r in experiments.holm(df, ["metric"], F.col("p")).collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_clip_area_of_rectangles(seed):
    g = np.random.default_rng(seed)
    w, s = g.random(2)
    ring = np.array([[w, s], [w + 1, s], [w + 1, s + 0.5], [w, s + 0.5]])
    x, y = g.random(5) * 2, g.random(5) * 2
    e, n = x + g.random(5), y + g.random(5)
    want = np.maximum(np.minimum(e, w + 1) - np.maximum(x, w), 0) * np.maximum(np.minimum(n, s + 0.5) - np.maximum(y, s), 0)
    assert np.allclose(geometry.clip_areas(ring, x, y, e, n), want, atol=1e-12)


def test_packing_keeps_its_promise():
    t = np.radians(15)
    rot = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    strip = np.array([[-0.025, -1.35], [0.025, -1.35], [0.025, 1.35], [-0.025, 1.35]]) @ rot.T + [-130, 18.5]
    region = geometry.valid_centres(strip, 0.018, 0.75)
    c = geometry.pack_strips(region, 0.018)
    assert len(c) > 100 and geometry.shares(strip, c[:, 0], c[:, 1], 0.018).min() >= 0.75 - 1e-9
    assert len(geometry.valid_centres(strip, 5.0, 0.9)) == 0


def test_raster_kernels():
    y, x = np.mgrid[0:64, 0:64]
    flat, ok = 3.0 * x + 2 * y, np.ones((64, 64), dtype=bool)
    assert raster.topographic_residual(flat, ok) < 1e-8 and raster.tin_score(flat, ok) == 1.0
    assert raster.mosaic([np.array([[0.0, 1]]), np.array([[2.0, 3], [4, np.nan]])]).tolist() == [[2, 1], [4, 0]]
    m = metrics.all_metrics(flat, flat, ok)
    assert m["rmse"] < 1e-9 and m["normal_error"] < 1e-3 and m["ms_ssim"] == pytest.approx(1.0)
    assert metrics.errors(flat, flat, ~ok)["rmse"] == 0.0


def test_a_bad_tile_is_an_error_row(spark):
    df = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, 4.0]), (2, 2, 2, [1.0]), (3, 2, 2, None)], "id long, height int, width int, a array<double>")
    got = {r["id"]: r for r in raster.map_tiles(df, ["a"], lambda a: {"s": float(a.sum())}, "s double, error string").collect()}
    assert got[1]["s"] == 10.0 and got[1]["error"] is None and got[2]["error"] and got[3]["error"]


def test_mosaic_offsets_are_recovered(spark):
    truth = np.add.outer(np.arange(12.0), np.sin(np.arange(12.0)))
    rows = [(r * 2 + c, r, c, (truth[r * 4 : r * 4 + 8, c * 4 : c * 4 + 8] + 5.0 * r - 3.0 * c).ravel().tolist(), [1.0] * 64) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "patch long, row int, col int, values array<double>, conf array<double>")
    got = reconstruct.reconstruct(df, 8, 4).toPandas()
    m = got.pivot(index="y", columns="x", values="blended").to_numpy()
    d = m - truth
    assert np.abs(d - d.mean()).max() < 0.05


def test_mosaic_tilts_are_recovered(spark):
    y, x = np.meshgrid(np.linspace(-1, 1, 8), np.linspace(-1, 1, 8), indexing="ij")
    truth = np.add.outer(np.arange(16.0) ** 2 / 10, np.sin(np.arange(16.0)))
    tilt = np.random.default_rng(1).normal(size=(9, 3)) * 5
    tilt -= tilt.mean(axis=0)
    rows = [(r * 3 + c, r, c, (truth[r * 4 : r * 4 + 8, c * 4 : c * 4 + 8] + tilt[r * 3 + c, 0] * x + tilt[r * 3 + c, 1] * y + tilt[r * 3 + c, 2]).ravel().tolist(), [1.0] * 64) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "patch long, row int, col int, values array<double>, conf array<double>")
    m = reconstruct.reconstruct(df, 8, 4).toPandas().pivot(index="y", columns="x", values="blended").to_numpy()
    assert np.abs(m - truth).max() < 1e-4


def test_plane_solve_is_the_least_squares_solution():
    import pandas as pd

    rng = np.random.default_rng(2)
    place = {r * 4 + c: (r, c) for r in range(3) for c in range(4)}
    pairs_ = [(a, b, dr, dc, *rng.normal(size=3)) for a, (r, c) in place.items() for b, (s, t) in place.items() for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)) if (s - r, t - c) == (dr, dc)]
    got = reconstruct.solve_planes(pd.DataFrame(pairs_, columns=["a", "b", "dr", "dc", "px", "py", "pc"]), list(place), 8, 4)[["tilt_x", "tilt_y", "offset"]].to_numpy()
    a, rhs = [], []
    for i, j, dr, dc, *p in pairs_:
        for k in range(3):
            row = np.zeros((12, 3))
            row[j, k], row[i, k] = 1, -1
            if k == 2:
                row[j, 0], row[j, 1] = -dc * 8 / 7, -dr * 8 / 7
            a.append(row.ravel())
            rhs.append(p[k])
    for k in range(3):
        row = np.zeros((12, 3))
        row[:, k] = 100
        a.append(row.ravel())
        rhs.append(0.0)
    a, rhs = np.vstack([*a, 1e-4 * np.eye(36)]), np.concatenate([rhs, np.zeros(36)])
    assert np.abs(got.ravel() - np.linalg.lstsq(a, rhs, rcond=None)[0]).max() < 1e-6


def test_every_embedding_is_in_a_mosaic(spark, data):
    from redsift.plans.experiments import mosaic_reconstruction

    ids = [r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()]
    want = {}
    for i in ids:
        r, c = i % 16 // 4, i % 4
        for y in range(r * 4, r * 4 + 8):
            for x in range(c * 4, c * 4 + 8):
                want[i // 16, y, x] = want.get((i // 16, y, x), 0) + 1
    got = mosaic_reconstruction(spark, data).collect()
    assert len(ids) > 16 and {(r["scene"], r["y"], r["x"]): r["n"] for r in got} == want


def test_scenes_are_solved_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(s, r * 2 + c, r, c, (rng.normal(size=64) + 10.0 * s * (r + c)).tolist(), [1.0] * 64) for s in range(2) for r in range(2) for c in range(2)] + [(2, 0, 0, 0, rng.normal(size=64).tolist(), [1.0] * 64)]
    df = spark.createDataFrame(rows, "scene int, patch long, row int, col int, values array<double>, conf array<double>")
    got = {(r["scene"], r["y"], r["x"]): r["blended"] for r in reconstruct.reconstruct(df, 8, 4).collect()}
    assert len(got) == 144 * 2 + 64
    for s in range(3):
        for r in reconstruct.reconstruct(df.where(F.col("scene") == s).drop("scene"), 8, 4).collect():
            assert got[s, r["y"], r["x"]] == pytest.approx(r["blended"], abs=1e-9)
    assert [got[2, i // 8, i % 8] for i in range(64)] == pytest.approx(rows[-1][4], abs=1e-9)


def test_bootstrap_query_takes_every_part(spark, monkeypatch):
    import inspect

    from redsift.plans.experiments import hierarchical_bootstrap

    folder, bootstrap, seen = "/root/testdata/sf0.01", experiments.bootstrap, {}

    def spy(df, *args, **named):
        call = inspect.signature(bootstrap).bind(df, *args, **named)
        call.apply_defaults()
        seen.update(call.arguments)
        return bootstrap(df, *args, **named)

    monkeypatch.setattr(experiments, "bootstrap", spy)
    got = {r["variant"]: r for r in hierarchical_bootstrap(spark, folder).collect()}
    keys = {tuple(r) for r in spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_returnflag", "l_linenumber % 3", "l_partkey").distinct().collect()}
    assert seen["draws"] == 2000
    assert seen["df"].count() == sum(v != "N" and ("N", s, t) in keys for v, s, t in keys)
    assert set(got) == {"A", "R"} and all(r["lo"] < r["mean"] < r["hi"] for r in got.values())


def test_cache_keeps_good_rows(spark):
    m = spark.createDataFrame([("A", "x  y"), ("B", "z"), ("C", None)], "obs_id string, rationale_desc string")

    def expand(p):
        if p == "z":
            raise RuntimeError("no")
        return p.upper()

    c = cache.build_cache(m, cache.load_cache(spark, None), expand, "m1")
    got = {r["obs_id"]: r for r in cache.merge_cache(m, c).collect()}
    assert got["A"]["rationale_expanded"] == "X Y" and got["A"]["has_rationale_expanded"] and got["B"]["rationale_expanded"] is None and not got["B"]["has_rationale_expanded"]
    again = cache.build_cache(m, c, lambda p: "never for hits", "m1").where("obs_id = 'A'").first()
    assert again["rationale_expanded"] == "X Y"


def test_text_filter_is_literal(spark):
    df = spark.createDataFrame([(1, "A.c crater", None), (2, None, None), (3, "abc", "CRATER")], "id long, a string, b string")
    assert [r["id"] for r in catalog.text_filter(df, "crater").collect()] == [1, 3]
    assert [r["id"] for r in catalog.text_filter(df, "A.C").collect()] == [1]
    assert catalog.text_filter(df, None).count() == 3
