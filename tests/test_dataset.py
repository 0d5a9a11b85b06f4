"""Patch records, windows, samples, seams and chunks: hand-made cases and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from redsift.functions import masks
from redsift.operators import cache, experiments, geometry, patches, raster, seams, training, windows
from redsift.operators.ranks import percentiles
from redsift.sources.writers import save_summary

META = "obs_id string, rationale_desc string, has_near_infrared boolean, has_red boolean, has_blue_green boolean"


def test_patch_records_have_gaps_ties_and_flags(spark):
    foot = spark.createDataFrame([("B", 0.0, 0.0, 1.0, 1.0), ("A", 0.0, 0.0, 1.0, 1.0), ("C", 0.5, 0.0, 1.0, 1.0), ("bad", 1.0, 1.0, 0.0, 0.0), ("nul", None, 0.0, 1.0, 1.0)], "id string, west double, south double, east double, north double")
    centres = spark.createDataFrame([(0, 0.5, 0.5), (1, 9.0, 9.0), (2, 0.5, 0.5), (3, 0.25, 0.5), (4, None, 1.0)], "pos int, cx double, cy double").withColumns({"t_start": F.lit(None).cast("timestamp"), "t_stop": F.lit(None).cast("timestamp")})
    meta = spark.createDataFrame([("A", "why", True, True, True), ("C", None, False, True, False)], META)
    got = {r["patch_id"]: r for r in patches.patch_records(centres, foot, meta, (0.2, 0.2)).collect()}
    assert set(got) == {"patch_000000", "patch_000002"}  # the second centre overlaps nothing, the third repeats the first
    r = got["patch_000000"]
    assert r["contributing_obs_ids"] == ["A", "B", "C"] and r["dominant_obs_id"] == "A" and r["rationale_raw"] == "why"
    assert r["overlap_fractions"] == pytest.approx([0.4, 0.4, 0.2]) and r["contributing_rationales"] == ["why", None] and r["has_near_infrared"]
    assert got["patch_000002"]["source_obs_count"] == 2
    assert patches.patch_records(centres.limit(0), foot, meta, (0.2, 0.2)).count() == 0


def test_sampler_parts_are_disjoint(spark):
    df = spark.createDataFrame([(f"p{i:02d}", float(i % 7), float(i % 7) + 1) for i in range(40)], "patch_id string, min_lon double, max_lon double")
    x = patches.split_coordinate("longitude")
    for method in ("geographic", "random", "kfold"):
        parts = [{r["patch_id"] for r in patches.sampler(df, "patch_id", x, s, method=method, folds=4, fold=1).collect()} for s in ("train", "val", "test")]
        assert sum(map(len, parts)) == 40 and len(set().union(*parts)) == 40 and all(parts)
    with pytest.raises(ValueError):
        patches.sampler(df, "patch_id", x, "other")
    with pytest.raises(ValueError):
        patches.split_coordinate("depth")


def test_empty_summaries(spark):
    s = spark.createDataFrame([], "overall_valid_fraction double, is_patch_valid boolean, source_obs_count int, dominant_overlap_fraction double, band_valid_fraction array<double>, min_valid_fraction double")
    r = patches.sample_summary(s).first()
    assert r["num_samples"] == 0 and r["mean_band_valid_fraction"] == [0.0, 0.0, 0.0] and r["valid_patch_fraction"] == 0.0


def test_windows_take_the_first_value(spark):
    rows = [("t0", "RED", 0, 0.0, 0.0, 2.0, 2.0, 1.0, 2, [1.0, 0.0, 3.0, -9.0], -9.0, None, None), ("t1", "RED", 1, 0.0, 0.0, 2.0, 2.0, 1.0, 2, [7.0, 8.0, 9.0, float("nan")], None, 10.0, 1.0)]
    tiles = spark.createDataFrame(rows, "id string, channel string, pos int, west double, south double, east double, north double, res double, width int, values array<double>, nodata double, scale double, offset double")
    w = spark.createDataFrame([("w", 0.0, 0.0, 2.0, 2.0, 1.0), ("far", 50.0, 50.0, 51.0, 51.0, 1.0), ("nul", None, 0.0, 1.0, 1.0, 1.0), ("part", 1.0, 1.0, 3.0, 2.0, 1.0)], "id string, west double, south double, east double, north double, res double")
    got = {r["window_id"]: r["values"] for r in windows.window_pixels(w, tiles, fill=-1.0).collect()}
    assert got == {"w": [1.0, 81.0, 3.0, -1.0], "part": [81.0, -1.0]}
    pix = windows.window_pixels(w, tiles).withColumn("source", F.lit("RED")).where("window_id = 'w'")
    assert windows.assembled(pix, ["RED", "NEAR-INFRARED"]).first()["tile"] == [0.0] * 4 + [1.0, 81.0, 3.0, 0.0]
    with pytest.raises(ValueError):
        windows.require_channels(["GREEN"])
    assert windows.require_channels(["RED", "NEAR-INFRARED"]) == ["NEAR-INFRARED", "RED"]


def test_seams():
    g = np.random.default_rng(0)
    valid = np.ones((128, 128), dtype=bool)
    base = np.cumsum(g.normal(0, 0.01, (128, 128)), axis=0)
    cut = base + np.where(np.arange(128)[:, None] < 64, 0.0, 2.0)
    got, plain = seams.detect_seam(cut, base, valid), seams.detect_seam(g.normal(0, 1, (128, 128)), base, valid)
    assert got["is_seam"] and not plain["is_seam"] and got["composite"] > 5 * plain["composite"]
    assert abs(got["row"] - 63) <= 2 and got["angle"] == 0.0 and got["span"] > 0.9 and got["linearity"] > 0.8
    for v in (np.zeros_like(valid), valid[:3, :3]):
        assert seams.detect_seam(base[: v.shape[0], : v.shape[1]], base[: v.shape[0], : v.shape[1]], v)["composite"] == 0
    lab = seams.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], dtype=bool))
    assert len(np.unique(lab)) == 3 and lab[0, 0] == lab[1, 1] == lab[0, 2] != lab[3, 0]


def test_kriging_follows_a_plane():
    y, x = np.mgrid[:12, :12]
    a, valid = 3.0 * x - 2.0 * y + 5, np.random.default_rng(1).random((12, 12)) > 0.4
    assert np.allclose(raster.kriging_fill(np.where(valid, a, 0), valid), a, atol=1e-6)
    flat = raster.kriging_fill(np.where(valid, 4.0, 0), valid, drift=False)
    assert np.allclose(flat, 4.0) and np.array_equal(raster.kriging_fill(a, np.zeros_like(valid)), a)


def test_masks_and_batches(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [True, True, False], [False, True, True])], "t array<array<double>>, ok array<boolean>, seen array<boolean>")
    r = df.select(masks.masked_tokens(F.col("t"), F.col("ok"), F.col("seen")).alias("h"), masks.composite(F.col("t"), F.transform("t", lambda p: F.transform(p, lambda x: -x)), F.col("ok"), F.col("seen")).alias("c"), masks.pack_visible(F.col("t"), F.col("seen"), 3).alias("p"), masks.three_channels(F.slice("t", 1, 1)).alias("k")).first()
    assert r["h"] == [[0, 0], [3, 4], [0, 0]] and r["c"] == [[-1, -2], [3, 4], [0, 0]] and r["p"] == [[3, 4], [5, 6], [0, 0]] and r["k"] == [[1, 2]] * 3
    b = training.collated(spark.range(7), "id", 3, ["id"]).orderBy("batch").collect()
    assert [x["id"] for x in b] == [[0, 1, 2], [3, 4, 5], [6]]


def test_chunks_and_documents_round_trip(spark, tmp_path):
    c = training.chunked(spark.range(50), "id", 8, seed=3)
    training.write_chunks(c, str(tmp_path / "c"))
    back = training.read_chunks(spark, str(tmp_path / "c")).orderBy("step").collect()
    want = [r["id"] for r in c.orderBy("chunk", "place").collect()]
    assert [r["id"] for r in back] == want and [r["step"] for r in back] == list(range(1, 51))
    a, b = ([r["id"] for r in training.read_chunks(spark, str(tmp_path / "c"), e).orderBy("step").collect()] for e in (0, 1))
    assert sorted(a) == sorted(b) == list(range(50)) and a != b
    training.write_normalization(spark, str(tmp_path / "n"), [1.0, 2.0], [0.5, 0.25], {"n": 3})
    assert training.read_normalization(spark, str(tmp_path / "n")) == ([1.0, 2.0], [0.5, 0.25], {"n": 3})
    with pytest.raises(ValueError):
        training.write_normalization(spark, str(tmp_path / "n"), [1.0], [], {})
    d = training.statistics_document(spark.createDataFrame([("red", 1.0, 2), ("blue", 0.5, 1), ("red", 3.0, 1)], "channel string, mean double, n int"))
    save_summary(d, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).select("channels.red.mean", "channels.blue.n").first() == (1.0, 1)
    h = spark.createDataFrame([(2, None, 1.0), (1, None, None), (0, 3.0, None)], "step int, a double, b double")
    assert [r["step"] for r in training.history(h, "step", ["a", "b"]).collect()] == [0, 2]
    assert training.batch_means(h.limit(0), ["a"]).first()["a"] == 0.0


def test_percentiles_equal_numpy(spark):
    g = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("a", 300), ("b", 1), (None, 40)) for v in np.round(g.normal(0, 1, n), 1)] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["percentiles"], r["n"]) for r in percentiles(df, ["k"], "v", [0.02, 0.5, 0.98, 1.0]).collect()}
    for k in ("a", "b", None):
        v = [x for key, x in rows if key == k and x is not None]
        assert got[k][1] == len(v) and got[k][0] == pytest.approx(np.percentile(v, [2, 50, 98, 100]).tolist())
    assert set(got) == {"a", "b", None}
    assert percentiles(df, [], "v", [0.5]).first()["n"] == 341 and percentiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_synthetic_strips():
    a = geometry.synthetic_strips(5, 1)
    assert a == geometry.synthetic_strips(5, 1) and len(a) == 5 and len(a[0]) == 8 and len(geometry.synthetic_strips(1, chamfer=False)[0]) == 4


def test_bootstrap_does_not_depend_on_partitions(spark):
    g = np.random.default_rng(7)
    rows = [("v", s, i, float(x)) for s in range(3) for i, x in enumerate(g.normal(1 + s / 10, 2, 150))]
    df = spark.createDataFrame(rows, "variant string, seed int, tile int, delta double")
    one, many = (experiments.bootstrap(df.repartition(n), ["variant"], "seed", "delta", draws=2050).first() for n in (1, 9))
    assert [one[k] for k in ("mean", "lo", "hi")] == pytest.approx([many[k] for k in ("mean", "lo", "hi")])
    means = [np.mean([np.mean(g.choice([r[3] for r in rows if r[1] == s], 150)) for s in g.integers(0, 3, 3)]) for _ in range(3000)]
    assert one["lo"] == pytest.approx(np.percentile(means, 2.5), abs=0.05) and one["hi"] == pytest.approx(np.percentile(means, 97.5), abs=0.05)


@pytest.mark.parametrize(("x", "k"), [(2.0, 1), (10.0, 4), (3000.0, 1400), (1000.0, 600), (0.0, 3), (2e6, 1_000_000)])
def test_chi_square_tail(x, k):
    got = experiments.chi2_sf_even(x, k)
    z = ((x / (2 * k)) ** (1 / 3) - (1 - 1 / (9 * k))) / (1 / (9 * k)) ** 0.5
    from math import erfc, exp, factorial

    want = sum(exp(-x / 2) * (x / 2) ** i / factorial(i) for i in range(k)) if k < 10 else 0.5 * erfc(z / 2**0.5)
    assert got == pytest.approx(want, abs=2e-4)


def test_cache_manifest(spark, tmp_path):
    data, doc = str(tmp_path / "d"), str(tmp_path / "m")
    spark.range(40).repartition(6).write.parquet(data)
    assert cache.cache_issues(spark, data, doc, size=1) == ["no manifest"]
    cache.write_cache_manifest(spark, data, doc, size=1)
    assert cache.cache_issues(spark, data, doc, size=1) == [] and cache.cache_issues(spark, data, doc, size=2) == ["other parameters"]
    part = sorted(p for p in (tmp_path / "d").iterdir() if p.name.startswith("part"))[0]
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "d" / f".{part.name}.crc").unlink()
    issues = cache.cache_issues(spark, data, doc, size=1)
    assert len(issues) == 2 and any(i.startswith("mismatch") for i in issues) and any("bytes" in i for i in issues)
    assert cache.load_split(spark, str(tmp_path / "none"), 3, a=1) is None


def embeddings(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r[0]: np.array(r[1], dtype=float) for r in rows}


def test_tile_queries_equal_plain_formulas(spark, data):
    from redsift.plans import experiments as q

    e = embeddings(spark, data)
    shade = {r["vec_id"]: r for r in q.tile_hillshade(spark, data).collect()}
    fill = {r["vec_id"]: r for r in q.tile_fill(spark, data).collect()}
    krige = {r["vec_id"]: r for r in q.tile_kriging(spark, data).collect()}
    assert set(shade) == set(fill) == set(krige) == set(e) and not any(r["error"] for r in [*shade.values(), *fill.values(), *krige.values()])
    y, x = np.mgrid[:8, :8]
    sun = np.array([np.cos(np.radians(45)) * np.sin(np.radians(315)), np.cos(np.radians(45)) * np.cos(np.radians(315)), np.sin(np.radians(45))])
    for k, v in e.items():
        a = v.reshape(8, 8)
        gy, gx = np.gradient(a)
        assert len(shade[k]["shade"]) == 64 and 0 <= min(shade[k]["shade"]) and max(shade[k]["shade"]) <= 1
        flat = np.hypot(gx, gy).ravel() < 1e-9
        assert np.allclose(np.array(shade[k]["shade"])[flat], sun[2])
        ok = a > 0
        near, soft, harm = (np.array(fill[k][c]).reshape(8, 8) for c in ("nearest", "diffused", "harmonic"))
        assert np.allclose(near[ok], a[ok]) and np.allclose(harm[ok], a[ok])
        vy, vx = np.nonzero(ok)
        d = (y[..., None] - vy) ** 2 + (x[..., None] - vx) ** 2
        for i, j in zip(*np.nonzero(~ok), strict=True):
            close = np.flatnonzero(d[i, j] == d[i, j].min())
            assert near[i, j] in a[vy[close], vx[close]]
            around = [harm[p, r] for p, r in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= p < 8 and 0 <= r < 8]
            assert harm[i, j] == pytest.approx(np.mean(around), abs=1e-4)
        assert soft[~ok].size == 0 or (soft[~ok].min() >= a.min() - 1e-9 and soft[~ok].max() <= a.max() + 1e-9)


def test_projection_equals_plain_decomposition(spark, data):
    from redsift.plans.catalog import pca_projection

    e = embeddings(spark, data)
    m = np.stack(list(e.values()))
    c = m - m.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:2].T
    got = np.array([r["projection"] for r in sorted(pca_projection(spark, data).collect(), key=lambda r: list(e).index(r["vec_id"]))])
    for k in range(2):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-6


def test_centres_lie_in_their_strips(spark, data):
    from redsift.plans import experiments as q

    box = {r["pos"]: r for r in spark.read.parquet(f"{data}/rdr_index.parquet").collect()}
    for df in (q.simple_centres(spark, data), q.optimal_centres(spark, data)):
        rows = df.collect()
        assert {r["id"] for r in rows} == set(box)
        for r in rows:
            b = box[r["id"]]
            if r["cx"] is None:
                continue
            w, e = ((v + 180) % 360 - 180 for v in (b["min_longitude"], b["max_longitude"]))
            dx = min(r["cx"] + 0.009, e) - max(r["cx"] - 0.009, w)
            dy = min(r["cy"] + 0.009, b["max_latitude"]) - max(r["cy"] - 0.009, b["min_latitude"])
            assert r["share"] == pytest.approx(dx * dy / 0.018**2, abs=1e-6) and r["share"] >= 0.75 - 1e-6
    cover = {r["id"]: r for r in q.strip_coverage(spark, data).collect()}
    assert all(0 <= c["covered"] <= c["total"] + 1e-9 for c in cover.values())


def test_next_rows_equal_plain_order(spark):
    from redsift.operators.ranks import with_next

    g = np.random.default_rng(4)
    rows = [(k, int(t), i) for k, n in (("hot", 400), ("one", 1), (None, 30)) for i, t in enumerate(g.integers(0, 50, n))] + [("hot", None, 900)]
    got = with_next(spark.createDataFrame(rows, "k string, t int, i int").repartition(9), ["k"], ["t", "i"], "i").collect()
    assert len(got) == len(rows)
    for k in ("hot", "one", None):
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-1 if r[1] is None else r[1], r[2]))
        want = {r[2]: (order[j + 1][2] if j + 1 < len(order) else None, j == 0) for j, r in enumerate(order)}
        assert {r["i"]: (r["next"], r["first"]) for r in got if r["k"] == k} == want


def test_inverted_file_finds_clustered_neighbours(spark):
    from redsift.operators.embeddings import cosine_topk, ivf_topk

    g = np.random.default_rng(9)
    centres = g.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + g.normal(0, 0.2, 16)).tolist()) for i in range(1200)] + [(5000, None), (5001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    exact = {(r["id"], r["neighbour"]) for r in cosine_topk(df, "id", "v", 5, 20).collect()}
    found = {(r["id"], r["neighbour"]) for r in ivf_topk(df, "id", "v", 5, 20, per_task=15).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)
    assert ivf_topk(df.limit(0), "id", "v").count() == 0


def test_ortho_overlap_wraps(spark):
    ring = [(179.0, 0.0), (180.0, 0.0), (180.0, 1.0), (179.0, 1.0)]
    rows = [(1, ring, 179.5, 0.0, 181.0, 1.0, True, True), (2, ring, 0.0, 0.0, 1.0, 1.0, False, True), (3, ring, None, None, None, None, True, False), (4, None, 0.0, 0.0, 1.0, 1.0, True, True), (5, ring, 539.0, -1.0, 539.5, 0.25, True, True)]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, west double, south double, east double, north double, present boolean, placed boolean")
    got = {r["id"]: r["overlap"] for r in geometry.ortho_overlap(df).collect()}
    assert got == pytest.approx({1: 0.5, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.125})
