import pytest
from pyspark.sql import functions as F

from redsift.operators.cache import checksum_issues, checksum_sample, checksums, config_hash, load_split, save_split
from redsift.sources import readers, writers

LABEL = """PRODUCT_ID = "PSP_1_COLOR"
OBSERVATION_ID = "PSP_1"
SCALING_FACTOR = 2.5e-04
OFFSET = 0.04
SAMPLE_BITS = 16
SAMPLE_BIT_MASK = 2#0000001111111111#
BANDS = 3
FILTER_NAME = ("NEAR-INFRARED", "RED", "BLUE-GREEN")
SUB_SOLAR_AZIMUTH = 12.5 <DEG>
"""


def test_labels(spark, tmp_path):
    (tmp_path / "a.LBL").write_text(LABEL)
    (tmp_path / "b.LBL").write_text('PRODUCT_ID = "X"\n')
    a, b = readers.read_labels(spark, str(tmp_path)).orderBy("path").collect()
    assert (a["scaling_factor"], a["offset"], a["max_dn"], a["bands"], a["solar_azimuth"]) == (2.5e-4, 0.04, 1023, 3, 12.5)
    assert a["filter_names"] == ["NEAR-INFRARED", "RED", "BLUE-GREEN"]
    assert (b["scaling_factor"], b["offset"], b["bands"], b["filter_names"]) == (1.0, 0.0, 1, [])


def test_tab_and_suffixes(spark, tmp_path):
    good = '"V","f","ESP_1 ","ESP_1_RED","MARS", 5,"X","t","2018-01", 36.5,1,2,4,10,20,"NO "'
    p = tmp_path / "i.tab"
    p.write_text("\n".join([good, good.replace("36.5", "x"), good]))
    r = readers.load(spark, str(p)).collect()
    assert len(r) == 1 and (r[0]["year"], r[0]["mid_lat"], r[0]["mid_lon"]) == (2018, 3.0, 15.0)
    with pytest.raises(ValueError, match="no reader"):
        readers.load(spark, str(tmp_path / "x.bin"))
    q = tmp_path / "w.txt"
    q.write_text("AB 12  3.5\nCD xx  4.5\n")
    assert [tuple(x)[:3] for x in readers.read_fixed_width(spark, str(q), [("a", 1, 2, "string"), ("b", 4, 2, "int"), ("c", 7, 4, "double")]).collect()] == [("AB", 12, 3.5), ("CD", None, 4.5)]


@pytest.mark.parametrize("suffix", ["parquet", "csv", "jsonl", "orc"])
def test_round_trip(spark, tmp_path, suffix):
    schema = "patch_id string, ids array<string>, n int"
    df = spark.createDataFrame([("a", ["x", None], 1), ("b", None, None), ('q"u,o', [], 3)], schema)
    path = str(tmp_path / f"r.{suffix}")
    writers.save(df, path)
    assert {(r["patch_id"], tuple(r["ids"]) if r["ids"] is not None else None, r["n"]) for r in writers.load_records(spark, path, schema).collect()} == {("a", ("x", None), 1), ("b", None, None), ('q"u,o', (), 3)}


def test_chunks_and_metrics(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") < 20, "train").otherwise("val").alias("split"))
    writers.save_chunks(df.coalesce(1), str(tmp_path / "c"), 8)
    assert len(list((tmp_path / "c" / "split=train").glob("*.parquet"))) == 3 and (tmp_path / "c" / "_SUCCESS").exists()
    m = spark.createDataFrame([("a", 1.0, "t", 0), ("b", 2.0, "t", 0), ("b", 9.0, "t", 1), ("c", 3.0, "t", 1)], "tile_id string, rmse double, tag string, rank int")
    writers.save_tile_metrics(m, str(tmp_path / "m"))
    assert {(r["tile_id"], r["rmse"]) for r in writers.load_tile_metrics(spark, str(tmp_path / "m"), "t", "tile_id string, rmse double, tag string, rank int").collect()} == {("a", 1.0), ("b", 2.0), ("c", 3.0)}


def test_listing_and_checksums(spark, tmp_path):
    for n in ("A.JP2", "DTE_1.IMG", "x.img", "_SUCCESS", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert [r["name"] for r in readers.image_files(spark, str(tmp_path)).collect()] == ["A.JP2"]
    assert [r["name"] for r in readers.elevation_files(spark, str(tmp_path)).collect()] == ["DTE_1.IMG"]
    c = checksums(spark, str(tmp_path))
    old = c.withColumn("sha256", F.when(F.col("name") == "c.txt", "0").otherwise(F.col("sha256"))).unionByName(c.limit(1).withColumn("name", F.lit("gone")))
    assert {tuple(r) for r in checksum_issues(old, c).collect()} == {("c.txt", "mismatch"), ("gone", "missing")}
    assert checksum_sample(c).first()["name"] == "_SUCCESS"
    idx = spark.createDataFrame([("RDR/A.JP2",), (None,)], "file_name_specification string")
    assert [r["url_path"] for r in readers.download_plan(idx, spark.createDataFrame([(f"{tmp_path}/images/A.JP2",)], "path string"), str(tmp_path)).collect()] == ["RDR/A.LBL"]


def test_split_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    save_split(spark, df, str(tmp_path / "s"), axis="lon", seed=1)
    assert load_split(spark, str(tmp_path / "s"), 2, axis="lon", seed=1).count() == 2
    assert load_split(spark, str(tmp_path / "s"), 2, axis="lat", seed=1) is None and load_split(spark, str(tmp_path / "s"), 3, axis="lon", seed=1) is None and load_split(spark, str(tmp_path / "none"), 2) is None
    assert len(config_hash({"b": 1, "a": 2})) == 16 and config_hash({"b": 1, "a": 2}) == config_hash({"a": 2, "b": 1})
