"""Queries of the operators that build datasets: patch records, samplers, windows, samples, masks, histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.functions import masks
from redsift.functions.geo import normalize_longitude
from redsift.functions.ids import product_observation
from redsift.operators import catalog, geometry, pairs, patches, training, windows
from redsift.operators.latest import keep_first
from redsift.plans.catalog import lon, rounded
from redsift.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- patch records


_SIDE = 0.02
_OBS = "regexp_replace(trim(product_id), '_(COLOR|RED)$', '')"
_RECORDS = f"""
with f as (select {_OBS} as id, {lon('min_longitude')} as west, min_latitude as south, {lon('max_longitude')} as east, max_latitude as north, pos from rdr_index qualify row_number() over (partition by {_OBS} order by pos) = 1),
m as (select {_OBS} as id, coalesce(regexp_extract(product_id, '_(COLOR|RED)\\s*$', 1) = 'COLOR', false) as color, trim(regexp_replace(rationale_desc, '\\s+', ' ', 'g')) as why from rdr_index
 qualify row_number() over (partition by {_OBS} order by case when coalesce(regexp_extract(product_id, '_(COLOR|RED)\\s*$', 1) = 'COLOR', false) then 0 else 1 end, pos) = 1),
s as (select * from f where west < east and south < north),
g as (select *, west + unnest(range(0, floor((east - west) / {_SIDE}::double)::bigint + 1)) * {_SIDE}::double as cx from s), h as (select *, south + unnest(range(0, floor((north - south) / {_SIDE}::double)::bigint + 1)) * {_SIDE}::double as cy from g),
k as (select pos, cx, cy, greatest(least(cx + 0.01::double, east) - greatest(cx - 0.01::double, west), 0) * greatest(least(cy + 0.01::double, north) - greatest(cy - 0.01::double, south), 0) / ({_SIDE}::double * {_SIDE}::double) as o from h),
c as (select * from k where o > 0.6::double qualify row_number() over (partition by round_even(cx, 6), round_even(cy, 6) order by pos, cx, cy) = 1),
n as (select row_number() over (order by pos, cx, cy) - 1 as i, cx, cy, cx - {_SIDE}::double / 2 as w, cy - {_SIDE}::double / 2 as s, cx + {_SIDE}::double / 2 as e, cy + {_SIDE}::double / 2 as t from c),
o as (select i, cx, cy, x.id, (least(n.e, x.east) - greatest(n.w, x.west)) * (least(n.t, x.north) - greatest(n.s, x.south)) as area from n join s x on n.w < x.east and x.west < n.e and n.s < x.north and x.south < n.t),
r as (select i, cx, cy, list(o.id order by round(area, 15) desc, o.id) as ids, list(area order by round(area, 15) desc, o.id) as areas, list(coalesce(color, false) order by round(area, 15) desc, o.id) as colors, list(why order by round(area, 15) desc, o.id) as texts, sum(area) as total from o left join m using (id) group by 1, 2, 3)
"""


def _footprints(spark: SparkSession, d: str) -> DataFrame:
    first = keep_first(table(spark, d, "rdr_index").withColumn("id", product_observation("product_id")), ["id"], ["pos"])
    return first.select("id", "pos", normalize_longitude("min_longitude").alias("west"), F.col("min_latitude").alias("south"), normalize_longitude("max_longitude").alias("east"), F.col("max_latitude").alias("north"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    f = _footprints(spark, d)
    strips = f.select(F.struct("pos", "id").alias("id"), "west", "south", "east", "north")
    centres = pairs.candidate_grid(strips, _SIDE, _SIDE, 0.6).select(F.struct("id.pos", "cx", "cy").alias("pos"), "cx", "cy")
    times = F.lit(None).cast("timestamp")
    return patches.patch_records(centres.withColumns({"t_start": times, "t_stop": times}), f.drop("pos"), catalog.observation_metadata(table(spark, d, "rdr_index")), (_SIDE, _SIDE), 6)


@query(_RECORDS + """select format('patch_{:06d}', i) as patch_id, round(cx, 6) as centroid_lon, round(cy, 6) as centroid_lat, ids[1] as dominant_obs_id, ids as contributing_obs_ids, [round(a / total, 6) for a in areas] as overlap_fractions,
 round(areas[1] / total, 6) as dominant_overlap_fraction, len(ids)::int as source_obs_count, list_contains(colors, true) as has_near_infrared, true as has_red, texts[1] as rationale_raw from r""")
def patch_record_build(spark, d):
    r = _records(spark, d).withColumn("overlap_fractions", F.transform("overlap_fractions", lambda x: F.round(x, 6)))
    return rounded(r.select("patch_id", "centroid_lon", "centroid_lat", "dominant_obs_id", "contributing_obs_ids", "overlap_fractions", "dominant_overlap_fraction", "source_obs_count", "has_near_infrared", "has_red", "rationale_raw"))


_AXIS = """with n as (select *, (min_lon + max_lon) / 2 as x from (select distinct patch_id, min_lon, max_lon from patch_records where patch_id is not null qualify row_number() over (partition by patch_id order by built_at desc) = 1)),
r as (select patch_id, row_number() over (order by x nulls first, patch_id) as r, row_number() over (order by md5('42:' || patch_id), patch_id) as m, count(*) over () as n from n) """


def _patches(spark: SparkSession, d: str) -> DataFrame:
    from redsift.operators.latest import latest

    return latest(table(spark, d, "patch_records").where("patch_id is not null").select("patch_id", "min_lon", "max_lon", "min_lat", "max_lat", "built_at"), ["patch_id"], ["built_at"])


@query(_AXIS + "select patch_id from r where r > n - 2 * round_even(n * 0.1, 0) and r <= n - round_even(n * 0.1, 0)")
def sampler_geographic(spark, d):
    return patches.sampler(_patches(spark, d), "patch_id", patches.split_coordinate("longitude"), "val").select("patch_id")


@query(_AXIS + "select patch_id, case when m <= n - 2 * round_even(n * 0.1, 0) then 'train' when m <= n - round_even(n * 0.1, 0) then 'val' else 'test' end as split from r")
def sampler_random(spark, d):
    return patches.sampler(_patches(spark, d), "patch_id", patches.split_coordinate("longitude"), "all", method="random").select("patch_id", "split")


@query(_AXIS + "select patch_id from r where r between 11 and 40")
def sampler_subset(spark, d):
    p = _patches(spark, d).withColumn("pos", F.struct(patches.split_coordinate("longitude").alias("x"), "patch_id"))
    return patches.centre_subset(p, "pos", 10, 40).select("patch_id")


# ---------------------------------------------------------------- windows over a table of tiles: an embedding is a tile of 8 x 8


_TILES = """with t as (select vec_id, embedding::double[] as v, (vec_id % 40) * 8.0::double as west, (vec_id // 40) * 8.0::double + 8 as north from embeddings),
w as (select vec_id as window_id, west + 3 as ww, north + 5 as wn from t), p as (select window_id, i, ww + i % 8 + 0.5 as x, wn - i // 8 - 0.5 as y from w, range(64) r(i)),
c as (select window_id, i, v[((north - y)::int * 8 + floor(x - west)::int) + 1] as z from p join t on x >= west and x < west + 8 and y <= north and y > north - 8) """
_TILES = _TILES.replace("(north - y)::int", "floor(north - y)::int")


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    west, north = (F.col("vec_id") % 40) * 8.0, F.floor(F.col("vec_id") / 40) * 8.0 + 8
    return e.select(F.col("vec_id").alias("id"), F.lit("RED").alias("channel"), F.col("vec_id").alias("pos"), west.alias("west"), (north - 8).alias("south"), (west + 8).alias("east"), north.alias("north"), F.lit(1.0).alias("res"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("values"), F.lit(None).cast("double").alias("nodata"), F.lit(2.0).alias("scale"), F.lit(1.0).alias("offset"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("id", *[(F.col(k) + s).alias(k) for k, s in (("west", 3), ("south", 5), ("east", 3), ("north", 5))], "res")


@query(_TILES + "select window_id, list(round(coalesce(case when z <> 0 then z * 2 + 1 end, 0), 4) order by i) as pixels from (select window_id, i, max(z) as z from (select window_id, i, z from c union all select window_id, i, null from p) group by 1, 2) group by 1")
def window_read(spark, d):
    got = windows.window_pixels(_windows(spark, d), _tiles(spark, d), cell=8.0)
    return got.select("window_id", F.transform("values", lambda x: F.round(x, 4)).alias("pixels"))


@query(_TILES + "select window_id, count(distinct vec_id) as num_merges from w join t on west < ww + 8 and ww < west + 8 and north - 8 < wn and wn - 8 < north group by 1")
def window_merges(spark, d):
    return windows.merge_counts(_windows(spark, d), _tiles(spark, d), 8.0)


@query(_TILES + """select window_id, list(round(coalesce(case when z <> 0 then z * 2 + 1 end, 0), 4) order by i) || [0 for k in range(64)] as tile from (select window_id, i, max(z) as z from (select window_id, i, z from c union all select window_id, i, null from p) group by 1, 2) group by 1""")
def tile_assembly(spark, d):
    got = windows.window_pixels(_windows(spark, d), _tiles(spark, d), cell=8.0).withColumn("source", F.lit("COLOR"))
    return windows.assembled(got, ["BLUE-GREEN", "RED"]).select("window_id", F.transform("tile", lambda x: F.round(x, 4)).alias("tile"))


# ---------------------------------------------------------------- masks and samples


_TOK = """with e as (select vec_id, embedding::double[] as v from embeddings), t as (select vec_id, v, [v[k * 16 + 1 : k * 16 + 16] for k in range(4)] as tok, [v[k * 16 + 1] > -0.1 for k in range(4)] as ok, [v[k * 16 + 2] > 0 for k in range(4)] as seen from e) """


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    each = F.sequence(F.lit(0), F.lit(3))
    return e.withColumns({"tok": F.transform(each, lambda k: F.slice("v", k * 16 + 1, 16)), "ok": F.transform(each, lambda k: F.get("v", k * 16) > -0.1), "seen": F.transform(each, lambda k: F.get("v", k * 16 + 1) > 0)})


def _round(c):
    return F.transform(F.flatten(c), lambda x: F.round(x, 6))


@query(_TOK + """select vec_id, [round(x, 6) for x in flatten([case when ok[k] and seen[k] then tok[k] else [0 for z in range(16)] end for k in range(1, 5)])] as hidden,
 [round(x, 6) for x in flatten([case when not ok[k] then [0 for z in range(16)] when seen[k] then tok[k] else [y * -2 for y in tok[k]] end for k in range(1, 5)])] as composite,
 [round(x, 6) for x in flatten([tok[k] for k in range(1, 5) if seen[k]] || [[0::double for z in range(16)] for q in range(4 - len([1 for k in range(1, 5) if seen[k]]))])] as packed from t""")
def masked_patches(spark, d):
    t = _tokens(spark, d)
    rebuilt = F.transform("tok", lambda p: F.transform(p, lambda x: x * -2))
    return t.select("vec_id", _round(masks.masked_tokens(F.col("tok"), F.col("ok"), F.col("seen"))).alias("hidden"), _round(masks.composite(F.col("tok"), rebuilt, F.col("ok"), F.col("seen"))).alias("composite"), _round(masks.pack_visible(F.col("tok"), F.col("seen"), 4)).alias("packed"))


@query("""with e as (select vec_id, embedding::double[] as v from embeddings), n as (select vec_id, [case when x > 0 then (x - 0.05) / 0.1 else 0 end for x in v] as z, v from e)
select vec_id, [round(x, 6) for x in z] as normalised, [round(x * 0.1 + 0.05, 6) for x in z] as restored, [round(case when x > 0 then x else list_avg([y for y in v if y > 0]) end, 6) for x in v] as filled from n""")
def masked_normalise(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", F.transform("v", lambda x: x > 0))
    z = e.withColumn("z", masks.normalize_valid(F.col("v"), F.col("ok"), 0.05, 0.1))
    six = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return z.select("vec_id", six(F.col("z")).alias("normalised"), six(masks.denormalize(F.col("z"), 0.05, 0.1)).alias("restored"), six(training.filled(F.col("v"), F.col("ok"))).alias("filled"))


_SAMPLE = """with p as (select patch_id, arg_max(struct_pack(o := dominant_obs_id, n := source_obs_count, f := dominant_overlap_fraction), built_at) as s from patch_records where patch_id is not null group by 1),
i as (select patch_id, s, row_number() over (order by patch_id) - 1 as i from p), c as (select count(*) as c from embeddings),
t as (select patch_id, s, [case when x > -0.05 then x else 0 end for x in embedding::double[]] as v from i, c join embeddings on vec_id = i % c),
f as (select patch_id, s, len([x for x in v if x <> 0]) / len(v) as share from t) """


def _samples(spark: SparkSession, d: str) -> DataFrame:
    from redsift.operators.latest import latest
    from redsift.operators.splits import ranked

    p = latest(table(spark, d, "patch_records").where("patch_id is not null").select("patch_id", "dominant_obs_id", "source_obs_count", "dominant_overlap_fraction", "built_at"), ["patch_id"], ["built_at"])
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > -0.05, x).otherwise(0.0)).alias("values"))
    n = e.count()
    tiles = ranked(p.select("patch_id"), [F.col("patch_id")]).withColumn("vec_id", (F.col("_r") - 1) % n).join(e, "vec_id")
    return training.patch_samples(p, tiles, catalog.observation_metadata(table(spark, d, "rdr_index")), 0.05, 0.1, 0.6)


@query(_SAMPLE + "select patch_id, s.o as dominant_obs_id, round(share, 6) as overall_valid_fraction, share >= 0.6 as is_patch_valid from f")
def patch_samples(spark, d):
    return rounded(_samples(spark, d).select("patch_id", "metadata.dominant_obs_id", "metadata.overall_valid_fraction", "metadata.is_patch_valid"))


@query(_SAMPLE + """select (select count(*) from patch_records) as n_patches, (select count(distinct dominant_obs_id) from patch_records) as n_observations, count(*) as num_samples, count(*) filter (share >= 0.6) as num_valid_patches,
 round(avg(share), 6) as mean_overall_valid_fraction, round(min(share), 6) as min_overall_valid_fraction, round(max(share), 6) as max_overall_valid_fraction, round(avg(s.n), 6) as mean_source_obs_count, round(avg(s.f), 6) as mean_dominant_overlap_fraction, 0.6::double as min_valid_fraction_threshold from f""")
def patch_report(spark, d):
    s = _samples(spark, d).select("metadata.*").withColumn("band_valid_fraction", F.array(*[F.col("overall_valid_fraction")] * 3))
    got = patches.patch_report(table(spark, d, "patch_records"), s)
    return rounded(got.select("n_patches", "n_observations", "num_samples", "num_valid_patches", "mean_overall_valid_fraction", "min_overall_valid_fraction", "max_overall_valid_fraction", "mean_source_obs_count", "mean_dominant_overlap_fraction", "min_valid_fraction_threshold"))


@query("with r as (select vec_id, row_number() over (order by md5('7:' || vec_id), vec_id) - 1 as r from embeddings) select vec_id, r // 64 as chunk, (r % 64)::int as place from r")
def training_chunks(spark, d):
    return training.chunked(table(spark, d, "embeddings").select("vec_id"), "vec_id", 64, 7).select("vec_id", "chunk", "place")


@query("with r as (select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) - 1 as r from orders) select r // 100 as batch, list(o_orderkey order by r) as o_orderkey, list(o_orderstatus order by r) as o_orderstatus from r group by 1")
def batch_collate(spark, d):
    return training.collated(table(spark, d, "orders"), "o_orderkey", 100, ["o_orderkey", "o_orderstatus"]).select("batch", "o_orderkey", "o_orderstatus")


_CHANNELS = ["min_latitude", "max_latitude", "map_scale", "incidence_angle"]


@query(" union all ".join(f"select '{c}' as channel, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std, min({c}) as min, max({c}) as max from rdr_index where {c} is not null and not isnan({c}) having count(*) > 0" for c in _CHANNELS))
def channel_document(spark, d):
    return rounded(training.channel_document(table(spark, d, "rdr_index"), _CHANNELS), min=12, max=12)


# ---------------------------------------------------------------- histories


@query("select pos as step, map_scale, phase_angle from rdr_index where map_scale is not null or phase_angle is not null order by pos")
def metric_history(spark, d):
    return training.history(table(spark, d, "rdr_index").select(F.col("pos").alias("step"), "map_scale", "phase_angle"), "step", ["map_scale", "phase_angle"])


@query("select l_returnflag as variant, l_linenumber % 3 as seed, round(avg(l_discount), 9) as l_discount, round(avg(l_tax), 9) as l_tax from lineitem group by 1, 2")
def cooptimisation(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variant"), (F.col("l_linenumber") % 3).alias("seed"), "l_discount", "l_tax")
    return rounded(training.cooptimised(li, ["variant", "seed"], ["l_discount", "l_tax"]), 9)


@query("with b as (select l_orderkey as batch, avg(l_discount) as loss, avg(l_tax) as mae from lineitem group by 1) select count(*) as n_batches, round(avg(loss), 9) as loss, round(avg(mae), 9) as mae from b")
def loader_evaluation(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.avg("l_discount").alias("loss"), F.avg("l_tax").alias("mae"))
    return rounded(training.batch_means(b, ["loss", "mae"]), 9)


@query("with v as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings) select vec_id, round(degrees(atan2(y, x)) + case when atan2(y, x) < 0 then 360 else 0 end, 6) as azimuth, round(degrees(asin(least(greatest(z, -1), 1))), 6) as elevation from v")
def solar_distribution(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    return rounded(training.solar_distribution(v, "x", "y", "z").select("vec_id", "azimuth", "elevation"))


@query(f"""with b as (select pos, {lon('min_longitude')} as w, {lon('max_longitude')} as e, min_latitude as s, max_latitude as n, pos % 7 <> 3 as present, pos % 5 <> 1 as placed from rdr_index),
c as (select *, {lon('(w + (e - w) / 4)')} as a, {lon('(e + (e - w) / 4)')} as z from b)
select pos, case when not present then 0 when not placed then 1 when w is null or e is null or s is null or n is null or w >= e or s >= n then 0
 else round(0.5 * (case when a <= z then greatest(0, least(e, z) - greatest(w, a)) else greatest(0, e - greatest(w, a)) + greatest(0, least(e, z) - w) end) / (e - w), 6) end::double as overlap from c""")
def ortho_overlap(spark, d):
    # the image lies a quarter of the width to the east of the footprint, and half of its height to the north
    r = table(spark, d, "rdr_index")
    w, e, s, n = normalize_longitude("min_longitude"), normalize_longitude("max_longitude"), F.col("min_latitude"), F.col("max_latitude")
    p = r.select("pos", catalog.box_ring(w, s, e, n).alias("ring"), (w + (e - w) / 4).alias("west"), (s + (n - s) / 2).alias("south"), (e + (e - w) / 4).alias("east"), (n + (n - s) / 2).alias("north"), (F.col("pos") % 7 != 3).alias("present"), (F.col("pos") % 5 != 1).alias("placed"))
    return rounded(geometry.ortho_overlap(p).select("pos", "overlap"), 6)


@query()
def packing_comparison(spark, d):
    s = _footprints(spark, d).select("id", catalog.box_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north")).alias("ring"))
    return geometry.compared(s, 0.018, 0.5)
