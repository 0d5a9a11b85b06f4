"""Queries of the catalogue, patch, split, statistics and text operators, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift import fixed
from redsift.functions import geo, scale
from redsift.functions import text as tx
from redsift.functions.ids import plain_obs_id, product_observation, product_type
from redsift.operators import catalog, embeddings, pairs, splits, stats, text_stats
from redsift.operators.latest import keep_first, keep_last
from redsift.operators.ranks import percentiles, same, with_next
from redsift.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BOX = (-140.0, 0.0, -40.0, 40.0)
LON = "((((x) + 180) % 360 + 360) % 360 - 180)"
STOP = ", ".join(f"'{w}'" for w in sorted(set(tx.STOPWORDS)))


def lon(c: str) -> str:
    return LON.replace("x", c)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rdr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rdr_index")


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, more.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- filters and projections


@query("select pos, product_id from rdr_index where " + " or ".join(f"coalesce(contains(lower({c}), 'crater'), false)" for c in ("observation_id", "product_id", "file_name_specification", "target_name", "mission_phase", "rationale_desc", "start_time", "stop_time", "stereo_flag", "delivery")))
def text_any_column_filter(spark, d):
    return catalog.text_filter(rdr(spark, d), "Crater").select("pos", "product_id")


@query(f"select pos, product_id from rdr_index where {lon('min_longitude')} <= {BOX[2]} and {lon('max_longitude')} >= {BOX[0]} and min_latitude <= {BOX[3]} and max_latitude >= {BOX[1]}")
def bbox_overlap_filter(spark, d):
    return catalog.bbox_filter(rdr(spark, d), BOX).select("pos", "product_id")


@query(f"select pos from rdr_index where {lon('min_longitude')} <= {lon('max_longitude')}")
def antimeridian_reject(spark, d):
    return catalog.no_antimeridian(rdr(spark, d)).select("pos")


@query(f"select pos, round({lon('min_longitude')}, 6) as min_lon, round({lon('max_longitude')}, 6) as max_lon from rdr_index")
def lon_normalise(spark, d):
    return rdr(spark, d).select("pos", F.round(geo.normalize_longitude("min_longitude"), 6).alias("min_lon"), F.round(geo.normalize_longitude("max_longitude"), 6).alias("max_lon"))


@query("select pos, nullif(regexp_extract(product_id, '_(COLOR|RED)\\s*$', 1), '') as product_type, regexp_replace(trim(product_id), '_(COLOR|RED)$', '') as obs_id from rdr_index")
def product_parts(spark, d):
    return rdr(spark, d).select("pos", product_type("product_id").alias("product_type"), product_observation("product_id").alias("obs_id"))


@query("select pos, trim(regexp_replace(rationale_desc, '\\s+', ' ', 'g')) as clean from rdr_index")
def clean_text(spark, d):
    return rdr(spark, d).select("pos", tx.clean_text("rationale_desc").alias("clean"))


@query("""select pos, replace('Explain: {rationale}', '{rationale}', coalesce(trim(regexp_replace(rationale_desc, '\\s+', ' ', 'g')), '')) as prompt from rdr_index""")
def prompt_render(spark, d):
    return rdr(spark, d).select("pos", tx.render_prompt("Explain: {rationale}", "rationale_desc").alias("prompt"))


@query("""with t as (select pos, coalesce(trim(regexp_replace(rationale_desc, '\\s+', ' ', 'g')), '') as r, coalesce(trim(regexp_replace(mission_phase, '\\s+', ' ', 'g')), '') as e from rdr_index)
select pos, r as raw, case when e = '' then r else e end as expanded, case when e = '' then r when r = '' then e else r || chr(10) || 'Expanded context: ' || e end as both from t""")
def compose_text(spark, d):
    return rdr(spark, d).select("pos", *[tx.compose_text("rationale_desc", "mission_phase", m).alias(n) for m, n in (("raw", "raw"), ("expanded", "expanded"), ("raw_plus_expanded", "both"))])


@query("select pos, epoch_us(try_cast(trim(start_time) as timestamp)) as start_us, epoch_us(coalesce(try_cast(trim(stop_time) as timestamp), timestamp '2006-01-01')) as stop_us from rdr_index")
def parse_times(spark, d):
    return rdr(spark, d).select("pos", F.unix_micros(tx.parse_time("start_time")).alias("start_us"), F.unix_micros(catalog.times_with_epoch("stop_time")).alias("stop_us"))


@query("select pos, '/data/images/' || string_split(trim(file_name_specification), '/')[-1] as local_path, regexp_replace('/data/images/' || string_split(trim(file_name_specification), '/')[-1], '\\.[^./]*$', '') as local_stem from rdr_index")
def local_paths(spark, d):
    p = catalog.local_path("/data", F.col("file_name_specification"))
    return rdr(spark, d).select("pos", p.alias("local_path"), catalog.local_stem(p).alias("local_stem"))


@query("select pos, case when map_scale = 0 then 0 else round(least(greatest(map_scale * 0.25 + 0.04, 0), 1), 9) end as calibrated from rdr_index")
def calibration(spark, d):
    return rdr(spark, d).select("pos", F.round(scale.calibrate("map_scale", 0.25, 0.04), 9).alias("calibrated"))


_C = "least(greatest({}, -1), 1)"


@query("""with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as q, l_extendedprice as p from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest((q - 5) / (45 - 5) * 2 - 1, -1), 1), 6) as ranged, round(sign(q - 25) * ln(1 + abs(q - 25) / 10) / ln(2), 6) as logged,
 round(q - 25, 6) as unlogged, round(least(greatest(q / 30, -1), 1), 6) as linear, round(least(greatest(log2(1 + q / 20), -1), 1), 6) as log_scaled,
 case when q > 20 then 0 else round(1 / ((q + 20) * ln(2)), 6) end as slope, case when q = 0 then 0 else round((q - 25) / 14, 6) end as z, round(least(greatest((1 - abs(q / 50)) / 0.05, 0), 1), 6) as confidence,
 round(case when abs(q - 25) <= 10 then 0.5 * (q - 25) * (q - 25) else 10 * (abs(q - 25) - 5) end, 6) as huber from v""")
def value_scalings(spark, d):
    q = F.col("l_quantity")
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scale.range_scale(q, 5, 45).alias("ranged"), scale.log_residual(q - 25, 10).alias("logged"), scale.log_unresidual(scale.log_residual(q - 25, 10), 10).alias("unlogged"), scale.linear_scaling(q, 30).alias("linear"), scale.log_scaling(q, 20).alias("log_scaled"), scale.log_scaling_slope(q, 20).alias("slope"), scale.zscore(q, 25, 14).alias("z"), scale.saturation_confidence(q / 50).alias("confidence"), scale.huber(q - 25, 10).alias("huber")))


@query("select id as step, round(-2 * ln(tan(pi() / 2 * (id + 1) / 101)), 6) as log_snr, round(1 / (1 + exp(2 * ln(tan(pi() / 2 * (id + 1) / 101)))), 6) as alpha_bar from range(100) t(id)")
def noise_schedule(spark, d):
    t = (F.col("id") + 1) / 101.0
    return rounded(spark.range(100).select(F.col("id").alias("step"), scale.cosine_log_snr(t).alias("log_snr"), scale.cosine_alpha_bar(t).alias("alpha_bar")))


_GEO = "round(sin(2 * pi() * (centroid_lon + 180) / 360), 9), round(cos(2 * pi() * (centroid_lon + 180) / 360), 9), round(sin(2 * pi() * (centroid_lat + 90) / 180), 9), round(cos(2 * pi() * (centroid_lat + 90) / 180), 9), round(min_lon / 180, 9), round(max_lon / 180, 9), round(min_lat / 90, 9), round(max_lat / 90, 9)"


@query(f"select patch_id, built_at, [{_GEO}] as features from patch_records where centroid_lon is not null and centroid_lat is not null and min_lon is not null and max_lon is not null and min_lat is not null and max_lat is not null")
def geo_features(spark, d):
    p = table(spark, d, "patch_records").na.drop(subset=["centroid_lon", "centroid_lat", "min_lon", "max_lon", "min_lat", "max_lat"])
    return p.select("patch_id", "built_at", F.transform(geo.geo_features(), lambda x: F.round(x, 9)).alias("features"))


@query("""select pos, [round(emission_angle / 180, 6), round(incidence_angle / 180, 6), round(phase_angle / 180, 6), round(sin(2 * pi() * local_time / 24), 6), round(cos(2 * pi() * local_time / 24), 6),
 round(sin(2 * pi() * solar_longitude / 360), 6), round(cos(2 * pi() * solar_longitude / 360), 6), round(sin(2 * pi() * north_azimuth / 360), 6), round(cos(2 * pi() * north_azimuth / 360), 6),
 case when upper(trim(stereo_flag)) = 'YES' then 1.0::double else 0.0::double end] as features from rdr_index""")
def viewing_features(spark, d):
    return rdr(spark, d).select("pos", F.transform(geo.viewing_features(extra=False), lambda x: F.round(x, 6)).alias("features"))


# ---------------------------------------------------------------- observations


_FIRST = f"""
with c as (select *, trim(observation_id) as o from rdr_index where regexp_matches(product_id, '_COLOR\\s*$') and {lon('min_longitude')} <= {BOX[2]} and {lon('max_longitude')} >= {BOX[0]} and min_latitude <= {BOX[3]} and max_latitude >= {BOX[1]}),
f as (select * from c qualify row_number() over (partition by o order by pos) = 1)
"""


@query(_FIRST + f"""select o as obs_id, trim(product_id) as product_id, trim(regexp_replace(rationale_desc, '\\s+', ' ', 'g')) as rationale_desc, round({lon('min_longitude')}, 6) as min_lon, round({lon('max_longitude')}, 6) as max_lon,
 round(({lon('min_longitude')} + {lon('max_longitude')}) / 2, 6) as centroid_lon, round((min_latitude + max_latitude) / 2, 6) as centroid_lat, round(({lon('max_longitude')} - {lon('min_longitude')}) * (max_latitude - min_latitude), 6) as bbox_area_deg2,
 coalesce(upper(trim(stereo_flag)) = 'YES', false) as is_stereo from f where {lon('min_longitude')} <= {lon('max_longitude')}""")
def observation_manifest(spark, d):
    got = catalog.observation_records(rdr(spark, d), BOX)
    return rounded(got.select("obs_id", "product_id", "rationale_desc", "min_lon", "max_lon", "centroid_lon", "centroid_lat", "bbox_area_deg2", "is_stereo"))


@query("""with k as (select *, regexp_replace(trim(product_id), '_(COLOR|RED)$', '') as o, case when regexp_matches(product_id, '_COLOR\\s*$') then 0 else 1 end as k from rdr_index)
select o as obs_id, trim(product_id) as product_id, k = 0 as has_near_infrared, case when k = 0 then 3 else 1 end as channel_count from k qualify row_number() over (partition by o order by k, pos) = 1""")
def observation_metadata(spark, d):
    return catalog.observation_metadata(rdr(spark, d)).select("obs_id", "product_id", "has_near_infrared", "channel_count")


@query("""with k as (select *, regexp_replace(trim(product_id), '_(COLOR|RED)$', '') as o, regexp_extract(product_id, '_(COLOR|RED)\\s*$', 1) as t from rdr_index)
select o as obs_id, count(*) as n_products, arg_min(trim(file_name_specification), pos) filter (t = 'COLOR') as color_path, arg_min(trim(file_name_specification), pos) filter (t = 'RED') as red_path, min(pos) as first_pos from k group by 1""")
def observation_groups(spark, d):
    return catalog.observation_groups(rdr(spark, d)).select("obs_id", "n_products", "color_path", "red_path", "first_pos")


@query(f"select round(min({lon('min_longitude')}), 6) as min_lon, round(max({lon('max_longitude')}), 6) as max_lon, min(min_latitude) as min_lat, max(max_latitude) as max_lat, count(*) as n from rdr_index")
def index_extent(spark, d):
    return rounded(catalog.index_extent(rdr(spark, d)))


_GRID = f"""
with b as (select {lon('min_longitude')} as w, {lon('max_longitude')} as e, min_latitude as s, max_latitude as n from rdr_index),
c as (select least(greatest(floor(w + 180), 0), 360)::bigint as x0, least(greatest(ceil(e + 180), 0), 360)::bigint as x1, least(greatest(floor(s + 90), 0), 180)::bigint as y0, least(greatest(ceil(n + 90), 0), 180)::bigint as y1 from b
 where w is not null and e is not null and s is not null and n is not null),
g as (select unnest(range(y0, y1)) as "row", x0, x1 from c), h as (select "row", unnest(range(x0, x1)) as col from g), k as (select "row", col, count(*) as n from h group by 1, 2)
"""


def _grid(spark, d):
    b = rdr(spark, d).select(geo.normalize_longitude("min_longitude").alias("min_lon"), geo.normalize_longitude("max_longitude").alias("max_lon"), F.col("min_latitude").alias("min_lat"), F.col("max_latitude").alias("max_lat"))
    return catalog.coverage_grid(b.na.drop())


@query(_GRID + 'select "row", col, n from k')
def coverage_grid(spark, d):
    return _grid(spark, d)


@query(_GRID + "select count(*) as covered, round(count(*) * 100.0 / 64800, 6) as pct, round(median(n), 6) as median_n, max(n) as max_n, sum(n)::bigint as total from k")
def coverage_summary(spark, d):
    return catalog.coverage_summary(_grid(spark, d), 64800)


@query(_GRID + """select 'row' as axis, "row" as k, sum(n)::bigint as n from k group by 2 union all select 'col', col, sum(n)::bigint from k group by 2""")
def coverage_marginals(spark, d):
    return catalog.coverage_marginals(_grid(spark, d))


# ---------------------------------------------------------------- dedupe and joins


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def keep_first_dedupe(spark, d):
    return keep_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def keep_last_dedupe(spark, d):
    return keep_last(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""with f as (select o_custkey, o_orderkey from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select c_custkey, o_orderkey as latest_order, o_orderkey is not null as has_order from customer left join f on o_custkey = c_custkey""")
def latest_ok_left_join(spark, d):
    f = keep_last(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("latest_order"))
    return table(spark, d, "customer").join(f, "c_custkey", "left").select("c_custkey", "latest_order", F.col("latest_order").isNotNull().alias("has_order"))


_OBS = r"""nullif(trim(regexp_replace(upper({0}), '^\s*([A-Z]{{3}})[^A-Z0-9]*([0-9]{{6}})[^A-Z0-9]*([0-9]{{4}})([^A-Z0-9].*)?$', '\1_\2_\3')), '')"""


@query(f"""with a as (select distinct regexp_replace(trim(product_id), '_(COLOR|RED)$', '') as o from rdr_index where regexp_matches(product_id, '_COLOR\\s*$')),
p as (select patch_id, {_OBS.format('dominant_obs_id')} as o, [{_OBS.format('z')} for z in contributing_obs_ids] as c from patch_records where has_near_infrared and has_blue_green and contributing_obs_ids is not null)
select distinct patch_id from p where o in (select o from a) and patch_id not in (select patch_id from (select patch_id, unnest(c) as z from p) where z is null or z not in (select o from a))""")
def color_capable_patches(spark, d):
    allowed = rdr(spark, d).where(product_type("product_id") == "COLOR").select(product_observation("product_id").alias("obs_id"))
    p = table(spark, d, "patch_records").withColumn("dominant_obs_id", plain_obs_id("dominant_obs_id")).withColumn("contributing_obs_ids", F.transform("contributing_obs_ids", plain_obs_id))
    return catalog.color_patches(p, allowed).select("patch_id").distinct()


_PAIRS = """
with a as (select o_orderkey, o_custkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from orders),
p as (select o_orderkey as l, nxt as r, o_orderkey || '__' || nxt as pair_key from a where nxt is not null)
"""


def _pairs(spark, d):
    a = with_next(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "nxt").where("nxt is not null")
    l, r = F.col("o_orderkey").cast("string"), F.col("nxt").cast("string")  # noqa: E741
    return a.select(l.alias("left_obs"), r.alias("right_obs"), pairs.pair_key(l, r).alias("pair_key"))


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("obs_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("scale"), F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))


@query(_PAIRS + "select pair_key, l_orderkey::varchar as obs_id, l_partkey || '/' || l_suppkey || '/' || l_linenumber as path from lineitem join (select pair_key, l as o from p union select pair_key, r from p) on l_orderkey = o")
def many_to_many_pair_explode(spark, d):
    return pairs.orthos_of_pairs(_pairs(spark, d), _lines(spark, d)).select("pair_key", "obs_id", "path")


_SLOT = _PAIRS + """, e as (select pair_key, case when o = l then 'left' else 'right' end || '_' || l_returnflag as slot, l_partkey || '/' || l_suppkey || '/' || l_linenumber as path, case when l_linestatus = 'O' then 0 else 1 end as ex, l_linestatus, l_linenumber, l_partkey, l_suppkey
 from lineitem join (select pair_key, l, l as o from p union select pair_key, l, r from p) on l_orderkey = o),
s as (select pair_key, slot, path from e qualify row_number() over (partition by pair_key, slot order by ex, l_linestatus, l_linenumber, l_partkey, l_suppkey) = 1)
"""


@query(_SLOT + "select pair_key, slot, path from s")
def slot_assignment(spark, d):
    p = _pairs(spark, d)
    return pairs.ortho_slots(p, pairs.orthos_of_pairs(p, _lines(spark, d)), "O").select("pair_key", F.explode("slots").alias("slot", "path"))


@query(_SLOT + "select pair_key from s where slot in ('left_N', 'right_N') group by 1 having count(*) = 2")
def complete_pair_filter(spark, d):
    p = _pairs(spark, d)
    return pairs.complete_pairs(pairs.ortho_slots(p, pairs.orthos_of_pairs(p, _lines(spark, d)), "O"), ["N"]).select("pair_key")


@query(_PAIRS + "select pair_key from p where not exists (select 1 from lineitem where l_orderkey = l and (l_discount < 0.02 or (abs(l_tax) < 1e-6 and abs(l_quantity - 1) < 1e-6)))")
def alignment_anti_filter(spark, d):
    p = _pairs(spark, d)
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("left_obs"), F.col("l_discount").alias("overlap"), F.col("l_quantity").alias("scale_factor"), F.col("l_tax").alias("offset"))
    return pairs.aligned_pairs(p, p.join(o, "left_obs"), least=0.02).select("pair_key")


_OVER = f"""
with w as (select patch_id as id, min(min_lon) as west, min(min_lat) as south, min(max_lon) as east, min(max_lat) as north from patch_records where min_lon is not null and max_lon is not null and min_lat is not null and max_lat is not null group by 1),
b as (select pos as id, {lon('min_longitude')} as west, min_latitude as south, {lon('max_longitude')} as east, max_latitude as north from rdr_index),
j as (select w.id as window_id, b.id as box_id, (least(w.east, b.east) - greatest(w.west, b.west)) * (least(w.north, b.north) - greatest(w.south, b.south)) as area from w join b on w.west < b.east and b.west < w.east and w.south < b.north and b.south < w.north
 where w.west < w.east and w.south < w.north and b.west < b.east and b.south < b.north)
"""


def _overlaps(spark, d):
    p = table(spark, d, "patch_records").na.drop(subset=["min_lon", "max_lon", "min_lat", "max_lat"])
    w = p.groupBy(F.col("patch_id").alias("id")).agg(F.min("min_lon").alias("west"), F.min("min_lat").alias("south"), F.min("max_lon").alias("east"), F.min("max_lat").alias("north"))
    b = rdr(spark, d).select(F.col("pos").alias("id"), geo.normalize_longitude("min_longitude").alias("west"), F.col("min_latitude").alias("south"), geo.normalize_longitude("max_longitude").alias("east"), F.col("max_latitude").alias("north"))
    return pairs.box_overlaps(w, b)


@query(_OVER + "select window_id, box_id, round(area, 9) as area from j")
def window_footprint_overlap(spark, d):
    return _overlaps(spark, d).withColumn("area", F.round("area", 9))


@query(_OVER + "select window_id, count(*) as n_sources, round(max(area) / sum(area), 6) as dominant_fraction from j group by 1")
def dominant_overlap(spark, d):
    r = pairs.dominant(_overlaps(spark, d))
    return r.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_sources"), F.round(F.max(F.when(F.col("rank") == 1, F.col("fraction"))), 6).alias("dominant_fraction"))


@query("select count(*) as n_patches, count(distinct dominant_obs_id) as n_observations, round(coalesce(avg(source_obs_count), 0), 6) as mean_sources, round(coalesce(avg(dominant_overlap_fraction), 0), 6) as mean_dominant from patch_records")
def patch_summary(spark, d):
    return pairs.patch_summary(table(spark, d, "patch_records"))


@query("""with r as (select *, round_even(centroid_lon, 3) as x, round_even(centroid_lat, 3) as y from patch_records)
select patch_id, built_at from r qualify row_number() over (partition by x, y order by patch_id, built_at) = 1""")
def dedupe_centres(spark, d):
    p = table(spark, d, "patch_records").select("patch_id", "built_at", "centroid_lon", "centroid_lat").withColumn("pos", F.struct("patch_id", "built_at"))
    return pairs.dedupe_centres(p, "centroid_lon", "centroid_lat", "pos", 3).select("patch_id", "built_at")


@query("""with s as (select pos as id, min_longitude as west, min_latitude as south, max_longitude as east, max_latitude as north from rdr_index where min_longitude < max_longitude and min_latitude < max_latitude),
g as (select *, west + unnest(range(0, floor((east - west) / 0.02)::bigint + 1)) * 0.02 as cx from s), h as (select *, south + unnest(range(0, floor((north - south) / 0.02)::bigint + 1)) * 0.02 as cy from g),
o as (select id, cx, cy, greatest(least(cx + 0.01, east) - greatest(cx - 0.01, west), 0) * greatest(least(cy + 0.01, north) - greatest(cy - 0.01, south), 0) / 0.0004 as overlap from h)
select id, round(cx, 6) as cx, round(cy, 6) as cy from o where overlap > 0.6""")
def candidate_grid(spark, d):
    s = rdr(spark, d).select(F.col("pos").alias("id"), F.col("min_longitude").alias("west"), F.col("min_latitude").alias("south"), F.col("max_longitude").alias("east"), F.col("max_latitude").alias("north"))
    return rounded(pairs.candidate_grid(s, 0.02, 0.02, 0.6).select("id", "cx", "cy"))


@query("""with g as (select l_suppkey as r, l_partkey as c, min(l_orderkey) as k from lineitem group by 1, 2), o as (select * from (values (0, 1), (1, -1), (1, 0), (1, 1)) t(dr, dc))
select x.k as a, y.k as b, dr, dc from g x, o, g y where y.r = x.r + dr and y.c = x.c + dc""")
def grid_neighbour_join(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.min("l_orderkey").alias("k"))
    return pairs.grid_neighbours(g, "k", "r", "c")


# ---------------------------------------------------------------- splits


@query("""with n as (select count(*) as n from orders), r as (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as r from orders)
select o_orderkey, case when r <= n - round_even(n * 0.1, 0) - round_even(n * 0.1, 0) then 'train' when r <= n - round_even(n * 0.1, 0) then 'val' else 'test' end as split from r, n""")
def split_geographic(spark, d):
    return splits.percent_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "split")


@query("""with f as (select o_orderkey, (ntile(5) over (order by o_totalprice, o_orderkey) - 1)::int as fold from orders),
v as (select o_orderkey, row_number() over (order by md5('2:' || o_orderkey), o_orderkey) as r, count(*) over () as n from f where fold <> 2)
select o_orderkey, fold, case when fold = 2 then 'test' when r <= greatest(1, round_even(n * 0.1, 0)) then 'val' else 'train' end as split from f left join v using (o_orderkey)""")
def kfold_assignment(spark, d):
    return splits.kfold_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [F.col("o_totalprice"), F.col("o_orderkey")], 5, 2).select("o_orderkey", "fold", "split")


@query("""with p as (select distinct patch_id from patch_records), r as (select patch_id, row_number() over (order by md5('3:' || coalesce(patch_id, '')), patch_id nulls first) as r, row_number() over (order by patch_id nulls first) - 1 as i, count(*) over () as n from p),
c as (select *, round_even(n * 0.15, 0)::bigint as h from r), k as (select *, r - h as k, n - h as m from c)
select patch_id, i as patch_index, case when r <= h then 'test' when r <= 2 * h then 'val' else 'train' end as holdout_split, r <= h as is_test,
 case when r > h then case when k <= (m % 5) * (m // 5 + 1) then (k - 1) // (m // 5 + 1) else (k - 1 - (m % 5) * (m // 5 + 1)) // (m // 5) + m % 5 end end::int as fold from k""")
def split_manifest_build(spark, d):
    return splits.split_manifest(table(spark, d, "patch_records").select("patch_id").distinct(), seed=3)


@query("""with b as (select o_orderkey, (ntile(5) over (order by o_totalprice, o_orderkey) - 1)::int as block from orders), t as (select i from range(5) r(i) order by md5('0:' || i), i limit 1)
select o_orderkey, block, case when block in (select i from t) then 'test' else 'train' end as split from b""")
def block_split(spark, d):
    return splits.block_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "block", "split")


_M = "lower(trim(holdout_split))"


@query(f"select count(*) as n, count(*) filter ({_M} = 'train') as n_train, count(*) filter ({_M} = 'val') as n_val, count(*) filter ({_M} = 'test') as n_test, " + ", ".join(f"round(count(*) filter ({_M} = '{s}') / count(*), 6) as {s}_fraction" for s in ("train", "val", "test")) + ", count(distinct fold) as n_folds from split_manifest")
def split_summary(spark, d):
    return splits.manifest_summary(table(spark, d, "split_manifest"))


@query("select fold, count(*) as n from split_manifest where fold is not null group by 1")
def fold_counts(spark, d):
    return splits.fold_counts(table(spark, d, "split_manifest"))


@query("select patch_id from split_manifest where not is_test and fold <> 1")
def role_filter(spark, d):
    return splits.role_ids(table(spark, d, "split_manifest"), "train", "kfold", 1)


@query("select distinct patch_id from patch_records where patch_id not in (select patch_id from split_manifest)")
def missing_ids(spark, d):
    return splits.missing_ids(table(spark, d, "patch_records"), table(spark, d, "split_manifest")).distinct()


@query(f"select 'train' as role, count(*) as n from patch_records where patch_id in (select patch_id from split_manifest where {_M} = 'train') union all select 'val', count(*) from patch_records where patch_id in (select patch_id from split_manifest where {_M} = 'val') union all select 'test', count(*) from patch_records where patch_id in (select patch_id from split_manifest where {_M} = 'test')")
def subset_semi_joins(spark, d):
    parts = splits.subsets(table(spark, d, "patch_records").select("patch_id"), table(spark, d, "split_manifest"))
    a, b, c = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("role"), "n") for r, p in zip(("train", "val", "test"), parts, strict=True)]
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------- statistics


@query("select l_returnflag, count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity) * count(l_quantity), 2) as m2, round(stddev_pop(l_quantity), 6) as std, min(l_quantity) as min, max(l_quantity) as max from lineitem group by 1")
def moments_by_group(spark, d):
    return rounded(stats.moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"), m2=2)


@query("select l_returnflag, count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std, min(l_quantity) as min, max(l_quantity) as max from lineitem group by 1")
def moments_merged(spark, d):
    parts = stats.moments(table(spark, d, "lineitem"), ["l_returnflag", "l_shipdate"], "l_quantity").drop("std")
    return rounded(stats.merge_moments(parts, ["l_returnflag"]).drop("m2")).select("l_returnflag", "n", "mean", "std", "min", "max")


@query("with c as (select l_returnflag, l_quantity - avg(l_quantity) over (partition by l_orderkey) as z from lineitem) select l_returnflag, round(avg(abs(z)), 6) as mean_abs, round(stddev_pop(z), 6) as std from c group by 1")
def centred_moments(spark, d):
    c = stats.centred(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", "z")
    return rounded(c.groupBy("l_returnflag").agg(F.avg(F.abs("z")).alias("mean_abs"), F.stddev_pop("z").alias("std")))


_H = "with h as (select l_returnflag, least(floor((l_extendedprice - 1000) / (80000.0 / 64)), 63)::int as bin, count(*) as n from lineitem where l_extendedprice between 1000 and 81000 group by 1, 2)"


def _hist(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 1000.0, 81000.0, 64)


@query(_H + " select * from h")
def fixed_histogram(spark, d):
    return _hist(spark, d)


@query(_H + """, c as (select *, sum(n) over (partition by l_returnflag order by bin) as c, sum(n) over (partition by l_returnflag) * 0.98 as t from h), f as (select * from c where c >= t qualify row_number() over (partition by l_returnflag order by bin) = 1)
select l_returnflag, round(1000 + (bin + (t - (c - n)) / n) * 1250, 4) as value from f""")
def hist_percentile(spark, d):
    return rounded(stats.histogram_percentile(_hist(spark, d), ["l_returnflag"], 0.98, 1000.0, 81000.0, 64), 4)


@query(_H + ", s as (select min(bin) as a, max(bin) as b from h), i as (select h.* from h, s where bin between a and b) select l_returnflag, bin, round(n / sum(n) over (partition by l_returnflag), 9) as density from i")
def shared_histogram_support(spark, d):
    return rounded(stats.shared_support(_hist(spark, d), ["l_returnflag"]), 9)


@query("""with p as (select l_returnflag, quantile_cont(l_quantity, 0.02) as a, quantile_cont(l_quantity, 0.98) as b from lineitem where l_quantity <> 0 group by 1)
select l_returnflag, round(avg(case when l_quantity = 0 or b <= a then 0 else least(greatest((l_quantity - a) / (b - a), 0), 1) end), 6) as mean from lineitem join p using (l_returnflag) group by 1""")
def percentile_stretch(spark, d):
    s = stats.percentile_stretch(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return rounded(s.groupBy("l_returnflag").agg(F.avg("stretched").alias("mean")))


@query("with r as (select l_orderkey, min(l_quantity) as a, max(l_quantity) as b from lineitem group by 1) select l_orderkey, round(sum(case when b > a then -1 + (l_quantity - a) / (b - a) * 2 else 0 end), 4) as total from lineitem join r using (l_orderkey) group by 1")
def minmax_per_group(spark, d):
    return rounded(stats.minmax(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", -1.0, 1.0).groupBy("l_orderkey").agg(F.sum("scaled").alias("total")), 4)


@query("select l_returnflag, count(*) filter (l_discount > 0) as n, round(avg(l_quantity) filter (l_discount > 0), 6) as mean, round(stddev_pop(l_quantity) filter (l_discount > 0), 5) as std from lineitem group by 1")
def channel_stats(spark, d):
    return rounded(stats.channel_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_discount") > 0), std=5)


@query("""with u as (unpivot (select l_returnflag, l_quantity, l_extendedprice, l_discount from lineitem) on l_quantity, l_extendedprice, l_discount into name metric value v)
select l_returnflag, metric, count(v) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(median(v), 4) as median, round(min(v), 4) as min, round(max(v), 4) as max from u group by 1, 2""")
def metric_summary_unpivot(spark, d):
    return rounded(stats.unpivot_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"]), 4)


@query("select l_returnflag, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std, round(stddev_pop(l_quantity) / avg(l_quantity), 6) as cv, round((quantile_cont(l_quantity, 0.98) - quantile_cont(l_quantity, 0.02)) / avg(l_quantity), 6) as drcr from lineitem group by 1")
def ratio_metrics(spark, d):
    return rounded(stats.ratio_metrics(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"))


@query("""with h as (select round(abs(value))::double as c, count(*) as n from events group by 1), t as (select unnest([10.0::double, 20.0, 40.0]) as threshold)
select threshold, round(sum(case when c > threshold then n else 0 end) / sum(n), 6) as saturation, round(sum(greatest(c - threshold, 0) * n) / sum(n), 6) as mean_error, round(max(greatest(c - threshold, 0)), 6) as max_error from h, t where c is not null group by 1""")
def clipping_sweep(spark, d):
    h = table(spark, d, "events").groupBy(F.round(F.abs("value")).alias("c")).agg(F.count(F.lit(1)).alias("n")).where("c is not null")
    return rounded(stats.clipping(h, "c", "n", [10.0, 20.0, 40.0]))


@query("select threshold, round(avg((l_quantity < threshold)::int) * 100, 6) as rejected_pct from lineitem, (select unnest([1.0::double, 5.0, 10.0, 25.0]) as threshold) group by 1")
def threshold_rejection(spark, d):
    return stats.threshold_rejection(table(spark, d, "lineitem"), "l_quantity", [1.0, 5.0, 10.0, 25.0])


@query("select count(*) filter (dominant_overlap_fraction >= 1) as \"full\", count(*) filter (dominant_overlap_fraction > 0 and dominant_overlap_fraction < 1) as partial, count(*) filter (dominant_overlap_fraction <= 0) as empty, round(avg(dominant_overlap_fraction) * 100, 6) as valid_pct from patch_records")
def mask_statistics(spark, d):
    return stats.mask_statistics(table(spark, d, "patch_records"), "dominant_overlap_fraction")


@query("""with g as (select l_returnflag, avg(l_quantity) as mx, avg(l_discount) as my, avg(l_extendedprice) as mz, covar_pop(l_quantity, l_quantity) as xx, covar_pop(l_discount, l_discount) as yy, covar_pop(l_quantity, l_discount) as xy, covar_pop(l_quantity, l_extendedprice) as xz, covar_pop(l_discount, l_extendedprice) as yz, count(*) as n from lineitem group by 1),
f as (select *, (xz * yy - yz * xy) / (xx * yy - xy * xy) as a, (yz * xx - xz * xy) / (xx * yy - xy * xy) as b from g) select l_returnflag, n, round(a, 3) as a, round(b, 1) as b, round(mz - a * mx - b * my, 1) as c from f""")
def plane_fit(spark, d):
    return rounded(stats.plane_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice"), 1, a=3)


@query("select l_returnflag, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as scale, round(regr_intercept(l_extendedprice, l_quantity), 2) as shift from lineitem group by 1")
def affine_align(spark, d):
    return rounded(stats.affine_align(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 4, shift=2)


@query("""with v as (select l_returnflag, l_quantity as p, 51 - l_quantity as t from lineitem where l_quantity > 0 and l_quantity < 51), e as (select *, p - t as d, ln(p) - ln(t) as l, greatest(p / t, t / p) as r from v)
select l_returnflag, count(*) as n, round(avg(abs(d) / t), 4) as abs_rel, round(avg(d * d / t), 4) as sq_rel, round(sqrt(avg(d * d)), 4) as rmse, round(sqrt(avg(l * l)), 4) as rmse_log, round(sqrt(var_pop(l)) * 100, 4) as si_log,
 round(avg((r < 1.25)::int) * 100, 4) as delta_1, round(avg((r < 1.5625)::int) * 100, 4) as delta_2, round(avg((r < 1.953125)::int) * 100, 4) as delta_3 from e group by 1""")
def pixel_metrics(spark, d):
    v = table(spark, d, "lineitem").withColumn("t", 51 - F.col("l_quantity"))
    return rounded(stats.pixel_metrics(v, ["l_returnflag"], "l_quantity", "t"), 4)


@query("select l_returnflag, round(median(abs(l_quantity - m)) * 1.4826, 6) as mad from lineitem join (select l_returnflag as f, median(l_quantity) as m from lineitem group by 1) on f = l_returnflag group by 1")
def mad_scale(spark, d):
    return rounded(stats.mad_scale(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"))


@query("select l_returnflag, round(avg((abs(l_discount) < 1e-6)::int), 6) as at_zero, round(avg((abs(l_discount - 0.04) < 1e-6)::int), 6) as near_offset, case when avg((abs(l_discount - 0.04) < 1e-6)::int) > avg((abs(l_discount) < 1e-6)::int) and avg((abs(l_discount - 0.04) < 1e-6)::int) > 0.05 then 'BUG' when avg((abs(l_discount) < 1e-6)::int) > 0.01 then 'PASS' else 'UNCLEAR' end as verdict from lineitem group by 1")
def nodata_check(spark, d):
    return stats.nodata_check(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", 0.04)


@query("select user_id, coalesce(arg_min(value, event_id) filter (value <> 0), 0) as value from events group by 1")
def merge_first_nonzero(spark, d):
    return stats.first_non_zero(table(spark, d, "events"), ["user_id"], "value", "event_id")


@query("""with e as (select user_id, value as v, event_id % 7 + 1 as w from events where value is not null), a as (select *, sum(v * w) over (partition by user_id) / sum(w) over (partition by user_id) as m from e),
b as (select *, greatest(sum(abs(v - m) * w) over (partition by user_id) / sum(w) over (partition by user_id) * 1.4826, 1e-3) as s from a)
select user_id, round(sum(case when abs(v - m) <= 3 * s then v * w else 0 end) / sum(case when abs(v - m) <= 3 * s then w else 0 end), 6) as blended, count(*) as n from b group by 1""")
def robust_blend(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("w", (F.col("event_id") % 7 + 1).cast("double"))
    return rounded(stats.robust_blend(e, ["user_id"], "value", "w"))


@query("select user_id, round(sum((value - 10) * (value - 10) * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 5) as loss from events group by 1")
def weighted_loss(spark, d):
    e = table(spark, d, "events").withColumn("t", F.lit(10.0)).withColumn("w", F.col("event_id") % 5 + 1)
    return rounded(stats.weighted_mse(e, ["user_id"], "value", "t", "w"), 5)


# ---------------------------------------------------------------- texts


_TOK = f"select token from (select unnest(regexp_extract_all(lower(rationale_desc), '[a-z][a-z\\-]+[a-z]|[a-z]')) as token from rdr_index) where length(token) > 2 and token not in ({STOP})"
_LIST = f"[t for t in regexp_extract_all(lower(rationale_desc), '[a-z][a-z\\-]+[a-z]|[a-z]') if length(t) > 2 and t not in ({STOP})]"


@query(f"select token, count(*) as n from ({_TOK}) group by 1")
def token_counts(spark, d):
    return text_stats.token_counts(rdr(spark, d), "rationale_desc")


@query(f"with l as (select {_LIST} as a from rdr_index), z as (select a, unnest(range(1, len(a))) as i from l) select a[i] || ' ' || a[i + 1] as bigram, count(*) as n from z group by 1")
def bigram_counts(spark, d):
    return text_stats.bigram_counts(rdr(spark, d), "rationale_desc")


@query(f"with l as (select pos, {_LIST} as a from rdr_index), z as (select pos, unnest(a) as token, unnest(range(len(a))) as k from l) select token, count(*) as n from z group by 1 order by n desc, min((pos, k)) limit 20")
def top_words(spark, d):
    return text_stats.most_common(rdr(spark, d), "rationale_desc", "pos")


@query("with w as (select unnest([" + ", ".join(f"'{w}'" for w in fixed.GEO_FEATURES) + "]) as word) select word, count(*) as n from w, rdr_index where regexp_matches(rationale_desc, '(?i)\\b' || word || '\\b') group by 1")
def feature_mentions(spark, d):
    return text_stats.mentions(rdr(spark, d), "rationale_desc", list(fixed.GEO_FEATURES))


def _theme_sql(t: str = "rationale_desc") -> str:
    hits = ", ".join(f"case when regexp_matches(lower({t}), '\\b(" + "|".join(re.escape(w.lower()) for w in k) + f")\\b') then '{n}' end" for n, k in fixed.THEMES.items())
    return f"case when len(list_filter([{hits}], lambda x: x is not null)) > 0 then list_filter([{hits}], lambda x: x is not null) else ['Other'] end"


@query(f"select theme, count(*) as n from (select unnest({_theme_sql()}) as theme from rdr_index) group by 1")
def theme_counts(spark, d):
    return text_stats.theme_counts(rdr(spark, d), "rationale_desc")


@query(f"select ({_theme_sql()})[1] as theme, count(*) as n from rdr_index group by 1")
def primary_themes(spark, d):
    return text_stats.primary_themes(rdr(spark, d), "rationale_desc")


_BAND = "case " + " ".join(f"when y > {a} and y <= {b} then '({a:g}, {b:g}]'" for a, b in text_stats.BANDS) + " end"


@query(f"with t as (select (min_latitude + max_latitude) / 2 as y, unnest({_theme_sql()}) as theme from rdr_index), b as (select {_BAND} as band, theme from t where y is not null) select band, " + ", ".join(f"count(*) filter (theme = '{n}') as \"{n}\"" for n in [*fixed.THEMES, "Other"]) + " from b where band is not null group by 1")
def band_theme_crosstab(spark, d):
    return text_stats.band_theme_crosstab(rdr(spark, d), "rationale_desc", (F.col("min_latitude") + F.col("max_latitude")) / 2)


@query(f"""with t as (select least(greatest(floor(({lon('min_longitude')} + 180) / 2), 0), 179)::bigint as cx, least(greatest(floor((min_latitude + 90) / 2), 0), 89)::bigint as cy, unnest({_theme_sql()}) as theme from rdr_index where min_longitude is not null and min_latitude is not null),
c as (select cx, cy, theme, count(*) as n from t group by 1, 2, 3), p as (select theme, sum(n) as total from c group by 1)
select cx, cy, arg_max(theme, (n, total, theme)) as theme, round(ln(1 + sum(n)), 6) as log_density from c join p using (theme) group by 1, 2""")
def dominant_theme_cells(spark, d):
    return text_stats.dominant_theme_cells(rdr(spark, d), "rationale_desc", geo.normalize_longitude("min_longitude"), F.col("min_latitude"))


@query(f"""with c as (select ({lon('min_longitude')} + 180) / 8 as x, (min_latitude + 90) / (180 / 22.0::double) as y from rdr_index where min_longitude is not null and min_latitude is not null),
k as (select round(x) as ax, round(y) as ay, floor(x) as fx, floor(y) as fy, x, y from c), f as (select *, (x - ax) * (x - ax) + 3 * (y - ay) * (y - ay) < (x - fx - 0.5) * (x - fx - 0.5) + 3 * (y - fy - 0.5) * (y - fy - 0.5) as first from k)
select case when first then ax else fx + 0.5 end::double as hx, case when first then ay else fy + 0.5 end::double as hy, count(*) as n from f group by 1, 2""")
def hex_density(spark, d):
    return text_stats.hex_cells(rdr(spark, d), geo.normalize_longitude("min_longitude"), F.col("min_latitude"))


_VOC = "with t as (select pos, [lower(x) for x in regexp_extract_all(rationale_desc, '[A-Za-z0-9][A-Za-z0-9_\\-/:.]*')] as a from rdr_index where rationale_desc is not null), w as (select unnest(a) as token from t), v as (select token, count(*) as n from w group by 1 having count(*) >= 2), i as (select token, n, row_number() over (order by token) + 3 as id from v)"


@query(_VOC + " select token, n, id from i")
def vocabulary(spark, d):
    return text_stats.vocabulary(rdr(spark, d), "rationale_desc", 2)


@query(_VOC + """, u as (select pos, unnest(a[1:64]) as token, unnest(range(len(a[1:64]))) as k from t), e as (select pos, list(coalesce(id, 1) order by k) as b from u left join i using (token) group by 1),
f as (select pos, ([2] || coalesce(b, []) || [3])[1:64] as g from t left join e using (pos)) select pos, g || [0 for z in range(64 - len(g))] as ids from f""")
def encode_tokens(spark, d):
    r = rdr(spark, d).where("rationale_desc is not null")
    return text_stats.encoded(r, "pos", "rationale_desc", text_stats.vocabulary(rdr(spark, d), "rationale_desc", 2), 64)


# ---------------------------------------------------------------- embeddings, sets


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), s as (select q.vec_id, e.vec_id as neighbour, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from q, embeddings e where q.vec_id <> e.vec_id)
select vec_id, neighbour, row_number() over (partition by vec_id order by score desc, neighbour) as rank, score from s qualify rank <= 3""")
def cosine_topk(spark, d):
    return embeddings.cosine_topk(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 20)


@query("select true as enough, count(*) filter (vec_id % 20 = 0) as n_queries from embeddings where embedding is not null")
def ivf_recall(spark, d):
    """Whether the inverted file finds at least nine tenths of the exact neighbours of all queries."""
    e = table(spark, d, "embeddings")
    exact, found = (f(e, "vec_id", "embedding", 3, 20).select("vec_id", "neighbour") for f in (embeddings.cosine_topk, embeddings.ivf_topk))
    both = exact.withColumn("e", F.lit(1)).join(found.withColumn("f", F.lit(1)), ["vec_id", "neighbour"], "left")
    return both.agg((F.count("f") >= 0.9 * F.count("e")).alias("enough"), F.count_distinct("vec_id").alias("n_queries"))


@query()
def pca_projection(spark, d):
    return embeddings.pca(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("select distinct patch_id, list_sort(list_distinct([x for x in contributing_obs_ids if x is not null and x <> dominant_obs_id])) as others from patch_records where contributing_obs_ids is not null and dominant_obs_id is not null")
def array_set_ops(spark, d):
    p = table(spark, d, "patch_records").where("contributing_obs_ids is not null and dominant_obs_id is not null")
    return p.select("patch_id", F.array_sort(F.array_except(F.array_compact("contributing_obs_ids"), F.array("dominant_obs_id"))).alias("others")).distinct()


@query("with u as (select *, 0 as rank from orders where o_orderkey % 2 = 0 union all select *, 1 from orders) select o_orderkey, rank from u qualify row_number() over (partition by o_orderkey order by rank) = 1")
def union_dedupe(spark, d):
    o = table(spark, d, "orders")
    u = o.where("o_orderkey % 2 = 0").withColumn("rank", F.lit(0)).unionByName(o.withColumn("rank", F.lit(1)))
    return keep_first(u, ["o_orderkey"], ["rank"]).select("o_orderkey", "rank")


@query("select event_id, (props->>'k')::int as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""with f as (select * from lineitem where l_quantity >= 10 and l_shipdate >= timestamp '1994-01-01'), k as (select * from f qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1)
select l_returnflag, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_pop(l_extendedprice), 4) as std, min(l_extendedprice) as min, max(l_extendedprice) as max, round(quantile_cont(l_extendedprice, 0.02), 4) as p02, round(quantile_cont(l_extendedprice, 0.98), 4) as p98 from k group by 1""")
def minimum_slice(spark, d):
    """Scan, range filter, first row per entity, moments and percentiles per category."""
    li = table(spark, d, "lineitem").where((F.col("l_quantity") >= 10) & (F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp")))
    k = keep_first(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    k = written(k.select("l_returnflag", "l_extendedprice"), "slice")  # read for the moments and for the percentiles
    v = F.col("l_extendedprice")
    g = k.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    p = percentiles(k, ["l_returnflag"], "l_extendedprice", [0.02, 0.98], "p").select("l_returnflag", F.col("p")[0].alias("p02"), F.col("p")[1].alias("p98"))
    return rounded(g.alias("l").join(p.alias("r"), same("l", "r", ["l_returnflag"]), "left").select("l.*", "p02", "p98"), 4)
