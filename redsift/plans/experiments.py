"""Queries of the experiment, job, geometry and tile operators, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.functions.geo import normalize_longitude
from redsift.operators import catalog, experiments, geometry, metrics, raster, reconstruct, seams
from redsift.operators.cache import build_cache, load_cache, merge_cache, upsert
from redsift.plans.catalog import lon, rounded
from redsift.session import table
from redsift.sources import readers
from redsift.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Simpson's rule on [0, t] in so many steps.
_STEPS = 2000
_P = f"""case when {{t}} is null then null else round(greatest(0, 1 - 2 * ({{t}} / {_STEPS} / 3) * (select sum(case when i in (0, {_STEPS}) then 1 when i % 2 = 1 then 4 else 2 end * {{f}}) from range({_STEPS + 1}) r(i))), 6) end"""


_T = """with t as (select l_returnflag as variant, l_linenumber % 3 as seed, l_partkey as tile, avg(l_discount) as v from lineitem group by 1, 2, 3),
p as (select a.variant, a.seed, a.tile, a.v - b.v as delta from t a join t b using (seed, tile) where a.variant <> 'N' and b.variant = 'N')
"""


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    tiles = li.groupBy(F.col("l_returnflag").alias("variant"), (F.col("l_linenumber") % 3).alias("seed"), F.col("l_partkey").alias("tile")).agg(F.avg("l_discount").alias("v"))
    return experiments.paired(tiles, "variant", "N", ["seed", "tile"], "v").select("variant", "seed", "tile", "delta")


@query("select r_name as variant, s as seed, [lower(r_name)] || ['steps=10'] as overrides from region, (select unnest([1, 2, 3]) as s)")
def variants_x_seeds(spark, d):
    names = [r[0] for r in table(spark, d, "region").select("r_name").collect()]  # a table of five regions
    return experiments.runs(spark, [(n, [n.lower()]) for n in names], [1, 2, 3], ["steps=10"])


@query(_T + "select variant, seed, tile, round(delta, 9) as delta from p")
def paired_delta(spark, d):
    return rounded(_deltas(spark, d), 9)


@query("""with u as (unpivot (select l_returnflag, l_linestatus, l_quantity, l_discount from lineitem) on l_quantity, l_discount into name metric value v)
select l_returnflag, l_linestatus, metric, round(avg(v), 6) as mean, round(median(v), 6) as median, count(v) as n from u group by 1, 2, 3""")
def long_results(spark, d):
    return rounded(experiments.long_results(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"]))


@query("""with s as (select l_returnflag as variant, l_linenumber % 3 as seed, avg(l_quantity) as m from lineitem group by 1, 2)
select variant, count(*) as n_seeds, round(avg(m), 6) as mean, round(case when count(*) < 2 then 0 else stddev_samp(m) end, 6) as std from s group by 1""")
def track_summary(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variant"), (F.col("l_linenumber") % 3).alias("seed"), "l_quantity")
    return rounded(experiments.track_summary(li, ["variant"], "seed", "l_quantity"))


@query(_T + ", s as (select variant, seed, count(*) as n, avg(delta) as mean, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) as t from p group by 1, 2) select variant, seed, n, round(mean, 9) as mean, round(t, 4) as t, "
  + _P.format(t="abs(t)", f="exp(lgamma(n / 2) - lgamma((n - 1) / 2) - 0.5 * ln((n - 1) * pi()) - n / 2 * ln(1 + pow(abs(t) * i / 2000, 2) / (n - 1)))") + " as p from s")
def ttest_runs(spark, d):
    return rounded(experiments.ttest(_deltas(spark, d), ["variant", "seed"], "delta"), 4, mean=9, p=6)


_W = _T + """, z as (select variant, round(delta, 9) as delta from p where round(delta, 9) <> 0), c as (select variant, abs(delta) as a, count(*) as c, count(*) filter (delta > 0) as up from z group by 1, 2),
r as (select *, sum(c) over (partition by variant order by a) - c + (c + 1) / 2 as rank from c), g as (select variant, sum(c)::double as n, sum(up * rank) as plus, sum(pow(c, 3) - c) as ties from r group by 1),
s as (select variant, n, least(plus, n * (n + 1) / 2 - plus) as w, abs(least(plus, n * (n + 1) / 2 - plus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from g)
select variant, n::bigint as n, round(w, 3) as w, """ + _P.format(t="z", f="exp(-0.5 * pow(z * i / 2000, 2)) / sqrt(2 * pi())") + " as p from s"


@query(_W)
def wilcoxon_runs(spark, d):
    return rounded(experiments.wilcoxon_test(rounded(_deltas(spark, d), 9), ["variant"], "delta"), 3, p=6)


@query("""with q as (select l_returnflag as metric, l_linenumber as variant, avg(l_discount) as p from lineitem group by 1, 2), r as (select *, row_number() over (partition by metric order by p, variant) as i, count(*) over (partition by metric) as k from q)
select metric, variant, round(least(max((k - i + 1) * p) over (partition by metric order by p, variant), 1), 6) as holm_p from r""")
def holm_correction(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("variant")).agg(F.avg("l_discount").alias("p"))
    return rounded(experiments.holm(q.select("metric", "variant", "p"), ["metric"], F.col("p")).select("metric", "variant", "holm_p"))


@query("""with c as (select l_suppkey, count(*) as k, -2 * sum(ln(greatest(0.02 + 9 * l_discount, 1e-300))) as chi2 from lineitem group by 1)
select l_suppkey, k, round(chi2, 6) as chi2, round(least(1, (select sum(exp(i * ln(chi2 / 2) - lgamma(i + 1) - chi2 / 2)) from range(100000) r(i) where i < k)), 6) as p from c""")
def fisher_combination(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (0.02 + 9 * F.col("l_discount")).alias("p"))
    return rounded(experiments.fisher(li, ["l_suppkey"], "p"))


@query()
def hierarchical_bootstrap(spark, d):
    return experiments.bootstrap(_deltas(spark, d), ["variant"], "seed", "delta")


@query("select o_orderstatus, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders qualify row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) = 1")
def best_row(spark, d):
    return rounded(experiments.best_by(table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "o_orderkey"), 2)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def worst_k(spark, d):
    return experiments.extreme_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 5")
def best_k(spark, d):
    return experiments.extreme_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 5, False)


@query("with r as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as r, count(*) over () as n from orders) select o_orderkey, o_totalprice from r where r in (floor(0.1 * (n - 1)) + 1, floor(0.5 * (n - 1)) + 1, floor(0.9 * (n - 1)) + 1)")
def representative_picks(spark, d):
    return experiments.quantile_picks(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("select l_linenumber as step, count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std from lineitem group by 1")
def curve_across_runs(spark, d):
    return rounded(experiments.curve(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "step"), "step", "l_quantity"))


@query("select max(file_name_specification) as name, try_cast(nullif(regexp_extract(max(file_name_specification), '([0-9]+)[^0-9]*$', 1), '') as int) as step from rdr_index")
def latest_step(spark, d):
    return experiments.latest_step(table(spark, d, "rdr_index"), "file_name_specification")


# ---------------------------------------------------------------- jobs


@query("select user_id, epoch_us(max(ts)) as last_us, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n_events from events group by 1")
def job_latest_state(spark, d):
    s = jobs.latest_state(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    return s.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"), "event_type", "n_events")


@query("""with g as (select user_id, event_id, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 as gap_s, row_number() over w as r from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, round(gap_s, 3) as gap_s from g where gap_s > 3600 + case when r = 1 then 1800 else 0 end""")
def stall_gaps(spark, d):
    return jobs.stall_gaps(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600, 1800).select("user_id", "event_id", "gap_s")


@query("select user_id, arg_max(value, ts) filter (value is not null) as last, coalesce(isfinite(arg_max(value, ts) filter (value is not null)), false) as finite from events group by 1")
def last_valid_value(spark, d):
    return jobs.last_valid(table(spark, d, "events"), "user_id", "ts", "value")


@query("select epoch_us(time_bucket(interval '10 minutes', ts)) as start_us, event_type, count(*) as n from events group by 1, 2")
def heartbeat_windows(spark, d):
    h = jobs.heartbeats(table(spark, d, "events"), "ts", "event_type")
    return h.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


@query("with u as (select *, 0 as v from orders union all select *, 1 from orders where o_orderkey % 2 = 0) select o_orderkey, max(v) as v from u group by 1")
def state_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return upsert(o.withColumn("v", F.lit(0)), o.where("o_orderkey % 2 = 0").withColumn("v", F.lit(1)), "o_orderkey", "v")


@query("""with m as (select distinct regexp_replace(trim(product_id), '_(COLOR|RED)$', '') as obs_id, trim(regexp_replace(rationale_desc, '\\s+', ' ', 'g')) as t from rdr_index)
select obs_id, upper(coalesce(t, '')) as rationale_expanded, trim(coalesce(t, '')) <> '' as has_rationale_expanded from m qualify row_number() over (partition by obs_id order by t) = 1""")
def rationale_cache_build(spark, d):
    from redsift.functions.ids import product_observation

    m = table(spark, d, "rdr_index").select(product_observation("product_id").alias("obs_id"), "rationale_desc").groupBy("obs_id").agg(F.min("rationale_desc").alias("rationale_desc"))
    cache = build_cache(m, load_cache(spark, None), str.upper, "upper")
    return merge_cache(m, cache).select("obs_id", "rationale_expanded", "has_rationale_expanded")


@query("select r_name as queue, n_nationkey as index, lower(n_name) as name, [lower(n_name), '--run'] as argv, 'queued' as status, '/queues/logs/' || lpad(n_nationkey::varchar, 2, '0') || '_' || lower(n_name) || '.log' as log_path, null::int as exit_code from nation join region on r_regionkey = n_regionkey")
def queue_initial(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    n = n.select(F.col("r_name").alias("queue"), F.col("n_nationkey").alias("index"), F.lower("n_name").alias("name"), F.array(F.lower("n_name"), F.lit("--run")).alias("argv"))
    return jobs.initial_status(n, "/queues").select("queue", "index", "name", "argv", "status", "log_path", "exit_code")


_OUTCOME = """with j as (select o_custkey, o_orderkey, case o_orderstatus when 'O' then 0 when 'F' then 1 end as code from orders), f as (select o_custkey, min(o_orderkey) as f from j where code <> 0 group by 1),
o as (select o_custkey, o_orderkey, case when o_orderkey > f then 'skipped' when code is null then 'queued' when code = 0 then 'completed' else 'failed' end as status from j left join f using (o_custkey)) """


def _outcome(spark, d):
    code = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1)
    return jobs.queue_outcome(table(spark, d, "orders").select("o_custkey", "o_orderkey", code.alias("code")), ["o_custkey"], "o_orderkey", "code").select("o_custkey", "o_orderkey", "status")


@query(_OUTCOME + "select * from o")
def queue_outcome(spark, d):
    return _outcome(spark, d)


@query(_OUTCOME + """select o_custkey, case when count(*) filter (status = 'failed') > 0 then 'failed' when count(*) filter (status = 'queued') > 0 then 'running' else 'completed' end as state,
 count(*) filter (status = 'completed') as n_completed, count(*) filter (status = 'failed') as n_failed, count(*) filter (status = 'skipped') as n_skipped, count(*) filter (status = 'queued') as n_queued from o group by 1""")
def queue_states(spark, d):
    return jobs.queue_states(_outcome(spark, d), ["o_custkey"])


_MESSAGES = ["opj_decode() failed", "IReadBlock FAILED at X offset 0", "No space left on device", "a.JP2: not recognized as being in a supported file format.", "Tile part length size inconsistent"]


@query("select r_regionkey, r_regionkey <> 2 as corrupt from region")
def corrupt_sources(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), F.col("r_regionkey").cast("int") + 1)
    return table(spark, d, "region").select("r_regionkey", readers.is_corrupt(message).alias("corrupt"))


# ---------------------------------------------------------------- geometry


def _strips(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rdr_index")
    w, e = normalize_longitude("min_longitude"), normalize_longitude("max_longitude")
    return r.select(F.col("pos").alias("id"), w.alias("west"), F.col("min_latitude").alias("south"), e.alias("east"), F.col("max_latitude").alias("north"), catalog.box_ring(w, F.col("min_latitude"), e, F.col("max_latitude")).alias("ring"))


@query(f"""select pos as id, case when {lon('min_longitude')} < {lon('max_longitude')} and min_latitude < max_latitude then
 round(({lon('max_longitude')} - {lon('min_longitude')}) * (max_latitude - min_latitude) * 0.3771234, 9) end as area from rdr_index""")
def ring_window_area(spark, d):
    s = _strips(spark, d)
    part = s.select("id", "ring", "west", "south", (F.col("west") + (F.col("east") - F.col("west")) * 0.3771234).alias("east"), "north")
    return geometry.ring_overlaps(part).select("id", F.round("area", 9).alias("area"))


@query()
def optimal_centres(spark, d):
    return geometry.strip_centres(_strips(spark, d).select("id", "ring"), 0.018, 0.75)


@query()
def simple_centres(spark, d):
    return geometry.strip_centres(_strips(spark, d).select("id", "ring"), 0.018, 0.75, mode="simple")


@query()
def strip_coverage(spark, d):
    return geometry.coverage_stats(optimal_centres(spark, d), 0.018)


# ---------------------------------------------------------------- tiles: an embedding of 64 numbers is a tile of 8 x 8


def _images(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("elevation"))
    e = e.withColumns({"height": F.lit(8), "width": F.lit(8), "image": F.reverse("elevation"), "valid": F.transform("elevation", lambda x: x != 0)})
    return e


@query()
def tile_quality(spark, d):
    return raster.map_tiles(_images(spark, d), ["elevation", "image", "valid"], raster.patch_quality, raster.QUALITY, ["vec_id"])


@query()
def tile_metrics(spark, d):
    return raster.map_tiles(_images(spark, d), ["elevation", "image", "valid"], metrics.all_metrics, metrics.METRICS, ["vec_id"])


@query()
def tile_hillshade(spark, d):
    return raster.map_tiles(_images(spark, d), ["elevation"], lambda a: {"shade": raster.hillshade(a)}, "shade array<double>, error string", ["vec_id"])


@query()
def tile_fill(spark, d):
    return raster.map_tiles(_images(spark, d).withColumn("valid", F.transform("elevation", lambda x: x > 0)), ["elevation", "valid"], lambda a, v: {"nearest": raster.nearest_fill(a, v), "diffused": raster.diffusion_fill(a, v), "harmonic": raster.harmonic_fill(a, v)}, "nearest array<double>, diffused array<double>, harmonic array<double>, error string", ["vec_id"])


@query()
def tile_seams(spark, d):
    # four tiles side by side twice over: 16 x 32 pixels, as seams need room
    e = _images(spark, d).select("vec_id", F.lit(16).alias("height"), F.lit(32).alias("width"), F.flatten(F.array_repeat("elevation", 8)).alias("elevation"), F.flatten(F.array_repeat("image", 8)).alias("image")).withColumn("valid", F.transform("elevation", lambda x: x.isNotNull()))
    return raster.map_tiles(e, ["image", "elevation", "valid"], seams.detect_seam, seams.SEAM, ["vec_id"])


@query()
def tile_kriging(spark, d):
    e = _images(spark, d).withColumn("valid", F.transform("elevation", lambda x: x > 0))
    return raster.map_tiles(e, ["elevation", "valid"], lambda a, v: {"drift": raster.kriging_fill(a, v), "plain": raster.kriging_fill(a, v, drift=False)}, "drift array<double>, plain array<double>, error string", ["vec_id"])


@query()
def mosaic_reconstruction(spark, d):
    # every embedding is a tile: scenes of 4 x 4 tiles in the order of their ids
    place = F.col("vec_id") % 16
    grid = _images(spark, d).select(F.floor(F.col("vec_id") / 16).alias("scene"), F.col("vec_id").alias("patch"), F.floor(place / 4).cast("int").alias("row"), (place % 4).cast("int").alias("col"), F.col("elevation").alias("values"), F.transform("elevation", lambda x: F.lit(1.0)).alias("conf"))
    return reconstruct.reconstruct(grid, 8, 4)
