"""Queries of the general training-data problems (1: rows that fail to parse, 5: points near points or regions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.operators.bad_rows import loaded, reason_counts, rejected
from redsift.operators.latest import latest
from redsift.operators.spatial_join import boxes, discs, dual_tree_join
from redsift.session import table

#: The sphere in km, and how close a site counts as near.
MARS_KM = 3396.19
NEAR_KM = 25.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "tab_records").select("line_id", "line")).select("line_id", "reason").distinct()


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return loaded(table(spark, d, "tab_records"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reason_counts(table(spark, d, "tab_records"), "delivery")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    patches = table(spark, d, "patch_records").select("patch_id", "centroid_lon", "centroid_lat", "built_at").where("patch_id is not null")
    index = table(spark, d, "rdr_index").select("product_id", "min_longitude", "max_longitude", "min_latitude", "max_latitude", "received_at", "pos").where("product_id is not null")
    regions = boxes(latest(index, ["product_id"], ["received_at", "pos"]), "product_id", "min_longitude", "max_longitude", "min_latitude", "max_latitude")
    regions = regions.unionByName(discs(table(spark, d, "target_sites"), "site_id", "lon", "lat", NEAR_KM, MARS_KM))
    got = dual_tree_join(latest(patches, ["patch_id"], ["built_at"]), "patch_id", "centroid_lon", "centroid_lat", regions, counted=patches)
    return got.select(F.when(F.col("kind") == 1, "inside").otherwise("near").alias("kind"), F.col("pid").alias("patch_id"), F.col("rid").alias("other_id"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per product or site, how many patches lie in or near it."""
    return p5_found(spark, d).groupBy("kind", "other_id").agg(F.count(F.lit(1)).alias("n_patches"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_loaded, p1_reasons, p5_found, p5_counts)}

_FIELD = r'(\s*"([^"]|"")*"\s*|[^",]*)'
_SPLIT = """
with v as (select line_id, delivery, coalesce(line, '') as l from tab_records),
q as (select *, regexp_full_match(l, '%(f)s(,%(f)s)*') as ok, regexp_replace(l, '"([^"]|"")*"', 'Q', 'g') as o from v),
f as (select *, len(string_split(o, ',')) as n,
  [trim(replace(regexp_replace(trim(x, e' \\t\\r\\n'), '^"(.*)"$', '\\1'), '""', '"'), e' \\t\\r\\n') for x in regexp_extract_all(l, '(?:^|,)(\\s*"(?:[^"]|"")*"\\s*|[^",]*)', 1)] as fields from q),
r as (select line_id, delivery, case when not ok then 'quoting' when n <> 16 then 'columns'
  when not regexp_full_match(fields[6], '\\+?0*[0-9]{1,6}') then 'orbit_number'
  when not regexp_full_match(fields[10], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then 'incidence_angle'
  when not coalesce(try_cast(fields[10] as double) between 0 and 180, false) then 'incidence_angle' end as reason, fields from f)
""".replace("%(f)s", _FIELD)

_TEXTS = ["volume_id", "file_name_specification", "observation_id", "product_id", "target_name", "", "mission_phase_name", "rationale_desc", "start_time", "", "", "", "", "", "", "stereo_flag"]
_NUMBERS = {"emission_angle": 11, "min_latitude": 12, "max_latitude": 13, "min_longitude": 14, "max_longitude": 15}
_FIELDS = ", ".join([f"fields[{k}] as {n}" for k, n in enumerate(_TEXTS, 1) if n] + [f"try_cast(fields[{k}] as double) as {n}" for n, k in _NUMBERS.items()])

SQL: dict[str, str] = {
    "p1_loaded": _SPLIT + f"select r.line_id, r.delivery, received_at, try_cast(fields[6] as int) as orbit_number, try_cast(fields[10] as double) as incidence_angle, {_FIELDS} from r join tab_records using (line_id) where reason is null",
    "p1_found": _SPLIT + "select distinct line_id, reason from r where reason is not null",
    "p1_reasons": _SPLIT + "select delivery, coalesce(reason, 'loaded') as reason, count(*) as n_lines from r group by 1, 2",
    "p5_found": f"""
with p as (select patch_id, arg_max(struct_pack(x := centroid_lon, y := centroid_lat), built_at) as c from patch_records group by 1),
pt as (select patch_id, ((c.x % 360) + 360) % 360 as x, c.y as y from p where c.x is not null and c.y is not null),
b as (select product_id, arg_max(struct_pack(s := min_latitude, n := max_latitude, w := min_longitude, e := max_longitude), received_at) as c from rdr_index group by 1)
select 'inside' as kind, patch_id, product_id as other_id from pt join b on y between c.s and c.n and c.w is not null and c.e is not null
  and case when c.w <= c.e then x between c.w - 1e-10 and c.e + 1e-10 else x >= c.w - 1e-10 or x <= c.e + 1e-10 end
union all
select 'near', patch_id, site_id from pt, target_sites where 2 * {MARS_KM} * asin(least(1, sqrt(pow(sin(radians(y - lat) / 2), 2)
  + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(x - lon) / 2), 2)))) <= {NEAR_KM}
""",
}
SQL["p5_counts"] = f"select kind, other_id, count(*) as n_patches from ({SQL['p5_found']}) group by 1, 2"
