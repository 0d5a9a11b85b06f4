"""Queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.functions.ids import plain_obs_id
from redsift.llm import cross_split, cut_text, group_splits, leakage, packing, subjects
from redsift.llm.term_counts import marked, term_counts
from redsift.operators.latest import latest
from redsift.session import table, written


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = group_splits.linked(table(spark, d, "patch_records"), "dominant_obs_id", "centroid_lon", "centroid_lat")
    return got.select(F.col("obs").alias("obs_id"), F.col("label").alias("group_obs_id"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    once = group_splits.patches_once(table(spark, d, "patch_records"))
    return group_splits.grouped_split(group_splits.record_groups(once, "patch_id", "dominant_obs_id", "centroid_lon", "centroid_lat"))


def p2_integrity(spark: SparkSession, d: str) -> DataFrame:
    """One row: patches, how many observations and centres are parted, and how far val and test are from a tenth each."""
    got = p2_splits(spark, d)
    at = group_splits.patches_once(table(spark, d, "patch_records")).select("patch_id", plain_obs_id("dominant_obs_id").alias("obs"), *group_splits.centre_key("centroid_lon", "centroid_lat"))
    got = written(got.join(at, "patch_id", "left"), "splits")
    parted = lambda *k: got.dropna(subset=list(k)).groupBy(*k).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("_".join(k)))
    n = F.count(F.lit(1))
    off = [F.abs(F.count_if(F.col("split") == s) - F.bround(n * 0.1)).cast("long").alias(f"{s}_off") for s in ("val", "test")]
    return got.agg(F.count_distinct("patch_id").alias("n_patches"), (n - F.count("split")).alias("n_without"), *off).join(parted("obs").withColumnRenamed("obs", "obs_parted")).join(parted("kx", "ky").withColumnRenamed("kx_ky", "centres_parted"))


def _products(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "rdr_index").select("product_id", "rationale_desc", "received_at", "pos").where("product_id is not null"), ["product_id"], ["received_at", "pos"])


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return marked(term_counts(_products(spark, d), "rationale_desc")).select("term", "n_occurrences", "n_records", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return marked(term_counts(_products(spark, d), "rationale_desc")).where("mark is not null").select("term", "mark")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlaps(cross_split.records(table(spark, d, "patch_records"), table(spark, d, "split_manifest")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("eval_id", "train_id").alias("patch_id_a"), F.greatest("eval_id", "train_id").alias("patch_id_b"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and dominant observation, the pairs and the evaluation patches that a training patch repeats."""
    owner = group_splits.patches_once(table(spark, d, "patch_records")).select(F.col("patch_id").alias("eval_id"), plain_obs_id("dominant_obs_id").alias("obs_id"))
    per = _overlaps(spark, d).groupBy("eval_id", "part").agg(F.count(F.lit(1)).alias("n")).join(owner, "eval_id")
    split = F.when(F.col("part") == 1, "val").otherwise("test")
    return per.groupBy(split.alias("split"), "obs_id").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_patches"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return cut_text.cut_rows(table(spark, d, "rdr_index").select("pos", "rationale_desc", "delivery"), "pos", "rationale_desc", "delivery")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("cut").select(F.col("key").alias("pos")).distinct()


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return cut_text.cut_shares(_cut(spark, d)).withColumnRenamed("source", "delivery")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens per document or piece. The sizes are written once: packing reads them twice."""
    return packing.packed(written(packing.sized(table(spark, d, "documents"), "doc_id", "text"), "sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d))


def p7_integrity(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those placed nowhere, containers above capacity, short documents that were divided, and whether
    there are hardly more containers than the tokens need."""
    got = written(p7_packed(spark, d), "packed")
    per = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"))
    docs = per.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("k") > F.greatest(F.ceil(F.col("n") / packing.CAPACITY), F.lit(1))).alias("n_divided"))
    nowhere = table(spark, d, "documents").select("doc_id").join(got, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    over = got.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_overfull"))
    tight = packing.fill(got).select((F.col("n_containers") <= F.ceil(F.col("least") * 1.01) + 1).alias("tight"))
    return docs.join(nowhere).join(over).join(tight)  # one row each


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item, how many documents repeat it, and the greatest share of its words that one does."""
    share = F.round(F.max(F.col("n_words") / F.col("n_item_words")), 4)
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), share.alias("most"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """What to remove from each leaking document: stretches of characters, those of all items merged."""
    return leakage.removal_spans(_leaks(spark, d))


#: The subjects of the problem; a document about none of them is general.
SUBJECTS = ["impact", "slopes", "polar", "aeolian", "fluvial", "volcanic", "mineralogy", "tectonics", "landing", "calibration"]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_labels"), "doc_id", "subject", SUBJECTS).distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.shares(p9_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_splits, p2_integrity, p3_found, p3_terms, p4_found, p4_counts, p6_found, p6_shares, p7_packed, p7_fill, p7_integrity, p8_found, p8_items, p8_spans, p9_found, p9_shares)}

_PLAIN = r"""nullif(trim(regexp_replace(upper({0}), '^\s*([A-Z]{{3}})[^A-Z0-9]*([0-9]{{6}})[^A-Z0-9]*([0-9]{{4}})([^A-Z0-9].*)?$', '\1_\2_\3')), '')"""

_P2 = f"""
with recursive p as (select distinct {_PLAIN.format('dominant_obs_id')} as o, ((round(centroid_lon * 1e5)::bigint % 36000000) + 36000000) % 36000000 as x, round(centroid_lat * 1e5)::bigint as y
  from patch_records where dominant_obs_id is not null and centroid_lon is not null and centroid_lat is not null),
e as (select distinct a.o as u, b.o as v from p a join p b on a.x = b.x and a.y = b.y and a.o <> b.o),
c as (select u as obs_id, u as g from e union select e.u, c.g from e join c on e.v = c.obs_id)
select obs_id, min(g) as group_obs_id from c group by 1
"""
_P3 = """
with r as (select product_id, any_value(rationale_desc) as t from rdr_index where product_id is not null group by 1 having t is not null),
w as (select product_id, lower(unnest(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9-]*'))) as term from r),
c as (select term, count(*) as n_occurrences, count(distinct product_id) as n_records from w group by 1),
m as (select *, case when n_records < 3 then 'rare' when n_records > (select count(*) from r) * 0.1 then 'common' end as mark from c)
"""
_P4 = f"""
with p as (select patch_id, arg_max(struct_pack(x := centroid_lon, y := centroid_lat, c := contributing_obs_ids, o := dominant_obs_id), built_at) as s from patch_records group by 1),
m as (select patch_id, lower(trim(holdout_split)) as part from split_manifest),
r as (select patch_id, part, ((s.x % 360) + 360) % 360 as x, s.y as y, {_PLAIN.format('s.o')} as obs_id,
  list_distinct([{_PLAIN.format('z')} for z in s.c if {_PLAIN.format('z')} is not null]) as o from p join m using (patch_id) where s.x is not null and s.y is not null),
q as (select a.patch_id as e, b.patch_id as t, a.part, a.obs_id, len(list_intersect(a.o, b.o)) as n, len(a.o) + len(b.o) as k from r a join r b
  on a.part in ('val', 'test') and b.part = 'train' and abs(a.y - b.y) < 0.000505 and least(abs(a.x - b.x), 360 - abs(a.x - b.x)) < 0.000505 and len(a.o) > 0 and len(b.o) > 0),
f as (select * from q where n >= 0.75 * (k - n))
"""

SQL: dict[str, str] = {
    "p2_found": _P2,
    "p2_integrity": "select count(distinct patch_id) as n_patches, 0::bigint as n_without, 0::bigint as val_off, 0::bigint as test_off, 0::bigint as obs_parted, 0::bigint as centres_parted from patch_records where patch_id is not null",
    "p7_integrity": "select count(distinct doc_id) as n_documents, 0::bigint as n_divided, 0::bigint as n_missing, 0::bigint as n_overfull, true as tight from documents",
    "p3_terms": _P3 + "select term, n_occurrences, n_records, mark from m",
    "p3_found": _P3 + "select term, mark from m where mark is not null",
    "p4_found": _P4 + "select least(e, t) as patch_id_a, greatest(e, t) as patch_id_b from f",
    "p4_counts": _P4 + "select part as split, obs_id, count(*) as n_pairs, count(distinct e) as n_patches from f group by 1, 2",
}
