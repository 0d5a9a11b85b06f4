"""Caches: rationale expansions, configuration hashes, sidecars with checksums."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsift.functions.text import clean_text, render_prompt
from redsift.operators.latest import keep_last

#: Columns of an expansion cache.
CACHE_SCHEMA = "obs_id string, rationale_raw string, rationale_expanded string, expansion_model string, prompt_version string, prompt_template string, expansion_status string, expansion_error string, expansion_timestamp timestamp"
KEYS = ["obs_id", "rationale_raw", "expansion_model", "prompt_version"]


def load_cache(spark: SparkSession, source: DataFrame | str | None) -> DataFrame:
    """A frame, a parquet or CSV path, or nothing, with all cache columns (missing ones null)."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    if source is None:
        return empty
    if isinstance(source, str):
        source = spark.read.option("header", True).csv(source) if source.endswith(".csv") else spark.read.parquet(source)
    if "expansion_timestamp" in source.columns:
        source = source.withColumn("expansion_timestamp", F.try_to_timestamp(F.col("expansion_timestamp").cast("string")))
    return empty.unionByName(source, allowMissingColumns=True).select(*[c.split()[0] for c in CACHE_SCHEMA.split(", ")])


def merge_cache(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Manifest with the latest good expansion per observation (a null time counts as latest) and whether there is one."""
    ok = keep_last(cache.where("expansion_status = 'ok'"), ["obs_id"], ["expansion_timestamp"]).select("obs_id", "rationale_expanded")
    got = manifest.drop("rationale_expanded").join(ok, "obs_id", "left")
    return got.withColumn("has_rationale_expanded", F.coalesce(F.length(F.trim("rationale_expanded")) > 0, F.lit(False)))


def build_cache(manifest: DataFrame, cache: DataFrame, expander: Callable[[str], str], model: str, version: str = "v1", template: str = "{rationale}", overwrite: bool = False) -> DataFrame:
    """Cache rows of the manifest: good hits on the four keys are kept, all others are expanded in parallel.

    An exception of the expander becomes an error row. Null texts match null texts.
    """
    want = manifest.select("obs_id", clean_text("rationale_desc").alias("rationale_raw")).distinct().withColumns({"expansion_model": F.lit(model), "prompt_version": F.lit(version)})
    last = keep_last(cache, KEYS, ["expansion_timestamp"]).where("expansion_status = 'ok' and rationale_expanded is not null")
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in KEYS]
    names = [c.split()[0] for c in CACHE_SCHEMA.split(", ")]
    hits = want.alias("w").join(last.alias("c"), on).select(*[f"c.{n}" for n in names]) if not overwrite else cache.limit(0)
    miss = want.alias("w").join(last.alias("c"), on, "left_anti") if not overwrite else want
    prompts = miss.withColumn("prompt", render_prompt(template, "rationale_raw"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, status, error = [], [], []
            for p in pdf.pop("prompt"):
                try:
                    text.append(expander(p))
                    status.append("ok")
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    text.append(None)
                    status.append("error")
                    error.append(str(e))
            yield pdf.assign(rationale_expanded=text, prompt_template=template, expansion_status=status, expansion_error=error, expansion_timestamp=pd.Timestamp.now("UTC"))[names]

    return hits.unionByName(prompts.mapInPandas(expand, CACHE_SCHEMA))


# ---------------------------------------------------------------- configuration hashes (driver side)


def config_hash(data: dict, length: int = 16) -> str:
    """First hex digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()[:length]


def run_id(config: dict) -> str:
    return config_hash(config, 8)


def split_cache_key(**parameters: object) -> str:
    """Key of a stored split: of all its parameters, the axis included."""
    return config_hash(parameters)


def save_split(spark: SparkSession, assignments: DataFrame, path: str, **parameters: object) -> None:
    """Assignments with their key, as a table."""
    assignments.withColumn("_key", F.lit(split_cache_key(**parameters))).write.mode("overwrite").parquet(path)


def load_split(spark: SparkSession, path: str, expected: int, **parameters: object) -> DataFrame | None:
    """Stored assignments, or None when they are absent, of other parameters or of another number of rows."""
    if not exists(spark, path):
        return None
    got = spark.read.parquet(path).where(F.col("_key") == split_cache_key(**parameters)).drop("_key")
    return got if got.count() == expected else None


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


MANIFEST = "key string, parameters string, n_files long, n_bytes long, created timestamp, files array<struct<name:string,sha256:string,length:long>>"


def write_cache_manifest(spark: SparkSession, folder: str, path: str, **parameters: object) -> None:
    """A JSON document beside a cache: its key and parameters, how many files and bytes, and a sample of checksums."""
    files = checksums(spark, folder)
    total = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    sample = checksum_sample(files).agg(F.array_sort(F.collect_list(F.struct("name", "sha256", "length"))).alias("files"))  # nine at most
    doc = total.join(sample).select(F.lit(config_hash(parameters)).alias("key"), F.lit(json.dumps(parameters, sort_keys=True, default=str)).alias("parameters"), "n_files", "n_bytes", F.current_timestamp().alias("created"), "files")
    doc.coalesce(1).write.mode("overwrite").json(path)


def cache_issues(spark: SparkSession, folder: str, path: str, **parameters: object) -> list[str]:
    """What is wrong with a cache, by its document; nothing: it may be used."""
    if not exists(spark, path):
        return ["no manifest"]
    doc = spark.read.schema(MANIFEST).json(path).first()  # one document
    if doc is None or doc["key"] is None:
        return ["no manifest"]
    issues = [] if doc["key"] == config_hash(parameters) else ["other parameters"]
    if not exists(spark, folder):
        return [*issues, "no data"]
    files = checksums(spark, folder)
    now = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    issues += [f"{now['n']} files instead of {doc['n_files']}"] if now["n"] != doc["n_files"] else []
    issues += [f"{now['b']} bytes instead of {doc['n_bytes']}"] if now["b"] != doc["n_bytes"] else []
    expected = spark.createDataFrame(doc["files"] or [], "name string, sha256 string, length long")
    return issues + [f"{r['issue']}: {r['name']}" for r in checksum_issues(expected, files).orderBy("name").collect()]


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, sha256, length)`` of the files of a folder, hashed in parallel."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    got = f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")
    # the scan passes over names that begin with an underscore; the marker is one small file
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        return got
    stream = fs.open(marker)
    data = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    return got.unionByName(spark.createDataFrame([("_SUCCESS", hashlib.sha256(data).hexdigest(), len(data))], "name string, sha256 string, length long"))


def checksum_sample(files: DataFrame, most: int = 9) -> DataFrame:
    """The success marker and every (n // 8)-th other file in name order."""
    from redsift.operators.splits import ranked

    rest = files.where("name <> '_SUCCESS'")
    n = rest.count()
    picked = ranked(rest, [F.col("name")]).where((F.col("_r") - 1) % max(1, n // 8) == 0).drop("_r")
    return files.where("name = '_SUCCESS'").unionByName(picked.select(*files.columns)).orderBy(F.col("name") != "_SUCCESS", "name").limit(most)


def checksum_issues(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(name, issue)``: files that are missing or differ."""
    j = expected.alias("e").join(actual.alias("a"), "name", "left")
    return j.select("name", F.when(F.col("a.sha256").isNull(), "missing").when(F.col("a.sha256") != F.col("e.sha256"), "mismatch").alias("issue")).where("issue is not null")


# ---------------------------------------------------------------- keyed state


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """State after changes: the latest row per key."""
    return keep_last(state.unionByName(changes, allowMissingColumns=True), [key], [order])
