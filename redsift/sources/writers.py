"""Sinks: patch records, manifests, summaries, statistics, per-tile metrics, training chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "patch_id string, patch_index long, holdout_split string, fold int, is_test boolean"


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats that cannot hold them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def save(df: DataFrame, path: str) -> None:
    """By suffix: CSV (nested columns as JSON text), JSON lines, ORC, else parquet."""
    w = (_flat(df) if path.endswith(".csv") else df).write.mode("overwrite")
    if path.endswith(".csv"):
        w.option("header", True).option("escape", '"').csv(path)
    elif path.endswith((".json", ".jsonl")):
        w.json(path)
    elif path.endswith(".orc"):
        w.orc(path)
    else:
        w.parquet(path)


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`save` wrote, under a declared schema; JSON text becomes nested again."""
    want = spark.createDataFrame([], schema).schema
    if not path.endswith(".csv"):
        reader = spark.read.schema(want)
        return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.orc(path) if path.endswith(".orc") else reader.parquet(path)
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    nested = ("array", "map", "struct")
    return raw.select(*[(F.from_json(f.name, f.dataType) if f.dataType.typeName() in nested else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in want.fields])


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return load_records(spark, path, MANIFEST_SCHEMA)


def save_summary(df: DataFrame, path: str) -> None:
    """A frame of one row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_tile_metrics(df: DataFrame, path: str) -> None:
    """Per-tile metrics by tag and rank."""
    df.write.mode("overwrite").partitionBy("tag", "rank").parquet(path)


def load_tile_metrics(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """All ranks of a tag: unreadable files are passed over, a tile comes once (from the least rank)."""
    from redsift.operators.latest import keep_first

    df = spark.read.option("ignoreCorruptFiles", True).schema(schema).parquet(path).where(F.col("tag") == tag)
    return keep_first(df, ["tile_id"], ["rank"])


def save_chunks(df: DataFrame, path: str, rows: int, by: str = "split") -> None:
    """A training set in chunks of ``rows`` records per split (zstd); the writer leaves the success marker."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").partitionBy(by).parquet(path)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at a path if it is complete, else built, written and read back."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
