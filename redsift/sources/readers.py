"""Sources: fixed-width and delimited index tables, labels, file listings, JSON. Every schema is declared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redsift.fixed import CORRUPT_MARKS
from redsift.operators.bad_rows import TAB_SCHEMA, loaded
from redsift.operators.catalog import require
from redsift.operators.latest import keep_first

#: Defaults of a label without the key.
LABEL_DEFAULTS = {"SCALING_FACTOR": 1.0, "OFFSET": 0.0, "SAMPLE_BITS": 10.0, "BANDS": 1.0}


def with_pos(df: DataFrame) -> DataFrame:
    """``df`` with ``pos``, its place in the scan: what "first" means from here on."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """A fixed-record table; fields: (name, first byte from 1, length, type). Values are stripped, unusable ones null."""
    lines = with_pos(spark.read.text(path))
    cols = [F.expr(f"try_cast(trim(substring(value, {a}, {n})) as {t})").alias(name) for name, a, n, t in fields]
    return lines.select(*cols, "pos")


def read_tab(spark: SparkSession, path: str, schema: T.StructType = TAB_SCHEMA) -> DataFrame:
    """Delimited index rows; malformed lines are dropped (see operators.bad_rows for their reasons), the first row of an
    observation is kept, with mid coordinates and year."""
    rows = loaded(with_pos(spark.read.text(path).withColumnRenamed("value", "line")), schema=schema)
    mid = {"mid_lon": (F.col("min_longitude") + F.col("max_longitude")) / 2, "mid_lat": (F.col("min_latitude") + F.col("max_latitude")) / 2, "year": F.substring("start_time", 1, 4).try_cast("int")}
    return keep_first(rows.withColumns(mid), ["observation_id"], ["pos"])


def read_csv(spark: SparkSession, path: str, *needed: str) -> DataFrame:
    """CSV with a header; missing needed columns are an error."""
    return require(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), *needed)


#: By suffix; callers may add their own.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".tab": read_tab,
    ".csv": lambda s, p: with_pos(read_csv(s, p, "rationale_desc")),
    ".parquet": lambda s, p: s.read.parquet(p),
    ".json": lambda s, p: s.read.option("multiLine", True).json(p),
    ".jsonl": lambda s, p: s.read.json(p),
    ".orc": lambda s, p: s.read.orc(p),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The reader of the path's suffix; an unknown suffix or an empty result is an error."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix}")
    df = READERS[suffix](spark, path)
    if df.isEmpty():
        raise ValueError(f"nothing to read in {path}")
    return df


# ---------------------------------------------------------------- labels


def _value(text: Column, key: str) -> Column:
    raw = F.regexp_extract(text, rf"(?m)^\s*{key}\s*=\s*(.*?)\s*$", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(raw, r"<[^>]*>\s*$", ""), r'^"|"$', "")), F.lit(""))


def parse_labels(df: DataFrame, text: str = "value") -> DataFrame:
    """Key/value labels as rows: strings, numbers with defaults, the band filters as a list, the greatest count from the
    bit mask (``2#..#``) or the number of bits. The sun's azimuth falls back to the sub-solar one."""
    t = F.col(text)
    num = lambda k, d=None: F.coalesce(F.try_to_number(_value(t, k), F.lit("S9999999999.999999999999")).cast("double"), _value(t, k).try_cast("double"), F.lit(d))
    text_of = lambda k: _value(t, k)
    mask = F.nullif(F.regexp_extract(t, r"SAMPLE_BIT_MASK\s*=\s*2#([01]+)#", 1), F.lit(""))
    bits = num("SAMPLE_BITS", LABEL_DEFAULTS["SAMPLE_BITS"])
    ones = F.coalesce(F.length(F.replace(mask, F.lit("0"), F.lit(""))).cast("double"), bits)
    filters = F.transform(F.split(F.regexp_replace(F.regexp_extract(t, r"(?s)FILTER_NAME\s*=\s*\(?([^)\n]*(?:\n[^=\n]*)*?)\)?\s*(?:\n|$)", 1), r'["()\s]', ""), ","), F.trim)
    d = {k: num(k, v) for k, v in LABEL_DEFAULTS.items()}
    return df.select(
        "*", text_of("PRODUCT_ID").alias("product_id"), text_of("OBSERVATION_ID").alias("observation_id"), text_of("TARGET_NAME").alias("target_name"), text_of("RATIONALE_DESC").alias("rationale_desc"),
        text_of("START_TIME").alias("start_time"), text_of("STOP_TIME").alias("stop_time"), d["SCALING_FACTOR"].alias("scaling_factor"), d["OFFSET"].alias("offset"), bits.cast("int").alias("sample_bits"),
        (F.pow(F.lit(2.0), ones) - 1).cast("int").alias("max_dn"), d["BANDS"].cast("int").alias("bands"), F.filter(filters, lambda x: x != "").alias("filter_names"),
        num("MAP_SCALE").alias("map_scale"), num("EMISSION_ANGLE").alias("emission_angle"), num("INCIDENCE_ANGLE").alias("incidence_angle"), num("PHASE_ANGLE").alias("phase_angle"),
        F.coalesce(num("SOLAR_AZIMUTH"), num("SUB_SOLAR_AZIMUTH")).alias("solar_azimuth"), num("SOLAR_LONGITUDE").alias("solar_longitude"), num("LOCAL_TIME").alias("local_time"), num("NORTH_AZIMUTH").alias("north_azimuth"),
        text_of("STEREO_FLAG").alias("stereo_flag"), num("LINES").cast("int").alias("lines"), num("LINE_SAMPLES").cast("int").alias("line_samples"),
    )


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One row per label file below a folder."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{LBL,lbl}").text(folder, wholetext=True)
    return parse_labels(f.withColumn("path", F.input_file_name())).drop("value")


def product_meta(labels: DataFrame) -> DataFrame:
    """Labels of COLOR and RED products nested per observation; an absent one is null."""
    rest = F.struct(*[c for c in labels.columns if c not in ("path", "observation_id")])
    pick = lambda k: F.max(F.when(F.col("product_id").endswith(k), rest)).alias(k.lower())
    return labels.groupBy(F.col("observation_id").alias("obs_id")).agg(pick("COLOR"), pick("RED"))


# ---------------------------------------------------------------- listings


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, name, stem, suffix, length, modified)`` of files below a folder, contents unread."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder).where("suffix = '.jp2'")


def elevation_files(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder).where("suffix = '.img' and stem like 'DTE%'")


def conversion_plan(files: DataFrame) -> DataFrame:
    """Each source with ``skipped`` where its sidecar (.tif) is there and not older, else ``convert``."""
    tif = files.where("suffix = '.tif'").select("stem", F.col("modified").alias("_t")).groupBy("stem").agg(F.max("_t").alias("_t"))
    got = files.where("suffix in ('.jp2', '.img')").join(tif, "stem", "left")
    return got.withColumn("status", F.when(F.col("_t") >= F.col("modified"), "skipped").otherwise("convert")).drop("_t")


def is_corrupt(message: Column) -> Column:
    """Whether a decoder's message tells of a corrupt source; disks that are full and the like do not. Null: no."""
    low = F.lower(message)
    return F.coalesce(reduce(or_, [F.contains(low, F.lit(m)) for m in CORRUPT_MARKS]), F.lit(False))


def download_plan(index: DataFrame, files: DataFrame, root: str, suffixes: tuple[str, ...] = (".JP2", ".LBL")) -> DataFrame:
    """``(url_path, path)`` of the files of each product that are not there yet. Fetching them is not part of the engine."""
    stem = F.regexp_replace(F.trim("file_name_specification"), r"\.[^./]*$", "")
    want = index.where("file_name_specification is not null").select(F.explode(F.array(*[F.concat(stem, F.lit(s)) for s in suffixes])).alias("url_path")).distinct()
    want = want.withColumn("path", F.concat(F.lit(f"{root}/images/"), F.element_at(F.split("url_path", "/"), -1)))
    return want.join(files.select("path"), "path", "left_anti").select("url_path", "path")


# ---------------------------------------------------------------- statistics and settings


def load_quantiles(stats: DataFrame) -> DataFrame:
    """One row of scaling constants from per-channel statistics (channel, p02, p98, centered_p98).

    Fixed values stand in for what is absent."""
    e, img = F.col("channel") == "elevation", F.col("channel").isin("left", "right")
    pick = lambda c, v, d: F.coalesce(F.avg(F.when(c, F.col(v))), F.lit(d))
    return stats.agg(pick(e, "p02", -4396.57).alias("elevation_p02"), pick(e, "p98", 20757.66).alias("elevation_p98"), pick(img, "p02", 0.06526).alias("image_p02"), pick(img, "p98", 0.18289).alias("image_p98"), pick(e, "centered_p98", 45.9075).alias("residual_scale"))
