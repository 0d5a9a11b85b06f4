"""Frequency of every distinct term by recursive radix spilling.

Each task counts the terms of a batch of records, and the partial counts are spilled to the shared folder, partitioned by
the top bits of a hash of the term. A partition above a size is split again by the next bits, until it fits or holds one
term only. Each final partition is then aggregated on its own, out of core, by DuckDB in a task of its own. No step holds
all terms, and a hot term is one row per batch before it is spilled.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsift.session import deleted, shared_path, written

TERM = r"[A-Za-z0-9][A-Za-z0-9-]*"
BITS = 4
ROWS = 2_000_000
DUCK_MEMORY, DUCK_ALONE = "256MB", "1GB"
OUT_ROWS = 50_000


def terms(text: Column | str) -> Column:
    """Terms of a text: maximal runs of ASCII letters, digits and hyphens from a letter or digit on, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)), F.lower)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch, and the number of its records under the empty term."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(0)
        t = pa.table({"r": pc.list_parent_indices(lists), "term": lists.flatten()})
        each = t.group_by(["r", "term"]).aggregate([([], "count_all")])
        both = each.group_by("term").aggregate([("count_all", "sum"), ("count_all", "count")])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([both["term"].combine_chunks(), pa.array([""], both["term"].type)]),
                pa.concat_arrays([both["count_all_sum"].combine_chunks().cast(pa.int64()), pa.array([0], pa.int64())]),
                pa.concat_arrays([both["count_all_count"].combine_chunks().cast(pa.int64()), pa.array([b.num_rows], pa.int64())]),
            ],
            names=["term", "n_occurrences", "n_records"],
        )


def _aggregated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb
    import pyarrow.dataset as ds
    from pyarrow import fs

    for b in batches:
        for uri in b.column(0).to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            # out of core beside the table where the shared folder is mounted; an object store offers no place to spill to, but
            # a partition has ROWS rows at most or one term only, so memory suffices there
            own = tempfile.mkdtemp(dir=os.path.dirname(path)) if isinstance(system, fs.LocalFileSystem) else ""
            c = duckdb.connect(config={"memory_limit": DUCK_MEMORY if own else DUCK_ALONE, "threads": 1, "temp_directory": own})
            c.register("spilled", ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False))
            got = c.sql("select term, sum(n_occurrences)::bigint n_occurrences, sum(n_records)::bigint n_records from spilled group by term")
            yield from got.to_arrow_reader(OUT_ROWS) if hasattr(got, "to_arrow_reader") else got.fetch_arrow_reader(OUT_ROWS)
            c.close()
            if own:
                shutil.rmtree(own)


def term_counts(records: DataFrame, text: str, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """``(term, n_occurrences, n_records, n_total)`` of every distinct term; n_total: records with non-null text.

    Each row of ``records`` is a record, repeated texts count each; null texts are no records, empty ones are records
    without terms. Texts of any length are counted whole. No records: no rows.
    """
    spark = records.sparkSession
    schema = "term string, n_occurrences bigint, n_records bigint"
    part = records.where(F.col(text).isNotNull()).select(terms(text).alias("terms")).mapInArrow(_partial, schema)
    radix = lambda depth: F.shiftright(F.shiftleft("h", bits * depth), 64 - bits).cast("int")
    spilled = f"{schema}, h bigint, radix int"
    base = shared_path(spark, "terms")
    root = f"{base}/0"
    part.withColumn("h", F.xxhash64("term")).withColumn("radix", radix(0)).write.partitionBy("radix").parquet(root)
    # the empty term carries the numbers of records of the batches
    total = spark.read.schema(spilled).parquet(root).where((F.col("h") == F.xxhash64(F.lit(""))) & (F.col("term") == "")).agg(F.sum("n_records")).first()[0] or 0
    leaves, open_, depth = [], [root], 0
    while open_:
        split = []
        for folder in open_:
            # one row per partition
            for r in spark.read.schema(spilled).parquet(folder).groupBy("radix").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).collect():
                at = f"{folder}/radix={r['radix']}"
                if r["n"] > rows and r["a"] != r["b"] and (depth + 2) * bits <= 64:
                    split.append(at)
                else:
                    leaves.append(at)
        open_, depth = [], depth + 1
        for i, at in enumerate(split):
            deeper = f"{base}/{depth}-{i}"
            spark.read.schema(spilled).parquet(at).withColumn("radix", radix(depth)).write.partitionBy("radix").parquet(deeper)
            open_.append(deeper)
            deleted(spark, at)
    if not leaves:
        deleted(spark, base)
        return spark.createDataFrame([], schema + ", n_total bigint")
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(leaves)], "i int, path string").repartitionById(len(leaves), F.col("i"))
    counts = paths.select("path").mapInArrow(_aggregated, schema)
    counts = written(counts, "counts")
    deleted(spark, base)
    return counts.where("term <> ''").withColumn("n_total", F.lit(total).cast("bigint"))


def marked(counts: DataFrame, least: int = 3, most: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in fewer than ``least`` records, else ``common`` in more than ``most`` of all."""
    mark = F.when(F.col("n_records") < least, "rare").when(F.col("n_records") > F.col("n_total") * most, "common")
    return counts.withColumn("mark", mark)
