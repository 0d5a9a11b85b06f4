"""Embeddings: exact nearest neighbours in blocks, principal components, contrastive loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redsift.session import parallelism, written


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cosine_topk(df: DataFrame, key: str, vector: str, k: int = 3, query_modulo: int = 1, block: int = 4096) -> DataFrame:
    """``(key, neighbour, rank, score)``: the k most similar other rows of each query, by cosine, scores to six decimals,
    ties by the smaller id.

    Queries are the rows whose id is divisible by ``query_modulo``, in blocks; each block meets every partition of the
    rows, keeps k per query there, and the partial results are merged. Null vectors take no part; a zero vector is
    similar to nothing (score 0). With fewer than k others all come out.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    n_blocks = max(1, -(-rows.where(F.col("id") % query_modulo == 0).count() // block))
    q = rows.where(F.col("id") % query_modulo == 0).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    parts = parallelism(spark)
    # a task meets one block of queries and one part of the rows
    r = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int"))
    left = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("qb", "part", "id", "v", F.lit(True).alias("is_q"))
    right = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("qb", "part", "id", "v", F.lit(False).alias("is_q"))
    both = left.unionByName(right).select((F.col("qb") * parts + F.col("part")).alias("task"), "id", "v", "is_q").repartitionById(n_blocks * parts, F.col("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        is_q = t["is_q"].to_numpy(zero_copy_only=False)
        ids, v = t["id"].to_numpy(), _matrix(t["v"].combine_chunks())
        v = _unit(v)
        yield from _nearest_rows(ids[is_q], v[is_q], ids[~is_q], v[~is_q], k)

    near = both.select("id", "v", "is_q").mapInArrow(run, f"id {kind}, neighbour {kind}, score double")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", "rank", "score")


def ivf_topk(df: DataFrame, key: str, vector: str, k: int = 3, query_modulo: int = 1, lists: int | None = None, recall: float = 0.95, sample: int = 20_000, per_task: int = 50_000) -> DataFrame:
    """``(key, neighbour, rank, score)`` as :func:`cosine_topk`, from an inverted file: every row is in the list of its
    nearest centre, and a query looks into the lists nearest to it: as many as, within the sample, hold the share ``recall``
    of the true neighbours. Vectors without any structure need most of the lists, clustered ones few.

    Centres (``lists`` of them, by default about the root of the number of rows, 4,096 at most) are fitted by spherical k-means
    on at most ``sample`` rows, those with the least hashes; the index itself holds every row. A long list is cut into parts of
    ``per_task`` rows, each met by the list's queries. Approximate: the recall measured is in the README.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"{key} {kind}, neighbour {kind}, rank int, score double")
    lists = lists or max(1, min(4096, round(n**0.5)))
    fit = _unit(np.array([r[0] for r in rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample).select("v").collect()]))
    centres = fit[:lists].copy()
    for _ in range(10):
        best = (fit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, fit)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    probes = _probes(fit, centres, k, recall)
    shared = spark.sparkContext.broadcast(centres)  # at most 4,096 vectors

    def nearest(m: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = _unit(_matrix(b.column(1))) @ shared.value.T
                    top = np.argpartition(-s, min(m, s.shape[1]) - 1, axis=1)[:, :m]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "v", "l"])

        return run

    schema = f"id {kind}, v array<double>, l array<int>"
    held = written(rows.mapInArrow(nearest(1), schema).select("id", "v", F.col("l")[0].alias("l")), "lists")
    # one row per list
    sizes = held.groupBy("l").agg(F.count(F.lit(1)).alias("n")).select("l", F.ceil(F.col("n") / per_task).cast("int").alias("parts"))
    held_in = held.join(F.broadcast(sizes), "l").select("l", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", F.lit(False).alias("is_q"))
    asked = rows.where(F.col("id") % query_modulo == 0).mapInArrow(nearest(probes), schema).select("id", "v", F.explode("l").alias("l")).join(F.broadcast(sizes), "l")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("l", "part", "id", "v", F.lit(True).alias("is_q"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        is_q, ids, v = t["is_q"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), _unit(_matrix(t["v"].combine_chunks()))
        yield from _nearest_rows(ids[is_q], v[is_q], ids[~is_q], v[~is_q], k)

    both = held_in.unionByName(asked)
    near = both.groupBy("l", "part").applyInArrow(lambda t: pa.Table.from_batches(list(search(t.to_batches())), schema=pa.schema([("id", t.schema.field("id").type), ("neighbour", t.schema.field("id").type), ("score", pa.float64())])), f"id {kind}, neighbour {kind}, score double")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")  # probes times k rows
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", "rank", "score")


def _probes(fit: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 500) -> int:
    """Lists to look into so that the share ``recall`` of the k nearest others of some sampled rows is in them."""
    asked = fit[:queries]
    s = asked @ fit.T
    s[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(fit) - 1)]
    if not near.size:
        return 1
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list in a query's order
    at = np.take_along_axis(place, (fit @ centres.T).argmax(axis=1)[near], axis=1)
    return int(np.quantile(at, recall, method="higher")) + 1


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _nearest_rows(qi: np.ndarray, qv: np.ndarray, ri: np.ndarray, rv: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query, 512 queries at a time; ties by the smaller id. Vectors have length one."""
    order = np.argsort(ri)
    ri, rv = ri[order], rv[order]
    for a in range(0, len(qi) if len(ri) else 0, 512):
        s = np.round(qv[a : a + 512] @ rv.T, 6)
        s[qi[a : a + 512, None] == ri[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(s, top, axis=1)
        row, col = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(qi[a + row]), pa.array(ri[top[row, col]]), pa.array(score[row, col])], names=["id", "neighbour", "score"])


def gram(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and number of the vectors; a block of sums per task reaches the driver in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, g, n = None, None, 0
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                s = m.sum(axis=0) if s is None else s + m.sum(axis=0)
                g = m.T @ m if g is None else g + m.T @ m
                n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=["k", "n", "s", "g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            tot = lambda c: sum(np.frombuffer(r[c]) for r in rows).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([sum(r["n"] for r in rows)], pa.int64()), pa.array([tot("s")], pa.binary()), pa.array([tot("g")], pa.binary())], names=["n", "s", "g"])

    parts = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "k int, n long, s binary, g binary").repartitionById(16, F.col("k")).mapInArrow(add, "n long, s binary, g binary").collect()
    if not parts:
        return np.zeros(0), np.zeros((0, 0)), 0
    n = sum(r["n"] for r in parts)
    mean = sum(np.frombuffer(r["s"]) for r in parts) / n
    d = len(mean)
    return mean, sum(np.frombuffer(r["g"]) for r in parts).reshape(d, d) / n - np.outer(mean, mean), n


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """``(key, projection)`` on the first k principal components; the sign makes a component's largest weight positive."""
    mean, cov, n = gram(df, vector)
    kind = dict(df.dtypes)[key]
    if n == 0:
        return df.sparkSession.createDataFrame([], f"{key} {kind}, projection array<double>")
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, np.argsort(-values)[:k]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((_matrix(b.column(1)) - mean) @ top).tolist(), pa.list_(pa.float64()))], names=[key, "projection"])

    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, projection array<double>")


def masked_mean(vectors: str, keep: str):
    """Mean of the vectors that are kept (an array of arrays and one of 0/1), the number of kept ones at least one."""
    width = F.size(F.element_at(vectors, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(F.zip_with(vectors, keep, lambda v, m: F.transform(v, lambda x: x * m)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.aggregate(keep, F.lit(0.0), lambda a, m: a + m), F.lit(1.0)))


def contrastive_loss(a: np.ndarray, b: np.ndarray, scale: float) -> float:
    """Symmetric cross-entropy of matching rows within one batch of unit vectors."""
    logits = scale * a @ b.T

    def side(x: np.ndarray) -> float:
        m = x.max(axis=1, keepdims=True)
        return float(np.mean(m[:, 0] + np.log(np.exp(x - m).sum(axis=1)) - np.diag(x)))

    return (side(logits) + side(logits.T)) / 2
