"""Splits that keep related records together: components of related records, whole groups, exact proportions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsift.functions.ids import plain_obs_id
from redsift.llm.components import connected_components
from redsift.operators.latest import latest
from redsift.session import written

#: A subset-sum bitset aims at sums of at most this many bits (with the pieces that reached them 20 MB); what a target has
#: beyond is first taken by the largest sizes, the rest of it is exact.
MAX_BITS = 1 << 22
#: Groups above this share of a split's rows are not used to fill it (they would be all of it).
LARGEST = 0.5
#: Groups of a size are ranked in buckets of about so many.
PER_BUCKET = 50_000


def centre_key(lon: str, lat: str) -> list[Column]:
    """Centre as two longs: both to five decimals, the longitude modulo 360. Null or NaN gives nulls."""
    x, y = F.nanvl(F.col(lon), F.lit(None)), F.nanvl(F.col(lat), F.lit(None))
    k = F.pmod(F.round(x * 1e5).cast("long"), F.lit(36_000_000))
    m = F.round(y * 1e5).cast("long")
    both = k.isNotNull() & m.isNotNull()
    return [F.when(both, k).alias("kx"), F.when(both, m).alias("ky")]


def linked(patches: DataFrame, obs: str, lon: str, lat: str) -> DataFrame:
    """``(obs, label)`` of all observations that share a centre with another, directly or through others."""
    at = patches.select(plain_obs_id(obs).alias("obs"), *centre_key(lon, lat)).where("obs is not null and kx is not null")
    # few centres have two observations; an aggregation with a partial step finds them however many rows a centre has
    shared = at.groupBy("kx", "ky").agg(F.min("obs").alias("hub"), F.max("obs").alias("top")).where("hub < top").select("kx", "ky", "hub")
    edges = at.join(shared, ["kx", "ky"]).where("obs <> hub").select(F.col("obs").alias("u"), F.col("hub").alias("v")).distinct()
    return connected_components(edges).select(F.col("node").alias("obs"), "label")


def record_groups(patches: DataFrame, pid: str, obs: str, lon: str, lat: str) -> DataFrame:
    """``(patch_id, group_id)``: one group for all patches related through observations or centres.

    A patch without an observation belongs to the group of those at its centre, or to a group of its centre; one
    without either is a group of its own. A null id is no patch.
    """
    labels = linked(patches, obs, lon, lat)
    p = patches.select(F.col(pid).alias("patch_id"), plain_obs_id(obs).alias("obs"), *centre_key(lon, lat))
    # an observation of a thousandth of all rows or more (a thousand of them at most) is joined by broadcast
    n = patches.count()
    hot = p.where("obs is not null").groupBy("obs").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, n // 1000)).select("obs")
    hot = F.broadcast(hot.join(labels, "obs", "left").select("obs", F.coalesce("label", "obs").alias("hot_id")))
    met = p.where("obs is not null").join(hot, "obs", "left")
    named = met.where("hot_id is not null").select("patch_id", F.col("hot_id").alias("group_id"))
    named = named.unionByName(met.where("hot_id is null").join(labels, "obs", "left").select("patch_id", F.coalesce("label", "obs").alias("group_id")))
    bare = p.where("obs is null")
    hubs = p.where("obs is not null and kx is not null").join(bare.where("kx is not null").select("kx", "ky").distinct(), ["kx", "ky"], "left_semi")
    hubs = hubs.groupBy("kx", "ky").agg(F.min("obs").alias("obs")).join(labels, "obs", "left").select("kx", "ky", F.coalesce("label", "obs").alias("hub"))
    rest = bare.where("kx is not null").join(hubs, ["kx", "ky"], "left").select("patch_id", F.coalesce("hub", F.concat_ws(":", F.lit("centre"), "kx", "ky")).alias("group_id"))
    alone = bare.where("kx is null").select("patch_id", F.concat_ws(":", F.lit("patch"), "patch_id").alias("group_id"))
    return named.unionByName(rest).unionByName(alone)


def choose(sizes: dict[int, int], target: int, max_bits: int = MAX_BITS) -> dict[int, int]:
    """How many groups of each size to take so that their sum is as close to ``target`` as it can be.

    A subset-sum bitset over size classes: multiplicities are cut into powers of two, each piece one shift and or. Sums
    beyond ``max_bits`` are first brought down greedily by the largest sizes.
    """
    taken: dict[int, int] = {}
    left = dict(sizes)
    for s in sorted(left, reverse=True):
        if target - sum(k * n for k, n in taken.items()) <= max_bits:
            break
        n = min(left[s], (target - sum(k * n for k, n in taken.items()) - max_bits // 2) // s)
        if n > 0:
            taken[s] = n
            left[s] -= n
    rest = target - sum(k * n for k, n in taken.items())
    usable = {s: n for s, n in left.items() if n and s <= 2 * max(rest, 1)}
    limit = min(rest + max(usable, default=0), 2 * rest)  # no sum is farther from the target than none at all
    mask = (1 << (limit + 1)) - 1
    pieces: list[tuple[int, int]] = []
    for s, n in sorted(usable.items()):
        n, k = min(n, limit // s), 1
        while n > 0:
            pieces.append((s, min(k, n)))
            n, k = n - k, 2 * k
    # one bitset, and for each sum the first piece that reached it: what remains without it was reached before
    reach, first = 1, np.zeros(limit + 1, dtype=np.uint16 if len(pieces) < 1 << 16 else np.uint32)
    for i, (s, k) in enumerate(pieces):
        new = (reach << (s * k)) & mask & ~reach
        if new:
            octets = np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), dtype=np.uint8)
            at = np.flatnonzero(octets)
            for j in range(0, len(at), 1 << 20):  # bits of a stretch at a time
                some = at[j : j + (1 << 20)]
                row, bit = np.nonzero(np.unpackbits(octets[some, None], axis=1, bitorder="little"))
                first[some[row] * 8 + bit] = i
            reach |= new
        if reach >> rest & 1:
            break
    if reach >> rest & 1:
        best = rest
    else:
        below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
        above = reach >> (rest + 1)
        up = rest + (above & -above).bit_length() if above else 3 * rest + 1
        best = below if rest - below <= up - rest else up
    while best > 0:
        s, k = pieces[int(first[best])]
        best -= s * k
        taken[s] = taken.get(s, 0) + k
    return taken


def grouped_split(groups: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), largest: float = LARGEST) -> DataFrame:
    """``(patch_id, group_id, split)``: whole groups to train, val and test, split totals as close as group sizes allow.

    ``groups``: one row per record, as :func:`record_groups` gives. Test and val are filled exactly by subset sums over
    the multiplicities of group sizes, with groups of at most ``largest`` of the split's rows where these suffice; train
    takes the rest. Which groups of a size go where depends on a hash of the group id only.
    """
    groups = written(groups, "groups")
    sized = written(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # group sizes that differ are fewer than the root of twice the number of records: a bounded collect
    classes = {r["n"]: r["k"] for r in sized.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = sum(n * k for n, k in classes.items())
    buckets = 1 + sum(classes.values()) // PER_BUCKET
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int"))
    left, plan = dict(classes), {"test": {}, "val": {}}
    for name, share in (("test", shares[2]), ("val", shares[1])):
        target = round(total * share)
        small = {s: n for s, n in left.items() if s <= largest * target}
        use = small if sum(s * n for s, n in small.items()) >= target else left
        plan[name] = choose(use, target) if target else {}
        left = {s: n - plan[name].get(s, 0) for s, n in left.items()}
    spark = groups.sparkSession
    quota = spark.createDataFrame([(s, plan["test"].get(s, 0), plan["val"].get(s, 0)) for s in classes], "n long, n_test long, n_val long")
    # rank within a size, in buckets: no window holds all groups of a size
    counts = sized.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = counts.withColumn("skip", F.sum("k").over(Window.partitionBy("n").orderBy("bucket")) - F.col("k")).drop("k")
    w = Window.partitionBy("n", "bucket").orderBy(F.xxhash64(F.lit(7), "group_id"), "group_id")
    ranked = sized.withColumn("r", F.row_number().over(w)).join(before, ["n", "bucket"]).join(quota, "n").withColumn("r", F.col("r") + F.col("skip"))
    split = F.when(F.col("r") <= F.col("n_test"), "test").when(F.col("r") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    ranked = ranked.select("group_id", "n", split.alias("split"))
    # groups of a thousandth of all rows or more are at most a thousand: they are joined by broadcast, so that the
    # rows of a hot group stay where they are
    hot = F.col("n") >= max(2, total // 1000)
    big = F.broadcast(ranked.where(hot).select("group_id", F.col("split").alias("big")))
    got = groups.join(big, "group_id", "left")
    large = got.where("big is not null").select("patch_id", "group_id", F.col("big").alias("split"))
    small = got.where("big is null").drop("big").join(ranked.where(~hot).drop("n"), "group_id").select("patch_id", "group_id", "split")
    return large.unionByName(small)


def patches_once(df: DataFrame) -> DataFrame:
    """Patches with the columns that relate them, a patch written twice counted once (its latest row)."""
    return latest(df.select("patch_id", "dominant_obs_id", "centroid_lon", "centroid_lat", "built_at").where("patch_id is not null"), ["patch_id"], ["built_at"])
