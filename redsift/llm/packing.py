"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function that sizes texts.
TOKENIZER = os.environ.get("REDSIFT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CAPACITY = 2048
#: Documents of a group: enough for a close fill, few enough for one task's memory whatever the texts are.
PER_GROUP = 5000
#: Fixed value: how this vocabulary cuts text before merging (the published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in blocks of at least so many characters, cut only where the pattern cuts whatever stands
#: around; without such a place the rest is encoded in one piece.
BLOCK = 20_000
CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])")
#: A run of white space of so many characters is taken out of the pattern, which goes back over it step by step.
RUN = 100_000
_SPACE = "[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def token_counter(path: str = TOKENIZER, block: int = BLOCK, run: int = RUN):
    """A function from text to its number of tokens; the vocabulary is read once per Python worker.

    The number is that of the whole text at once, whatever its length and wherever it is cut.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    space = re.compile(f"{_SPACE}{{{run}}}{_SPACE}*")

    def part(text: str, at: int, end: int) -> int:
        n = 0
        while at < end:
            cut = CUT.search(text, at + block, end) if at + block < end else None
            to = cut.start() if cut else end
            n += len(coder.encode_ordinary(text[at:to]))
            at = to
        return n

    def count(text: str | None) -> int:
        if not text:
            return 0
        n, at = 0, 0
        if len(text) >= run:
            for m in space.finditer(text):
                # the pattern takes the run but for its last character, which opens what follows
                to = m.end() if m.end() == len(text) else m.end() - 1
                n += part(text, at, m.start()) + len(coder._encode_single_piece(text[m.start() : to]))
                at = to
        return n + part(text, at, len(text))

    return count


def sized(docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)``: the whole text in tokens. Null and empty texts have none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or token_counter(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens int")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each item, and each bin's load. sizes: 1..capacity.

    The tournament tree holds the room of every bin at its leaves and the greatest room at each node, so the leftmost
    bin with enough room is found, and its room updated, in logarithmic time.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(n - 1).bit_length()) if n else 1
    tree = [capacity] * (2 * leaves)
    out = np.zeros(n, dtype=np.int64)
    for i in order.tolist():
        s, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        out[i] = node - leaves
        tree[node] -= s
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a >= b else b
    loads = np.bincount(out, weights=sizes, minlength=int(out.max()) + 1 if n else 0).astype(np.int64)
    return out, loads


def packed(sizes: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP, seed: int = 0) -> DataFrame:
    """``(doc_id, piece, n_tokens, container, container_tokens)`` from ``(doc_id, n_tokens)``.

    Every document with at least one token is placed; one longer than ``capacity`` is divided into full pieces and a
    rest (pieces are numbered from 0), no other is. Documents without tokens need no room: container null, piece 0. Rows
    are items: a repeated doc_id is placed again. A document of any length stays within one group, and groups are drawn
    by hash, so they are alike in size however sources and lengths are distributed. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)["doc_id"]
    n = sizes.where("n_tokens > 0").count()
    groups = max(1, -(-n // per_group))
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("n_tokens") % capacity
    pieces = F.concat(
        F.transform(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("piece"), F.lit(capacity).alias("size"))),
        F.when(rest > 0, F.array(F.struct(whole.alias("piece"), rest.alias("size")))).otherwise(F.array().cast(f"array<struct<piece:int,size:int>>")),
    )
    items = sizes.where("n_tokens > 0").select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.piece", F.col("p.size").alias("n_tokens"))
    items = items.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, loads = first_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        pdf["container"] = [f"{g}-{b}" for g, b in zip(pdf["group"], bins, strict=True)]
        pdf["container_tokens"] = loads[bins]
        return pdf[["doc_id", "piece", "n_tokens", "container", "container_tokens"]]

    out = items.groupBy("group").applyInPandas(run, f"doc_id {kind}, piece int, n_tokens int, container string, container_tokens long")
    none = sizes.where("coalesce(n_tokens, 0) <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("container_tokens"))
    return out.unionByName(none)


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the fill."""
    got = placed.where("container is not null").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return got.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least"), F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"))
