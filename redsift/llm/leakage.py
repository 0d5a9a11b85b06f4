"""Evaluation texts leaking into training text: a full-text index per shard of documents, searched for all test items.

Texts become words, normalised so that light damage (case, ligatures, soft hyphens, quoting marks, line breaks) does not
matter. A shard's words are indexed (wavelet-tree ranks, sampled suffix positions); every item is searched backward from
each of its words at once, which yields all maximal matches; those of usual wording are left out; spans are merged per
document and item, in order, over light alterations. No document leaves its task: there is no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redsift.llm.fm_index import FMIndex
from redsift.session import written

#: Fixed value of the problem: the share of an item's words that a leaking document repeats.
SHARE = 0.4
#: A match has at least so many words, a piece of matches too; a phrase is usual if more families of items than this
#: have it; items of a family share so many words in a row.
LEAST, PIECE, USUAL, FAMILY = 3, 6, 3, 12
#: An opening sentence in more items than this is an instruction that belongs to no item.
SHARED = 5
#: Altered words between two matches that still count as repeated, and the widest gap that is looked into.
ALTERED, GAP = 3, 12
#: Words of a shard's index, and items searched at a time.
SHARD_WORDS, BLOCK_ITEMS = 1_000_000, 2_000

_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_BROKEN = re.compile(r"(?<=[a-z])[-‐‑]\r?\n[>\s]*(?=[a-z])")
_TAG = re.compile(r"<[^<>]{0,200}>")
#: ASCII letters and digits, everything else a space.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """Words of a text: runs of letters and digits, compatibility forms resolved, without case, tags and soft hyphens."""
    if not text:
        return []
    plain = text.isascii()
    if not plain:
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text.encode().translate(_PLAIN).decode().split() if plain else _WORD.findall(text)


def item_words(items: list[tuple[int, str | None]]) -> dict[int, list[str]]:
    """Words of each item without a shared opening sentence."""
    first = {k: re.match(r"[^.?!]*[.?!]", t or "") for k, t in items}
    n = Counter(m.group(0).strip().lower() for m in first.values() if m)
    return {k: words(t[m.end() :] if (m := first[k]) and n[m.group(0).strip().lower()] > SHARED else t) for k, t in items}


def words_at(text: str) -> list[tuple[int, int]]:
    """Where each of :func:`words` lies in the text: its first character, and the one after its last."""
    chars, at = [], []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        for c in _UNSEEN.sub("", unicodedata.normalize("NFKC", text[i:j])).lower():
            chars.append(c)
            at.append((i, j))
        i = j
    for pattern, fill in ((_BROKEN, ""), (_TAG, " ")):
        now, kept, here = "".join(chars), [], []
        i = 0
        for m in pattern.finditer(now):
            kept += chars[i : m.start()] + list(fill)
            here += at[i : m.start()] + at[m.start() : m.start() + len(fill)]
            i = m.end()
        chars, at = kept + chars[i:], here + at[i:]
    found = [(at[m.start()][0], at[m.end() - 1][1]) for m in _WORD.finditer("".join(chars))]
    n = len(words(text))
    # texts whose whole normal form has other words than that of its parts: every word is the whole text
    return found if len(found) == n else [(0, len(text))] * n


class Items:
    """A block of items as one array of symbols (0 separates, 1 is any word of no item)."""

    def __init__(self, texts: dict[int, list[str]], usual: set[tuple[str, ...]] | None = None) -> None:
        self.ids = [k for k, w in texts.items() if w]
        lists = [texts[k] for k in self.ids]
        vocabulary = sorted({w for x in lists for w in x})
        self.code = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.sigma = len(vocabulary) + 2
        self.start = np.cumsum([0] + [len(x) for x in lists]).astype(np.int64)
        self.symbols = np.array([self.code[w] for x in lists for w in x], dtype=np.int64)
        self.of = np.repeat(np.arange(len(lists)), np.diff(self.start))
        usual = usual if usual is not None else usual_phrases(texts)
        rare = [k + LEAST <= len(x) and tuple(x[k : k + LEAST]) not in usual for x in lists for k in range(len(x))]
        self.rare = np.concatenate([[0], np.cumsum(rare)]).astype(np.int64)

    def n(self, item: int) -> int:
        return int(self.start[item + 1] - self.start[item])


def families(texts: dict[int, list[str]]) -> dict[int, int]:
    """A number for each item; items that share a run of ``FAMILY`` words, directly or through others, share it."""
    up = {k: k for k in texts}

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    first: dict[int, int] = {}
    for k, x in texts.items():
        for i in range(max(1, len(x) - FAMILY + 1)):
            up[find(k)] = find(first.setdefault(hash(tuple(x[i : i + FAMILY])), k))
    return {k: find(k) for k in texts}


def usual_phrases(texts: dict[int, list[str]]) -> set[tuple[str, ...]]:
    """Phrases of ``LEAST`` words that more than ``USUAL`` families of items have: copies of an item make none usual."""
    family, seen = families(texts), defaultdict(set)
    for k, x in texts.items():
        for i in range(len(x) - LEAST + 1):
            of = seen[tuple(x[i : i + LEAST])]
            if len(of) <= USUAL:
                of.add(family[k])
    return {p for p, of in seen.items() if len(of) > USUAL}


def _matches(index: FMIndex, text: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Maximal matches of unusual wording: (item, first word in the item, length, text position)."""
    s = items.symbols
    n = len(s)
    at = np.arange(n)
    end = at.copy()
    lo, hi = index.step(s, np.zeros(n, dtype=np.int64), np.full(n, index.n, dtype=np.int64))
    length, out = 1, []
    begin = items.start[items.of]
    stop = items.start[items.of + 1]
    while True:
        live = lo < hi
        at, end, lo, hi = at[live], end[live], lo[live], hi[live]
        if not len(at):
            break
        before = np.where(at > begin[at], s[at - 1], -1)
        if length >= LEAST:
            ok = np.flatnonzero(items.rare[end - LEAST + 2] > items.rare[at])
            span = hi[ok] - lo[ok]
            which = np.repeat(ok, span)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(span) - span, span) + lo[which]
            stuck = index.tree.access(rows) != before[which]
            which = which[stuck]
            out.append((at[which], end[which], rows[stuck]))
        on = np.flatnonzero(before > 0)
        at, end = at[on] - 1, end[on]
        lo, hi = index.step(before[on], lo[on], hi[on])
        length += 1
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    at, end, rows = (np.concatenate(x) for x in zip(*out, strict=True))
    pos = index.locate(rows)
    # not maximal to the right: the next symbols agree too, a longer match covers it
    after = np.where(end + 1 < stop[end], s[np.minimum(end + 1, n - 1)], -1)
    keep = text[pos + end - at + 1] != after
    at, end, pos = at[keep], end[keep], pos[keep]
    return items.of[at], at - begin[at], end - at + 1, pos


def _repeated(spans: list[tuple[int, int, int]], item: np.ndarray, doc: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Words of the item that the document repeats in pieces that each keep the item's order, and those pieces.

    spans: maximal matches (item position, length, document position). Two that follow each other in item and document
    are one piece: a short gap between them is altered words, of a longer one the words in common count. A piece of
    fewer than ``PIECE`` words is a coincidence. Pieces: first and last position in the document.
    """
    spans = sorted(spans, key=lambda x: (x[2], x[0]))
    have = np.zeros(len(item), dtype=bool)
    for a, n, _ in spans:
        have[a : a + n] = True
    links: dict[int, tuple[int, int]] = {}
    piece = list(range(len(spans)))

    def find(k: int) -> int:
        while piece[k] != k:
            piece[k] = k = piece[piece[k]]
        return k

    for i, (b, m, q) in enumerate(spans):
        for j in range(i + 1, len(spans)):
            a, n, p = spans[j]
            gap, dgap = a - b - m, p - q - m
            if dgap > 2 * GAP:
                break
            if a > b and p > q and gap <= 0 and dgap <= GAP:  # they overlap in the item
                piece[find(j)] = find(i)
            elif 0 < gap <= GAP and 0 <= dgap <= gap + GAP:
                piece[find(j)] = find(i)
                if not have[b + m : a].any():
                    fill = gap if gap <= ALTERED and dgap <= gap + ALTERED else _common(item[b + m : a], doc[q + m : p])
                    if fill > links.get(b + m, (0, 0))[0]:
                        links[b + m] = (fill, i)
    words: dict[int, np.ndarray] = {}
    ends: dict[int, list[int]] = {}
    for i, (a, n, p) in enumerate(spans):
        k = find(i)
        words.setdefault(k, np.zeros(len(item), dtype=bool))[a : a + n] = True
        e = ends.setdefault(k, [p, p + n - 1])
        e[1] = max(e[1], p + n - 1)
    extra: dict[int, int] = defaultdict(int)
    for fill, i in links.values():
        extra[find(i)] += fill
    real = [k for k, w in words.items() if int(w.sum()) + extra[k] >= PIECE]
    if not real:
        return 0, []
    total = int(np.logical_or.reduce([words[k] for k in real]).sum()) + sum(extra[k] for k in real)
    return min(total, len(item)), sorted((ends[k][0], ends[k][1]) for k in real)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two short arrays."""
    where = defaultdict(list)
    for j, x in enumerate(b.tolist()):
        where[x].append(j)
    tails: list[int] = []
    for x in a.tolist():
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
    return len(tails)


def shard_leaks(texts: list[str | None], items: Items, share: float = SHARE) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """(document's number, item's number, words repeated, pieces) of the leaking documents of a shard.

    Pieces are numbers of words of the document, first and last. The result does not depend on how texts are sharded.
    """
    get = items.code.get
    parts, kept, starts, n = [], [], [], 0
    k = GAP * 2
    for t in texts:
        found = words(t)
        s = np.fromiter(map(get, found, repeat(1)), dtype=np.int64, count=len(found))
        near = np.arange(len(s))
        if len(s) > k:  # a run of foreign words is one symbol for each of its first few, so gaps stay gaps
            c = np.cumsum(s != 1)
            near = near[(near < k) | (c > np.concatenate([np.zeros(k, dtype=np.int64), c[:-k]]))]
            s = s[near]
        starts.append(n)
        kept.append(near)
        parts += [s, np.zeros(1, dtype=np.int64)]
        n += len(s) + 1
    if not n or not len(items.symbols):
        return
    text = np.concatenate(parts)
    index = FMIndex(text, items.sigma)
    item, first, length, pos = _matches(index, text, items)
    if not len(item):
        return
    begin = np.array(starts)
    doc = np.searchsorted(begin, pos, side="right") - 1
    key = doc * len(items.ids) + item
    order = np.lexsort((pos, key))
    key, first, length, pos = key[order], first[order], length[order], pos[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(length, cuts)
    for a, b, total in zip(cuts, [*cuts[1:], len(key)], sums, strict=True):
        d, i = divmod(int(key[a]), len(items.ids))
        size = items.n(i)
        # a match that another follows brings its own words and those of one gap at most, the last one its own only
        if total + GAP * (b - a - 1) < share * size:
            continue
        here = text[begin[d] : (begin[d + 1] if d + 1 < len(begin) else len(text)) - 1]
        spans = list(zip(first[a:b].tolist(), length[a:b].tolist(), (pos[a:b] - begin[d]).tolist(), strict=True))
        got, pieces = _repeated(spans, items.symbols[items.start[i] : items.start[i + 1]], here)
        if got >= share * size:
            yield d, i, got, [(int(kept[d][p]), int(kept[d][q])) for p, q in pieces]


def _block_leaks(docs: DataFrame, kinds: tuple[str, str], block: Broadcast, share: float) -> DataFrame:
    """Leaks of one broadcast block of items; ``docs``: key and text."""
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[1], pa.string())
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[str | None] = []
        size = 0
        b, key_type = block.value, None

        def flush() -> Iterator[pa.RecordBatch]:
            got = list(shard_leaks(held, b, share))
            at = {d: words_at(held[d]) for d, *_ in got}
            spans = [[{"begin": at[d][p][0], "end": at[d][q][1]} for p, q in pieces] for d, _, _, pieces in got]
            if got:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, *_ in got], key_type), pa.array([b.ids[i] for _, i, *_ in got], item_type), pa.array([n for _, _, n, _ in got], pa.int32()),
                        pa.array([b.n(i) for _, i, *_ in got], pa.int32()), pa.array(spans, span),
                    ],
                    names=["doc_id", "item_id", "n_words", "n_item_words", "spans"],
                )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(k)
                held.append(t)
                size += len(t or "") // 6
                if size >= SHARD_WORDS:
                    yield from flush()
                    ids.clear()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, n_item_words int, spans array<struct<begin:int,end:int>>")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = SHARE, block: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, n_words, n_item_words, spans)`` of every document that repeats ``share`` of an item's words in order.

    spans: the stretches to remove, in characters of the document (begin, end exclusive), as pieces of the item repeat.

    Items are the test sets asked about, not corpus data: they are held on the driver. They are searched in blocks of
    ``block``, and each block's result is written before the next one is sent, so tasks hold one block however many
    there are. Null and empty texts and items leak nothing; repeated documents are each a case; an item given twice with
    one id counts once; items alike are each found. Whole texts of any length are indexed.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    rows = [(r[0], r[1]) for r in items.select(item_key, item_text).where(items[item_text].isNotNull() & items[item_key].isNotNull()).groupBy(item_key).agg(F.min(item_text)).orderBy(item_key).collect()]
    texts = item_words(rows)
    usual = usual_phrases(texts)
    blocks = [Items({k: texts[k] for k, _ in rows[i : i + block]}, usual) for i in range(0, len(rows), block)] or [Items({})]
    asked = docs.select(key, text).where(F.col(text).isNotNull())
    if len(blocks) == 1:
        return _block_leaks(asked, kinds, spark.sparkContext.broadcast(blocks[0]), share)
    out = None
    for b in blocks:
        sent = spark.sparkContext.broadcast(b)
        part = written(_block_leaks(asked, kinds, sent, share), "leaks")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def removal_spans(found: DataFrame) -> DataFrame:
    """``(doc_id, begin, end)``: the stretches of all items of a document merged where they meet or overlap.

    ``found`` as :func:`leaks` gives. A window holds the stretches of one document only.
    """
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.begin", "s.end").distinct()
    w = Window.partitionBy("doc_id").orderBy("begin", "end")
    new = F.coalesce(F.col("begin") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = each.withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(w))
    return numbered.groupBy("doc_id", "k").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("doc_id", "begin", "end")
