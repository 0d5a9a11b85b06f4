"""Subject area of each document: term weighting, truncated singular value decomposition, refined seed centroids.

Documents are embedded per language by weighted terms and a truncated SVD, found by randomised subspace iteration: every
pass streams all documents and adds up one block of sums, in a tree of tasks. Sentences are folded in by the same basis and
compared by cosine with a centroid per subject. Centroids start from labelled documents and are refined over all documents;
a centroid is the mean of its documents' sentences less that of all others, so what is common to all subjects cancels.

A sentence may name a subject only in passing. Frames of sentences (their words without the topical ones) are counted
over the corpus: a frame whose subject is seldom that of the rest of its document does not treat it.

Texts are read once; from then on a word is the hash of its letters. Counts, basis, centroids and frames are computed over
all documents. Labels are read up to a documented bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redsift.operators.joins import hot_join
from redsift.session import dropped, parallelism, written

#: At most this many labelled documents (those with the least hashes) seed the centroids.
LABELLED = 50_000
DIMENSIONS, PASSES, ROUNDS = 64, 2, 3
#: Terms of a language, the most frequent first: each of the first EXACT has a row of the basis of its own, the others share
#: as many by hash. No more than TERMS are known at all (a documented bound of the model).
EXACT, TERMS = 1 << 14, 1 << 18
#: A term in fewer documents is left out, as is one that other languages use nearly as often (a name).
LEAST_DF, NEUTRAL = 3, 0.25
#: Cosines: a sentence may be of a subject, surely is, and is without a known frame; a term is topical.
MAYBE, SURE, ALONE, TOPICAL = 0.1, 0.25, 0.16, 0.4
#: A frame is known from so many sentences; sentences that a document needs for a subject.
FRAME_ROWS, SENTENCES = 6, 2
#: Partial sums that one task adds up; documents of a small matrix.
FAN_IN, DOCS = 16, 256
#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and in to a is at that on by with was for",
    "de": "der die das und im ist bei ein von auf wir den für nicht wurde zu",
    "es": "el la los de en se que por una sin del las y un",
    "fr": "le la les de des du et est à dans une sur près nous",
}
LANGS = tuple(FUNCTION_WORDS)
_FUNCTION = [frozenset(w.split()) for w in FUNCTION_WORDS.values()]
#: A sentence ends behind a mark, at an empty line, and before a line that begins with a capital or a quotation.
_ENDS = [re.compile(x) for x in (r"[.!?]\s+", r"\n\s*\n", r"\n(?=[A-Z>])")]
_TAG = re.compile(r"<[^<>]{0,200}>")
_WORD = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)*|[\1\2]")
_MARKS = {1: " ", 2: " "}
#: ASCII bytes of words in lower case, everything else a space; \1 stands for the end of a sentence, \2 for that of a text.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalpha() or chr(c) in "-\1\2" else 32 for c in range(128)) + b" " * 128


def tokens(texts: list[str]) -> list[str]:
    """Words of the texts, lower case, without digits and tags, with \\1 after sentences and \\2 after each text. A word may
    have hyphens at its ends, which are no part of it."""
    out: list[str] = []
    for plain, run in groupby(texts, str.isascii):
        big = "\2".join([t.translate(_MARKS) if "\1" in t or "\2" in t else t for t in run]) + "\2"
        big = big if plain else unicodedata.normalize("NFKC", big)
        big = _TAG.sub(" ", big) if "<" in big else big
        for end in _ENDS:
            big = end.sub(" \1 ", big)
        if plain:
            out += big.replace("\2", " \2 ").encode().translate(_PLAIN).replace(b"--", b" ").decode().split()
        else:
            out += _WORD.findall(big.lower())
    return out


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence of one text."""
    out: list[list[str]] = [[]]
    for w in tokens([text or ""]):
        if w in ("\1", "\2"):
            out.append([])
        elif w.strip("-"):
            out[-1].append(w.strip("-"))
    return [w for w in out if w]


#: Codes of what is no word: the end of a sentence, that of a text, and a lone hyphen.
SENTENCE, TEXT, NOTHING = 1, 2, 3


class _Codes(dict):
    """Signed 64-bit hashes of words, kept while a worker lives."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self.update({"\1": SENTENCE, "\2": TEXT})
        bare = word.strip("-")
        code = self[word] = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), 7) - (1 << 63) if bare else NOTHING
        return code


_CODES = _Codes({"\1": SENTENCE, "\2": TEXT})


# ---------------------------------------------------------------- passes over all documents


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Whole numbers of each row as bytes: the JVM moves them without looking into them. ends: of the rows, from 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset) if len(column) else np.zeros(1, dtype=np.int32)
    size = np.dtype(dtype).itemsize
    n = int(ends[-1] - ends[0]) // size
    return (np.frombuffer(column.buffers()[2], dtype=dtype, count=n, offset=int(ends[0])) if n else np.zeros(0, dtype=dtype)), np.diff(ends) // size


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its language (that with the most function words, the first on a tie), and the words of its
    sentences as hashes, one sentence after the other, with the place where each begins. Then a row for each word of the
    batch and language: in how many documents it occurs."""
    own = [np.array(sorted(_CODES[w] for w in f)) for f in _FUNCTION]
    every = np.unique(np.concatenate(own))
    has = lambda known, x: known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
    for b in batches:
        flat = tokens([t or "" for t in b.column(1).to_pylist()])
        codes = np.fromiter(map(_CODES.__getitem__, flat), dtype=np.int64, count=len(flat))
        text = codes == TEXT
        doc, sentence = np.cumsum(text), np.cumsum(text | (codes == SENTENCE))
        keep = (codes < SENTENCE) | (codes > NOTHING)
        codes, doc, sentence = codes[keep], doc[keep], sentence[keep]
        hit = np.flatnonzero(has(every, codes))
        votes = np.stack([np.bincount(doc[hit][has(k, codes[hit])], minlength=b.num_rows) for k in own], axis=1)
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
        words = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=b.num_rows))])
        starts = first - words[doc[first]]
        lang = votes.argmax(axis=1).astype(np.int32)
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), _packed(starts.astype(np.int32), offsets), _packed(codes, words), none, none], names=HASHED)
        known = _distinct(codes)
        pair = _distinct(doc * max(len(known), 1) + np.searchsorted(known, codes))
        n = np.bincount(lang[pair // max(len(known), 1)] * len(known) + pair % max(len(known), 1), minlength=len(LANGS) * len(known))
        at = np.flatnonzero(n)
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays(
            [none.cast(b.column(0).type), pa.array((at // max(len(known), 1)).astype(np.int32)), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(known[at % max(len(known), 1)] if len(known) else known), pa.array(n[at])],
            names=HASHED,
        )


HASHED = ["doc_id", "lang", "starts", "codes", "code", "n"]


def vocabulary(hashed: DataFrame, exact: int = EXACT, terms: int = TERMS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language the hashes of its terms in ascending order, the row of the basis of each, and the weights of the rows.

    Terms are the most frequent words by documents, without names."""
    spark = hashed.sparkSession
    counts = hashed.where("n is not null").select("lang", "code", "n")
    sizes = [0] * len(LANGS)
    for r in hashed.where("n is null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["lang"]] = r["n"]
    wide = written(counts.groupBy("code").agg(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(LANGS))]), "terms")
    out = []
    for k in range(len(LANGS)):
        others = [j for j in range(len(LANGS)) if j != k]
        rest = sum((F.col(f"n{j}") for j in others), F.lit(0)) / F.lit(max(1, sum(sizes[j] for j in others)))
        own = F.col(f"n{k}") / F.lit(max(1, sizes[k]))
        rows = wide.where((F.col(f"n{k}") >= LEAST_DF) & (rest <= NEUTRAL * own)).orderBy(F.desc(f"n{k}"), "code").limit(terms).select("code", f"n{k}").toPandas()
        code, n = rows["code"].to_numpy(dtype=np.int64), rows[f"n{k}"].to_numpy(dtype=float)
        row = np.arange(len(code))
        row[exact:] = exact + (code[exact:] % exact)
        total = np.bincount(row, weights=n) if len(row) else np.zeros(0)
        weights = np.log((sizes[k] + 1) / (np.minimum(total, sizes[k]) + 0.5))
        order = np.argsort(code)
        out.append((code[order], row[order].astype(np.int32), weights))
    dropped(spark, wide)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order (sorting whole numbers is faster than hashing them)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _encode(shared: Broadcast) -> Callable:
    """Words to rows of the basis; words that are no terms and sentences without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_numpy()
            (start, per_doc), (codes, words) = _unpacked(b.column(2), np.int32), _unpacked(b.column(3), np.int64)
            base = np.cumsum(words) - words
            start = start + np.repeat(base, per_doc)
            sentence = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(codes))))
            lang = np.repeat(langs, words)
            rows = np.full(len(codes), -1, dtype=np.int32)
            for k, (known, row, _) in enumerate(shared.value):
                on = np.flatnonzero(lang == k)
                if len(on) and len(known):
                    at = np.minimum(np.searchsorted(known, codes[on]), len(known) - 1)
                    rows[on] = np.where(known[at] == codes[on], row[at], -1)
            keep = rows >= 0
            # terms that share a row count once in a sentence
            key = _distinct(sentence[keep].astype(np.int64) << 32 | rows[keep])
            sentence, rows = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
            begin = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, dtype=np.int64)
            left, size = sentence[begin], np.diff(np.append(begin, len(sentence)))
            of = np.repeat(np.arange(b.num_rows), per_doc)[left]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, weights=size, minlength=b.num_rows).astype(np.int64))])
            first = np.cumsum(size) - size - ends[of]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(first.astype(np.int32), offsets), _packed(rows, ends)], names=["doc_id", "lang", "starts", "terms"])

    return run


class Block:
    """Sentences of the documents of one language in a batch, as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, lang: int) -> None:
        self.rows = np.flatnonzero(batch.column(1).to_numpy() == lang)
        part = batch.take(pa.array(self.rows))
        self.ids = part.column(0)
        (start, n), (terms, words) = _unpacked(part.column(2), np.int32), _unpacked(part.column(3), np.int32)
        self.terms = terms.astype(np.int64)
        self.n_docs = len(self.rows)
        self.doc = np.repeat(np.arange(self.n_docs), n)  # of each sentence
        self.start = start + np.repeat(np.cumsum(words) - words, n)
        self.size = np.diff(np.append(self.start, len(self.terms)))
        self.sentence = np.repeat(np.arange(len(self.start)), self.size)  # of each term

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Of each term in its sentence, which has length one."""
        x = w[self.terms]
        return x / np.maximum(np.sqrt(np.bincount(self.sentence, weights=x * x, minlength=len(self.start))), 1e-9)[self.sentence]


def _summed(encoded: DataFrame, step: Callable[[Block, int, np.ndarray], None], shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums over all documents, an array per language.

    There are no more partial sums than the session's width of a stage, however many files; FAN_IN of them meet in a task,
    level by level, and the driver gets as many at most.
    """
    sizes = [int(np.prod(s)) for s in shapes]
    n = min(encoded.rdd.getNumPartitions(), max(FAN_IN, parallelism(encoded.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [np.zeros(s) for s in shapes]
        for b in batches:
            for k in range(len(LANGS)):
                if sizes[k] and len((block := Block(b, k)).terms):
                    step(block, k, acc[k])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int32()), pa.array([np.concatenate([a.ravel() for a in acc]).astype(np.float32).tobytes()], pa.binary())], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(1):
                x = np.frombuffer(v.as_buffer(), dtype=np.float32)
                total = x.astype(np.float64) if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["k", "v"])

    parts = encoded.coalesce(n).mapInArrow(run, "k int, v binary")
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartitionById(n, F.col("k")).mapInArrow(add, "k int, v binary")
    flat = sum((np.frombuffer(r[1], dtype=np.float32).astype(np.float64) for r in parts.collect()), np.zeros(sum(sizes)))
    return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def basis(encoded: DataFrame, weights: list[np.ndarray], dimensions: int = DIMENSIONS, passes: int = PASSES) -> list[np.ndarray]:
    """Right singular vectors of the weighted documents per language, by randomised subspace iteration over all documents."""
    q = [np.random.default_rng(k).standard_normal((len(w), min(dimensions, len(w)))) for k, w in enumerate(weights)]
    for _ in range(passes):

        def step(block: Block, k: int, acc: np.ndarray, q: list = q) -> None:
            now, v = q[k].astype(np.float32), len(weights[k])
            key = np.sort(block.doc[block.sentence] * v + block.terms)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, (doc, term) = np.diff(np.append(at, len(key))), np.divmod(key[at], v)
            x = np.log1p(n) * weights[k][term]
            x = (x / np.maximum(np.sqrt(np.bincount(doc, weights=x * x, minlength=block.n_docs)), 1e-9)[doc]).astype(np.float32)
            # a few documents at a time, as a matrix over the terms they have
            cuts = np.searchsorted(doc, np.arange(0, block.n_docs + DOCS, DOCS))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    mine, column = np.unique(term[a:b], return_inverse=True)
                    m = np.zeros((DOCS, len(mine)), dtype=np.float32)
                    m[doc[a:b] % DOCS, column] = x[a:b]
                    acc[mine] += m.T @ (m @ now[mine])

        q = [np.linalg.qr(x)[0] if x.size else x for x in _summed(encoded, step, [x.shape for x in q])]
    return q


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(n > 1e-12, x / np.maximum(n, 1e-12), 0)


def _best(block: Block, w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best subject and its cosine for each sentence. table: terms by subjects."""
    x = block.weights(w)
    scores = np.add.reduceat(x[:, None] * table[block.terms], block.start, axis=0)
    best = scores.argmax(axis=1)
    return best, scores[np.arange(len(best)), best]


def _counts(block: Block, best: np.ndarray, on: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(block.doc[on] * n + best[on], minlength=block.n_docs * n).reshape(block.n_docs, n)


def centroids(encoded: DataFrame, weights: list[np.ndarray], q: list[np.ndarray], labels: dict, n: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Unit centroids (subjects by dimensions) per language. labels: of a document, the numbers of its subjects.

    The last of the n is that of documents about none of the others: what they say competes with the subjects."""
    cent: list[np.ndarray] | None = None
    for r in range(rounds):
        tables = None if cent is None else [a @ c.T for a, c in zip(q, cent, strict=True)]

        def step(block: Block, k: int, acc: np.ndarray, r: int = r, tables: list | None = tables) -> None:
            w = weights[k]
            share = np.zeros((block.n_docs, n))
            if r == 0:
                known = np.zeros(block.n_docs, dtype=bool)
                for i, d in enumerate(block.ids.to_pylist()):
                    if d in labels:
                        known[i] = True
                        share[i, labels[d]] = 1
            else:
                known = np.ones(block.n_docs, dtype=bool)
                best, top = _best(block, w, tables[k])
                share = _counts(block, best, top > SURE, n).astype(float)
                share[share < SENTENCES] = 0
                share[share[:, : n - 1].any(axis=1), n - 1] = 0
            part = share / np.maximum(share.sum(axis=1, keepdims=True), 1)
            x, of = block.weights(w), block.doc[block.sentence]
            n_sent = np.bincount(block.doc, minlength=block.n_docs)
            v = len(w)
            # sums over all known documents, less those of the subject: the other side
            every = np.bincount(block.terms, weights=x * known[of], minlength=v)
            n_every = (n_sent * known).sum()
            for s in range(n):
                has = share[:, s] > 0
                on = np.flatnonzero(has[of])
                acc[s, 0, :v] += np.bincount(block.terms[on], weights=x[on] * part[of[on], s], minlength=v)
                acc[s, 0, v] += (n_sent * part[:, s]).sum()
                acc[s, 1, :v] += every - np.bincount(block.terms[on], weights=x[on] * known[of[on]], minlength=v)
                acc[s, 1, v] += n_every - (n_sent * (known & has)).sum()

        sums = _summed(encoded, step, [(n, 2, len(w) + 1) if len(w) else (0,) for w in weights])
        new = []
        for k, x in enumerate(sums):
            if not x.size:
                new.append(np.zeros((n, 0)))
                continue
            mean = x[:, :, :-1] / np.maximum(x[:, :, -1:], 1e-9)
            c = _unit((mean[:, 0] - mean[:, 1]) @ q[k])
            c[(x[:, 0, -1] == 0) | (x[:, 1, -1] == 0)] = 0
            # a subject that finds no document in a round keeps its centroid
            new.append(c if cent is None else np.where(np.abs(c).sum(axis=1, keepdims=True) > 0, c, cent[k]))
        cent = new
    return cent or []


def _frames(block: Block, topical: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each sentence, a 63-bit sum over its words other than topical ones."""
    on = ~topical[block.terms]
    sums = np.zeros(len(block.start), dtype=np.uint64)
    np.add.at(sums, block.sentence[on], marks[block.terms[on]])
    return (sums & np.uint64((1 << 63) - 1)).astype(np.int64)


def subjects(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, names: list[str], none: str = "general") -> DataFrame:
    """``(doc_id, subject)``: each subject that at least two sentences of a document treat, else ``none``.

    ``labels`` holds ``(label_key, label)`` rows, with noise and repetitions; labels that are neither in ``names`` nor
    ``none`` are ignored. Null, empty and foreign texts get ``none``; without labels every document does. Texts of any
    length are read whole. Rows that share a key are judged each for itself.
    """
    spark, n = docs.sparkSession, len(names)
    kind = dict(docs.dtypes)[key]
    wanted = labels.where(F.col(label).isin([*names, none]) & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("k")).agg(F.collect_set(label).alias("s"))
    number = {s: i for i, s in enumerate([*names, none])}
    seeds = {r["k"]: [number[s] for s in r["s"]] for r in wanted.orderBy(F.xxhash64("k"), "k").limit(LABELLED).collect()}
    hashed = written(docs.select(key, text).mapInArrow(_hash, f"doc_id {kind}, lang int, starts binary, codes binary, code long, n long"), "hashed")
    terms = vocabulary(hashed)
    weights = [t[2] for t in terms]
    encoded = written(hashed.where("n is null").select("doc_id", "lang", "starts", "codes").mapInArrow(_encode(spark.sparkContext.broadcast(terms)), f"doc_id {kind}, lang int, starts binary, terms binary"), "encoded")
    dropped(spark, hashed)
    q = basis(encoded, weights)
    cent = centroids(encoded, weights, q, seeds, n + 1)
    tables = [(a @ c.T).astype(np.float32) for a, c in zip(q, cent, strict=True)]
    topical = [(_unit(a) @ c[:n].T).max(axis=1, initial=0) > TOPICAL if a.size else np.zeros(0, dtype=bool) for a, c in zip(q, cent, strict=True)]
    marks = [np.random.default_rng(99 + k).integers(1, 1 << 62, len(w)).astype(np.uint64) for k, w in enumerate(weights)]
    model = spark.sparkContext.broadcast((weights, tables, topical, marks))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each sentence that may be of a subject, and one without a subject for each document."""
        weights, tables, topical, marks = model.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = row + np.arange(b.num_rows)
            row += b.num_rows
            none_of = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at), none_of, pa.nulls(b.num_rows, pa.float64()), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=["doc_id", "row", "best", "top", "frame", "agree"])
            for k in range(len(LANGS)):
                block = Block(b, k)
                if not len(block.terms):
                    continue
                best, top = _best(block, weights[k], tables[k])
                sure = (top > SURE) & (best < n)
                others = _counts(block, best, sure, n + 1)[block.doc, best] - sure
                on = np.flatnonzero((top > MAYBE) & (best < n))
                frame = _frames(block, topical[k], marks[k])[on]
                yield pa.RecordBatch.from_arrays(
                    [block.ids.take(pa.array(block.doc[on])), pa.array(at[block.rows[block.doc[on]]]), pa.array(best[on].astype(np.int32)), pa.array(top[on].astype(float)), pa.array(frame), pa.array((others[on] >= 1).astype(np.int64))],
                    names=["doc_id", "row", "best", "top", "frame", "agree"],
                )

    found = written(encoded.mapInArrow(judge, f"doc_id {kind}, row long, best int, top double, frame long, agree long"), "sentences")
    dropped(spark, encoded)
    # marks differ between languages, so a frame is of one language
    known = found.where("frame is not null").groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("agree").alias("a")).where(F.col("n") >= FRAME_ROWS)
    known = written(known.select("frame", (2 * F.col("a") >= F.col("n")).alias("treats")), "frames")
    treats = F.coalesce(F.col("treats"), F.col("top") > ALONE)
    judged = hot_join(found, known, "frame").where(F.col("best").isNull() | treats)
    per = judged.groupBy("doc_id", "row", "best").agg(F.count(F.lit(1)).alias("n")).where(F.col("best").isNull() | (F.col("n") >= SENTENCES))
    of = per.groupBy("doc_id", "row").agg(F.array_compact(F.collect_list("best")).alias("s"))  # as many as there are subjects
    subject = F.when(F.size("s") > 0, F.transform("s", lambda k: F.array(*[F.lit(x) for x in names])[k])).otherwise(F.array(F.lit(none)))
    return of.select("doc_id", F.explode(subject).alias("subject"))


def shares(assigned: DataFrame) -> DataFrame:
    """Per subject the documents and their share of all documents (a document of two subjects counts in both)."""
    total = assigned.agg(F.count_distinct("doc_id").alias("n_all"))
    return assigned.groupBy("subject").agg(F.count_distinct("doc_id").alias("n_documents")).join(F.broadcast(total)).select("subject", "n_documents", F.round(F.col("n_documents") / F.col("n_all"), 6).alias("share"))
