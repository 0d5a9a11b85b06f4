"""Operators of the llm problems: SQL comparison, brute force on small tables, and the edge cases."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences

from redsift.llm import cross_split, cut_text, group_splits, leakage, packing, queries, subjects, term_counts
from redsift.llm.components import connected_components
from redsift.llm.fm_index import FMIndex, suffix_order


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    assert differences(queries.QUERIES[name](spark, data), queries.SQL[name], data) == ""


# ---------------------------------------------------------------- index


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.sampled_from([2, 5, 60, 400, 4000]))
def test_suffix_order_whatever_the_symbols(seed, docs, sigma):
    g = np.random.default_rng(seed)
    text = np.concatenate([np.append(g.integers(1, sigma, g.integers(0, 30)), 0) for _ in range(docs)]).astype(np.int64)
    ends = np.cumsum(text == 0)
    plain = sorted(range(len(text)), key=lambda i: [(0, int(ends[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))])
    assert suffix_order(text).tolist() == plain
    index = FMIndex(text, sigma)
    assert index.locate(np.arange(len(text))).tolist() == plain


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([2, 4, 6, 900]))
def test_index_finds_every_occurrence(seed, docs, sigma):
    g = np.random.default_rng(seed)
    text = np.concatenate([np.append(g.integers(1, sigma, g.integers(0, 40)), 0) for _ in range(docs)]).astype(np.int64)
    index = FMIndex(text, sigma)
    for n in (1, 2, 3, 5):
        p = g.integers(1, sigma, (4, n)).astype(np.int64)
        lo, hi = index.search(p, np.full(4, n))
        for row, a, b in zip(p, lo, hi, strict=True):
            got = sorted(index.locate(np.arange(a, b)).tolist())
            assert got == [i for i in range(len(text) - n + 1) if (text[i : i + n] == row).all()]


# ---------------------------------------------------------------- components and splits


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components_equal_union_find(spark):
    g = np.random.default_rng(4)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in g.integers(0, 120, (90, 2))] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    df = spark.createDataFrame([*edges, edges[0], (None, "x"), ("x", None)], "u string, v string")
    assert {r["node"]: r["label"] for r in connected_components(df).collect()} == union_find(edges)
    assert connected_components(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.integers(0, 200))
def test_choose_is_the_closest_sum(sizes, target):
    got = group_splits.choose(sizes, target)
    assert all(0 < k <= sizes[s] for s, k in got.items())
    sums = {0}
    for s, n in sizes.items():
        sums = {x + s * k for x in sums for k in range(n + 1)}
    assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(x - target) for x in sums)


PATCH = "patch_id string, dominant_obs_id string, centroid_lon double, centroid_lat double, label string"


def test_groups_never_part_and_totals_hold(spark):
    rows = [(f"hot{i}", "ESP_000001_0001", float(i) / 100, 1.0, "x") for i in range(300)] + [(f"p{i}", f"ESP_{i // 3:06d}_1000", float(i), 2.0, None) for i in range(600)]
    rows += [("l1", "esp 000005 1000", 999.0, 5.0, ""), ("l2", "ESP_000006_1000", -81.0, 5.0, ""), ("n1", None, 279.0, 5.0, ""), ("n2", None, 8.0, 8.0, ""), ("n3", None, 368.0, 8.0, ""), ("n4", None, None, None, ""), ("n5", None, float("nan"), 1.0, "")]
    df = spark.createDataFrame(rows, PATCH)
    got = group_splits.grouped_split(group_splits.record_groups(df, "patch_id", "dominant_obs_id", "centroid_lon", "centroid_lat")).toPandas()
    assert len(got) == len(rows) and set(got.patch_id) == {r[0] for r in rows}
    assert (got.groupby("group_id").split.nunique() == 1).all()
    of = dict(zip(got.patch_id, got.group_id, strict=True))
    assert of["l1"] == of["l2"] == of["n1"] == of["p15"] and of["n2"] == of["n3"] != of["n4"] != of["n5"]
    n = Counter(got.split)
    assert abs(n["val"] - len(rows) * 0.1) <= 1 and abs(n["test"] - len(rows) * 0.1) <= 1
    assert group_splits.grouped_split(group_splits.record_groups(df.limit(0), "patch_id", "dominant_obs_id", "centroid_lon", "centroid_lat")).count() == 0


# ---------------------------------------------------------------- terms


def test_term_counts_split_partitions(spark):
    g = np.random.default_rng(1)
    texts = [" ".join(f"t{int(x)}" for x in g.zipf(1.3, 12) % 500) for _ in range(200)] + ["", None, "-a b-c İK Straße", "x " * 50_000, "same", "same"]
    df = spark.createDataFrame([(t, "k") for t in texts], "t string, term string")
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["n_total"]) for r in term_counts.term_counts(df, "t", rows=20, bits=2).collect()}
    import re

    occ, rec = Counter(), Counter()
    for t in texts:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9-]*", t or "")]
        occ.update(w)
        rec.update(set(w))
    assert got == {k: (occ[k], rec[k], len(texts) - 1) for k in occ}
    assert term_counts.term_counts(df.limit(0), "t").count() == 0


# ---------------------------------------------------------------- overlaps across splits


def test_overlaps_equal_brute_force(spark):
    g = np.random.default_rng(2)
    obs = [f"ESP_{i:06d}_1000" for i in range(9)]
    rows = []
    for i in range(260):
        x, y = g.choice([0.0, 359.9998, 10.0, 10.0004]) + g.integers(0, 3) * 0.0002, 3.0 + g.integers(0, 4) * 0.0003
        rows.append((f"p{i}", float(x) - 360 * (i % 2), float(y), [str(z) for z in g.choice(obs, g.integers(1, 6), replace=False)] + ([None] if i % 5 == 0 else []), i))
    rows += [("nul", None, 1.0, obs[:1], 1), ("emp", 10.0, 3.0, [], 1), ("non", 10.0, 3.0, None, 1)]
    p = spark.createDataFrame(rows, "patch_id string, centroid_lon double, centroid_lat double, contributing_obs_ids array<string>, built_at int")
    part = {r[0]: ("train", " VAL", "test")[i % 3] for i, r in enumerate(rows)}
    m = spark.createDataFrame(list(part.items()), "patch_id string, holdout_split string")
    recs = cross_split.records(p.unionByName(p.limit(5)), m)
    want = set()
    for a in rows:
        for b in rows:
            if part[a[0]] != "train" and part[b[0]] == "train" and a[1] is not None and a[3] and b[3] and b[1] is not None:
                s, t = {z for z in a[3] if z}, {z for z in b[3] if z}
                gap = abs(a[1] % 360 - b[1] % 360)
                if abs(a[2] - b[2]) < 0.000505 and min(gap, 360 - gap) < 0.000505 and len(s & t) >= 0.75 * len(s | t):
                    want.add((a[0], b[0]))
    for per_task in (cross_split.PER_TASK, 30):
        got = [(r["eval_id"], r["train_id"]) for r in cross_split.overlaps(recs, per_task).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert cross_split.overlaps(recs.limit(0)).count() == 0


# ---------------------------------------------------------------- cut text


def test_cut_text(spark):
    g = np.random.default_rng(3)
    names = ["".join(g.choice(["bel", "dov", "kad", "mor", "nek", "qua"], 3)).title() for _ in range(60)]
    kinds, things = ["Crater", "Planum", "Vallis"], ["Dunes", "Gullies", "Layered bedrock", "Fresh ejecta"]
    full = [f"{g.choice(things)} on the {g.choice(['rim', 'northern wall', 'floor'])} of {g.choice(names)} {g.choice(kinds)}" for _ in range(1500)]
    rows, cut = [], set()
    for i, t in enumerate(full):
        if i % 10 == 0:
            t = t[: len(t) - int(g.integers(2, 5))]
            cut.add(i)
        elif i % 3 == 0:
            t += "."  # words count as whole where a value is closed
        rows.append((i, t, f"s{i % 3}", "clash"))
    rows += [(5000, None, "s0", ""), (5001, "", None, ""), (5002, "N/A", "s1", ""), (5003, "x" * 200_000, "s1", ""), (5004, full[1], "s1", "")]
    df = spark.createDataFrame(rows, "pos long, text string, source string, score string")
    got = {r["key"]: r for r in cut_text.cut_rows(df, "pos", "text", "source").collect()}
    assert len(got) == len(rows) and not any(got[k]["cut"] for k in (5000, 5001, 5002)) and got[5000]["score"] is None
    found = {k for k in got if got[k]["cut"] and k < 5000}
    assert len(found & cut) > 0.85 * len(cut) and len(found - cut) < 0.1 * len(cut) + 3
    assert cut_text.cut_rows(df.limit(0), "pos", "text", "source").count() == 0
    shares = {r["source"]: r for r in cut_text.cut_shares(cut_text.cut_rows(df.limit(40), "pos", "text", "source")).collect()}
    assert set(shares) == {"s0", "s1", "s2"}


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_equals_plain_first_fit(sizes):
    bins, loads = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        k = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(50)
        room[k] -= sizes[i]
        want[i] = k
    assert bins.tolist() == [want[i] for i in range(len(sizes))] and (loads <= 50).all()


def test_packing_places_every_token(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(0).integers(0, 700, 400))] + [(1000, 2048 * 3 + 5), (1001, 2048), (1002, None), (7, 12)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    got = packing.packed(df, per_group=150).toPandas()
    assert got.n_tokens.sum() == sum(n or 0 for _, n in rows)
    assert (got.dropna().groupby("container").n_tokens.sum() <= 2048).all()
    assert got[got.doc_id == 1000].n_tokens.tolist().count(2048) == 3 and len(got[(got.doc_id < 1000) & (got.n_tokens > 0)].query("piece > 0")) == 0
    assert packing.packed(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def counters():
    return packing.token_counter(block=10**9, run=10**9), packing.token_counter(block=5, run=4)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zé", "the", "'s", "'", "12", "!", "?!", " ", "  ", "\n", "\n\n", "\t", "\x85", "\x1c", "\xa0", "     ", "東京", "½", "_", "'ll", "-"]), max_size=40))
def test_sizes_do_not_depend_on_blocks(counters, parts):
    whole, blocks = counters
    assert blocks("".join(parts)) == whole("".join(parts))


def test_token_sizes_of_long_texts(counters):
    count, whole = packing.token_counter(), counters[0]
    for one in ("Layered bedrock at 12.5 degrees, again and again. ", "no\nsingle\nspaces\n", "two  spaces  each  ", "abcdefghij", "!", "x" * 30_000 + "1"):
        text = one * (90_000 // len(one))
        assert count(text) == whole(text)
    assert count("a" + " " * 2_000_000 + "b") == count("a") + count(" b") + count(" " * 1_999_999)
    assert count(None) == count("") == 0 and count("\n" * 1_500_000) > 0


# ---------------------------------------------------------------- leaks


def test_gaps_may_add_more_than_the_matches():
    item = [f"w{i}" for i in range(68)]
    gap = [0, 3, 6, 9, 11]  # altered words of a gap of 12: seven are left, none three in a row
    copy = item[:36]
    for start in (4, 20):
        for k in gap:
            copy[start + k] = f"x{start + k}"
    rest = [f"y{i}" for i in range(100)]
    items = leakage.Items({7: item})
    ((d, i, n, pieces),) = leakage.shard_leaks([" ".join(rest + copy + rest)], items, 26 / 68)
    assert (d, i, n) == (0, 0, 26) and pieces == [(100, 135)]  # 26 of 68 words, 12 of them matched

    rng = np.random.default_rng(4)
    docs = []
    for n in range(300):
        a = [w if rng.random() > (n % 10) / 15 else f"z{rng.integers(99)}" for w in item[: rng.integers(20, 69)]]
        docs.append(" ".join(rest + a + rest))
    every = [x for x in leakage.shard_leaks(docs, items, 0.0) if x[2] >= leakage.SHARE * 68]
    assert every and list(leakage.shard_leaks(docs, items)) == every


@pytest.mark.parametrize("every", [2, 3, 4, 5, 9])
def test_altered_words(every):
    items = leakage.Items({0: [f"w{i}" for i in range(60)]})
    text = " ".join("other" if i % every == every - 1 else f"w{i}" for i in range(60))
    assert [x[:2] for x in leakage.shard_leaks([text], items)] == ([(0, 0)] if every > 3 else [])


@pytest.mark.parametrize("n", [1, 3, 4, 40])
def test_items_alike_are_all_found(n):
    one = [f"w{i}" for i in range(50)]
    texts = {i: one if i % 2 else [*one[:40], f"end{i}"] for i in range(n)} | {100 + i: [f"v{i}{k}" for k in range(9)] + ["in", "the", "end"] for i in range(9)}
    assert ("in", "the", "end") in leakage.usual_phrases(texts)
    got = list(leakage.shard_leaks(["x y " + " ".join(one) + " z in the end"], leakage.Items(texts)))
    assert [x[1] for x in got] == list(range(n))


def test_shards_do_not_matter(data):
    import duckdb

    docs = [r[0] for r in duckdb.sql(f"select text from '{data}/documents.parquet' order by doc_id").fetchall()]
    rows = duckdb.sql(f"select item_id, text from '{data}/eval_items.parquet' order by 1").fetchall()
    # of every tenth item a short document, far shorter than the items' vocabulary
    docs += [t[len(t) // 4 :] for _, t in rows[::10]]
    items = leakage.Items(leakage.item_words(rows))
    want = list(leakage.shard_leaks(docs, items))
    assert len(want) >= 24
    for n in (1, 3, 10):
        assert [(i + d, *x) for i in range(0, len(docs), n) for d, *x in leakage.shard_leaks(docs[i : i + n], items)] == want


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB-\n >é\u0301ﬁ½\u00ad<x1_ ́", max_size=40))
def test_words_lie_where_they_are(text):
    at = leakage.words_at(text)
    assert len(at) == len(leakage.words(text)) and all(0 <= a < b <= len(text) for a, b in at)
    if text.isascii() and "<" not in text and "-" not in text:
        assert [text[a:b].lower() for a, b in at] == leakage.words(text)


def test_leaks(spark):
    g = np.random.default_rng(5)
    items = [(i, "Read this and answer. " + " ".join(f"w{int(x)}" for x in g.integers(0, 4000, 60))) for i in range(30)]
    noise = lambda n: " ".join(f"z{int(x)}" for x in g.integers(0, 900, n))
    body = {k: t.split(". ", 1)[1].split() for k, t in items}
    docs, want = [], set()
    for i in range(30):
        w = body[i]
        docs.append((i, f"{noise(50)} {' '.join(w)} {noise(30)}"))
        docs.append((100 + i, f"{noise(9)} {' '.join(w[30:50])} {noise(40)} {' '.join(w[:15]).upper()}"))
        docs.append((200 + i, f"{noise(30)} Read this and answer. {' '.join(w[:15])} {noise(10)}"))
        altered = [x if k % 9 else "changed" for k, x in enumerate(w)]
        docs.append((300 + i, f"{noise(5)} {' '.join(altered)}"))
        want |= {(i, i), (100 + i, i), (300 + i, i)}
    docs += [(900, None), (901, ""), (902, "q " * 200_000), (903, docs[0][1])]
    want.add((903, 0))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "k").repartition(3)
    it = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    for block in (7, 2000):
        rows = leakage.leaks(d, "k", "text", it, "item_id", "text", block=block)
        assert {(r["doc_id"], r["item_id"]) for r in rows.collect()} == want
        text = {k: t for k, t in docs}
        cut = defaultdict(list)
        for r in leakage.removal_spans(rows).collect():
            cut[r["doc_id"]].append(text[r["doc_id"]][r["begin"] : r["end"]])
        assert cut[3] == [" ".join(body[3])] and sorted(cut[104]) == sorted([" ".join(body[4][30:50]), " ".join(body[4][:15]).upper()])
    assert leakage.leaks(d.limit(0), "k", "text", it, "item_id", "text").count() == 0
    assert leakage.leaks(d, "k", "text", it.limit(0), "item_id", "text").count() == 0


# ---------------------------------------------------------------- subjects


def test_subjects(spark):
    g = np.random.default_rng(6)
    words = {"rock": ["basalt", "granite", "gneiss", "schist", "marble"], "wind": ["dune", "ripple", "gust", "loess", "yardang"], "ice": ["glacier", "frost", "firn", "serac", "moraine"]}
    frames = ["The team found {a} near the {b} of the site.", "In the north a {a} covers the {b} and more.", "Our count of {a} with {b} rose by ten."]
    office = ["Minutes of the meeting list many actions.", "The weekly list closes with open requests.", "Planner swapped two requests over lunch."]
    docs, truth = [], {}
    for i in range(900):
        names = [str(x) for x in g.choice(list(words), g.integers(0, 3), replace=False)]
        s = [str(g.choice(frames)).format(a=g.choice(words[n]), b=g.choice(words[n])) for n in names for _ in range(4)] + [str(x) for x in g.choice(office, 3)]
        g.shuffle(s)
        docs.append((i, " ".join(s), "clash"))
        truth[i] = set(names) or {"general"}
    docs += [(5000, None, ""), (5001, "", ""), (5002, "x" * 100_000, ""), (5003, docs[0][1], "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 300) for s in truth[i]] + [(0, "other"), (None, "ice"), (1, None)], "doc_id long, subject string")
    run = lambda d, labels: subjects.subjects(d, "doc_id", "text", labels, "doc_id", "subject", list(words))
    got = defaultdict(set)
    for r in run(d, labels).collect():
        got[r["doc_id"]].add(r["subject"])
    assert set(got) == {r[0] for r in docs} and all(got[k] == {"general"} for k in (5000, 5001, 5002)) and got[5003] == got[0]
    right = sum(got[i] == truth[i] for i in truth)
    assert right > 0.9 * len(truth)
    assert run(d.limit(0), labels).count() == 0
    assert {r["subject"] for r in run(d.limit(30), labels.limit(0)).collect()} == {"general"}
