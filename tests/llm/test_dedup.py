"""Near-duplicates, chunk dedup and suffix dedup against plain versions."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import cdc_chunks as C
from strata.llm import hyperminhash as H
from strata.llm import suffix_dedup as X

from . import brute
from .conftest import ODD


def _words(rnd, n, letters="abcdeéf"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(n))


# ------------------------------------------------------------ near duplicates
def _chains(rnd):
    """Texts that each edit the one before: components wider than any star."""
    rows = []
    for _ in range(25):
        t = _words(rnd, rnd.choice([3, 5, 8, 12, 40, 200]), "abcdefgh").split()
        for _ in range(rnd.choice([2, 5, 20])):
            rows.append((len(rows) + 1000, " ".join(t)))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = _words(rnd, 1)
            if rnd.random() < .3:
                t.insert(rnd.randrange(len(t)), _words(rnd, 1))
    rnd.shuffle(rows)
    return rows


def test_near_duplicates(spark, rnd, rows_of):
    rows = _chains(rnd) + rows_of
    rows += [(i, t) for i, t, *_ in ODD if i not in (None, 6)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: tuple(r)[1:] for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
           .collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near_components(rows).items()}


def test_near_duplicate_cases(spark, odd_docs, no_docs):
    out = H.near_duplicates(odd_docs).collect()
    assert len(out) == len(ODD) and H.near_duplicates(no_docs).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert by[1]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[3]["kept"]
    assert by[5]["component_id"] == 4 and not by[5]["kept"]
    kept = H.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(
        (r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 1, 2, 3, 4, 6, 6, 7, 8, 9], key=str)


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in H.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 103), 100)}


def test_estimate_follows_similarity():
    rng = np.random.default_rng(2)
    for j in (0.5, 0.75, 0.9):
        pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
        common = int(len(pool) * j)
        half = (len(pool) - common) // 2
        a, b = np.sort(pool[:common + half]), np.sort(np.r_[pool[:common], pool[common + half:]])
        est, sd = H.estimate(H.sketch(a)[None], H.sketch(b)[None], np.array([len(a) + len(b)]))
        assert abs(est[0] - j) < 5 * sd[0]


def test_no_text_is_dropped_for_another_ones_sake(spark, rnd):
    """Shared, repeated and null ids: what goes is a text that another document has."""
    a, b, c = (_words(rnd, 60) for _ in range(3))
    near = a.replace(a.split()[30], "changed")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, near), (None, a), (None, c), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, mark string")
    kept = H.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, a), (2, b), (3, c), (3, c), (None, a), (None, c), (5, None), (5, "")], key=repr)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in H.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (4, 1, False),
                          (None, None, True), (None, None, True), (5, 5, True), (5, 5, True)], key=repr)


def test_two_texts_of_one_id_are_two_nodes(spark, rnd):
    """Both texts of id 7 have copies; the copies' components stay apart."""
    a, b = _words(rnd, 50), _words(rnd, 50)
    docs = spark.createDataFrame([(7, a), (7, b), (8, a + " x"), (9, b + " y"), (10, b + " z")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in H.keep_first(docs).collect())
    assert kept == sorted([(7, a), (7, b)])


def pairs_at(rng, sizes, low, high, count):
    """Pairs of hash sets of these sizes with a similarity from ``low`` to ``high``."""
    for _ in range(count):
        n = int(rng.choice(sizes))
        j = rng.uniform(low, high)
        union = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))[:n]
        rng.shuffle(union)
        common = int(np.ceil(j * n))
        left = common + (n - common) // 2
        yield np.sort(union[:left]), np.sort(np.r_[union[:common], union[left:]])


def test_sketch_rules_out_no_link():
    """Thousands of linked pairs just over the threshold, in small, middle and
    large sets: none is ruled out by its sketch, hardly any misses all bands."""
    rng = np.random.default_rng(17)
    for sizes, count in (((4, 8, 12, 20, 40), 1500), ((80, 150, 300, 600), 1500), ((2000, 8000), 200)):
        ruled_out = missed = n = 0
        for a, b in pairs_at(rng, sizes, 0.75, 0.78, count):
            both = len(np.intersect1d(a, b))
            if 100 * both < H.THRESHOLD * (len(a) + len(b) - both):
                continue
            n += 1
            ra, rb = H.sketch(a), H.sketch(b)
            ruled_out += not H.possible(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
            missed += H.first_common_band(H.densified(ra)[None], H.densified(rb)[None])[0] == H.BANDS
        assert n > count / 2 and ruled_out == 0 and missed <= 1


def test_cells_give_a_spanning_forest(spark, monkeypatch):
    """One group of near copies and one of texts that are almost near: a cell
    puts out links of the first only, fewer than it has members."""
    rng = np.random.default_rng(4)
    core = np.unique(rng.integers(0, 1 << 63, 90, dtype=np.uint64))
    sets = [np.unique(np.r_[core, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(40)]  # J = 90 / 110
    sets += [np.unique(np.r_[core[:60], rng.integers(0, 1 << 63, 40, dtype=np.uint64)]) for _ in range(40)]  # 60 / 140
    regs = [H.sketch(s) for s in sets]
    dense = [H.densified(r) for r in regs]
    pairs, judged = [], 0
    for band in range(H.BANDS):
        same = {}
        for k, d in enumerate(dense):
            same.setdefault(d.reshape(H.BANDS, H.ROWS)[band].tobytes(), []).append(k)
        for members in same.values():
            if len(members) > 1:
                out = H.across(pa.table({
                    "doc": members, "label": members, "size": [len(sets[k]) for k in members], "own": [0] * len(members),
                    "i": [0] * len(members), "j": [0] * len(members), "band": [band] * len(members),
                    "regs": [regs[k].tobytes() for k in members], "hashes": [sets[k].tobytes() for k in members]}))
                got = list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
                assert len(got) < len(members)
                pairs += got
    assert len(pairs) == len(set(pairs))  # a pair is judged in one band only
    up = list(range(80))
    for a, b in pairs:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        low, high = sorted((up[a], up[b]))
        up = [low if u == high else u for u in up]
    assert set(up[:40]) == {0} and len(set(up[40:])) == 40


def test_cells_of_many_blocks(spark, rnd, monkeypatch):
    """Keys with more members than a block holds: the same components."""
    monkeypatch.setattr(H, "CELL", 4)
    base = _words(rnd, 40).split()
    texts = []
    for i in range(30):
        w = list(base)
        for k in rnd.sample(range(40), 3):
            w[k] = f"w{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


# --------------------------------------------------------------- chunk dedup
def _cuts_one_by_one(data):
    h, last, out = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
        if (h >> (32 - C.MASK_BITS) == 0 and i + 1 - last >= C.LEAST) or i + 1 - last == C.MOST:
            out.append(i + 1)
            last = i + 1
    return out + [len(data)] * (last < len(data))


def test_gear_cuts(rnd):
    for n in (0, 1, 5, 16, 33, 500, 5000):
        for data in (bytes(rnd.choice(b"abcdefgh ") for _ in range(n)), b"a" * n):
            assert C.cuts(data) == _cuts_one_by_one(data)


def test_cuts_resist_insertion(rnd):
    data = _words(rnd, 400).encode()
    moved = data[:700] + b"inserted" + data[700:]
    a = {data[s:e] for s, e in zip([0, *C.cuts(data)], C.cuts(data))}
    b = [moved[s:e] for s, e in zip([0, *C.cuts(moved)], C.cuts(moved))]
    assert sum(x not in a for x in b) <= 4


def _chunk_dedup(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data, a, runs, n = (t or "").encode(), 0, [], 0
        for e in C.cuts(data):
            if seen.setdefault(data[a:e], (i, a)) != (i, a):
                n += 1
                if runs and runs[-1][1] == a:
                    runs[-1][1] = e
                else:
                    runs.append([a, e])
            a = e
        runs = [r for r in runs if r[1] - r[0] >= C.RUN]
        out[i] = (len(data), n, sum(e - a for a, e in runs), len(runs), ",".join(f"{a}:{e}" for a, e in runs))
    return out


def test_chunk_dedup(spark, rnd, rows_of):
    passage = _words(rnd, 60)
    planted = [(5000 + i, f"{_words(rnd, 20)} {passage} {_words(rnd, 20)}") for i in range(4)]
    rows = rows_of + planted + [(6000, None), (6001, ""), (6002, "ab " * 400), (6003, planted[0][1])]
    got = {r["doc_id"]: tuple(r)[1:] for r in C.chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _chunk_dedup(rows)
    assert got[5000][2] == 0 and all(got[5000 + i][2] > len(passage) // 2 for i in (1, 2, 3))


def test_chunk_dedup_cases(spark, odd_docs, no_docs, rnd):
    out = collections.Counter(r["doc_id"] for r in C.chunk_dedup(odd_docs).collect())
    assert sum(out.values()) == len(ODD) and out[6] == 2 and C.chunk_dedup(no_docs).count() == 0
    long = _words(rnd, 100)
    docs = spark.createDataFrame([(1, long), (2, f"{long} tail"), (3, None)], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in C.without_repeats(docs).collect()}
    assert kept[1] == long and len(kept[2]) < 200 and kept[2].endswith("tail") and kept[3] == ""


def test_chunk_dedup_loses_no_text(spark, rnd):
    """Shared, repeated and null ids: text that occurs once stays."""
    p, q = _words(rnd, 100), _words(rnd, 100)
    docs = spark.createDataFrame([(1, p), (2, p), (2, q), (None, p), (None, q), (3, q), (4, q[:-1] + "#"), (4, q[:-1] + "#")],
                                 "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in C.without_repeats(docs).collect()]
    assert kept.count((1, p)) == 1 and (2, q) in kept and (None, p) in kept and (None, q) in kept
    assert sorted(len(t) for i, t in kept if i == 2) [0] < 60 and all(len(t) < 100 for i, t in kept if i == 3)
    assert len({t for i, t in kept if i == 4}) == 1 and len(kept) == 8


def test_chunk_dedup_of_very_many_repeats_in_one_text(spark):
    """A million chunks of which nearly all repeat, in runs: not quadratic."""
    begin = time.time()
    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc"), F.lit(0).cast("long").alias("tag"),
                                         (F.col("id") * 40).cast("int").alias("start"),
                                         F.when(F.col("id") % 4 == 3, 20).otherwise(40).alias("length"))
    r = C.removed_spans(rows).select("n_repeats", F.size("spans").alias("n"), F.element_at("spans", 2).alias("s")).first()
    assert (r["n_repeats"], r["n"], tuple(r["s"])) == (1_000_000, 250_000, (160, 300))
    assert time.time() - begin < 60


# -------------------------------------------------------------- suffix dedup
def test_multikey_order(rnd):
    for _ in range(100):
        n = rnd.randrange(0, 60)
        tokens = [np.array([rnd.randrange(4) for _ in range(n)], np.uint64) for _ in range(3)]
        order, same = X.multikey_order(tokens)
        want = sorted(range(n), key=lambda i: (*(t[i] for t in tokens), i))
        assert order.tolist() == want
        assert same.tolist() == [k > 0 and all(t[want[k]] == t[want[k - 1]] for t in tokens) for k in range(n)]


def test_anchor_of_each_string(rnd):
    for _ in range(30):
        n = rnd.randrange(X.SPAN, 400)
        h = np.array([rnd.randrange(rnd.choice([3, 1000])) for _ in range(n)], np.uint64)
        least, places = X.anchor_places(h)
        want = [min(range(p, p + X.SPAN), key=lambda i: (h[i], i)) for p in range(n - X.SPAN + 1)]
        assert X.anchor_of(h, least, places).tolist() == want


@pytest.fixture()
def passages(rnd):
    rows, shared = [], [_words(rnd, rnd.choice([8, 15, 20, 40, 90])) for _ in range(12)]
    for i in range(250):
        t = [_words(rnd, rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(0, 4)):
            q, a = rnd.choice(shared), rnd.randrange(0, 30)
            t += [q[a:] if rnd.random() < .5 else q[:len(q) - a], _words(rnd, rnd.randrange(0, 10))]
        rows.append((i * 3, rnd.choice([" ", ""]).join(t)))
    rows += [(2000, None), (2001, ""), (2002, "a" * 99), (2003, "a" * 100), (2004, "a" * 500), (2005, "xy" * 300),
             (2006, rows[3][1]), (2007, rows[3][1]), (2008, "ab " * 1000)]
    rnd.shuffle(rows)
    return rows


def _removed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: tuple(r)[1:] for r in X.substring_dedup(docs, **more).collect()}


def test_suffix_dedup(spark, passages, rows_of):
    rows = passages + [(i + 10_000, t) for i, t in rows_of]
    assert _removed(spark, rows) == brute.substrings_removed(rows)


def test_suffix_dedup_of_heavy_passage(spark, rnd):
    """A passage in more rows than the heavy bound, with a different text around
    each: split over buckets, and spread one by one."""
    common = _words(rnd, 50)
    rows = [(i, f"{_words(rnd, rnd.randrange(0, 12))} {common[rnd.randrange(0, 20):]}{_words(rnd, rnd.randrange(0, 12))}")
            for i in range(1500)]
    rnd.shuffle(rows)
    want = brute.substrings_removed(rows)
    assert _removed(spark, rows, heavy=50) == want
    assert _removed(spark, rows) == want


def test_splitters_split_only_frequent_grams():
    sample = [(g, d, 0) for g in range(100) for d in range(2)] + [(500, d, 0) for d in range(200)]
    s = X.Splitters(sample, 16, 40_000, 8_000)
    assert s.split.tolist() == [500] and len(s.full) <= 15
    gram, doc = np.array([5, 5, 500, 500]), np.array([-9, 10 ** 9, 0, 199])
    bucket = s.of_place(gram, doc, np.zeros(4, int))
    assert bucket[0] == bucket[1] and bucket[2] < bucket[3]


def test_suffix_dedup_cases(spark, odd_docs, no_docs):
    out = collections.defaultdict(list)
    for r in X.substring_dedup(odd_docs).collect():
        out[r["doc_id"]].append(r)
    assert sum(map(len, out.values())) == len(ODD) and X.substring_dedup(no_docs).count() == 0
    assert out[None][0]["n_removed"] == 0 and [r["n_removed"] for r in out[6]] == [0, 0]
    assert out[9][0]["n_removed"] == 4999 and out[1][0]["n_bytes"] == 0
    assert X.removal(odd_docs)[1].filter(F.col("doc") == 9).first()["kept"] == b"a"
