"""Quality classifier (held-out accuracy) and the pipeline against a plain version."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from strata.llm import quality_knn as Q

from . import brute
from .conftest import ODD, SF

SF_MORE = "/root/testdata/sf0.01"


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_MORE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(rows[x["doc_id"]], x["quality"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    y, s = np.array([q for _, q in held]), np.array([r["score"] for r, _ in held])
    assert _auc(s, y) > 0.97 and ((s >= 0.5) == y).mean() > 0.95


def test_learned_sample_is_bounded_and_keeps_the_fold_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MORE}/{t}.parquet") for t in ("documents", "labels"))
    assert len(Q.learned(docs, labels, sample=40).y) == 40
    train = [x for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 3 != 1]
    assert len(Q.learned(docs, labels).y) == len(train)


def test_classifier_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1), (9, 0), (9, 0), (None, 1), (4, None), (5, 3)], "doc_id long, quality int")
    out = Q.classify(odd_docs, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    none = Q.classify(odd_docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert Q.classify(no_docs, labels).count() == 0
    assert Q.keep_good(odd_docs, labels).columns == odd_docs.columns


def test_pipeline_stages_and_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    assert "pipeline" in E.queries() and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in E.queries()}


def test_pipeline_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in Q.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
            if r["predicted"]}
    docs = [d for d in docs if d[0] in good]
    first = {i for i, (_, c) in brute.near_components(docs).items() if i == c}
    docs = [d for d in docs if d[0] in first]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([t for _, t in docs], items)
    docs = [d for d, (n, hit, _) in zip(docs, found) if not (hit and 20 * hit >= n)]
    out = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == {d for d, _ in docs}
    from .test_tokens_packing import _check_packing
    from strata.llm import secret_scan as S
    clean = [(r["doc_id"], r["text"]) for r in S.redact(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    for (d, t), (e, u) in zip(sorted(docs), sorted(clean)):
        assert d == e and (t == u) == (not S_spans(t))
    _check_packing(out, clean, 2048)


def S_spans(t):
    from .test_scans import _entropy_spans
    return brute.base_spans(t) + _entropy_spans(t)


@pytest.mark.parametrize("stage", P.STAGES[:-1], ids=lambda s: s[0])
def test_stage_cases(spark, odd_docs, no_docs, stage):
    out = stage[1](spark, odd_docs, SF)
    assert out.columns == odd_docs.columns and out.count() <= len(ODD)
    extra = no_docs.withColumns({c: odd_docs[c] for c in ()})
    assert stage[1](spark, extra, SF).count() == 0


def test_votes_equal_a_plain_count():
    """Neighbours, ties and weights on given vectors, one by one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (80, Q.TERMS)).astype(np.float32) * (rng.random((80, Q.TERMS)) < .02)
    x[40:60] = x[:20]  # equal vectors tie
    y = rng.integers(0, 2, 80)
    voters = Q.Voters(x[:70], y[:70])
    latent = voters.latent(x)
    got = voters.score(x)
    for i in range(80):
        cos = [float(latent[i] @ v) for v in voters.v]
        last = sorted(cos, reverse=True)[Q.NEIGHBOURS - 1]
        votes = [(max(c, 0.0) ** Q.POWER, label) for c, label in zip(cos, y[:70]) if c >= last - 1e-6]
        total = sum(w for w, _ in votes)
        want = sum(w * label for w, label in votes) / total if total else 0.5
        assert abs(got[i] - want) < 1e-3, i


def test_long_tokens_are_measured_whole():
    """A text without blanks: what follows its beginning changes its terms."""
    head = "ab.!" * 40
    assert Q.tokens_of("one two") == ["one", "two"] and "".join(Q.tokens_of(head)) == head
    a, b = Q.Terms().vectors([head + "tail" * 50, head + "#7%" * 60])
    shapes = slice(Q.WORDS, Q.WORDS + Q.SHAPES)
    assert not np.allclose(a[shapes], b[shapes])
