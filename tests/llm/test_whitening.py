"""Whitening against plain numpy, its solver against known decompositions, and
the edge cases of the docstring."""

from fractions import Fraction

import numpy as np
import pytest

from strata.llm import whitening as W

SF = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, most=16):
    """vec_id -> (deviation, whitened, explained), n; in whole numbers and float64."""
    points = [(i, tuple(int(np.floor(64 * float(c))) + 1000000 for c in v)) for i, v in rows]
    distinct = sorted({x for _, x in points})
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > values[0] * 1e-11).sum()))
    share = values[:keep] / np.trace(z.T @ z / n)
    out = []
    for i, x in points:
        off = [n * a - s for a, s in zip(x, sums)]
        w = np.array([o / n for o in off]) @ vectors[:, :keep] / np.sqrt(values[:keep])
        out.append((i, sum(o * o for o in off), w))
    return out, share, n


def compare(spark_rows, rows, tolerance=1e-7):
    want, share, n = plain(rows)
    k = len(share)
    assert len(spark_rows) == k * len(want)
    got = {}
    for r in spark_rows:
        got.setdefault(r["vec_id"], []).append(r)
    signs = None
    for i, dev, w in want:
        mine = sorted(got[i], key=lambda r: r["component"])[::len(got[i]) // k]
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, dev)}
        values = np.array([r["whitened"] for r in mine])
        if signs is None and np.abs(values).min() > 1e-3:
            signs = np.sign(values * w)
        if signs is not None:
            assert np.abs(values - w * signs).max() < tolerance
        assert np.allclose([r["explained"] for r in mine], share, rtol=1e-6)
    assert len({r["identity_error"] for r in spark_rows}) == 1 and spark_rows[0]["identity_error"] < 1e-6


def test_equals_numpy_on_the_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    out = W.whitening(df)
    assert out.columns == COLUMNS
    compare(out.collect(), rows)


def test_copies_count_once_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(30)]
    copies = base + [(100 + i, base[0][1]) for i in range(60)]  # most rows are one vector
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 0.0]), (203, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in copies + bad],
                               "vec_id long, embedding array<float>, n int, x string")
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in copies]
    out = W.whitening(df).collect()
    assert {r["vec_id"] for r in out} == {i for i, _ in copies} and out[0]["n"] == 30
    compare(out, rows)


def test_short_null_id_repeated_and_huge(spark):
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [3.0]), (2, []), (3, [1.0, 9.0]), (4, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = W.whitening(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out if r["component"] == 1) == \
        [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    assert {r["n"] for r in out} == {5} and {r["deviation"] for r in out} == {None}  # no long holds them
    assert all(np.isfinite(r["whitened"]) for r in out)


def test_no_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = W.whitening(spark.createDataFrame(rows, schema))
        assert out.columns == COLUMNS and out.collect() == []
    flat = W.whitening(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)


def with_eigenvalues(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T, q


@pytest.mark.parametrize("values", [
    [5.0, 4.0, 3.0, 2.0, 1.0], [1.0, 1.0 + 1e-9, 1.0 + 3e-9, 0.5, 0.25, 0.25 + 1e-10],
    [1.0, 1.0, 1.0, 2.0, 2.0, 3.0], [1e-8, 1e-4, 1.0, 1.0 - 1e-12, 1e4], list(np.linspace(1, 1.00001, 40))])
def test_refinement_reaches_double_precision(values):
    v, _ = with_eigenvalues(values)
    v = (v + v.T) / 2
    start = np.linalg.eigh(v.astype(np.float32))[1]
    got, x = W.refined(v, start)
    size = np.abs(v).max()
    x, a = x.astype(np.longdouble), v.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-15
    assert np.abs(a @ x - x * got[None, :]).max() < 1e-15 * size * len(v)
    assert np.allclose(np.sort(got.astype(float)), np.sort(values), rtol=1e-12, atol=1e-15 * size)


def test_clustered_vectors_are_told_apart():
    """Eigenvalues that float32 can't tell apart: the sub-solve separates them."""
    v, q = with_eigenvalues([1.0, 1.0 + 1e-9, 3.0, 2.0])
    v = (v + v.T) / 2
    values, x = W.decomposed(v)
    for i, col in ((2, 1), (3, 0)):  # falling order: 3, 2, 1 + 1e-9, 1
        assert abs(abs(x[:, i] @ q[:, col]) - 1) < 1e-9
    assert np.abs(np.linalg.eigh(v.astype(np.float32))[1].T.astype(float) @ q).max() <= 1.001  # float32 alone is looser


def test_sums_are_exact(spark):
    rows = [(i, [float(2 ** 46), 1.0 / 64]) for i in range(5000)]
    df = W.fixed_point(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    n, sums = W.exact_sums(df, 2)
    assert (n, sums) == (5000, [5000 * (2 ** 52 + 1000000), 5000 * 1000001])
