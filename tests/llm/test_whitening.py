import math

import numpy as np
import pytest

from skeinbase.llm import whitening


def frame(spark, rows):
    """With extra columns whose names the operator uses for its own."""
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<double>, x int, whitened double, component int")


def vectors(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(0.6, 0.1, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).tolist()


def check(spark, rows, components=4):
    """Holds the operator against a whole eigendecomposition and whole numbers of any length."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    xs = [[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v in kept]
    fit = np.array(sorted(set(map(tuple, xs))), float)
    n, sums = len(fit), [sum(c) for c in zip(*set(map(tuple, xs)), strict=True)]
    cov = np.cov(fit.T, bias=True).reshape(width, width)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    found = whitening.whiten(frame(spark, rows), components=components).collect()
    k = min(components, int((value > 1e-12 * value[0]).sum()))
    assert len(found) == k * len(kept)
    white = (np.array(xs) - np.array(sums) / n) @ vector[:, :k] / np.sqrt(value[:k])
    want = sorted(((i, j + 1, sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True))), abs(w[j])) for (i, _), x, w in zip(kept, xs, white, strict=True) for j in range(k))
    got = sorted(((r["id"], r["component"], r["deviation"]), abs(r["whitened"])) for r in found)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    for r in found:
        assert r["n"] == n and abs(r["explained"] - value[r["component"] - 1] / value.sum()) < 1e-12 and r["identity_error"] < 1e-10 and r["residual"] < 1e-11
    # One sign for all rows.
    for j in range(1, k + 1):
        own = np.array([r["whitened"] for r in sorted(found, key=lambda r: (r["id"], r["deviation"])) if r["component"] == j])
        them = np.array([w[j - 1] for (i, _), x, w in sorted(zip(kept, xs, white, strict=True), key=lambda t: (t[0][0], sum((n * a - b) ** 2 for a, b in zip(t[1], sums, strict=True))))])
        assert min(np.abs(own - them).max(), np.abs(own + them).max()) < 1e-9


def test_equals_a_whole_eigendecomposition(spark):
    v = vectors()
    rows = list(enumerate(v)) + [(1000, v[5]), (1001, v[5]), (7, v[7]), (1002, None), (1003, [float("nan")] * 16), (1004, [1.0] * 15 + [None]), (1005, [float("-inf")] + [0.0] * 15), (-4, [0.0] * 16), (-5, [])]
    check(spark, rows)


def test_one_very_common_vector_counts_once(spark):
    v = vectors(40, 8)
    check(spark, list(enumerate(v)) + [(100 + i, v[0]) for i in range(2000)])


def test_fewer_directions_than_components(spark):
    line = [[i / 8, -i / 4, 0.5] for i in range(20)]
    check(spark, list(enumerate(line)))
    check(spark, list(enumerate(vectors(30, 2))))


def test_vectors_of_unlike_lengths_end_in_zeros(spark):
    check(spark, [(i, v[: 5 + i % 3]) for i, v in enumerate(vectors(60, 7))])


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0


def test_deviations_that_no_long_holds_are_null(spark):
    rows = [(0, [1e30, 0.0]), (1, [0.0, 1.0]), (2, [-1e30, 5.0]), (3, [3.0, 4.0])]
    assert {r["deviation"] is None for r in whitening.whiten(frame(spark, rows)).where("id in (0, 2)").collect()} == {True}


def test_null_ids_and_repeated_rows(spark):
    v = vectors(30, 4)
    rows = list(enumerate(v)) + [(None, v[0]), (None, v[0]), (3, v[3])]
    assert whitening.whiten(frame(spark, rows)).where("id is null or id = 3").count() == 4 * 4


@pytest.mark.parametrize("d", [1, 3, 50])
def test_lobpcg_finds_close_and_equal_eigenvalues(d):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectrum = np.sort(np.r_[[5.0, 5.0, 4.9999, 4.9], rng.uniform(0, 4.8, d)][:d])[::-1]
    a = (turn * spectrum) @ turn.T
    value, vector, residual, _ = whitening.lobpcg(lambda q: a @ q, d, min(4, d))
    assert np.allclose(value, spectrum[:4], atol=1e-11) and residual < 1e-11
    assert np.abs(a @ vector - vector * value).max() < 1e-11 and np.abs(vector.T @ vector - np.eye(min(4, d))).max() < 1e-12


def test_lobpcg_of_zero():
    value, _, residual, _ = whitening.lobpcg(lambda q: 0 * q, 6, 4)
    assert (value == 0).all() and residual == 0
