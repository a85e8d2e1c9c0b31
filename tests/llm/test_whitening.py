import math
import random

import numpy as np
import pytest

from vidmetrics.llm import whitening
from vidmetrics.llm.queries import op11_chebyshev_whitening

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, +-whitened, explained)} by a plain eigendecomposition."""
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in rows})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float)
    mean = np.array([s / n for s in total])
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in rows:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, total))
        for k in range(components):
            out.append((i, k + 1, n, deviation, float((np.array(v) - mean) @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def compared(got, want):
    got = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got)
    want = sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    for k in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        sign = np.sign(a @ b)
        np.testing.assert_allclose(a, sign * b, atol=1e-8)


def test_whole_table_against_eigendecomposition(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    got = op11_chebyshev_whitening(spark, SMALL).collect()
    compared(got, brute([(r.vec_id, r.embedding) for r in rows]))
    assert all(r.identity_error < 1e-10 for r in got)


def test_filter_is_the_chebyshev_polynomial():
    values = np.array([0.0, 0.3, 0.9, 1.0, 1.4, 2.0])
    got = whitening.filtered(lambda q: values[:, None] * q, np.eye(6), 7, 1.0, 2.0).diagonal()
    chebyshev = np.polynomial.chebyshev.Chebyshev.basis(7)
    np.testing.assert_allclose(got, chebyshev(2 * values - 1) / chebyshev(3.0), atol=1e-12)


def test_many_filters_on_a_flat_spectrum(spark):
    """More dimensions than the block, eigenvalues that nearly agree: only many passes tell them apart."""
    x = np.random.default_rng(3).standard_normal((300, 60)).round(2)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    compared(whitening.whiten(df).collect(), brute([(i, v) for i, v, _ in rows]))


def test_copies_count_once_and_bad_vectors_go(spark):
    pick = random.Random(5)
    good = [(i, [pick.uniform(-2, 2) for _ in range(5)], 1) for i in range(40)]
    hot = [(100 + i, [0.5, -0.25, -0.0, 1.0, 2.0], None) for i in range(60)]
    bad = [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [math.nan] * 5, 1), (203, [math.inf, 0.0, 0.0, 0.0, 0.0], 1),
           (204, [], 1), (205, [1.0, 2.0], 1)]
    same = good[:2] + [(None, good[3][1], 2)]
    df = spark.createDataFrame(good + hot + bad + same, SCHEMA).selectExpr("*", "1 as x", "2 as n", "3 as component", "4 as m")
    got = whitening.whiten(df).collect()
    nulls = [r for r in got if r.vec_id is None]
    assert len(nulls) == 4 and {r.n for r in got} == {41}
    compared([r for r in got if r.vec_id is not None], brute([(i, v) for i, v, _ in good + hot + good[:2]]))


@pytest.mark.parametrize("vectors, rows", [([], 0), ([None], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [3.0, 5.0]], 2), ([[1.0], [2.0], [4.0]], 3)])
def test_few_vectors(spark, vectors, rows):
    """No spread: no component. Two points: one component, at +-1."""
    got = whitening.whiten(spark.createDataFrame([(i, v, None) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(got) == rows
    if rows == 2:
        assert sorted(round(r.whitened, 9) for r in got) == [-1, 1] and got[0].explained == pytest.approx(1)


def test_large_numbers_stay_exact(spark):
    vectors = [[1e12, -3.0], [-7e11, 2.0], [5.0, 1e30], [1.0, 1.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v, None) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in got} == {i: None for i in range(4)}
    big = [[1e6, -3.0], [-7e5, 2.0], [5.0, 1.0], [1.0, 1.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v, None) for i, v in enumerate(big)], SCHEMA), components=1).collect()
    compared(got, brute(list(enumerate(big)), 1))
