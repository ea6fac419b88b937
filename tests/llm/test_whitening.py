"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from touchline.llm import whitening

KIND = "vec_id long, embedding array<double>"


def dense(rows):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in rows], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array((n * fit - sums) / n, dtype=float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, x, values[::-1], vectors[:, ::-1]


def check(found, ids, rows, count):
    n, sums, x, values, vectors = dense(rows)
    assert len(found) == len(rows) * count
    by = {(r.id, r.component): r for r in found}
    centred = np.array((n * x - sums) / n, dtype=float)
    for k in range(count):
        want = centred @ vectors[:, k] / np.sqrt(values[k])
        have = np.array([by[i, k + 1].whitened for i in ids])
        sign = np.sign(want @ have) or 1
        assert np.allclose(have, sign * want, atol=1e-7)
    for i, row in zip(ids, x):
        r = by[i, 1]
        assert (r.n, int(r.deviation)) == (n, sum(int(v) ** 2 for v in n * row - sums))
        assert abs(r.explained / (values[0] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_against_a_dense_decomposition(spark):
    random = np.random.default_rng(2)
    rows = (random.normal(size=(400, 40)) @ random.normal(size=(40, 40)) * 0.2).tolist()
    rows += [rows[5]] * 80 + [[c + 1e-9 for c in rows[5]]]  # a common vector counts once, equal as integers too
    ids = list(range(len(rows)))
    bad = [(9001, None), (9002, [float("nan")] * 40), (9003, [None] + [1.0] * 39), (9004, [float("-inf")] * 40), (9005, []), (9006, [1.0] * 3), (9007, [1e200] * 40)]
    frame = spark.createDataFrame([*zip(ids, rows), *bad], KIND).selectExpr("*", "1 AS component", "'c' AS n", "2 AS id")
    found = whitening.whiten(frame).collect()
    check(found, ids, rows, 16)


def test_close_eigenvalues_are_certified(spark):
    random = np.random.default_rng(3)
    rows = random.normal(size=(3000, 64)) / 8
    fitted = whitening.fit_rows(spark.createDataFrame(list(enumerate(rows.tolist())), KIND))
    model = whitening.fit(fitted)
    _, _, _, values, vectors = dense(rows)
    assert model.residual < 1e-12 and model.identity_error < 1e-10
    assert np.allclose(model.values, values[:16], rtol=1e-12)
    assert np.allclose(np.abs((model.vectors * vectors[:, :16]).sum(axis=0)), 1, atol=1e-12)


def test_filter_damps_the_unwanted_spectrum():
    values = np.array([5.0, 4.0, 1.0, 0.6, 0.0])
    calls = []
    out = whitening.chebyshev(lambda q: (calls.append(1), values[:, None] * q)[1], np.eye(5), 8, 0.0, 1.0, 5.0)
    kept = np.abs(np.diag(out))
    assert len(calls) == 8 and kept[0] == pytest.approx(1) and kept[2:].max() < 1e-4 * kept[1]


def test_small_and_flat_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    assert whitening.whiten(frame([])).isEmpty()
    assert whitening.whiten(frame([(1, None)])).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).isEmpty()  # no variance
    rows = [[0.5, 1.0, 3.0], [1.5, 2.0, 3.0], [0.5, 4.0, 3.0], [9.0, 1.0, 3.0]]  # one dimension does not vary
    check(whitening.whiten(frame([(i, r) for i, r in enumerate(rows)])).collect(), range(4), rows, 2)
    repeated = whitening.whiten(frame([(None, rows[0]), (1, rows[1]), (1, rows[1])])).collect()
    assert sorted((r.id or 0, r.component, r.n) for r in repeated) == [(0, 1, 2), (1, 1, 2), (1, 1, 2)]


def test_deviations_beyond_long_stay_exact():
    center = whitening.Center(3, (10**12, 5))
    x = np.array([[2**50, 7], [1, 2]])
    want = [(3 * 2**50 - 10**12) ** 2 + (21 - 5) ** 2, (3 - 10**12) ** 2 + 1]
    assert [int(v) for v in center.deviations(x)] == want
