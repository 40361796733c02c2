"""Jacobi-Davidson and whitening against full eigendecompositions and exact sums."""

import math

import numpy as np
import pytest

from rowscrub.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [np.linspace(9, 1, 40), np.geomspace(1e6, 1e-3, 200), np.r_[np.full(5, 3.0), np.linspace(2, 0.1, 60)], np.r_[np.linspace(5, 1, 6), np.zeros(80)], np.full(7, 2.0), np.array([4.0])],
)
def test_largest_eigenvalues(values):
    matrix, _ = symmetric(values)
    calls = []

    def product(columns):
        calls.append(columns.shape[1])
        return matrix @ columns

    k = min(12, len(values))
    got, units = W.jacobi_davidson(product, len(values), k)
    assert np.allclose(got, np.sort(values)[::-1][:k], rtol=1e-11, atol=1e-13 * values.max())
    assert np.allclose(units.T @ units, np.eye(k), atol=1e-13)
    assert np.linalg.norm(matrix @ units - units * got, axis=0).max() <= 1e-12 * values.max()
    assert len(calls) < 200


def test_minres_solves():
    matrix, _ = symmetric(np.r_[np.linspace(-3, -1, 8), np.linspace(1, 5, 12)])
    right = np.random.default_rng(2).standard_normal((20, 3))
    assert np.allclose(matrix @ W.minres(lambda c: matrix @ c, right, 40, 1e-14), right, atol=1e-9)


def expected(rows, k):
    """Exact whole numbers, and components by a full decomposition."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, units = np.linalg.eigh(centred.T @ centred / n)
    values, units = values[::-1][:k], units[:, ::-1][:, :k]
    return n, deviation, centred @ units / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize(("dim", "k", "blocks"), [(10, 4, 400), (24, 32, 2 << 20), (90, 12, 5000)])
def test_whitening(spark, monkeypatch, dim, k, blocks):
    monkeypatch.setattr(W, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(W, "DRIVER_BYTES", 0 if dim == 24 else 64 << 20)
    monkeypatch.setattr(W, "PARTIALS", 3)
    draw = np.random.default_rng(dim)
    data = draw.standard_normal((300, dim)) @ np.diag(np.geomspace(9, 0.5, dim)) + draw.standard_normal(dim)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += rows[:20]
    bad = [(900, None), (901, []), (902, [1.0] * (dim - 1) + [None]), (903, [math.nan] + [1.0] * (dim - 1)), (904, [math.inf] * dim), (905, [1.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows + bad + [(None, rows[3][1])]], SCHEMA).repartition(7)
    got = W.whitened_embeddings(df, k).collect()
    full = [*rows, (None, rows[3][1])]
    n, deviation, white, share = expected(full, min(k, dim))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == len(full) * min(k, dim)
    sign = {c: np.sign(by[7, c][0]["whitened"] * white[7, c - 1]) for c in range(1, min(k, dim) + 1)}
    for i, (vec, _) in enumerate(full):
        for c in range(1, min(k, dim) + 1):
            found = by[vec, c]
            assert len(found) == (2 if vec is not None and vec < 20 else 1)
            for r in found:
                assert (r["n"], r["deviation"]) == (n, deviation[i])
                assert abs(r["whitened"] - sign[c] * white[i, c - 1]) < 1e-8
                assert abs(r["explained"] / share[c - 1] - 1) < 1e-10
                assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [float(v) * 1e6, float(v % 3), -1e6]) for i, v in enumerate([1, 5, 9, 2, 7])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in W.whitened_embeddings(df, 3).collect()}
    assert set(got) == {(i, c) for i in range(5) for c in (1, 2)}  # the third entry never varies
    assert [got[i, 1] for i in range(5)] == expected(rows, 2)[1]
    with pytest.raises(Exception, match="exceeds a long|OverflowError"):
        W.whitened_embeddings(spark.createDataFrame([(1, [1e9], 0, "", 1), (2, [-1e9], 0, "", 1)] * 9, SCHEMA)).collect()


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [None])]])
def test_nothing_to_scale(spark, rows):
    got = W.whitened_embeddings(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA))
    assert got.columns == [c.split()[0] for c in W.WHITE.split(", ")]
    assert got.collect() == []
