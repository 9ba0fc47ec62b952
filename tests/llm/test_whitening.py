"""Embedding whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest

from labeltrail.llm.whitening import fit_whitening, one_sided_jacobi, pivoted_cholesky, whiten, whitened_components

SCHEMA = "vec_id long, embedding array<float>, component string, n string, deviation string, id string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "y", "z", "q") for i, v in zip(ids, vectors)], SCHEMA)


def plain(vectors, k):
    x = np.floor(np.asarray(vectors, np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return deviation, (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_factor_and_rotation_give_eigenvectors(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(40, d)) * 10.0 ** (np.arange(d) / 6)
    a = a.T @ a
    factor, order = pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], rtol=1e-10) and np.allclose(np.triu(factor, 1), 0)
    norms, columns = one_sided_jacobi(factor)
    assert np.allclose(norms**2, np.linalg.eigvalsh(a)[::-1], rtol=1e-9) and np.allclose(columns.T @ columns, np.eye(d), atol=1e-12)


def test_rank_is_found():
    b = np.random.default_rng(1).normal(size=(6, 2))
    factor, order = pivoted_cholesky(b @ b.T)
    assert factor.shape == (6, 2) and np.allclose(factor @ factor.T, (b @ b.T)[np.ix_(order, order)])
    assert pivoted_cholesky(np.zeros((3, 3)))[0].shape == (3, 0)


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(700, 10)) @ rng.normal(size=(10, 10))).astype(np.float32)
    out = whitened_components(frame(spark, v).repartition(7), k=8).toPandas()
    deviation, white, share = plain(v, 8)
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(np.abs(got), np.abs(white), atol=1e-9)
    assert out[out.component == 1].set_index("vec_id").deviation.sort_index().astype(object).map(int).tolist() == deviation
    assert np.allclose(out.groupby("component").explained.first(), share, rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9 and set(out.n) == {700}


def test_odd_rows(spark):
    v = [[1, 2, 3], None, [], [None, 1, 2], [1, float("nan"), 2], [1, float("inf"), 2], [1e20, 1, 1], [1, 2], [4, 2, 1], [0, -7, 1], [0, -7, 1]]
    out = whitened_components(frame(spark, v, [5, 1, 2, 3, 4, 6, 7, 8, None, 10, 10])).toPandas()
    good = [v[0], *v[8:]]
    deviation, white, _ = plain(good, 2)
    assert sorted(set(out.component)) == [1, 2] and len(out) == 8 and set(out.n) == {4}
    assert sorted(int(x) for x in out[out.component == 1].deviation) == sorted(deviation)
    assert np.allclose(sorted(out[out.component == 1].whitened.abs()), sorted(np.abs(white[:, 0])))


def test_immense_entries_stay_exact(spark):
    v = [[2.0**30, 1], [-(2.0**31), 5], [2.0**33, -9], [7, 2.0**20]]
    out = whitened_components(frame(spark, v)).toPandas()
    deviation, _, _ = plain(v, 1)
    assert [int(x) for x in out[out.component == 1].sort_values("vec_id").deviation] == deviation


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1, 2, 3]], [[1, 2], [1, 2]]):
        assert whitened_components(frame(spark, vectors)).count() == 0
    assert fit_whitening(frame(spark, [])).n == 0


def test_query(spark):
    from labeltrail.llm.queries import QUERIES

    out = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = v.toPandas()
    deviation, white, _ = plain(np.stack(rows.embedding), 8)
    found = out.toPandas()
    assert found[found.component == 1].set_index("vec_id").deviation.loc[rows.vec_id].tolist() == deviation
    assert np.allclose(np.abs(found[found.component == 3].set_index("vec_id").whitened.loc[rows.vec_id]), np.abs(white[:, 2]), atol=1e-9)
    assert whiten(v, fit_whitening(v), 3).count() == len(rows)
