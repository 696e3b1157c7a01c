"""Decompositions of wide and signed matrices, labels without a limit."""

import numpy as np
import pytest

from vertexloom.operators import evaluate as E, linalg

from .graphs import by_id


def signed(spark, rows, cols, rank, seed=0):
    """A signed matrix with a few strong directions."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(rows, rank)) * 3.0 ** -np.arange(rank)) @ rng.normal(size=(rank, cols)) + 0.001 * rng.normal(size=(rows, cols)) + rng.normal(size=cols) * 0.1
    return x, spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, features array<double>").repartition(3).cache()


@pytest.mark.parametrize("cols", [8, 5000])
def test_signed_columns_against_numpy(spark, cols):
    x, attrs = signed(spark, 60, cols, 6)
    names = [str(i) for i in range(60)]
    vectors, values = linalg.truncated_svd(attrs, 4)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = by_id(vectors, "vector")
    mat = np.array([got[n] for n in names])
    assert np.allclose(values, s[:4], rtol=1e-8)
    assert np.allclose(mat @ mat.T, (u[:, :4] * s[:4]**2) @ u[:, :4].T, atol=1e-6 * s[0]**2)
    got = by_id(linalg.pca(attrs, 3), "vector")
    mat = np.array([got[n] for n in names])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(mat @ mat.T, (u[:, :3] * s[:3]**2) @ u[:, :3].T, atol=1e-6 * s[0]**2)


def test_signed_cells_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(30, 8))
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(v)) for (i, j), v in np.ndenumerate(x)], "row string, col string, value double")
    _, values = linalg.svd_cells(cells, 3, iterations=8)
    assert np.allclose(values, np.linalg.svd(x)[1][:3], rtol=1e-6)


def test_twenty_thousand_labels(spark):
    rows = [(str(i), [1.0 if i % 2 else -1.0], [f"rare{i}", "odd" if i % 2 else "even"]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, labels array<string>").repartition(4)
    labels = df.select("id", "labels")
    index = E.label_index(labels)
    assert index.count() == 20_002 and index.orderBy("class").first().label == "even"
    lists = E.class_lists(labels, index)
    assert lists.filter("size(classes) <> 2").count() == 0
    weights = np.zeros((2, 20_002))
    weights[0, 0], weights[0, 1] = -5.0, 5.0  # even, odd
    weights[1, 2:] = -20.0
    row = E.f1_scores(E.nc_chosen(df.select("id", "vector").limit(200), lists, weights), "class").first()
    assert row.micro == pytest.approx(0.5, abs=0.01)


def test_flat_spectrum_of_wide_rows(spark, monkeypatch):
    """Singular values that fall slowly: the axes settle to the tolerance, or there is an error."""
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(300, 60)))[0], np.linalg.qr(rng.normal(size=(2000, 60)))[0]
    x = (u * (10 - 0.05 * np.arange(60))) @ v.T
    attrs = spark.createDataFrame([(str(i), row.tolist()) for i, row in enumerate(x)], "id string, features array<double>").repartition(4).cache()
    monkeypatch.setattr(linalg, "GRAM_COLUMNS", 100)
    got, values = linalg.truncated_svd(attrs, 6)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:6], rtol=1e-8)
    rows = by_id(got, "vector")
    mine = np.array([rows[str(i)] for i in range(300)])
    assert np.allclose(np.abs((mine / values).T @ u[:, :6]), np.eye(6), atol=1e-4)
    with pytest.raises(ValueError, match="residual"):
        linalg._wide_axes(attrs, "features", 2000, 6, np.zeros(2000), oversample=0, tolerance=1e-14, passes=2)
