"""Leading eigenpairs by block Krylov steps over tiles against a dense decomposition."""

import datetime as dt

import numpy as np
import pytest

from tidefolio.operators import covariance as G, leading as L
from tidefolio.session import hand_off

START = dt.datetime(2020, 1, 1)


def panel(spark, x):
    rows = [(START + dt.timedelta(days=t), f"T{k:05d}", float(x[t, k])) for t in range(x.shape[0]) for k in range(x.shape[1])]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, ret double")


def check(spark, x, k, **options):
    found = L.leading_factors(panel(spark, x), k, **options)
    sigma = np.atleast_2d(np.cov(x, rowvar=False))
    want = np.linalg.eigvalsh(sigma)[::-1][:k]
    got = found.eigenvalues.orderBy("k").toPandas()
    assert np.allclose(got["eigenvalue"], want, atol=1e-10 * max(want[0], 1e-300))
    assert np.allclose(got["explained"], want / np.trace(sigma), atol=1e-9)
    v = found.loadings.toPandas().pivot(index="ticker", columns="k", values="loading").to_numpy()
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-9)
    assert np.linalg.norm(sigma @ v - v * got["eigenvalue"].to_numpy(), axis=0).max() <= 1e-8 * want[0]
    specific = found.specific.orderBy("ticker").toPandas()
    common = (v**2 * got["eigenvalue"].to_numpy()).sum(axis=1)
    assert np.allclose(specific["specific"], np.maximum(np.diag(sigma) - common, 1e-12), atol=1e-9 * want[0])
    return found, sigma


@pytest.mark.parametrize(("dates", "names", "tile", "chunk"), [(60, 6, 256, 512), (90, 40, 16, 25), (30, 70, 16, 512)])
def test_equals_a_dense_decomposition(spark, monkeypatch, dates, names, tile, chunk):
    monkeypatch.setattr(L, "TILE_NAMES", tile)
    monkeypatch.setattr(L, "TILE_DATES", chunk)
    rng = np.random.default_rng(names)
    x = rng.normal(size=(dates, names)) * rng.uniform(0.5, 2, names) + rng.normal(size=(dates, 3)) @ rng.normal(size=(3, names))
    check(spark, x * 0.01, 4)


def test_factor_form_is_the_dense_factor_model(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 9)) * 0.01 + rng.normal(size=(50, 2)) @ rng.normal(size=(2, 9)) * 0.02
    found, _ = check(spark, x, 3)
    dense = G.cov_pca_factor(G.covariance(panel(spark, x), method="sample", annualize=False, store=hand_off), 3).toPandas().pivot(index="i", columns="j", values="value")
    v = found.loadings.toPandas().pivot(index="ticker", columns="k", values="loading")
    lam = found.eigenvalues.orderBy("k").toPandas()["eigenvalue"].to_numpy()
    model = (v.to_numpy() * lam) @ v.to_numpy().T + np.diag(found.specific.orderBy("ticker").toPandas()["specific"])
    assert np.allclose(model, dense.to_numpy(), atol=1e-10)


def test_rank_deficient_equal_and_constant_series(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 2)) * 0.01
    x = np.hstack([base[:, :1]] * 3 + [base[:, 1:]] * 2 + [np.zeros((40, 1))])
    got = L.leading_factors(panel(spark, x), 4).eigenvalues.orderBy("k").toPandas()["eigenvalue"].to_numpy()
    want = np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1][: len(got)]
    assert len(got) >= 2 and np.allclose(got, want, atol=1e-12)


def test_one_universe_at_a_time(spark):
    with pytest.raises(ValueError, match="universe"):
        from pyspark.sql import functions as F

        L.leading_factors(panel(spark, np.zeros((3, 2))).withColumn("universe_id", F.lit("u")))
