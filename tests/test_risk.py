"""Risk estimators against NumPy transcriptions of the published formulas."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import covariance as G, mu as M
from tidefolio.session import hand_off

START = dt.datetime(2020, 1, 1)


def returns(spark, x, names=None, step=1):
    names = names or [f"T{k:03d}" for k in range(x.shape[1])]
    rows = [
        (START + dt.timedelta(days=step * t), n, float(x[t, k]))
        for t in range(x.shape[0])
        for k, n in enumerate(names)
        if not np.isnan(x[t, k])
    ]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, ret double")


def matrix(sigma):
    return sigma.toPandas().pivot(index="i", columns="j", values="value").to_numpy()


def vector(mu):
    return mu.toPandas().sort_values("ticker")["mu"].to_numpy()


def oas(x):
    t, n = x.shape
    s = np.cov(x, rowvar=False, ddof=0)
    m = np.trace(s) / n
    a = np.mean(s**2)
    k = min(1.0, (a + m * m) / ((t + 1) * (a - m * m / n)))
    return (1 - k) * s + k * m * np.eye(n)


def ledoit_wolf(x):
    t, n = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / t
    m = np.trace(s) / n
    delta = np.sum((s - m * np.eye(n)) ** 2) / n
    beta = sum(np.sum((np.outer(r, r) - s) ** 2) for r in c) / (n * t * t)
    k = min(beta, delta) / delta
    return (1 - k) * s + k * m * np.eye(n), k


@pytest.fixture(scope="module")
def sample():
    return np.random.default_rng(0).normal(0, 0.01, size=(300, 5))


def test_oas_is_psd_and_matches(spark, sample):
    got = matrix(G.covariance(returns(spark, sample), method="oas", annualize=False))
    assert np.allclose(got, oas(sample), atol=1e-15)
    assert (np.linalg.eigvalsh(got) >= -1e-10).all()


def test_ledoit_wolf(spark, sample):
    want, k = ledoit_wolf(sample)
    got = matrix(G.covariance(returns(spark, sample), method="lw", annualize=False))
    assert 0 <= k <= 1 and np.allclose(got, want, atol=1e-15)


def test_ledoit_wolf_trusts_long_panels():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(4, 4))
    _, short = ledoit_wolf(rng.normal(size=(30, 4)) @ mix)
    _, long = ledoit_wolf(rng.normal(size=(30_000, 4)) @ mix)
    assert long < short / 50


def test_ewma(spark, sample):
    c = sample - sample.mean(axis=0)
    want = np.zeros((5, 5))
    for row in c:
        want = 0.9 * want + 0.1 * np.outer(row, row)
    got = matrix(G.covariance(returns(spark, sample), method="ewma", ewma_lambda=0.9, annualize=False))
    assert np.allclose(got, want, atol=1e-16)


def test_short_panel_falls_back_to_sample(spark, sample):
    short = sample[:20]
    for method in ("oas", "lw", "ewma"):
        full = G.covariance(returns(spark, short), method=method, min_periods=60, annualize=False)
        assert np.allclose(matrix(full.drop("estimator")), np.cov(short, rowvar=False), atol=1e-16)
        assert {r.estimator for r in full.select("estimator").distinct().collect()} == {"sample"}
        own = G.covariance(returns(spark, short), method=method, annualize=False)
        assert "estimator" not in own.columns and not np.allclose(matrix(own), np.cov(short, rowvar=False), atol=1e-16)


def test_single_date_has_zero_covariance(spark, sample):
    assert not matrix(G.covariance(returns(spark, sample[:1]), method="sample", annualize=False)).any()


@pytest.mark.parametrize("dates, names", [(512, 256), (7, 3), (50, 2)])
def test_tiles_of_any_shape(spark, monkeypatch, dates, names):
    monkeypatch.setattr(G, "TILE_DATES", dates)
    monkeypatch.setattr(G, "TILE_NAMES", names)
    x = np.random.default_rng(6).normal(size=(40, 8))
    got = matrix(G.covariance(returns(spark, x), method="sample", annualize=False, store=hand_off))
    assert np.allclose(got, np.cov(x, rowvar=False), atol=1e-14)


@pytest.mark.parametrize("dates, summed", [(512, False), (7, True)])
def test_cells_are_shuffled_only_where_dates_are_dealt_out(spark, monkeypatch, dates, summed):
    monkeypatch.setattr(G, "TILE_DATES", dates)
    x = np.random.default_rng(7).normal(size=(40, 8))
    products = G.cross_products(hand_off(returns(spark, x)).withColumnRenamed("ret", "x"))
    cells = {(r.i, r.j): r.value for r in products.collect()}
    names = sorted({i for i, _ in cells})
    assert np.allclose([cells[i, j] for k, i in enumerate(names) for j in names[k:]], (x.T @ x)[np.triu_indices(8)])
    assert ("sum(_p" in products._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]) == summed


@pytest.mark.parametrize("universes", [False, True])
def test_wide_panels_take_wide_blocks(spark, monkeypatch, universes):
    """The cells are the same, and a date travels once per pair of wide blocks."""
    for name, value in (("TILE_NAMES", 2), ("BLOCK_TILES", 1), ("ENOUGH_BLOCKS", 3), ("MOST_WIDE", 8), ("SIDE_CELLS", 1 << 10)):
        monkeypatch.setattr(G, name, value, raising=False)
    x = np.random.default_rng(8).normal(size=(9, 23))
    panel = returns(spark, x)
    if universes:
        narrow = returns(spark, x[:, :3], names=["a", "b", "c"]).withColumn("universe_id", F.lit("n"))
        panel = panel.withColumn("universe_id", F.lit("w")).unionByName(narrow)
    full = G.covariance(panel, method="sample", annualize=False, store=hand_off)
    if universes:
        assert np.allclose(matrix(full.where("universe_id = 'n'")), np.cov(x[:, :3], rowvar=False), atol=1e-14)
        full = full.where("universe_id = 'w'")
    assert full.count() == 23 * 23 and np.allclose(matrix(full), np.cov(x, rowvar=False), atol=1e-14)

    asked, frame = [], type(panel)
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, f=frame.mapInPandas: asked.append(self) or f(self, *a))
    G.cross_products(hand_off(returns(spark, x)).withColumnRenamed("ret", "x"))
    # 23 names in blocks of 8 are 3, which make 6 pairs; in blocks of 2 they were 12, which made 78.
    assert asked[0].count() == 9 * 6


def test_annual_scaling_follows_the_calendar(spark, sample):
    weekly = matrix(G.covariance(returns(spark, sample, step=7), method="sample"))
    assert np.allclose(weekly, 52 * np.cov(sample, rowvar=False))


def test_drop_and_mean_fill(spark, sample):
    x = sample[:80].copy()
    x[3, 1] = x[10, 4] = np.nan
    r = returns(spark, x)
    full = x[~np.isnan(x).any(axis=1)]
    assert np.allclose(matrix(G.covariance(r, method="sample", annualize=False)), np.cov(full, rowvar=False))
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    got = matrix(G.covariance(r, method="sample", fill="mean", annualize=False))
    assert np.allclose(got, np.cov(filled, rowvar=False))


def test_ema_changes_with_span(spark):
    x = np.random.default_rng(1).normal(0.0005, 0.01, size=(200, 3))
    r = returns(spark, x)
    short, long = vector(M.mu_ema(r, span=20)), vector(M.mu_ema(r, span=100))
    assert not np.allclose(short, long)
    alpha, s = 2 / 21, x[0]
    for row in x[1:]:
        s = alpha * row + (1 - alpha) * s
    assert np.allclose(short, 252 * s)


def test_capm_without_market_variance_is_historical(spark):
    x = np.tile([[0.01, 0.02]], (5, 1))
    r = returns(spark, x)
    assert np.allclose(vector(M.mu_capm(r)), vector(M.mu_historical(r)))


def test_equilibrium_rejects_empty_weights(spark, sample):
    weights = spark.createDataFrame([("T000", 0.0), ("T001", 0.0)], "ticker string, weight double")
    with pytest.raises(Exception, match="positive sum"):
        M.mu_equilibrium(returns(spark, sample), market_weights=weights).collect()


def views(spark, rows):
    return spark.createDataFrame(
        rows, "portfolio_id string, view_id bigint, long string, short string, q double, conf double"
    )


def test_black_litterman(spark, sample):
    r = returns(spark, sample)
    sigma = hand_off(G.covariance(r, method="sample", annualize=False))
    mu = M.mu_historical(r, annualize=False)
    v = views(spark, [("p", 1, "T000", None, 0.02, 0.5), ("p", 2, "T001", "T003", 0.01, 0.9), ("q", 7, "T004", None, 0.0, 2.0)])
    picks = M.bl_views(v, mu)
    got = M.bl_posterior(mu, sigma, picks, tau=0.05).toPandas()
    s, m = np.cov(sample, rowvar=False), sample.mean(axis=0)

    def posterior(p, q, conf):
        base = 0.05 * p @ s @ p.T
        omega = np.diag(np.diag(base) / np.clip(conf, 1e-3, 1))
        return m + 0.05 * s @ p.T @ np.linalg.inv(base + omega) @ (q - p @ m)

    p1 = np.array([[1.0, 0, 0, 0, 0], [0, 1, 0, -1, 0]])
    want = {"p": posterior(p1, np.array([0.02, 0.01]), np.array([0.5, 0.9])), "q": posterior(np.eye(5)[4:], np.zeros(1), np.ones(1))}
    for pid, w in want.items():
        mine = got[got.portfolio_id == pid].sort_values("ticker")
        assert np.allclose(mine["mu_post"], w) and np.allclose(mine["delta"], w - m)


def test_views_without_confidence_stay_at_the_prior(spark, sample):
    r = returns(spark, sample)
    sigma = hand_off(G.covariance(r, method="sample", annualize=False))
    mu = M.mu_historical(r, annualize=False)
    picks = M.bl_views(views(spark, [("p", 1, "T000", None, 0.02, 0.0)]), mu)
    free = M.bl_posterior(mu, sigma, picks, use_conf=False).where("ticker = 'T000'").first()
    tied = M.bl_posterior(mu, sigma, picks).where("ticker = 'T000'").first()
    assert abs(tied.delta) < abs(free.delta) / 100


def test_unknown_view_asset(spark, sample):
    mu = M.mu_historical(returns(spark, sample), annualize=False)
    v = views(spark, [("p", 1, "NOPE", None, 0.02, 0.5)])
    assert [r.ticker for r in M.unknown_view_assets(v, mu).collect()] == ["NOPE"]
    with pytest.raises(Exception, match="not in universe"):
        M.bl_views(v, mu).collect()


def table(spark, a):
    n = len(a)
    rows = [(f"T{i:03d}", f"T{j:03d}", float(a[i, j])) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "i string, j string, value double")


def test_correlation_guards_zero_variance(spark):
    a = np.array([[4.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]])
    got = matrix(G.correlation(table(spark, a)))
    assert np.allclose(got, [[1, 0.5, 0], [0.5, 1, 0], [0, 0, 0]])


def test_psd_clip_and_spectrum(spark):
    a = np.array([[1.0, 2.0, np.nan], [2.0, 1.0, 0.0], [np.nan, 0.0, -1.0]])
    got = matrix(G.psd_clip(table(spark, a), 1e-6))
    assert np.linalg.eigvalsh(got).min() >= 1e-6 - 1e-12 and np.allclose(got, got.T)
    d = G.spectrum_diagnostics(table(spark, np.diag([4.0, 1.0, 0.0]))).first()
    assert d.lambda_max == 4.0 and d.lambda_min == 0.0 and d.condition == 4.0 / 1e-16
    assert abs(d.effective_rank - 25 / 17) < 1e-12
    shares = [r.cumulative for r in G.spectrum(table(spark, np.diag([4.0, 1.0, 0.0]))).orderBy("k").collect()]
    assert np.allclose(shares, [0.8, 1.0, 1.0])


def test_pca_factor_model(spark, sample):
    s = np.cov(sample, rowvar=False)
    lam, vec = np.linalg.eigh(s)
    top = (vec[:, -2:] * lam[-2:]) @ vec[:, -2:].T
    want = top + np.diag(np.diag(s) - np.diag(top))
    assert np.allclose(matrix(G.cov_pca_factor(table(spark, s), 2)), want)


def test_ridge_and_stress(spark):
    a = np.array([[4.0, 1.0], [1.0, 9.0]])
    assert np.allclose(matrix(G.ridge(table(spark, a), 0.5)), a + 0.5 * np.eye(2))
    assert np.allclose(matrix(G.ridge(table(spark, a), -1)), a)
    assert np.allclose(matrix(G.stress_scenario(table(spark, a))), [[5.76, 0.72], [0.72, 12.96]])


def test_universes_stay_apart(spark, sample):
    other = np.random.default_rng(9).normal(size=(70, 2))
    both = returns(spark, sample).withColumn("universe_id", F.lit("a")).unionByName(
        returns(spark, other).withColumn("universe_id", F.lit("b"))
    )
    got = hand_off(G.covariance(both, method="oas", annualize=False))
    assert np.allclose(matrix(got.where("universe_id = 'a'")), oas(sample))
    assert np.allclose(matrix(got.where("universe_id = 'b'")), oas(other))
    mu = M.mu_shrunk(both, annualize=False)
    assert np.allclose(vector(mu.where("universe_id = 'a'")), vector(M.mu_shrunk(returns(spark, sample), annualize=False)))
