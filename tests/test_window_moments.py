"""Window moments by prefix sums of tiles against NumPy, on panels with holes; risk parity by Newton steps."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import backtest as B, solvers as S, window_moments as M
from tidefolio.operators.covariance import clean_psd

START = dt.datetime(2020, 1, 1)


def panel(spark, x, universe=None):
    rows = [
        (START + dt.timedelta(days=t), f"T{k:03d}", float(x[t, k])) + ((universe,) if universe else ())
        for t in range(x.shape[0]) for k in range(x.shape[1]) if np.isfinite(x[t, k])
    ]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, ret double" + (", universe_id string" if universe else ""))


def plain(window):
    """Pair by pair, as a loop over the dates that have both."""
    n = window.shape[1]
    mu, sigma, seen = np.zeros(n), np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            both = np.isfinite(window[:, i]) & np.isfinite(window[:, j])
            seen[i, j] = both.sum()
            if both.sum() >= 2:
                sigma[i, j] = np.cov(window[both, i], window[both, j])[0, 1]
        if seen[i, i]:
            mu[i] = np.nanmean(window[:, i])
    return mu, sigma, seen


def holed(rng, t, n, share):
    x = rng.normal(0.02, 0.01, (t, n)) + 0.01 * rng.normal(size=(t, 1))
    x[rng.random((t, n)) < share] = np.nan
    x[:, 1][t // 3 : t // 3 + 45] = np.nan  # gone for more than a window
    x[:, 0] = np.where(np.isfinite(x[:, 0]), x[:, 0], 0.0)  # one ticker keeps every date on the calendar
    return x


@pytest.mark.parametrize(("names", "tile", "dates"), [(5, 256, 512), (7, 3, 10)])
def test_moments_equal_numpy_on_panels_with_holes(spark, monkeypatch, names, tile, dates):
    monkeypatch.setattr(M, "TILE_NAMES", tile)
    monkeypatch.setattr(M, "TILE_DATES", dates)
    x = holed(np.random.default_rng(names), 140, names, 0.2)
    returns = panel(spark, x)
    points = B.rebalance_points(returns, "1mo", 40).withColumn("lookback", F.lit(40))
    rows = M.pack_windows(M.window_moments(returns, points)).collect()
    assert len(rows) == points.count() > 2
    for r in rows:
        at = (r.rb_date - START).days
        mu, sigma, seen = M.unpack_window(r.names, r._centres, [v.asDict() for v in r._lines])
        want = plain(x[at - 40 : at])
        assert np.allclose(mu, want[0], atol=1e-13) and np.allclose(sigma, want[1], atol=1e-14) and (seen == want[2]).all()
        local = M.pairwise_moments(x[at - 40 : at])
        assert np.allclose(local[0], want[0], atol=1e-13) and np.allclose(local[1], want[1], atol=1e-14)


def test_universes_do_not_mix(spark):
    rng = np.random.default_rng(2)
    a, b = holed(rng, 100, 3, 0.1), holed(rng, 130, 4, 0.3)
    both = panel(spark, a, "a").unionByName(panel(spark, b, "b"))
    points = B.rebalance_points(both, "1mo", 30).withColumn("lookback", F.lit(30))
    for r in M.pack_windows(M.window_moments(both, points)).collect():
        x, at = {"a": a, "b": b}[r.universe_id], (r.rb_date - START).days
        _, sigma, _ = M.unpack_window(r.names, r._centres, [v.asDict() for v in r._lines])
        assert np.allclose(sigma, plain(x[at - 30 : at])[1], atol=1e-14)


def test_repair_keeps_variances_and_complete_windows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 12))
    whole = M.pairwise_moments(x)
    assert M.repaired(whole[1], whole[2]) is whole[1]
    x[rng.random(x.shape) < 0.5] = np.nan
    _, sigma, seen = M.pairwise_moments(x)
    assert np.linalg.eigvalsh(sigma)[0] < 0
    fixed = M.repaired(sigma, seen)
    sd = np.sqrt(np.diag(fixed))
    assert np.allclose(np.diag(fixed), np.diag(sigma))
    assert np.isclose(np.linalg.eigvalsh(fixed / sd[:, None] / sd[None, :])[0], M.FLOOR)


def test_missing_cells_do_not_make_a_ticker_riskless(spark):
    """One hole, and a ticker without data in a window: the first keeps its risk, the second has no weight."""
    x = np.random.default_rng(5).normal(0, 0.01, (120, 4)) * [1, 2, 3, 1]
    x[70, 2] = np.nan
    x[:62, 3] = np.nan
    for method in ("hrp", "risk_parity", "mv_l2"):
        weights = B.rebalance_weights(panel(spark, x), freq="1mo", lookback=30, allocator=B.solver_allocator(method, gamma=0.0))
        rows = weights.orderBy("rb_date", "ticker").toPandas()
        assert set(rows["status"]) == {"ok"} and (rows["residual"] < 1e-9).all()
        wide = rows.pivot(index="rb_date", columns="ticker", values="weight")
        assert np.allclose(wide.sum(axis=1), 1.0) and (wide["T002"] < wide["T000"] / 2).all()
        assert wide["T003"].iloc[0] == 0.0 and wide["T003"].iloc[-1] > 0.1
        # An equal answer from the same window as an array.
        at = (wide.index[-1].to_pydatetime() - START).days
        assert np.allclose(wide.iloc[-1], B.solver_allocator(method, gamma=0.0)(x[at - 30 : at]), atol=1e-8)


def test_status_tells_what_did_not_settle(spark):
    x = np.random.default_rng(6).normal(0, 0.01, (70, 3))
    returns = panel(spark, x)
    cut = B.rebalance_weights(returns, lookback=30, allocator=B.solver_allocator("mv_l2", gamma=0.0, iters=1))
    assert set(cut.select("status").toPandas()["status"]) == {"not_converged"}
    tight = B.rebalance_weights(returns, lookback=30, allocator=B.solver_allocator("risk_parity", w_max=0.1))
    assert set(tight.select("status").toPandas()["status"]) == {"infeasible"}
    tail = B.rebalance_weights(returns, lookback=30, allocator=B.solver_allocator("cvar", alpha=0.9))
    assert set(tail.select("status").toPandas()["status"]) == {"ok"} and tail.agg(F.max("residual")).first()[0] <= S.GAP


def test_plan_carries_no_window_arrays(spark):
    returns = panel(spark, np.random.default_rng(7).normal(size=(70, 3)))
    plan = B.rebalance_weights(returns, lookback=30, allocator=B.solver_allocator("hrp"))._jdf.queryExecution().toString()
    assert "differences" in plan and "flatten(_w" not in plan


@pytest.mark.parametrize(("n", "dates"), [(3, 50), (25, 13), (300, 400), (1000, 1500)])
def test_risk_parity_by_newton_steps(n, dates):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(dates, n)) * rng.uniform(0.5, 3, n) + rng.normal(size=(dates, 1))
    sigma = clean_psd(np.cov(x, rowvar=False) * 1e-4, 1e-10)
    w, used = S.balanced(sigma)
    shares = w * (sigma @ w)
    assert used < 30 and np.ptp(shares) <= 1e-10 * shares.mean() and np.isclose(w.sum(), 1.0)
    box = [(0.0, 1.0), (0.0, 1.5 / n), (0.5 / n, 1.2 / n), (0.9 / n, 1.0), (0.0, 1.0001 / n)]
    lo, hi = (np.array([[b[k]] for b in box]) for k in (0, 1))
    w, residual = S.boxed_risk(sigma, lo, hi)
    assert (residual <= 1e-10).all() and np.allclose(w.sum(axis=1), 1.0) and (w >= lo - 1e-15).all() and (w <= hi + 1e-15).all()
    for row, (low, high) in zip(w, box):
        shares, inner = row * (sigma @ row), (row > low) & (row < high)
        if inner.any():
            c = shares[inner].mean()
            assert np.allclose(shares[inner], c, rtol=1e-9)
            assert (shares[row >= high] <= c * (1 + 1e-9)).all() and (shares[row <= low] >= c * (1 - 1e-9)).all()


def test_unsettled_newton_falls_back_to_bisection(monkeypatch):
    rng = np.random.default_rng(9)
    sigma = np.cov(rng.normal(size=(60, 6)) * rng.uniform(0.5, 4, 6), rowvar=False)
    lo, hi = np.zeros((1, 1)), np.full((1, 1), 0.2)
    want, _ = S.boxed_risk(sigma, lo, hi)
    steps = S._newton_in_box
    monkeypatch.setattr(S, "_newton_in_box", lambda s, w, c, a, b, limit, budget: (w, c) if budget else steps(s, w, c, a, b, limit, budget))
    got, residual = S.boxed_risk(sigma, lo, hi)
    assert residual[0] <= 1e-9 and np.allclose(got, want, atol=1e-9)
