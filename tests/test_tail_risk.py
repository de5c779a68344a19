"""Least CVaR by cutting planes on the tail against the dense program, over universes, dates and options."""

import datetime as dt

import numpy as np
import pytest

from tidefolio.operators import solvers as S, tail_risk as T

START = dt.datetime(2000, 1, 1)


def cvar(x, w, alpha):
    loss = np.sort(-x @ w)[::-1]
    tail = (1 - alpha) * len(loss)
    whole = int(tail + 1e-9)
    return (loss[:whole].sum() + (tail - whole) * loss[min(whole, len(loss) - 1)]) / tail


def panel(spark, x, universe=None):
    rows = [
        (START + dt.timedelta(days=t), f"T{k:03d}", float(x[t, k])) + ((universe,) if universe else ())
        for t in range(x.shape[0]) for k in range(x.shape[1]) if np.isfinite(x[t, k])
    ]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, ret double" + (", universe_id string" if universe else ""))


def weights(out, *keys):
    got = {}
    for r in out.orderBy("ticker").collect():
        got.setdefault(tuple(r[k] for k in keys), []).append(r.weight)
    return {k: np.array(v) for k, v in got.items()}


def test_many_dates_with_holes_equal_the_dense_program(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_t(4, (700, 8)) * 0.02 + 0.01 * rng.normal(size=(700, 1))
    x[rng.random(x.shape) < 0.1] = np.nan  # a missing return earns 0
    x[:, 0] = np.nan_to_num(x[:, 0])
    full, ref = np.nan_to_num(x), rng.dirichlet(np.ones(8))
    problems = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.001, 0.4), ("c", 5.0, 0.6), ("c", 5.0, 0.6)], "portfolio_id string, lam double, w_max double")
    bench = spark.createDataFrame([(f"T{k:03d}", float(v)) for k, v in enumerate(ref)], "ticker string, weight double")
    out = T.cvar_minimise(problems.distinct(), panel(spark, x), alpha=0.95, ref=bench)
    rows = out.collect()
    assert {r.status for r in rows} == {"ok"} and max(r.residual for r in rows) <= S.GAP
    got = weights(out, "portfolio_id")
    for name, lam, cap in (("a", 0.0, 1.0), ("b", 0.001, 0.4), ("c", 5.0, 0.6)):
        want, _ = S.least_cvar(full, 0.95, lam, ref, 0.0, cap)
        score = lambda w: cvar(full, w, 0.95) + lam * np.abs(w - ref).sum()
        w = got[(name,)]
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-12 and w.max() <= cap + 1e-12
        assert score(w) <= score(want) + 1e-7
    assert np.allclose(got[("c",)], np.clip(ref, 0, 0.6), atol=1e-8) or ref.max() > 0.6


def test_universes_and_portfolios_with_their_own_references(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0.001, 0.02, (90, 3)), rng.normal(0, 0.03, (600, 5))
    both = panel(spark, x, "x").unionByName(panel(spark, y, "y"))
    problems = spark.createDataFrame([("x", "p"), ("y", "p"), ("y", "q")], "universe_id string, portfolio_id string")
    ref = spark.createDataFrame([("p", "T000", 1.0), ("q", "T001", 0.5), ("q", "T002", 0.5), ("q", "gone", 1.0)], "portfolio_id string, ticker string, weight double")
    got = weights(T.cvar_minimise(problems, both, alpha=0.9, ref=ref, lam=0.002), "universe_id", "portfolio_id")
    for universe, data, name, own in (("x", x, "p", [1, 0, 0]), ("y", y, "p", [1, 0, 0, 0, 0]), ("y", y, "q", [0, 0.5, 0.5, 0, 0])):
        want, _ = S.least_cvar(data, 0.9, 0.002, np.array(own, float), 0.0, 1.0)
        score = lambda w: cvar(data, w, 0.9) + 0.002 * np.abs(w - np.array(own)).sum()
        assert score(got[universe, name]) <= score(want) + 1e-7


def test_few_rounds_infeasible_boxes_single_tickers_and_nothing(spark):
    x = np.random.default_rng(3).normal(0, 0.02, (200, 6))
    problems = spark.createDataFrame([("a", 1.0), ("tight", 0.1)], "portfolio_id string, w_max double")
    out = T.cvar_minimise(problems, panel(spark, x), alpha=0.9, rounds=1)
    assert {(r.portfolio_id, r.status) for r in out.collect()} == {("a", "not_converged"), ("tight", "infeasible")}
    assert np.allclose(weights(out, "portfolio_id")[("tight",)], 1 / 6)
    one = T.cvar_minimise(problems.where("w_max = 1"), panel(spark, x[:, :1]), alpha=0.9)
    assert [(r.weight, r.status) for r in one.collect()] == [(1.0, "ok")]
    assert T.cvar_minimise(problems.limit(0), panel(spark, x)).collect() == []
    assert T.cvar_minimise(problems, panel(spark, x).limit(0)).collect() == []


def test_short_positions(spark):
    x = np.random.default_rng(4).normal(0.001, 0.02, (150, 4))
    got = weights(T.cvar_minimise(spark.createDataFrame([("a",)], "portfolio_id string"), panel(spark, x), alpha=0.9, w_min=-0.5), "portfolio_id")
    want, _ = S.least_cvar(x, 0.9, 0.0, np.full(4, 0.25), -0.5, 1.0)
    assert cvar(x, got[("a",)], 0.9) <= cvar(x, want, 0.9) + 1e-8


@pytest.mark.parametrize("lam", [0.0, 0.01])
def test_master_program_bounds_every_answer(lam):
    rng = np.random.default_rng(5)
    x, ref = rng.normal(0, 1, (80, 5)), np.full(5, 0.2)
    share, cuts = 1 / (0.1 * 80), []
    for _ in range(20):
        w, v = rng.dirichlet(np.ones(5)), rng.normal()
        for b in range(4):
            value, *slopes = S.tail_cuts(x[np.arange(80) % 4 == b], w, v, share)
            if slopes[0] > 0:
                cuts.append([b, *slopes])
                assert np.isclose(value, np.array(slopes[1:]) @ w - slopes[0] * v)
    _, _, bound = S.tail_master(np.array(cuts), 4, lam, ref, 0.0, 1.0, -20.0)
    for _ in range(200):
        w = rng.dirichlet(np.ones(5))
        assert cvar(x, w, 0.9) + lam * np.abs(w - ref).sum() >= bound - 1e-9
