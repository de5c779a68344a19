"""Projections, solvers and backtests against plain NumPy and known answers."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidefolio.operators import allocate as A, backtest as B, portfolio as P, projection as J, solvers as S, tail_risk as T
from tidefolio.plans.pipelines import data_pipeline, optimise_portfolios, risk_model
from tidefolio.session import hand_off
from test_risk import START, matrix, returns, table


def bisect(v, lo, hi):
    a, b = np.min(v) - hi - 1, np.max(v) - lo + 1
    for _ in range(200):
        t = (a + b) / 2
        a, b = (t, b) if np.clip(v - t, lo, hi).sum() > 1 else (a, t)
    return np.clip(v - (a + b) / 2, lo, hi)


def weights_table(spark, rows):
    return spark.createDataFrame(
        [(p, f"T{k:03d}", float(w)) for p, ws in rows.items() for k, w in enumerate(ws)],
        "portfolio_id string, ticker string, weight double",
    )


def rows_of(df, value="weight"):
    return {p: g.sort_values("ticker")[value].to_numpy() for p, g in df.toPandas().groupby("portfolio_id")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=12), st.floats(0, 0.08), st.floats(0.0, 1.0))
def test_project_rows(values, lo, room):
    v = np.array(values)
    n = len(v)
    hi = max(1.0 / n, lo) + room
    got = S.project_rows(v[None, :], np.full((1, 1), lo), np.full((1, 1), hi))[0]
    assert np.allclose(got, bisect(v, lo, hi), atol=1e-9)


def test_project_box_simplex(spark):
    rng = np.random.default_rng(0)
    raw = {f"p{k}": rng.normal(size=rng.integers(5, 12)) for k in range(40)}
    raw["ties"] = np.zeros(8)
    got = rows_of(J.project_box_simplex(weights_table(spark, raw), 0.02, 0.3))
    for p, v in raw.items():
        assert np.allclose(got[p], bisect(v, 0.02, 0.3), atol=1e-12), p


def test_projection_at_and_beyond_the_edge_of_the_box(spark):
    df = weights_table(spark, {"edge": [3.0, 1.0, 0.0, 2.0], "out": [1.0, 2.0]})
    got = J.project_box_simplex(df, 0.0, 0.25).collect()
    assert all(abs(r.weight - 0.25) < 1e-12 and r.status == "ok" for r in got if r.portfolio_id == "edge")
    assert all(r.weight is None and r.status == "infeasible" for r in got if r.portfolio_id == "out")
    safe = rows_of(J.safe_project(df, 0.0, 0.25))
    assert np.allclose(safe["out"], 0.5)


def test_projection_bounds_per_portfolio(spark):
    raw = {"a": [0.9, 0.1, 0.0], "b": [0.9, 0.1, 0.0]}
    df = weights_table(spark, raw).withColumn("hi", F.when(F.col("portfolio_id") == "a", 0.5).otherwise(0.6))
    got = rows_of(J.project_box_simplex(df, 0.0, "hi"))
    assert np.allclose(got["a"], bisect(np.array(raw["a"]), 0, 0.5)) and np.allclose(got["b"], bisect(np.array(raw["b"]), 0, 0.6))


def test_projection_of_rows_in_small_batches(spark):
    """Portfolios over several batches, keys that are NULL, and weights that are NULL or not finite, in one sort and no window."""
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    raw = {("u", f"p{k}"): rng.normal(size=n).tolist() for k, n in enumerate((1, 2, 3, 30, 8, 64, 65))}
    raw |= {(None, "p0"): [0.9, 0.3, -0.2], ("v", None): [0.4, 0.4], (None, None): [2.0, 0.0, 0.0]}
    odd = {"null": [None, 0.7, 0.1], "all": [None, None], "nan": [nan, 0.2, None], "up": [inf, 0.5, 0.1], "down": [-inf, 0.5, 0.6]}
    rows = [(u, p, k, x) for (u, p), v in [*raw.items(), *((("odd", p), v) for p, v in odd.items())] for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "universe_id string, portfolio_id string, k int, weight double").withColumn("hi", F.lit(1.0))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "4")
    try:
        done = J.project_box_simplex(df, 0.0, "hi", group=("universe_id", "portfolio_id"))
        assert done.columns == ["universe_id", "portfolio_id", "k", "hi", "weight", "status"]
        got = {(r.universe_id, r.portfolio_id, r.k): r.weight for r in done.collect() if r.status == "ok"}
    finally:
        spark.conf.unset(setting)
    assert len(got) == len(rows)
    for (u, p), v in raw.items():
        assert np.allclose([got[u, p, k] for k in range(len(v))], bisect(np.array(v), 0.0, 1.0), atol=1e-12), (u, p)
    # A NULL counts as a weight that never falls from hi and is lo in the end; NaN is the largest number.
    want = {"null": [0, 0, 0], "all": [0, 0], "nan": [1, 1, 0], "up": [1, 0, 0], "down": [0, 0, 0]}
    assert {p: [got["odd", p, k] for k in range(len(v))] for p, v in odd.items()} == want
    assert "Window" not in done._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["te_active", "mean_te", "mv_l2", "min_te"])
def test_smooth_problems_take_few_steps(monkeypatch, method):
    """Bounds and exposures met follow from linear equations; the weights are those of plain steps."""
    rng = np.random.default_rng(5)
    n, rows = 25, 40
    sigma = np.cov(rng.normal(size=(80, n)) * np.geomspace(0.3, 1.5, n), rowvar=False)
    market = S.Market(np.arange(n), sigma, rng.normal(size=n) / 5, exposures=np.kron(np.eye(5), np.ones(5)), lb=-0.05, ub=0.05)
    column = lambda x: np.full((rows, 1), x)
    common = dict(gamma=rng.uniform(0.01, 0.5, (rows, 1)), lam=column(0.0), lo=column(0.0), hi=column(0.2), rho=column(1.0))
    common |= dict(bench=np.tile(rng.dirichlet(np.full(n, 30.0)), (rows, 1)), ref=rng.dirichlet(np.ones(n), rows))
    steps, nearest = [], S.nearest_rows
    monkeypatch.setattr(S, "nearest_rows", lambda z, *a: steps.append(len(z)) or nearest(z, *a))
    w, status, residual = S.optimise(market, method, **common)
    assert set(status) == {"ok"} and residual.max() <= S.RESIDUAL and np.allclose(w.sum(axis=1), 1.0)
    assert w.min() >= 0.0 and w.max() <= 0.2 and sum(steps) <= 70 * rows
    plain, _, _ = S.optimise(market, method, iters=100_000, **common)
    assert np.allclose(w, plain, atol=1e-7)


def test_topk(spark):
    got = rows_of(J.topk_project(weights_table(spark, {"p": [0.4, 0.3, 0.2, 0.1]}), 2))
    assert np.allclose(got["p"], bisect(np.array([0.4, 0.3, 0.0, 0.0]), 0.0, 1.0))
    same = rows_of(J.topk_project(weights_table(spark, {"p": [0.4, 0.3, 0.2, 0.1]}), None))
    assert np.allclose(same["p"], [0.4, 0.3, 0.2, 0.1])


@pytest.fixture(scope="module")
def risk(spark):
    x = np.random.default_rng(7).normal(0.001, 0.02, size=(200, 6)) @ np.diag([1, 1, 1, 2, 2, 3])
    s, m = np.cov(x, rowvar=False), x.mean(axis=0)
    mu = spark.createDataFrame([(f"T{k:03d}", float(v)) for k, v in enumerate(m)], "ticker string, mu double")
    return s, m, table(spark, s), mu


def objective(w, s, m, gamma, b=None, lam=0.0, ref=None):
    v = w if b is None else w - b
    out = 0.5 * v @ s @ v - gamma * m @ v
    return out + (0.5 * lam * np.sum((w - ref) ** 2) if ref is not None else 0.0)


def test_mean_variance_is_optimal(spark, risk):
    s, m, sigma, mu = risk
    problems = spark.createDataFrame([(f"p{k}", g) for k, g in enumerate([0.0, 0.1, 1.0])], "portfolio_id string, gamma double")
    got = rows_of(A.solve(problems, sigma, mu, method="mv_l2", w_max=0.5, part=2))
    rng = np.random.default_rng(0)
    for k, gamma in enumerate([0.0, 0.1, 1.0]):
        w = got[f"p{k}"]
        best = objective(w, s, m, gamma)
        for _ in range(300):
            other = bisect(w + rng.normal(scale=0.1, size=6), 0.0, 0.5)
            assert objective(other, s, m, gamma) >= best - 1e-9


def test_parameters_and_references_are_per_portfolio(spark, risk):
    s, m, sigma, mu = risk
    problems = spark.createDataFrame([("a", 0.0), ("b", 1e6)], "portfolio_id string, lam double")
    ref = weights_table(spark, {"a": [1, 0, 0, 0, 0, 0], "b": [0.1, 0.1, 0.2, 0.2, 0.2, 0.2]})
    got = rows_of(A.solve(problems, sigma, mu, method="mv_l2", ref=ref, gamma=0.0))
    assert np.allclose(got["b"], [0.1, 0.1, 0.2, 0.2, 0.2, 0.2], atol=1e-6)
    assert not np.allclose(got["a"], [1, 0, 0, 0, 0, 0], atol=1e-2)


def test_infeasible_boxes_are_marked(spark, risk):
    _, _, sigma, mu = risk
    problems = spark.createDataFrame([("ok", 0.5), ("bad", 0.1)], "portfolio_id string, w_max double")
    out = A.solve(problems, sigma, mu, method="mv_l2")
    status = {r.portfolio_id: r.status for r in out.select("portfolio_id", "status").distinct().collect()}
    assert status == {"ok": "ok", "bad": "infeasible"}
    assert np.allclose(rows_of(out)["bad"], 1 / 6)


def test_active_methods(spark, risk):
    s, m, sigma, mu = risk
    bench = spark.createDataFrame([(f"T{k:03d}", 1 / 6) for k in range(6)], "ticker string, weight double")
    one = spark.createDataFrame([("p",)], "portfolio_id string")
    least = rows_of(A.solve(one, sigma, method="min_te", bench=bench))["p"]
    assert np.allclose(least, 1 / 6)
    b = np.full(6, 1 / 6)
    te = rows_of(A.solve(one, sigma, mu, method="mean_te", bench=bench, gamma=0.05))["p"]
    same = rows_of(A.solve(one, sigma, mu, method="te_active", bench=bench, gamma=0.05))["p"]
    assert np.allclose(te, same) and objective(te, s, m, 0.05, b) <= objective(b, s, m, 0.05, b)


def test_exposure_bounds(spark, risk):
    _, _, sigma, mu = risk
    bench = spark.createDataFrame([(f"T{k:03d}", 1 / 6) for k in range(6)], "ticker string, weight double")
    x = spark.createDataFrame([("f", f"T{k:03d}", 1.0) for k in range(3)], "factor string, ticker string, exposure double")
    one = spark.createDataFrame([("p", 1.0)], "portfolio_id string, gamma double")
    common = dict(method="te_active", bench=bench)
    free = rows_of(A.solve(one, sigma, mu, **common))["p"]
    tied = rows_of(A.solve(one, sigma, mu, exposures=x, lb=-0.05, ub=0.05, rho=1000.0, **common))["p"]
    assert abs(tied[:3].sum() - 0.5) < 0.051 < abs(free[:3].sum() - 0.5)


def test_group_caps(spark, risk):
    _, _, sigma, _ = risk
    groups = spark.createDataFrame([(f"T{k:03d}", "g" if k < 2 else "h") for k in range(6)], "ticker string, group string")
    caps = spark.createDataFrame([("g", 0.3)], "group string, cap double")
    one = spark.createDataFrame([("p",)], "portfolio_id string")
    ref = weights_table(spark, {"p": [0.5, 0.3, 0.05, 0.05, 0.05, 0.05]})
    w = rows_of(A.solve(one, sigma, method="group_caps", ref=ref, groups=groups, caps=caps))["p"]
    assert w[:2].sum() <= 0.3 + 1e-9 and abs(w.sum() - 1) < 1e-9
    with pytest.raises(ValueError):
        A.solve(one, sigma, method="group_caps")
    with pytest.raises(ValueError):
        A.solve(one, sigma, method="mv_l2", wmax=1.0)


def test_risk_parity(spark, risk):
    s, _, sigma, _ = risk
    problems = spark.createDataFrame([("free", 1.0), ("tight", 0.2)], "portfolio_id string, w_max double")
    got = rows_of(A.solve(problems, sigma, method="risk_parity"))
    rc = got["free"] * (s @ got["free"])
    assert rc.max() / rc.min() < 1 + 1e-9
    assert got["tight"].max() <= 0.2 + 1e-12 and abs(got["tight"].sum() - 1) < 1e-12


def problem_batch(rows=40, n=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.05, (60, n))
    market = S.Market(np.arange(n), np.cov(x, rowvar=False), rng.normal(0, 0.01, n))
    one = lambda v: np.full((rows, 1), float(v))
    ref = rng.dirichlet(np.ones(n), rows)
    return market, ref, one, dict(gamma=rng.uniform(0.01, 1, (rows, 1)), lo=one(0), hi=one(0.3), bench=ref, ref=ref, rho=one(0))


def test_l1_answers_cannot_be_improved_by_exchanges():
    market, ref, one, common = problem_batch()
    lam = 2e-3
    w, status, residual = S.optimise(market, "mv_l1", lam=one(lam), **common)
    assert set(status) == {"ok"} and residual.max() <= S.RESIDUAL

    def loss(v, r):
        return 0.5 * v @ market.sigma @ v - common["gamma"][r, 0] * market.mu @ v + lam * np.abs(v - ref[r]).sum()

    for r in range(len(w)):
        base = loss(w[r], r)
        for i in range(w.shape[1]):
            for j in range(w.shape[1]):
                for d in (1e-2, 1e-3, 1e-4):
                    if i != j and w[r, i] >= d and w[r, j] + d <= 0.3:
                        other = w[r].copy()
                        other[i] -= d
                        other[j] += d
                        assert loss(other, r) >= base - 1e-12


def test_group_caps_give_the_nearest_point_or_say_infeasible():
    market, ref, one, common = problem_batch()
    market.members = np.array([[float(k % 4 == g) for k in range(12)] for g in range(4)])
    market.caps = np.full(4, 0.27)
    w, status, _ = S.optimise(market, "group_caps", lam=one(0), **common)
    assert set(status) == {"ok"} and (w @ market.members.T).max() <= 0.27 + 1e-12
    others = S.nearest_rows(np.random.default_rng(0).dirichlet(np.ones(12), 300), np.zeros((300, 1)), np.full((300, 1), 0.3), market)
    for r in range(len(w)):  # the angle at the nearest point of a convex set is never acute
        assert ((ref[r] - w[r]) * (others - w[r])).sum(axis=1).max() < 1e-12
    market.caps = np.full(4, 0.2)
    assert set(S.optimise(market, "group_caps", lam=one(0), **common)[1]) == {"infeasible"}
    market.members[0] = 1.0
    with pytest.raises(ValueError):
        S.nearest_rows(ref, one(0), one(1), market)


def test_solvers_say_when_a_limit_stops_them():
    market, _, one, common = problem_batch()
    w, status, residual = S.optimise(market, "mean_te", lam=one(0), iters=2, **common)
    assert "not_converged" in set(status) and residual.max() > S.RESIDUAL and np.allclose(w.sum(axis=1), 1)


def test_boxed_risk_parity_meets_its_conditions():
    market, _, one, common = problem_batch(rows=3)
    hi = np.array([[1.0], [0.12], [0.09]])
    w, status, _ = S.optimise(market, "risk_parity", lam=one(0), **{**common, "hi": hi})
    assert set(status) == {"ok"}
    for row, top in zip(w, hi[:, 0]):
        rc = row * (market.sigma @ row)
        free = row < top - 1e-12
        assert abs(row.sum() - 1) < 1e-12 and row.max() <= top + 1e-12
        assert np.ptp(rc[free]) <= 1e-6 * rc[free].mean() and (rc[~free] <= rc[free].mean() * (1 + 1e-6)).all()


def test_a_ticker_that_leaves_is_sold_and_one_that_returns_is_bought(spark):
    rows = [(1, "A", 0.5), (1, "B", 0.5), (2, "A", 1.0), (3, "A", 0.25), (3, "B", 0.75)]
    weights = spark.createDataFrame([(dt.datetime(2024, k, 1), t, w) for k, t, w in rows], "rb_date timestamp_ntz, ticker string, weight double")
    got = {r.rb_date.month: r.turnover for r in B.rebalance_turnover_cost(weights, 10.0).collect()}
    assert got == pytest.approx({1: 0.0, 2: 1.0, 3: 1.5})


def test_unpriced_holdings_are_reported(spark, risk):
    _, _, sigma, mu = risk
    held = spark.createDataFrame([("p", "T000", 0.75), ("p", "X", 0.25), ("q", "X", 1.0)], "portfolio_id string, ticker string, weight double")
    got = {r.portfolio_id: r for r in P.portfolio_stats(held, mu, sigma).collect()}
    assert got["p"].unpriced == 0.25 and got["q"].unpriced == 1.0 and got["q"].sigma_p is None and got["p"].sigma_p > 0
    bench = spark.createDataFrame([("Y", 1.0)], "ticker string, weight double")
    te = {r.portfolio_id: r for r in P.tracking_error(held, bench, sigma, mu).collect()}
    assert te["q"].te is None and te["q"].active_ret is None and te["q"].unpriced == 1.0 and te["p"].te > 0


def test_hrp_of_two_names_is_inverse_variance():
    assert np.allclose(S.hrp(np.diag([1.0, 4.0])), [0.8, 0.2])


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_clusters_keep_blocks_together(linkage):
    d = np.full((6, 6), 1.0)
    for block in ([0, 3, 5], [1, 2, 4]):
        d[np.ix_(block, block)] = 0.1
    np.fill_diagonal(d, 0.0)
    order = S.cluster_order(d, linkage)
    assert {frozenset(order[:3]), frozenset(order[3:])} == {frozenset({0, 3, 5}), frozenset({1, 2, 4})}
    with pytest.raises(ValueError):
        S.cluster_order(d, "median")


def test_leaf_order_has_the_least_sum_of_neighbour_distances():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7):
        points = rng.normal(size=(n, 3))
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        plain, best = S.cluster_order(d, "average", ordered=False), S.cluster_order(d, "average")
        assert sorted(best) == list(range(n))
        length = lambda order: sum(d[a, b] for a, b in zip(order, order[1:]))

        def turned(tree):  # every way of turning the clusters
            if isinstance(tree, int):
                return [[tree]]
            a, b = map(turned, tree)
            return [x + y for x in a for y in b] + [y + x for x in a for y in b]

        trees = {k: (k, [k]) for k in range(n)}
        while len(trees) > 1:
            keys = sorted(trees)
            mean = lambda a, b: np.mean([d[i, j] for i in trees[a][1] for j in trees[b][1]])
            a, b = min(((a, b) for a in keys for b in keys if a < b), key=lambda p: mean(*p))
            other = trees.pop(b)
            trees[a] = ((trees[a][0], other[0]), trees[a][1] + other[1])
        assert np.isclose(length(best), min(map(length, turned(trees[0][0]))))
        assert length(best) <= length(plain) + 1e-12


def greedy_order(d, linkage):
    """The nearest pair of all clusters, again and again; distances from the leaves themselves."""
    square = {"ward": lambda x, y: 2 * len(x) * len(y) / (len(x) + len(y)) * gap(x, y)}
    within = lambda x: (d[np.ix_(x, x)] ** 2).sum() / (2 * len(x) ** 2)
    gap = lambda x, y: (d[np.ix_(x, y)] ** 2).mean() - within(x) - within(y)
    far = {"single": np.min, "complete": np.max, "average": np.mean}
    measure = square.get(linkage) or (lambda x, y: far[linkage](d[np.ix_(x, y)]))
    trees = {k: [k] for k in range(len(d))}
    for merge in range(len(d) - 1):
        a, b = min(((a, b) for a in trees for b in trees if a < b), key=lambda p: measure(trees[p[0]], trees[p[1]]))
        trees[len(d) + merge] = trees.pop(a) + trees.pop(b)
    return next(iter(trees.values()))


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
@pytest.mark.parametrize("n", [1, 2, 3, 9, 25])
def test_clusters_are_those_of_the_nearest_pairs(linkage, n):
    rng = np.random.default_rng(n)
    for _ in range(4):
        points = rng.normal(size=(n, 4))
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        assert S.cluster_order(d, linkage, ordered=False) == greedy_order(d, linkage)


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_equal_distances_still_give_every_leaf_once(linkage):
    for d in (np.zeros((40, 40)), 1.0 - np.eye(40), np.kron(1.0 - np.eye(8), np.ones((5, 5)))):
        assert sorted(S.cluster_order(d, linkage)) == list(range(40)) == sorted(S.cluster_order(d, linkage, ordered=False))


def test_least_sums():
    rng = np.random.default_rng(4)
    for n, k, m in ((1, 1, 1), (3, 5, 7), (40, 700, 300)):
        a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
        assert np.array_equal(S.least_sums(a, b), np.array([(row[:, None] + b).min(axis=0) for row in a]))


def cvar(scenarios, w, alpha):
    loss = np.sort(-(scenarios @ w))[::-1]
    tail = (1 - alpha) * len(loss)
    whole = int(tail + 1e-9)
    return (loss[:whole].sum() + (tail - whole) * (loss[whole] if whole < len(loss) else 0.0)) / tail


@pytest.mark.parametrize("lam", [0.0, 0.002, 1.0])
def test_least_cvar_cannot_be_improved(lam):
    rng = np.random.default_rng(6)
    for t, n in ((40, 5), (83, 12)):
        r, ref = rng.normal(0.002, 0.05, (t, n)), rng.dirichlet(np.ones(n))
        w, gap = S.least_cvar(r, 0.9, lam, ref, 0.0, 0.4)
        assert gap <= S.GAP and abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and w.max() <= 0.4 + 1e-12
        loss = lambda v: cvar(r, v, 0.9) + lam * np.abs(v - ref).sum()
        for _ in range(300):  # convex: no direction into the set goes down
            other = S.project_rows(rng.dirichlet(np.ones(n))[None, :], np.zeros((1, 1)), np.full((1, 1), 0.4))[0]
            assert loss(0.999 * w + 0.001 * other) >= loss(w) - 1e-8


def test_cvar_minimise_of_many_problems(spark):
    x = np.random.default_rng(8).normal(0.001, 0.02, size=(60, 4))
    problems = spark.createDataFrame([(f"p{k}", 0.3 + 0.1 * (k % 3)) for k in range(20)] + [("none", 0.1)], "portfolio_id string, w_max double")
    out = T.cvar_minimise(problems, returns(spark, x), alpha=0.9)
    got, status = rows_of(out), {r.portfolio_id: r.status for r in out.select("portfolio_id", "status").distinct().collect()}
    assert status.pop("none") == "infeasible" and set(status.values()) == {"ok"} and np.allclose(got["none"], 0.25)
    for k in range(20):
        want, _ = S.least_cvar(x, 0.9, 0.0, np.full(4, 0.25), 0.0, 0.3 + 0.1 * (k % 3))
        assert np.isclose(cvar(x, got[f"p{k}"], 0.9), cvar(x, want, 0.9), atol=1e-8)
    with pytest.raises(ValueError):
        T.cvar_minimise(problems, returns(spark, x), gamma=1.0)


def test_closed_forms(spark, risk):
    s, m, sigma, mu = risk
    inv = np.linalg.inv(s)
    w = A.markowitz_closed_form(mu, sigma, rf=0.0001).toPandas().sort_values("ticker")
    gmv = inv @ np.ones(6) / inv.sum()
    tan = inv @ (m - 0.0001) / (inv @ (m - 0.0001)).sum()
    assert np.allclose(w["w_gmv"], gmv) and np.allclose(w["w_tan"], tan)
    pts = A.frontier_closed_form(mu, sigma, -0.01, 0.01, npts=5).orderBy("point").toPandas()
    a, b, c = inv.sum(), (inv @ m).sum(), m @ inv @ m
    for r, risk_ in zip(np.linspace(-0.01, 0.01, 5), pts["risk"]):
        v = (c - b * r) / (a * c - b * b) * (inv @ np.ones(6)) + (a * r - b) / (a * c - b * b) * (inv @ m)
        assert abs(risk_ - np.sqrt(v @ s @ v)) < 1e-9


def test_frontier_of_equal_means_is_one_point(spark, risk):
    s, _, sigma, _ = risk
    flat = spark.createDataFrame([(f"T{k:03d}", 0.0) for k in range(6)], "ticker string, mu double")
    pts = A.frontier_closed_form(flat, sigma, npts=10).collect()
    assert len(pts) == 1 and abs(pts[0].risk - np.sqrt(1 / np.linalg.inv(s).sum())) < 1e-9


def test_frontier_box_points(spark, risk):
    s, m, sigma, mu = risk
    got = A.frontier_box(mu, sigma, 0.0, 0.4, npts=7).orderBy("point").toPandas()
    inv = np.linalg.inv(s)
    a, b, c = inv.sum(), (inv @ m).sum(), m @ inv @ m
    for r, row in zip(np.linspace(m.min(), m.max(), 7), got.itertuples()):
        v = (c - b * r) / (a * c - b * b) * (inv @ np.ones(6)) + (a * r - b) / (a * c - b * b) * (inv @ m)
        w = bisect(v, 0.0, 0.4)
        assert abs(row.ret - w @ m) < 1e-9 and abs(row.risk - np.sqrt(w @ s @ w)) < 1e-9


def test_benchmarks_and_turnover(spark):
    universe = spark.createDataFrame([("T000",), ("T001",), ("T002",)], "ticker string")
    custom = spark.createDataFrame([("T000", 2.0), ("T001", float("nan"))], "ticker string, weight double")
    got = {r.ticker: r.weight for r in P.benchmark_weights(universe, custom).collect()}
    assert got == {"T000": 1.0, "T001": 0.0, "T002": 0.0}
    zero = spark.createDataFrame([("T000", 0.0)], "ticker string, weight double")
    assert {round(r.weight, 12) for r in P.benchmark_weights(universe, zero).collect()} == {round(1 / 3, 12)}
    held = weights_table(spark, {"p": [0.5, 0.5]})
    t = P.turnover(held, P.benchmark_weights(universe), lam=2.0).first()
    v = np.array([0.5, 0.5, 0]) - 1 / 3
    assert abs(t.l1 - np.abs(v).sum()) < 1e-12 and abs(t.l2 - np.sqrt(v @ v)) < 1e-12 and abs(t.l2_penalty - v @ v) < 1e-12


def test_portfolio_with_unpriced_ticker(spark, risk):
    s, m, sigma, mu = risk
    held = spark.createDataFrame([("p", "T000", 0.5), ("p", "ghost", 0.5)], "portfolio_id string, ticker string, weight double")
    got = P.portfolio_stats(held, mu, sigma).first()
    assert abs(got.mu_p - 0.5 * m[0]) < 1e-12 and abs(got.sigma_p - 0.5 * np.sqrt(s[0, 0])) < 1e-12


def simple_backtest(x, dates, lookback, allocate, bps):
    """Day-by-day reference run in NumPy."""
    n = x.shape[1]
    keys = [(d - dt.timedelta(microseconds=1)).strftime("%Y-%m") for d in dates]
    last = {k: i for i, k in enumerate(keys)}
    w, eq, equity, moved = np.full(n, 1 / n), 1.0, [], []
    for i in range(lookback, len(dates)):
        cost = 0.0
        if last[keys[i]] == i:
            new = allocate(x[i - lookback : i])
            new = new / new.sum()
            moved.append(np.abs(new - w).sum())
            cost, w = moved[-1] * bps / 1e4, new
        eq *= 1 + np.nansum(w * x[i]) - cost
        equity.append(eq)
    return np.array(equity), np.array(moved)


@pytest.mark.parametrize("name", ["inverse_variance", "hrp", "mv_l2"])
def test_backtest(spark, name):
    x = np.random.default_rng(11).normal(0, 0.01, size=(150, 4)) * [1, 2, 3, 1]
    x[100, 2] = np.nan
    dates = [START + dt.timedelta(days=k) for k in range(150)]
    if name == "inverse_variance":
        ours, theirs = name, lambda w: 1 / np.nanvar(w, axis=0, ddof=1)
    else:
        ours = B.solver_allocator(name, w_max=0.6)
        theirs = B.solver_allocator(name, w_max=0.6)
    run = B.backtest(returns(spark, x), lookback=40, rebalance_freq="1mo", cost_bps=5.0, allocator=ours, store=hand_off)
    equity, moved = simple_backtest(x, dates, 40, theirs, 5.0)
    got = run.equity.orderBy("date").toPandas()
    assert np.allclose(got["equity"], equity, atol=1e-10)
    assert np.allclose(run.turnover.orderBy("rb_date").toPandas()["turnover"], moved, atol=1e-10)
    assert (got["drawdown"] <= 0).all()


def test_solver_allocators_take_benchmark_exposures_and_tail_risk():
    x = np.random.default_rng(4).normal(0.001, 0.03, (60, 4))
    names, bench = np.array(["a", "b", "c", "d"], dtype=object), np.array([0.4, 0.3, 0.2, 0.1])
    held = B.solver_allocator("te_active", gamma=0.0, lam=1.0)(x, B.Inputs(names, bench))
    assert np.allclose(held, bench, atol=1e-9)
    factor = np.array([[1.0, 1.0, 0.0, 0.0]])
    tied = B.solver_allocator("te_active", gamma=5.0, lb=-0.01, ub=0.01, rho=1e4)(x, B.Inputs(names, bench, factor))
    free = B.solver_allocator("te_active", gamma=5.0)(x, B.Inputs(names, bench))
    assert abs((tied - bench) @ factor[0]) < 0.011 < abs((free - bench) @ factor[0])
    tail = B.solver_allocator("cvar", alpha=0.9, w_max=0.5)(x)
    assert np.isclose(cvar(x, tail, 0.9), cvar(x, S.least_cvar(x, 0.9, 0.0, np.full(4, 0.25), 0.0, 0.5)[0], 0.9))


def test_backtest_rejects_unknown_allocator(spark):
    with pytest.raises(ValueError):
        B.rebalance_weights(returns(spark, np.zeros((3, 2))), allocator="magic")


@pytest.mark.parametrize(
    "options",
    [
        dict(mu_method="historical", cov_method="sample"),
        dict(mu_method="ema", cov_method="ewma"),
        dict(mu_method="shrunk", shrink_target="rf", rf_annual=0.02, cov_method="lw", psd=True),
        dict(mu_method="capm"),
        dict(mu_method="black-litterman", ridge_eps=1e-4, stress=True),
        dict(cov_method="pca", n_factors=2, fill="mean"),
    ],
)
def test_risk_model_options(spark, options):
    x = np.random.default_rng(12).normal(0.001, 0.02, size=(90, 4))
    model = risk_model(returns(spark, x), store=hand_off, **options)
    a = matrix(model.sigma)
    assert a.shape == (4, 4) and np.allclose(a, a.T) and (np.linalg.eigvalsh(a) > 0).all()
    assert model.mu.count() == 4 and model.diagnostics.first().per_year == 252
    assert model.fill_report.count() == 4


def test_prices_to_weights(spark):
    rng = np.random.default_rng(13)
    steps = np.exp(np.cumsum(rng.normal(0, 0.01, size=(400, 3)), axis=0))
    rows = [(START + dt.timedelta(days=t), f"T{k:03d}", float(steps[t, k])) for t in range(400) for k in range(3)]
    rows.append((START, "lonely", 1.0))
    prices = spark.createDataFrame(rows, "date timestamp_ntz, ticker string, price double")
    run = data_pipeline(prices, freq_prices="1d", store=hand_off)
    assert [r.ticker for r in run.dropped.collect()] == ["lonely"]
    assert run.returns.select("ticker").distinct().count() == 3 and run.stats.count() == 3
    assert len(run.meta.first().fingerprint) == 16
    model = risk_model(run.returns.select("date", "ticker", "ret"), store=hand_off)
    one = spark.createDataFrame([("p", 0.1)], "portfolio_id string, gamma double")
    w = rows_of(optimise_portfolios(one, model, w_max=0.6, store=hand_off))["p"]
    assert abs(w.sum() - 1) < 1e-12 and w.max() <= 0.6 + 1e-9


def test_portfolios_meet_only_their_universe(spark):
    """Two universes share tickers and portfolio names; each portfolio has its own matrix and means."""
    sigma = spark.createDataFrame(
        [("u", "a", "a", 1.0), ("v", "a", "a", 4.0), ("v", "b", "b", 9.0), ("v", "a", "b", 0.0), ("v", "b", "a", 0.0)],
        "universe_id string, i string, j string, value double",
    )
    mu = spark.createDataFrame([("u", "a", 0.1), ("v", "a", 0.2), ("v", "b", 0.3)], "universe_id string, ticker string, mu double")
    held = spark.createDataFrame([("u", "p", "a", 1.0), ("v", "p", "a", 1.0), ("v", "q", "b", 1.0)], "universe_id string, portfolio_id string, ticker string, weight double")
    got = {(r.universe_id, r.portfolio_id): (r.mu_p, r.sigma_p) for r in P.portfolio_stats(held, mu, sigma).collect()}
    assert got == {("u", "p"): (0.1, 1.0), ("v", "p"): (0.2, 2.0), ("v", "q"): (0.3, 3.0)}
    bench = spark.createDataFrame([("u", "a", 1.0), ("v", "b", 1.0)], "universe_id string, ticker string, weight double")
    te = {(r.universe_id, r.portfolio_id): r.te for r in P.tracking_error(held, bench, sigma, mu).collect()}
    assert te[("u", "p")] == 0.0 and te[("v", "q")] == 0.0 and np.isclose(te[("v", "p")], np.sqrt(13.0))
    shares = {(r.universe_id, r.portfolio_id): r.rc for r in P.risk_contributions(held, sigma, normalize=True).collect()}
    assert shares == {("u", "p"): 1.0, ("v", "p"): 1.0, ("v", "q"): 1.0}
    moved = {(r.universe_id, r.portfolio_id): r.l1 for r in P.turnover(held, bench).collect()}
    assert moved == {("u", "p"): 0.0, ("v", "p"): 2.0, ("v", "q"): 0.0}
    both = P.te_objective(held, bench, sigma, mu, gamma=1.0).collect()
    assert len(both) == 3 and {r.universe_id for r in both} == {"u", "v"}
    with pytest.raises(ValueError, match="universe"):
        P.portfolio_stats(held.drop("universe_id"), mu, sigma)


def test_shared_benchmark_equals_one_per_portfolio(spark):
    rng = np.random.default_rng(8)
    names = [f"t{k}" for k in range(9)]
    rows = [(u, p, names[k], float(rng.normal())) for u in "uv" for p in "pq" for k in rng.choice(9, 4, replace=False)]
    rows += [("u", "all", n, 1 / 9) for n in names] + [("w", "p", "t0", 1.0), ("u", "p", "ghost", 0.5), ("u", "p", "t1", 0.25)]
    held = spark.createDataFrame(rows, "universe_id string, portfolio_id string, ticker string, weight double")
    bench = spark.createDataFrame([(u, n, 1 / 9) for u in "uv" for n in names], "universe_id string, ticker string, weight double")
    apart = held.select("universe_id", "portfolio_id").distinct().join(bench, "universe_id")
    x = spark.createDataFrame([(f, n, float(rng.normal())) for f in ("f", "g") for n in names[:6]], "factor string, ticker string, exposure double")

    def values(df, *keys):
        return {tuple(r[k] for k in keys): [v for c, v in sorted(r.asDict().items()) if c not in keys] for r in df.collect()}

    who = ("universe_id", "portfolio_id")
    for a, b in (
        (values(P.turnover(held, bench, 0.5), *who), values(P.turnover(held, apart, 0.5), *who)),
        (values(P.active_exposure(held, bench, x, -0.1, 0.1), *who, "factor"), values(P.active_exposure(held, apart, x, -0.1, 0.1), *who, "factor")),
    ):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)
    assert values(P.turnover(held, bench), *who)[("u", "all")][:2] == [0.0, 0.0]
    assert P.turnover(held, bench.limit(0)).count() == 6 and P.turnover(held.limit(0), bench).count() == 0
    plan = P.turnover(held, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("block, keys", [(512, 1 << 13), (3, 2)])
def test_portfolio_series_in_blocks(spark, monkeypatch, block, keys):
    """Blocks of portfolios and parts of dates give what a join of all rows gives, with NULL, NaN, infinite and repeated ones."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "PART_KEYS", keys)
    rng = np.random.default_rng(9)
    held = [(f"p{k}", f"t{n}", float(rng.normal())) for k in range(10) for n in rng.choice(6, 3, replace=False)]
    held += [("p0", "t0", 0.5), ("p1", "t1", None), ("odd", "t2", None), ("odd", None, 1.0), ("far", "ghost", 1.0), ("inf", "t5", float("inf"))]
    days = [START + dt.timedelta(days=k) for k in range(7)]
    rets = [(d, f"t{n}", float(rng.normal())) for d in days for n in range(6) if (d.day + n) % 4]
    rets += [(days[0], "t0", None), (days[1], "t1", float("nan")), (days[2], "t3", 0.25), (days[3], None, 1.0)]
    w = hand_off(spark.createDataFrame(held, "portfolio_id string, ticker string, weight double"))
    r = hand_off(spark.createDataFrame(rets, "date timestamp_ntz, ticker string, ret double"))
    bench = spark.createDataFrame([(f"t{n}", 1 / 5) for n in range(5)], "ticker string, weight double")

    def joined(weights):
        product = F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0)))
        return weights.join(r, "ticker").groupBy("portfolio_id", "date").agg(product.alias("ret"))

    def values(df, key, value):
        return {(x["portfolio_id"], x[key] if key else None): x[value] for x in df.collect()}

    def same(a, b):
        # One number as text: NaN is a value of its own.
        text = lambda v: None if v is None else "nan" if v != v else f"{v:.9g}"
        assert {k: text(v) for k, v in a.items()} == {k: text(v) for k, v in b.items()} and a

    out = P.portfolio_returns(w, r)
    same(values(out, "date", "ret"), values(joined(w), "date", "ret"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    active = P.active_weights(w, bench).select("portfolio_id", "ticker", F.col("active").alias("weight"))
    te = joined(active).groupBy("portfolio_id").agg(F.stddev_samp("ret").alias("te"))
    same(values(P.tracking_error_from_returns(w, bench, r), None, "te"), values(te, None, "te"))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.booleans(), st.integers(1, 30))
def test_newton_shift_equals_the_walk(seed, l1, n):
    rng = np.random.default_rng(seed)
    z, ref = rng.normal(size=(2, 20, n))
    lo, hi = np.zeros((20, n)), np.full((20, n), max(0.2, 1.5 / n))
    t = np.full((20, 1), 0.1 if l1 else 0.0)
    want = S._walked(z, ref, t, lo, hi, np.ones((20, 1)))
    assert np.allclose(S._shifted(z, ref, t, lo, hi, np.ones((20, 1))), want, atol=1e-12)
    found, left = S._by_newton(z, ref, t, lo, hi, np.ones((20, 1)))
    assert np.allclose(found[~left], want[~left], atol=1e-12)
