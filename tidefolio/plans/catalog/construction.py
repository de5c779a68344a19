"""Queries for portfolio construction.

Solvers have no SQL form; each query returns a certificate per problem (sum, box, caps, optimality) that the
comparison SQL predicts from the tables alone. Optimality is checked natively: at an optimum, a projected gradient
step does not move the weights.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ...operators import allocate as A, covariance as G, mu as M, panel, portfolio as P, projection as J
from ...operators.tail_risk import cvar_minimise as cvar_least
from ...session import hand_off
from .. import derive as D
from ..pipelines import data_pipeline, optimise_portfolios, risk_model
from ..registry import query, sql, tidy
from . import ctes as C
from .market import SUMMARY
from .portfolios import benchmark, holdings, risk_inputs
from .risk import brand_panel, brand_sigma

GAMMA = 1.0
BOX = (0.0, 0.2)


def _customers(spark, d):
    """One problem per customer, each with its own trade-off (from its account balance) and its holdings as reference."""
    customers = D.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("portfolio_id"), (0.01 + F.abs("c_acctbal") / 20000.0).alias("gamma")
    )
    held = holdings(spark, d)
    return customers.join(held.select("portfolio_id").distinct(), "portfolio_id", "left_semi"), held


CERTIFICATE = sql(
    [C.HOLD],
    """SELECT DISTINCT portfolio_id, 1.0 AS total, TRUE AS in_box, TRUE AS optimal,
              (SELECT count(DISTINCT p_brand) FROM part JOIN lineitem ON l_partkey = p_partkey) AS n FROM hold""",
    floats=["total"], ints=["n"], plain=["portfolio_id", "in_box", "optimal"],
)


def _certificate(weights, gradient, lo, hi, step=1.0, tol=1e-5):
    """Sum, box and fixed-point check per portfolio. ``gradient`` has (portfolio_id, ticker, grad)."""
    weights = hand_off(weights, "weights")
    moved = weights.join(gradient(weights), ["portfolio_id", "ticker"]).select(
        "portfolio_id", "ticker", F.col("weight").alias("w"), (F.col("weight") - step * F.col("grad")).alias("weight")
    )
    again = J.project_box_simplex(moved, lo, hi)
    w = F.col("w")
    return tidy(
        again.groupBy("portfolio_id").agg(
            F.sum(w).alias("total"),
            ((F.min(w) >= lo - 1e-9) & (F.max(w) <= hi + 1e-9)).alias("in_box"),
            (F.max(F.abs(w - F.col("weight"))) < tol).alias("optimal"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _quadratic_gradient(sigma, mu, problems, *, bench=None, lam=0.0, ref=None):
    """Sigma (w - b) - gamma mu + lam (w - ref), by joins."""

    def gradient(weights):
        w = weights.select("portfolio_id", "ticker", "weight")
        base = w if bench is None else P.active_weights(w, bench).select(
            "portfolio_id", "ticker", F.col("active").alias("weight")
        )
        g = P.sigma_times(base, sigma, portfolios=w).join(mu.select("ticker", "mu"), "ticker").join(problems, "portfolio_id")
        grad = F.col("_sw") - F.col("gamma") * F.col("mu")
        if ref is not None:
            away = P.active_weights(w, ref).select("portfolio_id", "ticker", F.col("active").alias("_away"))
            g = g.join(away, ["portfolio_id", "ticker"])
            grad = grad + lam * F.col("_away")
        return g.select("portfolio_id", "ticker", grad.alias("grad"))

    return gradient


@query("mv_l2", CERTIFICATE)
def mv_l2(spark, d):
    _, mu, sigma = risk_inputs(spark, d)
    mu = hand_off(mu, "mu")
    problems, held = _customers(spark, d)
    problems = hand_off(problems, "problems")
    w = A.solve(problems, sigma, mu, method="mv_l2", ref=held, lam=0.05, w_max=BOX[1])
    return _certificate(w, _quadratic_gradient(sigma, mu, problems, lam=0.05, ref=held), *BOX)


@query("mean_te", CERTIFICATE)
def mean_te(spark, d):
    _, mu, sigma = risk_inputs(spark, d)
    mu, bench = hand_off(mu, "mu"), benchmark(spark, d)
    problems = hand_off(_customers(spark, d)[0], "problems")
    w = A.solve(problems, sigma, mu, method="mean_te", bench=bench, w_max=BOX[1])
    return _certificate(w, _quadratic_gradient(sigma, mu, problems, bench=bench), *BOX)


@query("te_active", CERTIFICATE)
def te_active(spark, d):
    _, mu, sigma = risk_inputs(spark, d)
    mu, bench = hand_off(mu, "mu"), benchmark(spark, d)
    problems = hand_off(_customers(spark, d)[0], "problems")
    w = A.solve(problems, sigma, mu, method="te_active", bench=bench, lam=0.05, w_max=BOX[1])
    return _certificate(w, _quadratic_gradient(sigma, mu, problems, bench=bench, lam=0.05, ref=bench), *BOX)


@query("te_active_bounded", CERTIFICATE)
def te_active_bounded(spark, d):
    """Exposures outside the bounds cost rho times half their squared excess: the gradient has that part too."""
    _, mu, sigma = risk_inputs(spark, d)
    mu, bench = hand_off(mu, "mu"), benchmark(spark, d)
    problems = hand_off(_customers(spark, d)[0], "problems")
    x = hand_off(panel.onehot_exposure(bench, D.brand_meta(spark, d)), "exposures")
    lb, ub, rho = -0.05, 0.05, 1.0
    w = A.solve(problems, sigma, mu, method="te_active", bench=bench, w_max=BOX[1], exposures=x, lb=lb, ub=ub, rho=rho)
    plain = _quadratic_gradient(sigma, mu, problems, bench=bench)

    def gradient(weights):
        held = weights.select("portfolio_id", "ticker", "weight")
        outside = P.active_exposure(held, bench, x, lb, ub).select("portfolio_id", "factor", (F.col("above") - F.col("below")).alias("_out"))
        # What lies inside the bounds pushes nothing.
        push = outside.where("_out <> 0").join(x, "factor").groupBy("portfolio_id", "ticker").agg(F.sum(rho * F.col("_out") * F.col("exposure")).alias("_push"))
        both = plain(weights).join(push, ["portfolio_id", "ticker"], "left")
        return both.select("portfolio_id", "ticker", (F.col("grad") + F.coalesce("_push", F.lit(0.0))).alias("grad"))

    return _certificate(w, gradient, *BOX)


@query("mv_l1", CERTIFICATE)
def mv_l1(spark, d):
    """Moderate turnover costs against the holdings: no exchange between two tickers lowers the objective.

    A weight may rise at the right derivative and fall at the left one; the penalty makes them differ at the reference.
    """
    lam, edge, tol = 0.002, 1e-7, 1e-6
    _, mu, sigma = risk_inputs(spark, d)
    mu = hand_off(mu, "mu")
    problems, held = _customers(spark, d)
    problems = hand_off(problems, "problems")
    w = hand_off(A.solve(problems, sigma, mu, method="mv_l1", ref=held, lam=lam, w_max=BOX[1]), "weights")
    away = P.active_weights(w.select("portfolio_id", "ticker", "weight"), held).select("portfolio_id", "ticker", F.col("active").alias("away"))
    rows = w.join(_quadratic_gradient(sigma, mu, problems)(w), ["portfolio_id", "ticker"]).join(away, ["portfolio_id", "ticker"])
    weight, grad = F.col("weight"), F.col("grad")
    rise = grad + F.when(F.col("away") > -edge, lam).otherwise(-lam)
    fall = grad + F.when(F.col("away") > edge, lam).otherwise(-lam)
    best_fall = F.max(F.when(weight > BOX[0] + edge, fall))
    least_rise = F.min(F.when(weight < BOX[1] - edge, rise))
    return tidy(
        rows.groupBy("portfolio_id").agg(
            F.sum(weight).alias("total"),
            ((F.min(weight) >= BOX[0] - 1e-9) & (F.max(weight) <= BOX[1] + 1e-9)).alias("in_box"),
            F.coalesce(best_fall <= least_rise + tol, F.lit(True)).alias("optimal"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query("min_te", CERTIFICATE)
def min_te(spark, d):
    """The customers' own holdings as benchmarks, most of which the box does not admit."""
    _, mu, sigma = risk_inputs(spark, d)
    problems, held = _customers(spark, d)
    problems = hand_off(problems.withColumn("gamma", F.lit(0.0)), "problems")
    w = A.solve(problems, sigma, method="min_te", bench=held, w_max=0.06)
    return _certificate(w, _quadratic_gradient(sigma, hand_off(mu, "mu"), problems, bench=held), 0.0, 0.06)


@query(
    "te_frontier_sweep",
    sql(
        [C.SEG],
        """SELECT portfolio_id, 25 AS points, TRUE AS sums_to_one, TRUE AS in_box, TRUE AS te_rises, TRUE AS return_rises
           FROM seg GROUP BY 1""",
        ints=["points"], plain=["portfolio_id", "sums_to_one", "in_box", "te_rises", "return_rises"],
    ),
)
def te_frontier_sweep(spark, d):
    """25 trade-offs per segment: tracking error and active return both rise with gamma."""
    _, mu, sigma = risk_inputs(spark, d)
    segments = D.segment_holdings(spark, d).select("portfolio_id").distinct()
    bench = hand_off(D.segment_holdings(spark, d), "bench")
    w = hand_off(
        A.te_frontier_sweep(segments, sigma, mu, bench, A.geometric_grid(), w_max=0.2), "sweep"
    )
    point = F.concat_ws("@", "portfolio_id", F.col("gamma").cast("string"))
    keyed = w.select(point.alias("portfolio_id"), "ticker", "weight")
    points = w.select("portfolio_id", "gamma", point.alias("_point")).distinct()
    anchors = points.join(bench, "portfolio_id").select(F.col("_point").alias("portfolio_id"), "ticker", "weight")
    te = P.tracking_error(keyed, anchors, sigma, mu).withColumnRenamed("portfolio_id", "_point")
    sums = keyed.groupBy(F.col("portfolio_id").alias("_point")).agg(
        F.sum("weight").alias("_s"), F.min("weight").alias("_lo"), F.max("weight").alias("_hi")
    )
    order = W.partitionBy("portfolio_id").orderBy("gamma")
    rows = points.join(te, "_point").join(sums, "_point")
    rows = rows.withColumn("_dte", F.col("te") - F.lag("te").over(order)).withColumn(
        "_dar", F.col("active_ret") - F.lag("active_ret").over(order)
    )
    return tidy(
        rows.groupBy("portfolio_id").agg(
            F.count(F.lit(1)).alias("points"),
            (F.max(F.abs(F.col("_s") - 1)) < 1e-9).alias("sums_to_one"),
            ((F.min("_lo") >= -1e-9) & (F.max("_hi") <= 0.2 + 1e-9)).alias("in_box"),
            F.bool_and(F.coalesce(F.col("_dte") > -1e-6, F.lit(True))).alias("te_rises"),
            F.bool_and(F.coalesce(F.col("_dar") > -1e-6, F.lit(True))).alias("return_rises"),
        )
    )


@query(
    "risk_parity",
    sql(
        [C.SEG_RET],
        "SELECT universe_id, count(DISTINCT i) AS n, 1.0 AS total, TRUE AS equal_contributions FROM usigma GROUP BY 1",
        ints=["n"], floats=["total"], plain=["universe_id", "equal_contributions"],
    ),
)
def risk_parity(spark, d):
    """Every ticker contributes the same share of risk, in each segment's universe."""
    sigma = _segment_sigma(spark, d)
    problems = sigma.select("universe_id", F.col("universe_id").alias("portfolio_id")).distinct()
    w = hand_off(A.solve(problems, sigma, method="risk_parity"), "weights")
    rc = _universe_products(w, sigma).withColumn("rc", F.col("weight") * F.col("_sw"))
    return tidy(
        rc.groupBy("universe_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").alias("total"),
            (F.max("rc") - F.min("rc") < 0.001 * F.avg("rc")).alias("equal_contributions"),
        )
    )


def _segment_sigma(spark, d):
    returns = hand_off(D.segment_returns(spark, d), "returns")
    return hand_off(G.ridge(G.covariance(returns, method="oas", annualize=False, store=hand_off), 1e-4), "sigma")


def _universe_products(w, sigma):
    held = w.select("universe_id", F.col("ticker").alias("j"), F.col("weight").alias("_w"))
    sw = held.join(sigma, ["universe_id", "j"]).groupBy("universe_id", F.col("i").alias("ticker")).agg(
        F.sum(F.col("value") * F.col("_w")).alias("_sw")
    )
    return w.join(sw, ["universe_id", "ticker"])


def _hrp_sql():
    return sql(
        [C.SEG_RET],
        """SELECT universe_id, count(DISTINCT i) AS n, 1.0 AS total, TRUE AS positive, TRUE AS falls_with_variance
           FROM usigma GROUP BY 1""",
        ints=["n"], floats=["total"], plain=["universe_id", "positive", "falls_with_variance"],
    )


@query("hrp", _hrp_sql())
def hrp(spark, d):
    """Positive weights that sum to 1 and are smaller for tickers of larger variance, in each segment's universe."""
    sigma = _segment_sigma(spark, d)
    problems = sigma.select("universe_id", F.col("universe_id").alias("portfolio_id")).distinct()
    w = hand_off(A.solve(problems, sigma, method="hrp"), "weights")
    own = sigma.where("i = j").select("universe_id", F.col("i").alias("ticker"), F.col("value").alias("_var"))
    return tidy(
        w.join(own, ["universe_id", "ticker"]).groupBy("universe_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").alias("total"),
            (F.min("weight") > 0).alias("positive"),
            F.coalesce(F.corr("weight", "_var") < -0.1, F.lit(False)).alias("falls_with_variance"),
        )
    )


@query(
    "group_caps",
    sql(
        [C.HOLD, C.BRAND_META],
        """SELECT DISTINCT portfolio_id, upper(sector) AS "group", 1.0 AS total, TRUE AS capped, TRUE AS nearest
           FROM hold CROSS JOIN (SELECT DISTINCT sector FROM bmeta)""",
        floats=["total"], plain=["portfolio_id", '"group"', "capped", "nearest"],
    ),
)
def group_caps(spark, d):
    """Customers' weights with each maker limited to 30 % (five makers, so the caps can be met): the nearest such weights.

    At the nearest point no exchange brings weights closer to the holdings: what a weight lost to the constraints is no
    less in the receiving ticker than in the giving one, in any group of which the cap leaves room, or in the same group.
    """
    edge, tol = 1e-9, 1e-7
    sigma = brand_sigma(spark, d)
    problems, held = _customers(spark, d)
    groups = hand_off(D.brand_meta(spark, d).select("ticker", F.upper("sector").alias("group")), "groups")
    caps = groups.select("group").distinct().withColumn("cap", F.lit(0.3))
    w = hand_off(A.solve(problems, sigma, method="group_caps", ref=held, groups=groups, caps=caps), "weights")
    away = P.active_weights(w.select("portfolio_id", "ticker", "weight"), held).join(groups, "ticker")
    give, take = F.max(F.when(F.col("weight") > edge, F.col("active"))), F.min(F.when(F.col("weight") < 1 - edge, F.col("active")))
    per = away.groupBy("portfolio_id", "group").agg(F.sum("weight").alias("_sum"), give.alias("_give"), take.alias("_take"))
    room = F.when(F.col("_sum") < 0.3 - edge, F.col("_take"))
    all_ = per.groupBy("portfolio_id").agg(F.sum("_sum").alias("total"), F.max("_give").alias("_most"), F.min(room).alias("_least"))
    inside = F.coalesce(F.col("_give") <= F.col("_take") + tol, F.lit(True))
    across = F.coalesce(F.col("_most") <= F.col("_least") + tol, F.lit(True))
    return tidy(
        per.join(all_, "portfolio_id").select(
            "portfolio_id", "group", "total", (F.col("_sum") <= 0.3 + 1e-9).alias("capped"), (inside & across).alias("nearest")
        )
    )


# --- closed forms -------------------------------------------------------------------------------------------------

UMU = "umu AS (SELECT universe_id, ticker, avg(ret) AS mu FROM ufull GROUP BY 1, 2)"


def _markowitz_parts(spark, d):
    """Means, covariance with a ridge, and the closed forms' vectors, one universe per market segment."""
    returns = hand_off(D.segment_returns(spark, d), "returns")
    mu = hand_off(M.mu_historical(returns, annualize=False), "mu")
    sigma = hand_off(G.ridge(G.covariance(returns, method="sample", annualize=False, store=hand_off), 1e-2), "sigma")
    return mu, sigma, hand_off(A.closed_form_vectors(mu, sigma), "vectors")


@query(
    "markowitz_closed_form",
    sql(
        [C.SEG_RET],
        """SELECT universe_id, count(DISTINCT i) AS n, 1.0 AS gmv_total, 1.0 AS tan_total,
                  TRUE AS gmv_equal_marginals, TRUE AS tan_proportional FROM usigma GROUP BY 1""",
        ints=["n"], floats=["gmv_total", "tan_total"], plain=["universe_id", "gmv_equal_marginals", "tan_proportional"],
    ),
)
def markowitz_closed_form(spark, d):
    """Minimum variance: all marginal risks equal. Tangency: marginal risk proportional to excess return."""
    mu, sigma, vectors = _markowitz_parts(spark, d)
    w = hand_off(A.markowitz_closed_form(mu, sigma, rf=0.001, vectors=vectors), "weights")
    own = lambda c: _universe_products(w.select("universe_id", "ticker", F.col(c).alias("weight")), sigma)
    gmv = own("w_gmv").groupBy("universe_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("weight").alias("gmv_total"),
        (F.max("_sw") - F.min("_sw") < 1e-8 * F.abs(F.avg("_sw")) + 1e-10).alias("gmv_equal_marginals"),
    )
    ratio = F.col("_sw") / (F.col("mu") - 0.001)
    tan = own("w_tan").join(mu, ["universe_id", "ticker"]).groupBy("universe_id").agg(
        F.sum("weight").alias("tan_total"),
        (F.max(ratio) - F.min(ratio) < 1e-5 * F.abs(F.avg(ratio))).alias("tan_proportional"),
    )
    return tidy(gmv.join(tan, "universe_id"))


@query(
    "frontier_closed_form",
    sql(
        [C.SEG_RET, UMU],
        "SELECT universe_id, 100 AS points, TRUE AS convex, TRUE AS above_minimum, max(mu) AS highest FROM umu GROUP BY 1",
        ints=["points"], floats=["highest"], plain=["universe_id", "convex", "above_minimum"],
    ),
)
def frontier_closed_form(spark, d):
    """The squared risks of the frontier form a convex parabola above the minimum-variance point, in each universe."""
    mu, sigma, vectors = _markowitz_parts(spark, d)
    points = A.frontier_closed_form(mu, sigma, npts=100, vectors=vectors)
    floor = vectors.groupBy("universe_id").agg(F.sqrt(1.0 / F.sum("inv_one")).alias("_floor"))
    order = W.partitionBy("universe_id").orderBy("point")
    var = F.pow("risk", 2)
    bend = F.lead(var).over(order) - 2 * var + F.lag(var).over(order)
    rows = points.select("universe_id", "point", "ret", "risk", bend.alias("_bend")).join(floor, "universe_id")
    # The grid runs from a tenth to nine tenths of the way from the minimum-variance return to the best mean, so its two
    # ends give that mean back.
    first, last = F.min_by("ret", "point"), F.max_by("ret", "point")
    return tidy(
        rows.groupBy("universe_id").agg(
            F.count(F.lit(1)).alias("points"),
            F.bool_and(F.coalesce(F.col("_bend") > 0, F.lit(True))).alias("convex"),
            F.bool_and(F.col("risk") >= F.col("_floor") - 1e-12).alias("above_minimum"),
            (last + (last - first) / 8.0).alias("highest"),
        )
    )


@query(
    "frontier_range",
    sql([*C.RISK[:4], C.MU], "SELECT quantile_cont(mu, 0.1) AS r_min, quantile_cont(mu, 0.9) AS r_max FROM mu", floats=["r_min", "r_max"]),
)
def frontier_range(spark, d):
    return tidy(A.frontier_range(M.mu_historical(brand_panel(spark, d), annualize=False)))


@query(
    "frontier_box",
    sql(
        [C.SEG_RET, UMU],
        """SELECT universe_id, 40 AS points, TRUE AS above_closed_form, TRUE AS within_means, max(mu) AS highest_mean,
                  min(mu) AS lowest_mean FROM umu GROUP BY 1""",
        ints=["points"], floats=["highest_mean", "lowest_mean"], plain=["universe_id", "above_closed_form", "within_means"],
    ),
)
def frontier_box(spark, d):
    """Inside the box no point beats the unconstrained frontier, and returns lie between the extreme means."""
    mu, sigma, vectors = _markowitz_parts(spark, d)
    points = A.frontier_box(mu, sigma, 0.0, 0.2, npts=40, vectors=vectors)
    conic = vectors.groupBy("universe_id").agg(
        F.sum("inv_one").alias("a"), F.sum("inv_mu").alias("b"), F.sum(F.col("mu") * F.col("inv_mu")).alias("c"),
        F.min("mu").alias("lo"), F.max("mu").alias("hi"),
    )
    r, a, b, c = (F.col(x) for x in ("ret", "a", "b", "c"))
    best = F.sqrt((a * r * r - 2 * b * r + c) / (a * c - b * b))
    return tidy(
        points.join(conic, "universe_id").groupBy("universe_id").agg(
            F.count(F.lit(1)).alias("points"),
            F.bool_and(F.col("risk") >= best - 1e-9).alias("above_closed_form"),
            F.bool_and(r.between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("within_means"),
            F.max("hi").alias("highest_mean"),
            F.max("lo").alias("lowest_mean"),
        )
    )


# --- tail-risk selection ------------------------------------------------------------------------------------------

@query(
    "cvar_select",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.HOLD, C.BENCH, C.ACTIVE, C.PORT_RET,
         """scored AS (
           SELECT p.portfolio_id, any_value(c.c_mktsegment) AS segment, avg(-ret) FILTER (-ret >= q) + 0.1 * any_value(t.l1) AS score
           FROM port p JOIN (SELECT portfolio_id, quantile_cont(-ret, 0.95) AS q FROM port GROUP BY 1) USING (portfolio_id)
           JOIN (SELECT portfolio_id, sum(abs(v)) AS l1 FROM active GROUP BY 1) t USING (portfolio_id)
           JOIN customer c ON CAST(c_custkey AS VARCHAR) = p.portfolio_id GROUP BY 1)"""],
        """SELECT segment, portfolio_id, ticker, weight, score FROM hold
           JOIN (SELECT segment, arg_min(portfolio_id, score) AS portfolio_id, min(score) AS score FROM scored GROUP BY 1) USING (portfolio_id)""",
        floats=["weight", "score"], plain=["segment", "portfolio_id", "ticker"],
    ),
)
def cvar_select(spark, d):
    """Per market segment, the customer portfolio with the least CVaR plus turnover against the benchmark."""
    segments = D.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("portfolio_id"), F.col("c_mktsegment").alias("segment")
    )
    candidates = hand_off(D.customer_holdings(spark, d).join(segments, "portfolio_id"), "candidates")
    returns = brand_panel(spark, d)
    return tidy(
        A.cvar_select(
            candidates, returns, group="segment", alpha=0.95, lam_l1=0.1, ref=benchmark(spark, d), store=hand_off
        )
    )


@query(
    "cvar_minimise",
    sql(
        [C.SEG],
        """SELECT portfolio_id, (SELECT count(DISTINCT p_brand) FROM part JOIN lineitem ON l_partkey = p_partkey) AS n,
                  1.0 AS total, TRUE AS in_box, TRUE AS no_descent FROM seg GROUP BY 1""",
        ints=["n"], floats=["total"], plain=["portfolio_id", "in_box", "no_descent"],
    ),
)
def cvar_minimise(spark, d):
    """Per market segment, least tail loss with turnover costs against the holdings.

    The objective is convex: at its minimum a small step towards any admissible weights cannot lower it. Tried are steps
    towards equal weights, towards the benchmark and towards the holdings, the latter two cut to the box.
    """
    alpha, lam, cap, step = 0.9, 0.01, 0.2, 0.02
    returns = brand_panel(spark, d)
    held = hand_off(D.segment_holdings(spark, d), "held")
    problems = held.select("portfolio_id").distinct()
    w = hand_off(cvar_least(problems, returns, alpha=alpha, ref=held, lam=lam, w_max=cap), "weights")
    own = w.select("portfolio_id", "ticker", "weight")
    goals = {
        "equal": own.withColumn("goal", 1.0 / F.count(F.lit(1)).over(W.partitionBy("portfolio_id"))),
        "bench": own.join(benchmark(spark, d).select("ticker", F.col("weight").alias("goal")), "ticker", "left"),
        "held": own.join(held.select("portfolio_id", "ticker", F.col("weight").alias("goal")), ["portfolio_id", "ticker"], "left"),
    }
    tried = own.select("portfolio_id", F.lit("own").alias("way"), "ticker", "weight")
    for way, rows in goals.items():
        raw = rows.select("portfolio_id", "ticker", F.col("weight").alias("_w"), F.coalesce("goal", F.lit(0.0)).alias("weight"))
        near = J.project_box_simplex(raw, 0.0, cap)
        moved = near.select("portfolio_id", F.lit(way).alias("way"), "ticker", ((1 - step) * F.col("_w") + step * F.col("weight")).alias("weight"))
        tried = tried.unionByName(moved)
    keyed = hand_off(tried.withColumn("portfolio_id", F.concat_ws("@", "portfolio_id", "way")).drop("way"), "tried")
    losses = hand_off(P.portfolio_returns(keyed, returns).select("portfolio_id", (-F.col("ret")).alias("loss")), "losses")
    # The least over v of v + mean excess / (1 - alpha) is reached at one of the losses, the one of that rank.
    ranked = losses.withColumn("_rank", F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("loss")))).withColumn(
        "_tail", (1 - alpha) * F.count(F.lit(1)).over(W.partitionBy("portfolio_id"))
    )
    at = F.max(F.when(F.col("_rank") == F.ceil(F.col("_tail") - 1e-9), F.col("loss")))
    facts = ranked.groupBy("portfolio_id", "_tail").agg(
        at.alias("_v"), F.sum(F.when(F.col("_rank") <= F.floor(F.col("_tail") + 1e-9), F.col("loss")).otherwise(0.0)).alias("_sum")
    )
    cvar = (F.col("_sum") + (F.col("_tail") - F.floor(F.col("_tail") + 1e-9)) * F.col("_v")) / F.col("_tail")
    origin = F.substring_index("portfolio_id", "@", 1)
    moved = P.active_weights(
        keyed, keyed.select("portfolio_id").distinct().withColumn("_o", origin)
        .join(held.select(F.col("portfolio_id").alias("_o"), "ticker", "weight"), "_o").select("portfolio_id", "ticker", "weight"),
    ).groupBy("portfolio_id").agg((lam * F.sum(F.abs("active"))).alias("_cost"))
    scores = facts.join(moved, "portfolio_id").select(
        origin.alias("_o"), F.substring_index("portfolio_id", "@", -1).alias("way"), (cvar + F.col("_cost")).alias("score")
    )
    best = scores.groupBy(F.col("_o").alias("portfolio_id")).agg(
        (F.max(F.when(F.col("way") == "own", F.col("score"))) <= F.min(F.when(F.col("way") != "own", F.col("score"))) + 1e-8).alias("no_descent")
    )
    sums = own.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"),
        ((F.min("weight") >= -1e-9) & (F.max("weight") <= cap + 1e-9)).alias("in_box"),
    )
    return tidy(sums.join(best, "portfolio_id").select("portfolio_id", "n", "total", "in_box", "no_descent"))


@query(
    "cvar_minimise_universes",
    sql(
        [C.SEG_RET_MONTH],
        "SELECT universe_id, count(DISTINCT ticker) AS n, 1.0 AS total, TRUE AS in_box, TRUE AS solved, TRUE AS beats_equal FROM uret GROUP BY 1",
        ints=["n"], floats=["total"], plain=["universe_id", "in_box", "solved", "beats_equal"],
    ),
)
def cvar_minimise_universes(spark, d):
    """One problem per market segment, each on the monthly returns its own customers saw, solved together: a gap to the
    bound of at most 1e-9, and no more tail loss than equal weights."""
    alpha, cap = 0.9, 0.2
    returns = hand_off(D.segment_returns(spark, d, "1mo"), "returns")
    problems = returns.select("universe_id").distinct().withColumn("portfolio_id", F.col("universe_id"))
    w = hand_off(cvar_least(problems, returns, alpha=alpha, w_max=cap), "weights")
    equal = 1.0 / F.count(F.lit(1)).over(W.partitionBy("universe_id"))
    both = w.select("universe_id", "ticker", "weight").withColumn("even", equal)
    series = returns.join(both, ["universe_id", "ticker"]).groupBy("universe_id", "date").agg(
        (-F.sum(F.col("weight") * F.col("ret"))).alias("own"), (-F.sum(F.col("even") * F.col("ret"))).alias("equal")
    )
    # The tail mean over dates, the date at the border counted in part.
    tail = (1 - alpha) * F.count(F.lit(1)).over(W.partitionBy("universe_id"))
    part = lambda c: F.least(
        F.greatest(F.col("_tail") - F.row_number().over(W.partitionBy("universe_id").orderBy(F.desc(c))) + 1, F.lit(0.0)), F.lit(1.0)
    )
    shares = series.withColumn("_tail", tail).withColumn("_o", part("own")).withColumn("_e", part("equal"))
    beats = shares.groupBy("universe_id").agg(
        (F.sum(F.col("own") * F.col("_o")) <= F.sum(F.col("equal") * F.col("_e")) + 1e-9).alias("beats_equal")
    )
    sums = w.groupBy("universe_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"),
        ((F.min("weight") >= -1e-9) & (F.max("weight") <= cap + 1e-9)).alias("in_box"),
        F.every((F.col("status") == "ok") & (F.col("residual") <= 1e-9)).alias("solved"),
    )
    return tidy(sums.join(beats, "universe_id").select("universe_id", "n", "total", "in_box", "solved", "beats_equal"))


# --- end-to-end flows ---------------------------------------------------------------------------------------------

WINSOR = """wq AS (
  SELECT ticker, max(ret) FILTER (rk = floor(0.01 * m + 0.5)) AS lo, max(ret) FILTER (rk = floor(0.99 * m + 0.5)) AS hi
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret) - 1 AS rk, count(*) OVER (PARTITION BY ticker) - 1 AS m FROM raw)
  GROUP BY ticker),
w AS (SELECT date, ticker, least(greatest(ret, lo), hi) AS ret FROM raw JOIN wq USING (ticker)),
ret AS (
  SELECT g.date, t.ticker, coalesce(a.ret, 0) AS ret
  FROM (SELECT DISTINCT date_trunc('month', date - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS date FROM w) g
  CROSS JOIN (SELECT DISTINCT ticker FROM w) t
  LEFT JOIN (SELECT date_trunc('month', date - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS date, ticker, sum(ret) AS ret
             FROM w GROUP BY 1, 2) a ON a.date = g.date AND a.ticker = t.ticker)"""


def _data_run(spark, d):
    return data_pipeline(D.brand_prices(spark, d), freq_prices="1w", freq_returns="1mo", store=hand_off)


@query(
    "data_pipeline_returns",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK.replace("ret AS (", "raw AS (", 1), WINSOR], "SELECT * FROM ret",
        dates=["date"], floats=["ret"], plain=["ticker"],
    ),
)
def data_pipeline_returns(spark, d):
    return tidy(_data_run(spark, d).returns.select("date", "ticker", "ret"))


@query(
    "data_pipeline_stats",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK.replace("ret AS (", "raw AS (", 1), WINSOR], SUMMARY.replace("mean - 0.001", "mean - 0"),
        floats=["mean", "std", "skew", "kurt", "sharpe", "missing_pct"], ints=["n_obs"], plain=["ticker"],
    ),
)
def data_pipeline_stats(spark, d):
    return tidy(_data_run(spark, d).stats)


@query(
    "risk_model_sigma",
    sql(
        C.RISK[:-1],
        "SELECT i, j, CASE WHEN i = j THEN 1.44 * (12 * value + 0.0001) ELSE 0.72 * 12 * value END AS value FROM sigma",
        floats=["value"], plain=["i", "j"], digits=8,
    ),
)
def risk_model_sigma(spark, d):
    model = risk_model(
        D.brand_returns(spark, d), mu_method="historical", cov_method="sample", ridge_eps=1e-4, stress=True, store=hand_off
    )
    return tidy(model.sigma, 8)


@query(
    "risk_model_mu",
    sql(
        C.RISK[:4],
        """SELECT ticker, 12 * sum(ret * power(1 - 2.0 / 21, n - idx) * CASE WHEN idx = 1 THEN 1 ELSE 2.0 / 21 END) AS mu
           FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx,
                        count(*) OVER (PARTITION BY ticker) AS n FROM full_ret) GROUP BY ticker""",
        floats=["mu"], plain=["ticker"],
    ),
)
def risk_model_mu(spark, d):
    return tidy(risk_model(D.brand_returns(spark, d), mu_method="ema", mu_span=20, store=hand_off).mu)


@query(
    "risk_model_diagnostics",
    sql(
        C.RISK[:-1],
        """SELECT 12 AS per_year, power(sum(value) FILTER (i = j) + 0.001 / 12 * count(*) FILTER (i = j), 2)
                  / sum(power(value + CASE WHEN i = j THEN 0.001 / 12 ELSE 0 END, 2)) AS effective_rank,
                  TRUE AS better_conditioned FROM sigma""",
        floats=["effective_rank"], ints=["per_year"], plain=["better_conditioned"],
    ),
)
def risk_model_diagnostics(spark, d):
    model = risk_model(
        D.brand_returns(spark, d), mu_method="capm", cov_method="oas", ridge_eps=0.001, store=hand_off
    )
    return tidy(
        model.diagnostics.select(
            "per_year", "effective_rank", (F.col("condition_post") <= F.col("condition_pre")).alias("better_conditioned")
        )
    )


@query(
    "optimise_portfolios",
    sql(
        [C.HOLD],
        """SELECT portfolio_id, (SELECT count(DISTINCT p_brand) FROM part JOIN lineitem ON l_partkey = p_partkey) AS n,
                  1.0 AS total, TRUE AS in_box, TRUE AS optimal FROM hold GROUP BY 1""",
        ints=["n"], floats=["total"], plain=["portfolio_id", "in_box", "optimal"],
    ),
)
def optimise_customers(spark, d):
    """Risk model to exported weights for every customer: shrunk means, Ledoit-Wolf covariance, mean-variance."""
    model = risk_model(
        D.brand_returns(spark, d), mu_method="shrunk", shrink_target="equal", cov_method="lw", store=hand_off
    )
    problems = hand_off(_customers(spark, d)[0], "problems")
    w = optimise_portfolios(problems, model, method="mv_l2", w_max=0.1, store=hand_off)
    return _certificate(w, _quadratic_gradient(model.sigma, model.mu, problems), 0.0, 0.1)
