"""Queries for portfolio analytics and projections."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ...functions.numeric import soft_threshold as shrink_towards_zero
from ...operators import covariance as G, mu as M, panel, portfolio as P, projection as J, stats
from ...session import hand_off
from .. import derive as D
from ..registry import query, sql, tidy
from . import ctes as C
from .risk import brand_panel, brand_sigma

PF = dict(plain=["portfolio_id"])
PT = dict(plain=["portfolio_id", "ticker"])
RISKY = [*C.RISK, C.HOLD]
ACTIVE = [*C.RISK, C.HOLD, C.BENCH, C.ACTIVE]


def holdings(spark, d):
    return hand_off(D.customer_holdings(spark, d), "holdings")


def benchmark(spark, d):
    return hand_off(D.brand_benchmark(spark, d), "bench")


def risk_inputs(spark, d):
    """Stored monthly returns, per-period means and sample covariance."""
    returns = brand_panel(spark, d)
    sigma = hand_off(G.covariance(returns, method="sample", annualize=False, store=hand_off), "sigma")
    return returns, M.mu_historical(returns, annualize=False), sigma


# --- statistics of portfolios -------------------------------------------------------------------------------------

@query(
    "portfolio_stats",
    sql(
        RISKY,
        """SELECT portfolio_id, mu_p, sigma_p, CASE WHEN sigma_p > 1e-12 THEN (mu_p - 0.001) / sigma_p END AS sharpe, unpriced
           FROM (SELECT portfolio_id, sum(CASE WHEN ticker IN (SELECT i FROM sigma) THEN 0 ELSE weight END) / sum(weight) AS unpriced
                 FROM hold GROUP BY 1) LEFT JOIN (SELECT portfolio_id, sum(weight * mu) AS mu_p FROM hold JOIN mu USING (ticker) GROUP BY 1) USING (portfolio_id)
           LEFT JOIN (SELECT a.portfolio_id, sqrt(greatest(sum(a.weight * value * b.weight), 0)) AS sigma_p
                 FROM hold a JOIN hold b ON a.portfolio_id = b.portfolio_id JOIN sigma ON i = a.ticker AND j = b.ticker
                 GROUP BY 1) USING (portfolio_id)""",
        floats=["mu_p", "sigma_p", "sharpe", "unpriced"], **PF,
    ),
)
def portfolio_stats(spark, d):
    _, mu, sigma = risk_inputs(spark, d)
    return tidy(P.portfolio_stats(holdings(spark, d), mu, sigma, rf=0.001))


@query(
    "portfolio_stats_from_returns",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.HOLD, C.PORT_RET],
        """SELECT portfolio_id, mu_p, sigma_p, CASE WHEN sigma_p > 1e-12 THEN mu_p / sigma_p END AS sharpe
           FROM (SELECT portfolio_id, avg(ret) AS mu_p, stddev_samp(ret) AS sigma_p FROM port GROUP BY 1)""",
        floats=["mu_p", "sigma_p", "sharpe"], **PF,
    ),
)
def portfolio_stats_from_returns(spark, d):
    return tidy(P.portfolio_stats_from_returns(holdings(spark, d), brand_panel(spark, d)))


@query(
    "portfolio_returns",
    sql([C.BRAND, C.MONTH, C.RET, C.HOLD, C.PORT_RET], "SELECT * FROM port", dates=["date"], floats=["ret"], **PF),
)
def portfolio_returns(spark, d):
    return tidy(P.portfolio_returns(holdings(spark, d), brand_panel(spark, d)))


@query(
    "gini",
    sql(
        [C.HOLD],
        """SELECT portfolio_id, CASE WHEN sum(weight) > 0 THEN (count(*) + 1 - 2 * sum(cum) / sum(weight)) / count(*) ELSE 0 END AS gini
           FROM (SELECT *, sum(weight) OVER (PARTITION BY portfolio_id ORDER BY weight, ticker ROWS UNBOUNDED PRECEDING) AS cum
                 FROM hold) GROUP BY 1""",
        floats=["gini"], **PF,
    ),
)
def gini(spark, d):
    return tidy(P.gini(D.customer_holdings(spark, d)))


@query(
    "cvar_estimate",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.HOLD, C.PORT_RET],
        """SELECT portfolio_id, any_value(q) AS var, avg(ret) FILTER (ret <= q) AS cvar
           FROM port JOIN (SELECT portfolio_id, quantile_cont(ret, 0.05) AS q FROM port GROUP BY 1) USING (portfolio_id) GROUP BY 1""",
        floats=["var", "cvar"], **PF,
    ),
)
def cvar_estimate(spark, d):
    series = hand_off(P.portfolio_returns(holdings(spark, d), brand_panel(spark, d)), "series")
    return tidy(stats.cvar_estimate(series, 0.95))


LOSSES = "losses AS (SELECT l_extendedprice * l_discount / l_quantity AS loss, l_returnflag AS flag FROM lineitem)"


def _losses(spark, d):
    """Discount given away per unit: one loss per line, three groups."""
    items = D.table(spark, d, "lineitem")
    return items.select(
        (F.col("l_extendedprice") * F.col("l_discount") / F.col("l_quantity")).alias("loss"),
        F.col("l_returnflag").alias("flag"),
    )


@query(
    "loss_var_es",
    sql(
        [LOSSES, "q AS (SELECT unnest([0.95, 0.99]) AS alpha, unnest(quantile_cont(loss, [0.95, 0.99])) AS var FROM losses)"],
        "SELECT alpha, any_value(var) AS var, avg(loss) AS es FROM losses JOIN q ON loss >= var GROUP BY alpha",
        floats=["alpha", "var", "es"], digits=5,
    ),
)
def loss_var_es(spark, d):
    return tidy(stats.loss_var_es(_losses(spark, d)), 5)


@query(
    "loss_var_es_by_group",
    sql(
        [LOSSES, "q AS (SELECT flag, unnest([0.95, 0.99]) AS alpha, unnest(quantile_cont(loss, [0.95, 0.99])) AS var FROM losses GROUP BY flag)"],
        "SELECT flag, alpha, any_value(var) AS var, avg(loss) AS es FROM losses JOIN q USING (flag) WHERE loss >= var GROUP BY ALL",
        floats=["alpha", "var", "es"], plain=["flag"], digits=5,
    ),
)
def loss_var_es_by_group(spark, d):
    return tidy(stats.loss_var_es(_losses(spark, d), by=["flag"]), 5)


@query(
    "loss_histogram",
    sql(
        [LOSSES, "s AS (SELECT min(loss) AS lo, max(loss) AS hi, count(loss) AS total, (max(loss) - min(loss)) / 60 AS w FROM losses)"],
        """SELECT bin, lo + bin * w AS left_edge, lo + (bin + 1) * w AS right_edge, coalesce(n, 0) AS n, coalesce(n, 0) / total AS probability
           FROM (SELECT unnest(range(60)) AS bin), s LEFT JOIN (
             SELECT least(floor((loss - lo) / w), 59) AS b, count(*) AS n FROM losses, s GROUP BY 1) ON b = bin""",
        floats=["left_edge", "right_edge", "probability"], ints=["bin", "n"],
    ),
)
def loss_histogram(spark, d):
    return tidy(stats.loss_histogram(_losses(spark, d), 60))


@query(
    "drawdown",
    sql(
        [C.BRAND, C.MONTH, C.RET],
        """SELECT run_id, date, equity, equity / max(equity) OVER (PARTITION BY run_id ORDER BY date) - 1 AS drawdown
           FROM (SELECT ticker AS run_id, date, exp(sum(ret) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM ret)""",
        dates=["date"], floats=["equity", "drawdown"], plain=["run_id"],
    ),
)
def drawdown(spark, d):
    path = F.exp(F.sum("ret").over(W.partitionBy("ticker").orderBy("date")))
    equity = D.brand_returns(spark, d).select(F.col("ticker").alias("run_id"), "date", path.alias("equity"))
    return tidy(stats.drawdown(equity))


# --- risk, turnover, tracking error -------------------------------------------------------------------------------

RC = """SELECT a.portfolio_id, a.ticker, any_value(a.weight) * sum(value * b.weight) AS rc
FROM hold a JOIN hold b ON a.portfolio_id = b.portfolio_id JOIN sigma ON i = a.ticker AND j = b.ticker GROUP BY 1, 2"""


@query("risk_contributions", sql(RISKY, RC, floats=["rc"], digits=9, **PT))
def risk_contributions(spark, d):
    return tidy(P.risk_contributions(holdings(spark, d), brand_sigma(spark, d)), 9)


@query(
    "risk_contribution_shares",
    sql(
        [*RISKY, f"rc AS ({RC})"],
        "SELECT portfolio_id, ticker, rc / CASE WHEN abs(t) > 1e-16 THEN t ELSE 1 END AS rc FROM (SELECT *, sum(rc) OVER (PARTITION BY portfolio_id) AS t FROM rc)",
        floats=["rc"], **PT,
    ),
)
def risk_contribution_shares(spark, d):
    return tidy(P.risk_contributions(holdings(spark, d), brand_sigma(spark, d), normalize=True))


@query(
    "risk_contributions_from_returns",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.FULL, C.SEG,
         "sp AS (SELECT portfolio_id, date, sum(weight * ret) AS rp FROM seg JOIN full_ret USING (ticker) GROUP BY 1, 2)"],
        """SELECT portfolio_id, ticker, any_value(weight) * covar_samp(ret, rp) AS rc
           FROM seg JOIN full_ret USING (ticker) JOIN sp USING (portfolio_id, date) GROUP BY 1, 2""",
        floats=["rc"], digits=9, **PT,
    ),
)
def risk_contributions_from_returns(spark, d):
    weights = hand_off(D.segment_holdings(spark, d), "holdings")
    returns = hand_off(panel.complete_rows_only(brand_panel(spark, d)), "panel")
    return tidy(P.risk_contributions_from_returns(weights, returns), 9)


@query(
    "turnover",
    sql(
        [C.HOLD, C.BENCH, C.ACTIVE],
        """SELECT portfolio_id, sum(abs(v)) AS l1, sqrt(sum(v * v)) AS l2, 0.5 * sum(abs(v)) AS l1_penalty,
                  0.25 * sum(v * v) AS l2_penalty FROM active GROUP BY 1""",
        floats=["l1", "l2", "l1_penalty", "l2_penalty"], **PF,
    ),
)
def turnover(spark, d):
    return tidy(P.turnover(holdings(spark, d), benchmark(spark, d), lam=0.5))


TE = """te AS (
  SELECT portfolio_id, sqrt(greatest(sum(a.v * s), 0)) AS te, sum(a.v * mu.mu) AS active_ret
  FROM active a JOIN (SELECT portfolio_id, i AS ticker, sum(value * v) AS s FROM active JOIN sigma ON j = ticker GROUP BY 1, 2) x
       USING (portfolio_id, ticker) JOIN mu USING (ticker) GROUP BY 1)"""


@query(
    "tracking_error",
    sql(
        [*ACTIVE, TE],
        """SELECT portfolio_id, te, active_ret, unpriced FROM (
             SELECT portfolio_id, sum(CASE WHEN ticker IN (SELECT i FROM sigma) THEN 0 ELSE abs(v) END) / sum(abs(v)) AS unpriced
             FROM active GROUP BY 1) LEFT JOIN te USING (portfolio_id)""",
        floats=["te", "active_ret", "unpriced"], **PF,
    ),
)
def tracking_error(spark, d):
    _, mu, sigma = risk_inputs(spark, d)
    return tidy(P.tracking_error(holdings(spark, d), benchmark(spark, d), sigma, mu, store=hand_off))


@query(
    "tracking_error_from_returns",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.FULL, C.HOLD, C.BENCH, C.ACTIVE],
        """SELECT portfolio_id, stddev_samp(r) AS te FROM (
             SELECT portfolio_id, date, sum(v * ret) AS r FROM active JOIN full_ret USING (ticker) GROUP BY 1, 2) GROUP BY 1""",
        floats=["te"], **PF,
    ),
)
def tracking_error_from_returns(spark, d):
    returns = hand_off(panel.complete_rows_only(brand_panel(spark, d)), "panel")
    return tidy(P.tracking_error_from_returns(holdings(spark, d), benchmark(spark, d), returns))


EXPOSED = """exposed AS (
  SELECT portfolio_id, factor, sum(v * exposure) AS x FROM active JOIN expo USING (ticker) GROUP BY 1, 2),
bounded AS (
  SELECT *, greatest(x - 0.05, 0) AS above, greatest(-0.05 - x, 0) AS below FROM exposed)"""


def _exposures(spark, d):
    return hand_off(panel.onehot_exposure(D.brand_benchmark(spark, d), D.brand_meta(spark, d)), "exposures")


@query(
    "active_exposure",
    sql(
        [C.HOLD, C.BENCH, C.ACTIVE, C.BRAND_META, EXPOSED],
        "SELECT portfolio_id, factor, x AS exposure, above, below, 0.5 * (above * above + below * below) AS penalty FROM bounded",
        floats=["exposure", "above", "below", "penalty"], plain=["portfolio_id", "factor"],
    ),
)
def active_exposure(spark, d):
    bench = benchmark(spark, d)
    return tidy(P.active_exposure(holdings(spark, d), bench, _exposures(spark, d), lb=-0.05, ub=0.05))


@query(
    "te_objective",
    sql(
        [*ACTIVE, TE, C.BRAND_META, EXPOSED,
         "reg AS (SELECT portfolio_id, 0.1 * sum(v * v) AS reg FROM active GROUP BY 1)",
         "pen AS (SELECT portfolio_id, sum(0.5 * (above * above + below * below)) AS expo_pen FROM bounded GROUP BY 1)"],
        """SELECT portfolio_id, te, te * te AS te2, active_ret, reg, expo_pen,
                  0.5 * te * te - 2 * active_ret + reg + 10 * expo_pen AS loss
           FROM te JOIN reg USING (portfolio_id) JOIN pen USING (portfolio_id)""",
        floats=["te", "te2", "active_ret", "reg", "expo_pen", "loss"], **PF,
    ),
)
def te_objective(spark, d):
    _, mu, sigma = risk_inputs(spark, d)
    bench = benchmark(spark, d)
    return tidy(
        P.te_objective(
            holdings(spark, d), bench, sigma, mu, gamma=2.0, lam_l2=0.2, exposures=_exposures(spark, d),
            lb=-0.05, ub=0.05, rho=10.0, store=hand_off,
        )
    )


@query(
    "validate_weights",
    sql(
        [C.HOLD],
        """SELECT portfolio_id, TRUE AS all_finite, abs(sum(weight) - 1) < 1e-8 AS sums_to_one,
                  bool_and(weight >= -1e-8 AND weight <= 0.2 + 1e-8) AS in_box FROM hold GROUP BY 1""",
        plain=["portfolio_id", "all_finite", "sums_to_one", "in_box"],
    ),
)
def validate_weights(spark, d):
    return P.validate_weights(D.customer_holdings(spark, d), 0.0, 0.2)


@query(
    "box_feasible",
    sql(
        [C.HOLD],
        """SELECT portfolio_id, count(*) AS n, count(*) * 0.06 <= 1 AND count(*) * 0.09 >= 1 AS feasible,
                  least(0.06, 1.0 / count(*)) AS w_min, greatest(0.09, 1.0 / count(*)) AS w_max FROM hold GROUP BY 1""",
        ints=["n"], floats=["w_min", "w_max"], plain=["portfolio_id", "feasible"],
    ),
)
def box_feasible(spark, d):
    return tidy(P.box_check(D.customer_holdings(spark, d), 0.06, 0.09))


# --- tables behind the charts -------------------------------------------------------------------------------------

@query(
    "correlation_edges",
    sql(
        [*C.RISK[:-1], C.CORR],
        "SELECT i, j, value AS rho, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS sign, 1 + 3 * abs(value) AS width FROM corr WHERE i < j AND abs(value) >= 0.2",
        floats=["rho", "width"], ints=["sign"], plain=["i", "j"],
    ),
)
def correlation_edges(spark, d):
    return tidy(P.correlation_edges(G.correlation(brand_sigma(spark, d)), 0.2))


@query(
    "correlation_degree",
    sql(
        [*C.RISK[:-1], C.CORR],
        "SELECT i AS ticker, count(*) FILTER (abs(value) >= 0.2) - 1 AS degree FROM corr GROUP BY i",
        ints=["degree"], plain=["ticker"],
    ),
)
def correlation_degree(spark, d):
    return tidy(P.correlation_degree(G.correlation(brand_sigma(spark, d)), 0.2))


@query(
    "top_n_bars",
    sql(
        [C.HOLD],
        """SELECT portfolio_id, ticker, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, ticker) AS rank
           FROM hold) WHERE rank <= 5""",
        floats=["weight"], ints=["rank"], **PT,
    ),
)
def top_n_bars(spark, d):
    return tidy(P.top_n(D.customer_holdings(spark, d), "weight", 5))


@query(
    "top_paths",
    sql(
        [C.SEG],
        """SELECT portfolio_id, ticker, weight, peak, log10(gamma) AS log10_gamma, gamma FROM (
             SELECT *, length(portfolio_id)::DOUBLE AS gamma FROM seg) JOIN (
             SELECT ticker, max(weight) AS peak FROM seg GROUP BY 1 ORDER BY peak DESC, ticker LIMIT 10) USING (ticker)""",
        floats=["weight", "peak", "log10_gamma", "gamma"], **PT,
    ),
)
def top_paths(spark, d):
    weights = D.segment_holdings(spark, d).withColumn("gamma", F.length("portfolio_id").cast("double"))
    return tidy(P.top_paths(hand_off(weights, "paths"), 10))


@query(
    "frontier_points",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.HOLD, C.PORT_RET],
        "SELECT portfolio_id, stddev_samp(ret) AS risk, avg(ret) AS ret FROM port GROUP BY 1 HAVING count(ret) > 1",
        floats=["risk", "ret"], **PF,
    ),
)
def frontier_points(spark, d):
    points = P.portfolio_stats_from_returns(holdings(spark, d), brand_panel(spark, d))
    return tidy(
        P.frontier_points(points.select("portfolio_id", F.col("sigma_p").alias("risk"), F.col("mu_p").alias("ret")))
    )


# --- weight tables ------------------------------------------------------------------------------------------------

@query(
    "benchmark_equal",
    sql([C.BENCH], "SELECT ticker, 1.0 / count(*) OVER () AS weight FROM bench", floats=["weight"], plain=["ticker"]),
)
def benchmark_equal(spark, d):
    return tidy(P.benchmark_weights(D.brand_prices(spark, d)))


@query(
    "benchmark_custom",
    sql(
        [],
        """SELECT p_brand AS ticker, count(*) / (SELECT count(*) FROM lineitem) AS weight
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
        floats=["weight"], plain=["ticker"],
    ),
)
def benchmark_custom(spark, d):
    parts = D.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    counts = D.table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("ticker").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    counts = hand_off(counts, "counts")
    return tidy(P.benchmark_weights(counts, counts))


@query(
    "stack_weights",
    sql(
        [C.HOLD, C.SEG],
        """SELECT portfolio_id, ticker, CASE WHEN weight > 0.9 THEN 0 ELSE weight END AS weight FROM hold
           UNION ALL SELECT * FROM seg""",
        floats=["weight"], **PT,
    ),
)
def stack_weights(spark, d):
    spoilt = F.when(F.col("weight") > 0.9, F.lit(float("nan"))).otherwise(F.col("weight"))
    return tidy(
        P.stack_weights(D.customer_holdings(spark, d).withColumn("weight", spoilt), D.segment_holdings(spark, d))
    )


# Projection, by evaluating the clipped sum at every knot and interpolating between two of them.
def _projection_ctes(v: str, lo: float, hi: float) -> list[str]:
    return [
        C.HOLD,
        f"v AS ({v})",
        f"knots AS (SELECT DISTINCT portfolio_id, unnest([weight - {lo}, weight - {hi}]) AS t FROM v)",
        f"""sums AS (SELECT k.portfolio_id, k.t, sum(least(greatest(v.weight - k.t, {lo}), {hi})) AS s
                     FROM knots k JOIN v ON v.portfolio_id = k.portfolio_id GROUP BY 1, 2)""",
        """segments AS (SELECT *, lead(t) OVER w AS t2, lead(s) OVER w AS s2 FROM sums
                       WINDOW w AS (PARTITION BY portfolio_id ORDER BY t))""",
        """theta AS (SELECT portfolio_id, arg_max(CASE WHEN t2 IS NULL OR s = s2 THEN t ELSE t + (s - 1) * (t2 - t) / (s - s2) END, t) AS theta
                     FROM segments WHERE s >= 1 - 1e-12 GROUP BY 1)""",
        "sizes AS (SELECT portfolio_id, count(*) AS n FROM v GROUP BY 1)",
        f"""proj AS (SELECT portfolio_id, ticker,
               CASE WHEN n * {lo} <= 1 + 1e-12 AND n * {hi} >= 1 - 1e-12 THEN least(greatest(weight - theta, {lo}), {hi}) END AS weight, n
             FROM v JOIN sizes USING (portfolio_id) LEFT JOIN theta USING (portfolio_id))""",
    ]


STRETCHED = "SELECT portfolio_id, ticker, 2 * weight - 0.05 AS weight FROM hold"


def _stretched(spark, d):
    return holdings(spark, d).withColumn("weight", 2 * F.col("weight") - 0.05)


@query(
    "project_box_simplex",
    sql(
        _projection_ctes(STRETCHED, 0.01, 0.25),
        "SELECT portfolio_id, ticker, weight, CASE WHEN weight IS NULL THEN 'infeasible' ELSE 'ok' END AS status FROM proj",
        floats=["weight"], plain=["portfolio_id", "ticker", "status"],
    ),
)
def project_box_simplex(spark, d):
    return tidy(J.project_box_simplex(_stretched(spark, d), 0.01, 0.25))


@query(
    "safe_project",
    sql(
        _projection_ctes(STRETCHED.replace("2 * weight - 0.05", "CASE WHEN weight > 0.5 THEN 0 ELSE 2 * weight - 0.05 END"), 0.01, 0.25),
        """SELECT portfolio_id, ticker, CASE WHEN sum(weight) OVER p > 1e-12 THEN weight / sum(weight) OVER p ELSE 1.0 / n END AS weight,
                  CASE WHEN weight IS NULL THEN 'infeasible' ELSE 'ok' END AS status FROM proj WINDOW p AS (PARTITION BY portfolio_id)""",
        floats=["weight"], plain=["portfolio_id", "ticker", "status"],
    ),
)
def safe_project(spark, d):
    holed = F.when(F.col("weight") > 0.5, F.lit(float("inf"))).otherwise(2 * F.col("weight") - 0.05)
    return tidy(J.safe_project(holdings(spark, d).withColumn("weight", holed), 0.01, 0.25))


@query(
    "topk_project",
    sql(
        _projection_ctes(
            """SELECT portfolio_id, ticker, CASE WHEN row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, ticker) <= 6
                      THEN weight ELSE 0 END AS weight FROM hold""",
            0.0, 0.25,
        ),
        "SELECT portfolio_id, ticker, weight, CASE WHEN weight IS NULL THEN 'infeasible' ELSE 'ok' END AS status FROM proj",
        floats=["weight"], plain=["portfolio_id", "ticker", "status"],
    ),
)
def topk_project(spark, d):
    return tidy(J.topk_project(holdings(spark, d), 6, 0.0, 0.25))


@query(
    "soft_threshold",
    sql(
        [C.HOLD, C.BENCH, C.ACTIVE],
        "SELECT portfolio_id, ticker, sign(v) * greatest(abs(v) - 0.02, 0) AS moved FROM active",
        floats=["moved"], **PT,
    ),
)
def soft_threshold(spark, d):
    active = P.active_weights(holdings(spark, d), benchmark(spark, d))
    return tidy(active.select("portfolio_id", "ticker", shrink_towards_zero(F.col("active"), 0.02).alias("moved")))


@query(
    "portfolio_stats_universes",
    sql(
        [C.SEG_RET, C.SEG,
         "umu AS (SELECT universe_id, ticker, avg(ret) AS mu FROM ufull GROUP BY 1, 2)",
         "ubench AS (SELECT universe_id, ticker, 1.0 / count(*) OVER (PARTITION BY universe_id) AS b FROM umu)",
         """uact AS (
  SELECT coalesce(s.portfolio_id, b.universe_id) AS universe_id, coalesce(s.ticker, b.ticker) AS ticker, coalesce(weight, 0) AS w, coalesce(weight, 0) - coalesce(b, 0) AS v
  FROM seg s FULL JOIN ubench b ON s.portfolio_id = b.universe_id AND s.ticker = b.ticker)""",
         """uvar AS (
  SELECT a.universe_id, sum(a.w * b.w * s.value) AS var, sum(a.v * b.v * s.value) AS active
  FROM usigma s JOIN uact a ON a.universe_id = s.universe_id AND a.ticker = s.i JOIN uact b ON b.universe_id = s.universe_id AND b.ticker = s.j
  GROUP BY 1)""",
         "ugain AS (SELECT universe_id, sum(w * mu) AS mu_p, sum(v * mu) AS active_ret FROM uact JOIN umu USING (universe_id, ticker) GROUP BY 1)"],
        """SELECT universe_id, universe_id AS portfolio_id, mu_p, CASE WHEN var IS NOT NULL THEN sqrt(greatest(var, 0)) END AS sigma_p,
                  CASE WHEN active IS NOT NULL THEN sqrt(greatest(active, 0)) END AS te, active_ret
           FROM (SELECT DISTINCT portfolio_id AS universe_id FROM seg) LEFT JOIN uvar USING (universe_id) LEFT JOIN ugain USING (universe_id)""",
        floats=["mu_p", "sigma_p", "te", "active_ret"], plain=["universe_id", "portfolio_id"],
    ),
)
def portfolio_stats_universes(spark, d):
    """Each segment's spending on the returns its own customers saw, with that segment's covariance: risk, mean, and active
    risk against equal weights. One portfolio per universe; none meets another's matrix, and one whose universe has no
    complete dates has no risk rather than another's."""
    returns = hand_off(D.segment_returns(spark, d), "returns")
    sigma = hand_off(G.covariance(returns, method="sample", annualize=False, store=hand_off), "sigma")
    mu = hand_off(M.mu_historical(returns, annualize=False), "mu")
    held = hand_off(D.segment_holdings(spark, d).withColumn("universe_id", F.col("portfolio_id")), "held")
    size = mu.groupBy("universe_id").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    bench = mu.select("universe_id", "ticker").join(size, "universe_id")
    stats = P.portfolio_stats(held, mu, sigma).select("universe_id", "portfolio_id", "mu_p", "sigma_p")
    active = P.tracking_error(held, bench, sigma, mu, store=hand_off).select("universe_id", "portfolio_id", "te", "active_ret")
    return tidy(stats.join(active, ["universe_id", "portfolio_id"]))
