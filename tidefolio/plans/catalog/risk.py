"""Queries for expected returns and covariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import covariance as G, leading, mu as M
from ...schema import attach
from ...session import hand_off, shared_folder
from ...sources import artifacts
from .. import derive as D
from ..registry import query, sql, tidy
from . import ctes as C

MU_COLS = dict(floats=["mu"], plain=["ticker"])
COV_COLS = dict(floats=["value"], plain=["i", "j"], digits=8)
BASE = [C.BRAND, C.MONTH, C.RET, C.FULL]


def brand_panel(spark, d, freq="1mo"):
    return hand_off(D.brand_returns(spark, d, freq), "returns")


def brand_sigma(spark, d):
    """Sample covariance per month, stored: most queries below read it several times."""
    returns = brand_panel(spark, d)
    return hand_off(G.covariance(returns, method="sample", annualize=False, store=hand_off), "sigma")


# --- expected returns ---------------------------------------------------------------------------------------------

@query("mu_historical", sql(BASE, "SELECT ticker, 12 * avg(ret) AS mu FROM full_ret GROUP BY ticker", **MU_COLS))
def mu_historical(spark, d):
    return tidy(M.mu_historical(brand_panel(spark, d)))


@query(
    "mu_historical_mean_fill",
    sql([C.BRAND, C.WEEK, C.RET_WEEK, C.FILLED], "SELECT ticker, 52 * avg(ret) AS mu FROM filled GROUP BY ticker", **MU_COLS),
)
def mu_historical_mean_fill(spark, d):
    return tidy(M.mu_historical(brand_panel(spark, d, "1w"), fill="mean"))


@query(
    "mu_ema",
    sql(
        BASE,
        """SELECT ticker, 12 * sum(ret * power(1 - 2.0 / 61, n - idx) * CASE WHEN idx = 1 THEN 1 ELSE 2.0 / 61 END) AS mu
           FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx,
                        count(*) OVER (PARTITION BY ticker) AS n FROM full_ret) GROUP BY ticker""",
        **MU_COLS,
    ),
)
def mu_ema(spark, d):
    return tidy(M.mu_ema(brand_panel(spark, d), span=60))


LAM = """base AS (SELECT ticker, avg(ret) AS m, var_samp(ret) AS v FROM full_ret GROUP BY ticker),
lam AS (SELECT avg(v) / (avg(v) + var_pop(m)) AS lam, avg(m) AS grand FROM base)"""


def _shrunk_sql(target: str) -> str:
    return sql([*BASE, LAM], f"SELECT ticker, 12 * ((1 - lam) * m + lam * {target}) AS mu FROM base, lam", **MU_COLS)


@query("mu_shrunk", _shrunk_sql("0"))
def mu_shrunk(spark, d):
    return tidy(M.mu_shrunk(brand_panel(spark, d)))


@query("mu_shrunk_equal", _shrunk_sql("grand"))
def mu_shrunk_equal(spark, d):
    r = brand_panel(spark, d)
    return tidy(M.mu_shrunk(r, target=M.shrink_target(r, "equal")))


@query("mu_shrunk_rf", _shrunk_sql("(0.03 / 12)"))
def mu_shrunk_rf(spark, d):
    r = brand_panel(spark, d)
    return tidy(M.mu_shrunk(r, target=M.shrink_target(r, "rf", rf_annual=0.03, per_year=12)))


@query(
    "shrink_mu",
    sql(BASE, """SELECT ticker, 0.7 * m + 0.3 * avg(m) OVER () AS mu
                 FROM (SELECT ticker, avg(ret) AS m FROM full_ret GROUP BY ticker)""", **MU_COLS),
)
def shrink_mu(spark, d):
    r = brand_panel(spark, d)
    return tidy(M.shrink_mu(M.mu_historical(r, annualize=False), M.shrink_target(r, "equal"), 0.3))


def _capm_sql(index: str, covar: str) -> str:
    return sql(
        [*BASE, f"market AS ({index})"],
        f"""SELECT ticker, 12 * (0.001 + {covar}(ret, rm) / any_value(vm) * (any_value(em) - 0.001)) AS mu
            FROM full_ret JOIN market USING (date), (SELECT avg(rm) AS em, var_samp(rm) AS vm FROM market)
            GROUP BY ticker""",
        **MU_COLS,
    )


PROXY = "SELECT date, avg(ret) AS rm FROM full_ret GROUP BY date"


@query("mu_capm", _capm_sql(PROXY, "covar_pop"))
def mu_capm(spark, d):
    return tidy(M.mu_capm(brand_panel(spark, d), rf=0.001))


@query("mu_capm_market_ticker", _capm_sql("SELECT date, ret AS rm FROM full_ret WHERE ticker = 'Brand#11'", "covar_pop"))
def mu_capm_market_ticker(spark, d):
    return tidy(M.mu_capm(brand_panel(spark, d), market="Brand#11", rf=0.001))


@query("mu_capm_textbook", _capm_sql(PROXY, "covar_samp"))
def mu_capm_textbook(spark, d):
    return tidy(M.mu_capm(brand_panel(spark, d), rf=0.001, textbook=True))


# --- covariance ---------------------------------------------------------------------------------------------------

POP = """pop AS (
  SELECT a.ticker AS i, b.ticker AS j, avg(a.x * b.x) AS s FROM centred a JOIN centred b ON a.date = b.date GROUP BY 1, 2),
facts AS (
  SELECT sum(s) FILTER (i = j) AS tr, count(*) FILTER (i = j) AS n, sum(s * s) AS sq,
         (SELECT count(DISTINCT date) FROM centred) AS t FROM pop)"""
OAS = """oas AS (
  SELECT i, j, (1 - k) * s + CASE WHEN i = j THEN k * m ELSE 0 END AS value
  FROM pop, (SELECT t, m, least(1, (a + m * m) / ((t + 1) * (a - m * m / n))) AS k
             FROM (SELECT tr / n AS m, sq / (n * n) AS a, n, t FROM facts)))"""
LW = """lw AS (
  SELECT i, j, (1 - k) * s + CASE WHEN i = j THEN k * m ELSE 0 END AS value
  FROM pop, (SELECT t, m, least(beta, delta) / delta AS k
             FROM (SELECT t, tr / n AS m, (sq - 2 * tr / n * tr + tr * tr / n) / n AS delta,
                          ((SELECT sum(r * r) FROM (SELECT sum(x * x) AS r FROM centred GROUP BY date)) / t - sq) / (n * t) AS beta
                   FROM facts)))"""


@query("cov_sample", sql(C.RISK[:-1], "SELECT i, j, 12 * value AS value FROM sigma", **COV_COLS))
def cov_sample(spark, d):
    return tidy(G.covariance(brand_panel(spark, d), method="sample", store=hand_off), 8)


@query("cov_oas", sql([*BASE, C.CENTRED, POP, OAS], "SELECT i, j, 12 * value AS value FROM oas", **COV_COLS))
def cov_oas(spark, d):
    return tidy(G.covariance(brand_panel(spark, d), method="oas", store=hand_off), 8)


@query("cov_ledoit_wolf", sql([*BASE, C.CENTRED, POP, LW], "SELECT i, j, 12 * value AS value FROM lw", **COV_COLS))
def cov_ledoit_wolf(spark, d):
    return tidy(G.covariance(brand_panel(spark, d), method="lw", store=hand_off), 8)


@query(
    "cov_ewma",
    sql(
        [*BASE, C.CENTRED,
         """aged AS (SELECT date, 0.06 * power(0.94, age) AS w FROM (
              SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM full_ret)))"""],
        """SELECT a.ticker AS i, b.ticker AS j, 12 * sum(w * a.x * b.x) AS value
           FROM centred a JOIN centred b ON a.date = b.date JOIN aged ON aged.date = a.date GROUP BY 1, 2""",
        **COV_COLS,
    ),
)
def cov_ewma(spark, d):
    return tidy(G.covariance(brand_panel(spark, d), method="ewma", store=hand_off), 8)


@query(
    "cov_fallback",
    sql(C.RISK[:-1], "SELECT i, j, value, 'sample' AS estimator FROM sigma", **{**COV_COLS, "plain": ["i", "j", "estimator"]}),
)
def cov_fallback(spark, d):
    """Fewer dates than asked for: the shrinkage estimate gives way to the sample one."""
    r = brand_panel(spark, d)
    return tidy(G.covariance(r, method="oas", min_periods=10_000, annualize=False, store=hand_off), 8)


FILLED_SIGMA = """fc AS (SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM filled)"""


@query(
    "cov_mean_fill",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK, C.FILLED, FILLED_SIGMA],
        """SELECT a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / ((SELECT count(DISTINCT date) FROM fc) - 1) AS value
           FROM fc a JOIN fc b ON a.date = b.date GROUP BY 1, 2""",
        **COV_COLS,
    ),
)
def cov_mean_fill(spark, d):
    return tidy(G.covariance(brand_panel(spark, d, "1w"), method="sample", fill="mean", annualize=False, store=hand_off), 8)


SUPP_SIGMA = """sfill AS (
  SELECT d.date, t.ticker, coalesce(r.ret, t.m) - t.m AS x
  FROM (SELECT DISTINCT date FROM sret) d CROSS JOIN (SELECT ticker, avg(ret) AS m FROM sret GROUP BY ticker) t
  LEFT JOIN sret r ON r.date = d.date AND r.ticker = t.ticker)"""


@query(
    "cov_sample_supplier",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET, SUPP_SIGMA],
        """SELECT a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / ((SELECT count(DISTINCT date) FROM sfill) - 1) AS value
           FROM sfill a JOIN sfill b ON a.date = b.date GROUP BY 1, 2""",
        **COV_COLS,
    ),
)
def cov_sample_supplier(spark, d):
    """The wide case: as many tickers as there are suppliers."""
    return tidy(G.covariance(hand_off(D.supplier_returns(spark, d), "returns"), method="sample", fill="mean", annualize=False, store=hand_off), 8)


@query(
    "cov_by_universe",
    sql([C.SEG_RET], "SELECT * FROM usigma", floats=["value"], plain=["universe_id", "i", "j"], digits=8),
)
def cov_by_universe(spark, d):
    return tidy(G.covariance(
        hand_off(D.segment_returns(spark, d), "returns"), method="sample", annualize=False, store=hand_off
    ), 8)


@query("matrix_roundtrip", sql(C.RISK[:-1], "SELECT i, j, value FROM sigma", **COV_COLS))
def matrix_roundtrip(spark, d):
    root, cfg = shared_folder(spark), {"data": d, "matrix": "sample"}
    returns = brand_panel(spark, d)
    artifacts.write_matrix(G.covariance(returns, method="sample", annualize=False, store=hand_off), root, "sigma", cfg)
    return tidy(artifacts.read_matrix(spark, root, "sigma", cfg), 8)


@query("correlation", sql([*C.RISK[:-1], C.CORR], "SELECT * FROM corr", **COV_COLS))
def correlation(spark, d):
    return tidy(G.correlation(brand_sigma(spark, d)), 8)


@query(
    "ridge",
    sql(C.RISK[:-1], "SELECT i, j, value + CASE WHEN i = j THEN 0.001 ELSE 0 END AS value FROM sigma", **COV_COLS),
)
def ridge(spark, d):
    return tidy(G.ridge(brand_sigma(spark, d), 0.001), 8)


@query(
    "stress_scenario",
    sql(C.RISK[:-1], "SELECT i, j, value * CASE WHEN i = j THEN 1.44 ELSE 0.72 END AS value FROM sigma", **COV_COLS),
)
def stress_scenario(spark, d):
    return tidy(G.stress_scenario(brand_sigma(spark, d)), 8)


@query(
    "effective_rank",
    sql(
        C.RISK[:-1],
        "SELECT power(sum(value) FILTER (i = j), 2) / sum(value * value) AS effective_rank FROM sigma",
        floats=["effective_rank"],
    ),
)
def effective_rank(spark, d):
    return tidy(G.effective_rank(brand_sigma(spark, d)))


def _segment_sigma(spark, d):
    """One sample covariance per market segment, from quarterly returns."""
    returns = hand_off(D.segment_returns(spark, d), "returns")
    return hand_off(G.covariance(returns, method="sample", annualize=False, store=hand_off), "sigma")


@query(
    "spectrum",
    sql(
        [C.SEG_RET],
        """SELECT universe_id, count(DISTINCT i) AS n, sum(value) FILTER (i = j) AS total, sum(value * value) AS squares,
                  TRUE AS descending, 1.0 AS last_cumulative FROM usigma GROUP BY 1""",
        ints=["n"], floats=["total", "squares", "last_cumulative"], plain=["universe_id", "descending"],
    ),
)
def spectrum(spark, d):
    """Eigenvalues add up to the trace, their squares to the squared entries, and come in falling order; per universe."""
    from pyspark.sql import Window as W

    falls = F.col("eigenvalue") <= F.lag("eigenvalue").over(W.partitionBy("universe_id").orderBy("k"))
    values = G.spectrum(_segment_sigma(spark, d)).withColumn("_down", F.coalesce(falls, F.lit(True)))
    return tidy(
        values.groupBy("universe_id").agg(
            F.count("k").alias("n"),
            F.sum("eigenvalue").alias("total"),
            F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares"),
            F.bool_and("_down").alias("descending"),
            F.max("cumulative").alias("last_cumulative"),
        )
    )


@query(
    "spectrum_diagnostics",
    sql(
        [C.SEG_RET],
        """SELECT universe_id, TRUE AS min_below_mean, TRUE AS max_above_mean, TRUE AS condition_is_ratio, TRUE AS rank_is_ratio,
                  sum(value) FILTER (i = j) / count(*) FILTER (i = j) AS mean_eigenvalue FROM usigma GROUP BY 1""",
        floats=["mean_eigenvalue"], plain=["universe_id", "min_below_mean", "max_above_mean", "condition_is_ratio", "rank_is_ratio"],
    ),
)
def spectrum_diagnostics(spark, d):
    """Extreme eigenvalues lie around their mean, which is the mean variance; condition and effective rank follow from them
    (clipping an eigenvalue that rounding made negative moves the rank a little)."""
    s = _segment_sigma(spark, d)
    on_diag = F.when(F.col("i") == F.col("j"), F.col("value"))
    facts = s.groupBy("universe_id").agg(
        F.avg(on_diag).alias("mean_eigenvalue"), (F.pow(F.sum(on_diag), 2) / F.sum(F.col("value") * F.col("value"))).alias("_rank")
    )
    ratio = F.col("lambda_max") / F.greatest(F.col("lambda_min"), F.lit(1e-16))
    mean = F.col("mean_eigenvalue")
    return tidy(
        G.spectrum_diagnostics(s).join(facts, "universe_id").select(
            "universe_id",
            (F.col("lambda_min") <= mean).alias("min_below_mean"),
            (F.col("lambda_max") >= mean).alias("max_above_mean"),
            (F.abs(F.col("condition") / ratio - 1) < 1e-9).alias("condition_is_ratio"),
            (F.abs(F.col("effective_rank") / F.col("_rank") - 1) < 1e-6).alias("rank_is_ratio"),
            "mean_eigenvalue",
        )
    )


@query(
    "psd_clip",
    sql(
        [C.SEG_RET],
        "SELECT universe_id, count(DISTINCT i) AS n, TRUE AS is_symmetric, TRUE AS psd, TRUE AS diag_not_below FROM usigma GROUP BY 1",
        ints=["n"], plain=["universe_id", "is_symmetric", "psd", "diag_not_below"],
    ),
)
def psd_clip(spark, d):
    """Quarterly panels have about as many tickers as dates, so the clip has work to do; per universe."""
    returns = hand_off(D.segment_returns(spark, d), "returns")
    s = hand_off(G.covariance(returns, method="sample", annualize=False, store=hand_off), "sigma")
    p = hand_off(G.psd_clip(s, 1e-6), "psd")
    lowest = G.spectrum_diagnostics(p).select("universe_id", (F.col("lambda_min") >= 1e-6 - 1e-10).alias("psd"))
    turned = p.select("universe_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("t"))
    both = p.join(turned, ["universe_id", "i", "j"]).join(s.withColumnRenamed("value", "raw"), ["universe_id", "i", "j"])
    on_diag = F.col("i") == F.col("j")
    facts = both.groupBy("universe_id").agg(
        F.count_if(on_diag).alias("n"),
        (F.max(F.abs(F.col("value") - F.col("t"))) < 1e-12).alias("is_symmetric"),
        F.bool_and(~on_diag | (F.col("value") >= F.col("raw") - 1e-12)).alias("diag_not_below"),
    )
    return facts.join(lowest, "universe_id").select("universe_id", "n", "is_symmetric", "psd", "diag_not_below")


@query(
    "cov_pca_factor",
    sql(
        [C.SEG_RET], "SELECT universe_id, i AS ticker, value AS variance, TRUE AS closer_than_diagonal FROM usigma WHERE i = j",
        floats=["variance"], plain=["universe_id", "ticker", "closer_than_diagonal"], digits=8,
    ),
)
def cov_pca_factor(spark, d):
    """The factor model keeps every variance and explains more covariance than the diagonal alone, in each universe."""
    s = _segment_sigma(spark, d)
    model = hand_off(G.cov_pca_factor(s, 5).withColumnRenamed("value", "model"), "model")
    off = F.col("i") != F.col("j")
    missed = F.sum(F.when(off, F.pow(F.col("value") - F.col("model"), 2)))
    gap = s.join(model, ["universe_id", "i", "j"]).groupBy("universe_id").agg(
        (missed < F.sum(F.when(off, F.col("value") * F.col("value")))).alias("closer_than_diagonal")
    )
    rows = model.where("i = j").join(gap, "universe_id")
    return tidy(rows.select("universe_id", F.col("i").alias("ticker"), F.col("model").alias("variance"), "closer_than_diagonal"), 8)


# --- equilibrium and views ----------------------------------------------------------------------------------------

@query(
    "mu_equilibrium",
    sql(
        [*BASE, C.CENTRED, POP, OAS, C.BENCH],
        "SELECT i AS ticker, 12 * 2.5 * sum(value * weight) AS mu FROM oas JOIN bench ON bench.ticker = oas.j GROUP BY i",
        **MU_COLS,
    ),
)
def mu_equilibrium(spark, d):
    return tidy(M.mu_equilibrium(brand_panel(spark, d), market_weights=D.brand_benchmark(spark, d), store=hand_off))


@query(
    "mu_equilibrium_equal_weight",
    sql([*BASE, C.CENTRED, POP, OAS], "SELECT i AS ticker, 12 * 2.5 * avg(value) AS mu FROM oas GROUP BY i", **MU_COLS),
)
def mu_equilibrium_equal_weight(spark, d):
    return tidy(M.mu_equilibrium(brand_panel(spark, d), store=hand_off))


@query(
    "bl_views",
    sql(
        [C.HOLD, C.VIEWS], "SELECT * FROM picks",
        floats=["coef", "q", "conf"], ints=["view_id"], plain=["portfolio_id", "ticker"],
    ),
)
def bl_views(spark, d):
    return tidy(M.bl_views(D.customer_views(spark, d), D.brand_benchmark(spark, d)))


@query(
    "bl_unknown_assets",
    sql(
        [C.HOLD, C.VIEWS],
        """SELECT portfolio_id, view_id, ticker FROM (
             SELECT portfolio_id, view_id, ticker FROM picks
             UNION ALL SELECT portfolio_id, 3, 'Manufacturer#' || substr(top, 7, 1) FROM tops)
           WHERE ticker NOT IN (SELECT p_brand FROM part WHERE p_brand IS NOT NULL)""",
        ints=["view_id"], plain=["portfolio_id", "ticker"],
    ),
)
def bl_unknown_assets(spark, d):
    """A third view sets each first one's brand against its manufacturer, which is no asset."""
    views = D.customer_views(spark, d)
    maker = F.concat(F.lit("Manufacturer#"), F.substring("long", 7, 1))
    third = views.where("view_id = 1").withColumn("view_id", F.lit(3).cast("bigint")).withColumn("short", maker)
    return M.unknown_view_assets(views.unionByName(third), D.table(spark, d, "part").select(F.col("p_brand").alias("ticker")))


VIEW_RISK = """risk AS (
  SELECT a.portfolio_id, a.view_id, 0.05 * sum(a.coef * s.value * b.coef) AS base, any_value(a.conf) AS conf
  FROM picks a JOIN picks b ON a.portfolio_id = b.portfolio_id AND a.view_id = b.view_id
  JOIN sigma s ON s.i = a.ticker AND s.j = b.ticker GROUP BY 1, 2)"""


@query(
    "bl_omega",
    sql(
        [*C.RISK[:-1], C.HOLD, C.VIEWS, VIEW_RISK],
        "SELECT portfolio_id, view_id, 1000 * base / least(greatest(conf, 0.001), 1) AS omega FROM risk",
        floats=["omega"], ints=["view_id"], plain=["portfolio_id"],
    ),
)
def bl_omega(spark, d):
    picks = M.bl_views(hand_off(D.customer_views(spark, d), "views"), hand_off(D.brand_benchmark(spark, d), "bench"))
    return tidy(M.bl_omega(picks, brand_sigma(spark, d)).withColumn("omega", F.col("omega") * 1000))


POSTERIOR = """m AS (
  SELECT portfolio_id, view_id, s.j AS ticker, 0.05 * sum(coef * value) AS m
  FROM picks JOIN sigma s ON s.i = picks.ticker GROUP BY 1, 2, 3),
a AS (
  SELECT m.portfolio_id, m.view_id AS k, p.view_id AS l, sum(m.m * p.coef) AS a
  FROM m JOIN picks p ON p.portfolio_id = m.portfolio_id AND p.ticker = m.ticker GROUP BY 1, 2, 3),
r AS (
  SELECT portfolio_id, view_id, any_value(q) - sum(coef * mu) AS r FROM picks JOIN mu USING (ticker) GROUP BY 1, 2),
sys AS (
  SELECT r1.portfolio_id, a11.a + o1.base / o1.conf AS a11, a22.a + o2.base / o2.conf AS a22, a12.a AS a12, r1.r AS r1, r2.r AS r2
  FROM (SELECT * FROM r WHERE view_id = 1) r1
  JOIN (SELECT * FROM a WHERE k = 1 AND l = 1) a11 USING (portfolio_id)
  JOIN (SELECT * FROM risk WHERE view_id = 1) o1 USING (portfolio_id)
  LEFT JOIN (SELECT * FROM r WHERE view_id = 2) r2 USING (portfolio_id)
  LEFT JOIN (SELECT * FROM a WHERE k = 2 AND l = 2) a22 USING (portfolio_id)
  LEFT JOIN (SELECT * FROM a WHERE k = 1 AND l = 2) a12 USING (portfolio_id)
  LEFT JOIN (SELECT * FROM risk WHERE view_id = 2) o2 USING (portfolio_id)),
y AS (
  SELECT portfolio_id, CASE WHEN r2 IS NULL THEN r1 / a11 ELSE (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) END AS y1,
         coalesce((a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12), 0) AS y2 FROM sys)"""


@query(
    "bl_posterior",
    sql(
        [*C.RISK, C.HOLD, C.VIEWS, VIEW_RISK, POSTERIOR],
        """SELECT portfolio_id, ticker, mu.mu AS mu_prior, mu.mu + d AS mu_post, d AS delta FROM mu JOIN (
             SELECT portfolio_id, m.ticker, sum(m.m * CASE WHEN view_id = 1 THEN y1 ELSE y2 END) AS d
             FROM m JOIN y USING (portfolio_id) GROUP BY 1, 2) USING (ticker)""",
        floats=["mu_prior", "mu_post", "delta"], plain=["portfolio_id", "ticker"],
    ),
)
def bl_posterior(spark, d):
    r = brand_panel(spark, d)
    picks = hand_off(M.bl_views(hand_off(D.customer_views(spark, d), "views"), hand_off(D.brand_benchmark(spark, d), "bench")), "picks")
    sigma = hand_off(G.covariance(r, method="sample", annualize=False, store=hand_off), "sigma")
    return tidy(M.bl_posterior(M.mu_historical(r, annualize=False), sigma, picks, store=hand_off))


@query(
    "mu_prior_post",
    sql(
        [*BASE, LAM],
        """SELECT ticker, m AS mu_prior, (1 - lam) * m + lam * grand AS mu_post, (1 - lam) * m + lam * grand - m AS delta
           FROM base, lam""",
        floats=["mu_prior", "mu_post", "delta"], plain=["ticker"],
    ),
)
def mu_prior_post(spark, d):
    r = brand_panel(spark, d)
    post = M.mu_shrunk(r, target=M.shrink_target(r, "equal"), annualize=False)
    return tidy(M.mu_prior_post(M.mu_historical(r, annualize=False), post))


@query("mu_ranking", sql(BASE, "SELECT ticker, 12 * avg(ret) AS mu FROM full_ret GROUP BY ticker", **MU_COLS))
def mu_ranking(spark, d):
    return tidy(M.mu_ranking(M.mu_historical(brand_panel(spark, d))))


@query(
    "leading_factors",
    sql(
        C.RISK[:-1],
        "SELECT k, TRUE AS eigenpair, TRUE AS one_long, TRUE AS within_trace, (SELECT sum(value) FROM sigma WHERE i = j) AS trace FROM range(1, 6) r(k)",
        ints=["k"], floats=["trace"], plain=["eigenpair", "one_long", "within_trace"],
    ),
)
def leading_factors(spark, d):
    """The five largest eigenpairs without forming the matrix, checked against the matrix itself: covariance times loading is
    eigenvalue times loading, loadings have length one, and factor model and specific variances add up to the trace."""
    returns = brand_panel(spark, d)
    sigma = brand_sigma(spark, d)
    found = leading.leading_factors(returns, 5)
    loadings = hand_off(found.loadings, "loadings")
    turned = sigma.join(loadings.select(F.col("ticker").alias("j"), "k", "loading"), "j").groupBy(F.col("i").alias("ticker"), "k").agg(
        F.sum(F.col("value") * F.col("loading")).alias("sv")
    )
    first = found.eigenvalues.agg(F.max("eigenvalue").alias("largest"))
    both = attach(turned.join(loadings, ["ticker", "k"]).join(found.eigenvalues, "k"), first, [])
    gap = F.col("sv") - F.col("eigenvalue") * F.col("loading")
    checks = both.groupBy("k", "eigenvalue").agg(
        (F.sqrt(F.sum(gap * gap)) <= 1e-8 * F.max("largest")).alias("eigenpair"),
        (F.abs(F.sum(F.col("loading") * F.col("loading")) - 1.0) < 1e-9).alias("one_long"),
    )
    common = loadings.join(found.eigenvalues, "k").groupBy("ticker").agg(F.sum(F.col("loading") * F.col("loading") * F.col("eigenvalue")).alias("common"))
    trace = found.specific.join(common, "ticker").agg(
        F.sum("variance").alias("trace"), (F.max(F.col("common") + F.col("specific") - F.col("variance")) <= 1e-11).alias("within_trace")
    )
    return tidy(attach(checks, trace, []).select("k", "eigenpair", "one_long", "within_trace", "trace"))
