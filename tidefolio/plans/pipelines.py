"""The three end-to-end flows: prices to clean returns, returns to a risk model, risk model to weights."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import annualize as scale
from ..operators import allocate, covariance as cov, mu as mus, panel, quality, returns as rets, stats
from ..operators.portfolio import benchmark_weights
from ..schema import attach, one_of, universe_keys
from ..session import Store, lazily
from ..sources.artifacts import with_fingerprint


class DataRun(NamedTuple):
    returns: DataFrame
    coverage: DataFrame
    dropped: DataFrame
    missing: DataFrame
    gaps: DataFrame
    top_moves: DataFrame
    stats: DataFrame
    ranges: DataFrame
    meta: DataFrame


def data_pipeline(
    prices: DataFrame,
    *,
    freq_prices: str = "1w",
    ret_kind: str = "log",
    winsor_p: float = 0.01,
    freq_returns: str | None = None,
    gap_days: int = 3,
    top_k: int = 5,
    store: Store = lazily,
) -> DataRun:
    """Coverage guard, resampled returns, winsorising, change of frequency, and the reports on all of it.

    ``returns`` has columns date, ticker, ret (winsorised). ``store`` is applied to the cleaned prices, the raw
    returns and the final returns, each of which several reports read.
    """
    prices = store(panel.canonicalize(prices), "prices")
    price_cov = quality.price_coverage(prices)
    alive = panel.apply_universe(prices, price_cov, min_obs=2)
    raw = store(rets.returns_from_prices(alive, freq=freq_prices, kind=ret_kind), "raw_returns")
    final = stats.winsorize(raw, q=winsor_p).withColumnRenamed("ret_w", "ret")
    if freq_returns is not None and freq_returns != freq_prices:
        final = rets.returns_to_frequency(final, freq=freq_returns, kind=ret_kind)
    final = store(final, "returns")
    ret_cov = quality.return_coverage(final)
    kept = panel.apply_universe(final, ret_cov, min_obs=2, count_col="n_obs")
    meta = quality.dataset_stats(alive).select(
        "*",
        F.lit(ret_kind).alias("ret_kind"),
        F.lit(freq_prices).alias("freq_prices"),
        F.lit(freq_returns or freq_prices).alias("freq_returns"),
        F.lit(float(winsor_p)).alias("winsor_p"),
    )
    return DataRun(
        returns=kept,
        coverage=quality.coverage_full(ret_cov, price_cov),
        dropped=quality.excluded_tickers(price_cov, ret_cov),
        missing=quality.missing_report(kept),
        gaps=quality.gaps_report(alive, gap_days),
        top_moves=quality.top_abs_moves(raw, top_k),
        stats=stats.summary_stats(kept),
        ranges=quality.effective_ranges(alive),
        meta=with_fingerprint(meta),
    )


class RiskModel(NamedTuple):
    mu: DataFrame
    sigma: DataFrame
    diagnostics: DataFrame
    fill_report: DataFrame
    meta: DataFrame


MU_METHODS = ("historical", "ema", "shrunk", "capm", "black-litterman")


def validate_returns(returns: DataFrame, order_col: str | None = None) -> DataFrame:
    """Canonical, unique, finite returns without empty or constant series."""
    clean = panel.canonicalize(returns, value="ret")
    if order_col is not None:
        keys = (*universe_keys(returns), "date", "ticker")
        clean = panel.dedupe_keep_last(clean, keys=keys, order_col=order_col).drop(order_col)
    return panel.drop_constant_series(panel.drop_empty_series(panel.finite_or_null(clean)))


def risk_model(
    returns: DataFrame,
    *,
    mu_method: str = "ema",
    mu_span: int = 60,
    shrink_target: str | None = None,
    rf_annual: float = 0.0,
    cov_method: str = "oas",
    ewma_lambda: float = 0.94,
    n_factors: int = 5,
    fill: str = "drop",
    ridge_eps: float = 0.0,
    stress: bool = False,
    psd: bool = False,
    market: str = "SPY",
    store: Store = lazily,
) -> RiskModel:
    """Annual mu and Sigma with conditioning before and after ridge and stress, and a row of settings with a fingerprint.

    CAPM and Black-Litterman means go with the sample covariance; 'pca' keeps ``n_factors`` of it.
    """
    one_of(mu_method, MU_METHODS, "mu_method")
    one_of(cov_method, (*cov.COV_METHODS, "pca"), "cov_method")
    by = universe_keys(returns)
    valid = store(validate_returns(returns), "valid")
    report = panel.fill_policy_report(valid, fill)
    filled = store(panel.apply_fill_policy(valid, fill), "filled")
    periods = quality.infer_periodicity(valid).select(*by, "per_year")
    dense = dict(annualize=False, fill="drop")  # nothing is missing any more, so nothing is dropped

    if mu_method == "historical":
        mu = mus.mu_historical(filled, **dense)
    elif mu_method == "ema":
        mu = mus.mu_ema(filled, span=mu_span, **dense)
    elif mu_method == "capm":
        mu = mus.mu_capm(filled, market=market, **dense)
    elif mu_method == "black-litterman":
        mu = mus.mu_equilibrium(filled, store=store, **dense)
    else:
        target = None
        if shrink_target == "rf":
            base = mus.mu_historical(filled, **dense)
            target = attach(base, periods, by).select(
                *by, "ticker", (F.lit(float(rf_annual)) / F.col("per_year")).alias("target")
            )
        elif shrink_target is not None:
            target = mus.shrink_target(filled, shrink_target)
        mu = mus.mu_shrunk(filled, target=target, **dense)

    sample_only = mu_method in ("capm", "black-litterman")
    method = "sample" if sample_only or cov_method == "pca" else cov_method
    sigma = cov.covariance(
        filled, method=method, ewma_lambda=ewma_lambda, psd=psd and not sample_only and cov_method != "pca",
        store=store, **dense,
    )
    if cov_method == "pca" and not sample_only:
        sigma = cov.cov_pca_factor(sigma, n_factors)

    mu = attach(mu, periods, by).select(*by, "ticker", scale(F.col("mu"), F.col("per_year")).alias("mu"))
    before = store(
        attach(sigma, periods, by).select(*by, "i", "j", scale(F.col("value"), F.col("per_year")).alias("value")),
        "sigma_raw",
    )
    after = cov.ridge(before, ridge_eps)
    after = cov.stress_scenario(after) if stress else after
    changed = stress or ridge_eps > 0
    after = store(after, "sigma") if changed else before
    post = cov.spectrum_diagnostics(after).withColumnRenamed("condition", "condition_post")
    pre = cov.spectrum_diagnostics(before).select(*by, F.col("condition").alias("condition_pre"))
    diagnostics = attach(attach(post, pre, by), periods, by)
    settings = dict(
        mu_method=mu_method, mu_span=mu_span, shrink_target=shrink_target, rf_annual=rf_annual, cov_method=cov_method,
        ewma_lambda=ewma_lambda, n_factors=n_factors, fill=fill, ridge_eps=ridge_eps, stress=stress, psd=psd, market=market,
    )
    span = quality.dataset_stats(valid.withColumnRenamed("ret", "price"))
    meta = span.select("*", *[F.lit(v).cast("string").alias(k) for k, v in settings.items()])
    return RiskModel(mu, after, diagnostics, report, with_fingerprint(meta))


def optimise_portfolios(
    portfolios: DataFrame,
    model: RiskModel,
    *,
    method: str = "mv_l2",
    bench: DataFrame | None = None,
    w_min: float = 0.0,
    w_max: float = 1.0,
    psd_eps: float = 1e-10,
    store: Store = lazily,
    **options,
) -> DataFrame:
    """Weights per portfolio by any construction method, with the solver's status.

    The solvers answer inside box and sum to rounding, and infeasible problems get equal weights, so nothing is projected
    again for export.
    """
    sigma = store(cov.psd_clip(model.sigma, psd_eps), "sigma_psd")
    if bench is None:
        bench = benchmark_weights(model.mu)
    weights = allocate.solve(
        portfolios, sigma, model.mu, method=method, bench=bench, ref=bench, w_min=w_min, w_max=w_max, **options
    )
    return weights.drop("residual")
