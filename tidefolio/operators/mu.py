"""Expected-return estimators and Black-Litterman views, all per ticker in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clip, shrink
from ..schema import attach, grouped, one_of, require, universe_keys
from ..session import Store, lazily
from .covariance import covariance
from .panel import apply_fill_policy, calendar
from .quality import infer_periodicity


def _scaled(mu: DataFrame, returns: DataFrame, annualize: bool) -> DataFrame:
    """Per-period means times the periods per year of the original panel."""
    by = universe_keys(returns)
    if annualize:
        periods = infer_periodicity(returns).select(*by, "per_year")
        mu = attach(mu, periods, by).withColumn("mu", F.col("mu") * F.col("per_year"))
    return mu.select(*by, "ticker", "mu")


def mu_historical(returns: DataFrame, *, annualize: bool = True, fill: str = "drop") -> DataFrame:
    by = universe_keys(returns)
    mu = apply_fill_policy(returns, fill).groupBy(*by, "ticker").agg(F.avg("ret").alias("mu"))
    return _scaled(mu, returns, annualize)


def mu_ema(returns: DataFrame, *, span: int = 60, annualize: bool = True, fill: str = "drop") -> DataFrame:
    """Last exponential mean (alpha = 2 / (span + 1), started at the first value).

    The recursion is unrolled into one weight per date of the dense panel, so it is a plain weighted sum.
    """
    by = universe_keys(returns)
    panel = apply_fill_policy(returns, fill)
    alpha = 2.0 / (span + 1.0)
    age = (F.col("n_dates") - F.col("idx")).cast("double")
    weight = F.pow(F.lit(1.0 - alpha), age) * F.when(F.col("idx") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    mu = (
        panel.join(calendar(panel), [*by, "date"])
        .groupBy(*by, "ticker")
        .agg(F.sum(weight * F.col("ret")).alias("mu"))
    )
    return _scaled(mu, returns, annualize)


def shrink_target(
    returns: DataFrame, kind: str, rf_annual: float = 0.0, per_year: int = 252, fill: str = "drop"
) -> DataFrame:
    """(ticker, target) per period: 'zero', 'equal' (grand mean) or 'rf' (annual rate over periods)."""
    one_of(kind, ("zero", "equal", "rf"), "target")
    by = universe_keys(returns)
    means = mu_historical(returns, annualize=False, fill=fill)
    if kind == "equal":
        return attach(means, grouped(means, by, F.avg("mu").alias("target")), by).select(*by, "ticker", "target")
    value = 0.0 if kind == "zero" else rf_annual / max(per_year, 1)
    return means.select(*by, "ticker", F.lit(float(value)).alias("target"))


def mu_shrunk(
    returns: DataFrame, *, target: DataFrame | None = None, annualize: bool = True, fill: str = "drop"
) -> DataFrame:
    """Means shrunk to a target (0 by default); the intensity weighs mean variance against the spread of the means."""
    by = universe_keys(returns)
    base = apply_fill_policy(returns, fill).groupBy(*by, "ticker").agg(
        F.avg("ret").alias("_mean"), F.var_samp("ret").alias("_var")
    )
    noise, spread = F.avg("_var"), F.coalesce(F.var_pop("_mean"), F.lit(0.0))
    lam = F.coalesce(F.try_divide(noise, noise + spread), F.lit(0.0))
    rows = attach(base, grouped(base, by, lam.alias("_lam")), by)
    if target is None:
        rows = rows.withColumn("target", F.lit(0.0))
    else:
        rows = rows.join(target.select(*by, "ticker", "target"), [*by, "ticker"], "left")
    mu = rows.withColumn("mu", shrink(F.col("_mean"), F.coalesce("target", F.lit(0.0)), F.col("_lam")))
    return _scaled(mu, returns, annualize)


def shrink_mu(mu: DataFrame, target: DataFrame, lam: float) -> DataFrame:
    by = universe_keys(mu)
    both = mu.join(target.select(*by, "ticker", "target"), [*by, "ticker"])
    return both.select(*by, "ticker", shrink(F.col("mu"), F.col("target"), lam).alias("mu"))


def mu_capm(
    returns: DataFrame,
    *,
    market: str = "SPY",
    rf: float = 0.0,
    fill: str = "drop",
    annualize: bool = True,
    textbook: bool = False,
) -> DataFrame:
    """rf + beta (E[Rm] - rf), against the market ticker or, where the panel has none, the mean over tickers.

    Beta is population covariance over sample variance; ``textbook`` uses sample moments in both places.
    Without market variance the historical mean is returned.
    """
    by = universe_keys(returns)
    panel = apply_fill_policy(returns, fill)
    own = F.max(F.when(F.col("ticker") == market, F.col("ret")))
    index = panel.groupBy(*by, "date").agg(F.coalesce(own, F.avg("ret")).alias("_rm"))
    facts = grouped(index, by, F.avg("_rm").alias("_em"), F.var_samp("_rm").alias("_vm"))
    covar = F.covar_samp if textbook else F.covar_pop
    per_ticker = panel.join(index, [*by, "date"]).groupBy(*by, "ticker").agg(
        covar("ret", "_rm").alias("_cov"), F.avg("ret").alias("_mean")
    )
    beta = F.col("_cov") / F.col("_vm")
    mu = F.when(F.col("_vm") > 0, rf + beta * (F.col("_em") - rf)).otherwise(F.col("_mean"))
    return _scaled(attach(per_ticker, facts, by).withColumn("mu", mu), returns, annualize)


def mu_equilibrium(
    returns: DataFrame,
    *,
    sigma: DataFrame | None = None,
    market_weights: DataFrame | None = None,
    delta: float = 2.5,
    cov_method: str = "oas",
    annualize: bool = True,
    fill: str = "drop",
    store: Store = lazily,
) -> DataFrame:
    """Equilibrium returns delta * Sigma * w; weights are normalised over the tickers of Sigma (a non-positive sum is an
    error) or equal."""
    by = universe_keys(returns)
    if sigma is None:
        sigma = covariance(returns, method=cov_method, annualize=False, fill=fill, store=store)
    if market_weights is None:
        products = sigma.groupBy(*by, F.col("i").alias("ticker")).agg(F.avg("value").alias("_sw"))
    else:
        require(market_weights, "ticker", "weight")
        keys = universe_keys(market_weights)
        names = sigma.where(F.col("i") == F.col("j")).select(*keys, F.col("i").alias("ticker")).distinct()
        market_weights = market_weights.join(names, [*keys, "ticker"], "left_semi")
        total = grouped(market_weights, keys, F.sum("weight").alias("_total"))
        share = F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(
            F.raise_error(F.lit("market weights must have a positive sum")).cast("double")
        )
        shares = attach(market_weights, total, keys).select(*keys, F.col("ticker").alias("j"), share.alias("_w"))
        products = (
            sigma.join(shares, [*keys, "j"])
            .groupBy(*by, F.col("i").alias("ticker"))
            .agg(F.sum(F.col("value") * F.col("_w")).alias("_sw"))
        )
    return _scaled(products.withColumn("mu", delta * F.col("_sw")), returns, annualize)


# --- views --------------------------------------------------------------------------------------------------------

def _legs(views: DataFrame) -> DataFrame:
    """Views (portfolio_id, view_id, long, short, q, conf) as pick rows; an absolute view has no short side."""
    require(views, "portfolio_id", "view_id", "long", "short", "q", "conf")
    legs = F.array(
        F.struct(F.col("long").alias("ticker"), F.lit(1.0).alias("coef")),
        F.struct(F.col("short").alias("ticker"), F.lit(-1.0).alias("coef")),
    )
    return views.select("portfolio_id", "view_id", F.inline(legs), "q", "conf").where(F.col("ticker").isNotNull())


def unknown_view_assets(views: DataFrame, universe: DataFrame) -> DataFrame:
    names = universe.select("ticker").distinct()
    return _legs(views).join(names, "ticker", "left_anti").select("portfolio_id", "view_id", "ticker")


def bl_views(views: DataFrame, universe: DataFrame) -> DataFrame:
    """Pick table (portfolio_id, view_id, ticker, coef, q, conf); a ticker outside the universe fails the job."""
    names = universe.select("ticker").distinct().withColumn("_known", F.lit(True))
    error = F.raise_error(F.concat(F.lit("view asset not in universe: "), F.col("ticker"))).cast("double")
    return (
        _legs(views)
        .join(names, "ticker", "left")
        .select(
            "portfolio_id",
            "view_id",
            "ticker",
            F.when(F.col("_known"), F.col("coef")).otherwise(error).alias("coef"),
            "q",
            "conf",
        )
    )


def bl_omega(
    picks: DataFrame, sigma: DataFrame, *, tau: float = 0.05, scalar_conf: float | None = None, use_conf: bool = True
) -> DataFrame:
    """View uncertainty: diagonal of P tau Sigma P' over confidence (clipped to [0.001, 1]).

    The legs of a view are few (two for a relative view), so the self-join runs over legs only.
    """
    a = picks.select("portfolio_id", "view_id", F.col("ticker").alias("i"), F.col("coef").alias("_ci"), "conf")
    b = picks.select("portfolio_id", "view_id", F.col("ticker").alias("j"), F.col("coef").alias("_cj"))
    cells = a.join(b, ["portfolio_id", "view_id"]).join(sigma.select("i", "j", "value"), ["i", "j"])
    base = F.sum(F.col("_ci") * F.col("value") * F.col("_cj")) * tau
    if not use_conf:
        omega = base + 1e-12
    else:
        conf = F.lit(float(scalar_conf)) if scalar_conf is not None else F.first("conf")
        omega = base / clip(conf, 1e-3, 1.0)
    return cells.groupBy("portfolio_id", "view_id").agg(omega.alias("omega"))


def bl_posterior(
    mu: DataFrame,
    sigma: DataFrame,
    picks: DataFrame,
    *,
    tau: float = 0.05,
    scalar_conf: float | None = None,
    use_conf: bool = True,
    per_year: float = 1.0,
    portfolios: DataFrame | None = None,
    store: Store = lazily,
) -> DataFrame:
    """Posterior means per portfolio: mu + tau Sigma P' (P tau Sigma P' + Omega)^-1 (Q - P mu).

    Without ``portfolios`` there is a row for each portfolio with views; those listed there without any keep the prior.
    ``mu`` and ``sigma`` are annual; views are per period. All products are joins and sums; only the small system of
    one portfolio's views is solved inside a group.
    """
    prior = mu.select("ticker", (F.col("mu") / per_year).alias("_prior"))
    cov = sigma.select("i", "j", (F.col("value") / per_year).alias("value"))
    spread = store(
        picks.select("portfolio_id", "view_id", F.col("ticker").alias("i"), "coef")
        .join(cov, "i")
        .groupBy("portfolio_id", "view_id", F.col("j").alias("ticker"))
        .agg((F.sum(F.col("coef") * F.col("value")) * tau).alias("_m")),
        "spread",
    )
    other = picks.select("portfolio_id", F.col("view_id").alias("_l"), "ticker", "coef")
    gram = (
        spread.join(other, ["portfolio_id", "ticker"])
        .groupBy("portfolio_id", "view_id", "_l")
        .agg(F.sum(F.col("_m") * F.col("coef")).alias("_a"))
    )
    surprise = (
        picks.join(prior, "ticker")
        .groupBy("portfolio_id", "view_id")
        .agg((F.first("q") - F.sum(F.col("coef") * F.col("_prior"))).alias("_r"))
    )
    omega = bl_omega(picks, cov, tau=tau, scalar_conf=scalar_conf, use_conf=use_conf)
    square = gram.groupBy("portfolio_id").agg(
        F.array_sort(F.collect_list(F.struct("view_id", "_l", "_a"))).alias("_cells")
    )
    sides = (
        surprise.join(omega, ["portfolio_id", "view_id"])
        .groupBy("portfolio_id")
        .agg(F.array_sort(F.collect_list(F.struct("view_id", "_r", "omega"))).alias("_sides"))
    )
    systems = square.join(sides, "portfolio_id").select(
        "portfolio_id",
        F.transform("_cells", lambda c: c["_a"]).alias("a"),
        F.transform("_sides", lambda c: c["view_id"]).alias("ids"),
        F.transform("_sides", lambda c: c["_r"]).alias("r"),
        F.transform("_sides", lambda c: c["omega"]).alias("omega"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [
                np.linalg.solve(np.asarray(a).reshape(len(r), -1) + np.diag(omega), r)
                for a, r, omega in zip(pdf["a"], pdf["r"], pdf["omega"])
            ]
            sizes = [len(y) for y in answers]
            if sizes:
                yield pd.DataFrame(
                    {
                        "portfolio_id": np.repeat(pdf["portfolio_id"].to_numpy(), sizes),
                        "view_id": np.concatenate(list(pdf["ids"])),
                        "_y": np.concatenate(answers),
                    }
                )

    multipliers = systems.mapInPandas(solve, "portfolio_id string, view_id long, _y double")
    moves = (
        spread.join(multipliers, ["portfolio_id", "view_id"])
        .groupBy("portfolio_id", "ticker")
        .agg(F.sum(F.col("_m") * F.col("_y")).alias("_move"))
    )
    if portfolios is not None:
        silent = portfolios.select("portfolio_id").distinct().join(picks.select("portfolio_id"), "portfolio_id", "left_anti")
        names = prior.agg(F.collect_list("ticker").alias("_names"))  # one universe's tickers
        kept = attach(silent, names, []).select("portfolio_id", F.explode("_names").alias("ticker"), F.lit(0.0).alias("_move"))
        moves = moves.unionByName(kept)
    return moves.join(prior, "ticker").select(
        "portfolio_id",
        "ticker",
        (F.col("_prior") * per_year).alias("mu_prior"),
        ((F.col("_prior") + F.col("_move")) * per_year).alias("mu_post"),
        (F.col("_move") * per_year).alias("delta"),
    )


def mu_prior_post(prior: DataFrame, post: DataFrame) -> DataFrame:
    """Prior, posterior and change per ticker, largest change first."""
    both = prior.select("ticker", F.col("mu").alias("mu_prior")).join(
        post.select("ticker", F.col("mu").alias("mu_post")), "ticker"
    )
    return both.withColumn("delta", F.col("mu_post") - F.col("mu_prior")).orderBy(F.desc("delta"), "ticker")


def mu_ranking(mu: DataFrame) -> DataFrame:
    return mu.orderBy(F.desc_nulls_last("mu"), "ticker")
