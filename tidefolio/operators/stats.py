"""Winsorising, summary statistics, rolling measures, and statistics of portfolio return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import clip
from ..schema import attach, grouped, require, universe_keys
from .panel import calendar, date_totals, running, with_halo
from .quantiles import exact_quantiles, quantiles_with_tails

ROLL_CHUNK = 4096  # positions of one series per window partition


def _winsorize(returns: DataFrame, q: float, method: str) -> DataFrame:
    require(returns, "date", "ticker", "ret")
    keys = [*universe_keys(returns), "ticker"]
    bounds = exact_quantiles(returns, keys, "ret", {"_lo": q, "_hi": 1.0 - q}, method)
    clipped = F.when(F.col("ret").isNotNull(), clip(F.col("ret"), F.col("_lo"), F.col("_hi")))
    return returns.join(bounds, keys, "left").select(*keys[:-1], "date", "ticker", clipped.alias("ret_w"))


def winsorize(returns: DataFrame, q: float = 0.01) -> DataFrame:
    """Clip to the q and 1-q quantiles per ticker, quantiles taken at the nearest rank."""
    return _winsorize(returns, q, "nearest")


def winsorize_linear(returns: DataFrame, q: float = 0.01, exact: bool = True) -> DataFrame:
    """Same with interpolated quantiles; ``exact=False`` uses the approximate sketch in one pass."""
    if exact:
        return _winsorize(returns, q, "linear")
    keys = [*universe_keys(returns), "ticker"]
    bounds = returns.groupBy(*keys).agg(F.percentile_approx("ret", [q, 1.0 - q]).alias("_b"))
    clipped = F.when(F.col("ret").isNotNull(), clip(F.col("ret"), F.col("_b")[0], F.col("_b")[1]))
    return returns.join(bounds, keys, "left").select(*keys[:-1], "date", "ticker", clipped.alias("ret_w"))


def summary_stats(returns: DataFrame, *, risk_free: float = 0.0, col: str = "ret") -> DataFrame:
    """Mean, sd (ddof 1), population skewness and excess kurtosis, Sharpe ratio, observations and missing share."""
    by = universe_keys(returns)
    per_ticker = returns.groupBy(*by, "ticker").agg(
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.skewness(col).alias("skew"),
        F.kurtosis(col).alias("kurt"),
        F.count(col).alias("n_obs"),
    )
    sharpe = F.when(F.col("std") > 0, (F.col("mean") - risk_free) / F.col("std"))
    missing = (F.col("n_dates") - F.col("n_obs")) / F.col("n_dates") * 100.0
    return attach(per_ticker, date_totals(returns), by).select(
        *by, "ticker", "mean", "std", "skew", "kurt", sharpe.alias("sharpe"), "n_obs", missing.alias("missing_pct")
    )


def rolling_vol(returns: DataFrame, window: int = 26) -> DataFrame:
    """Rolling sd over ``window`` consecutive dates of the panel; NULL until all of them hold a value.

    Frames run on calendar positions, in chunks with an overlap, so no series needs a task of its own.
    """
    by = universe_keys(returns)
    placed = returns.select(*by, "date", "ticker", "ret").join(calendar(returns), [*by, "date"])
    frame = W.partitionBy(*by, "ticker", "_chunk").orderBy("idx").rangeBetween(-(window - 1), 0)
    full = F.count("ret").over(frame) == window
    vol = F.when(full, F.stddev_samp("ret").over(frame))
    return (
        with_halo(placed, "idx", ROLL_CHUNK, window - 1)
        .withColumn("vol", vol)
        .where("_chunk = _own")
        .select(*by, "date", "ticker", "vol")
    )


def _pair(returns: DataFrame, a: str, b: str, overlap: int) -> DataFrame:
    by = universe_keys(returns)
    both = (
        returns.where(F.col("ticker").isin(a, b))
        .groupBy(*by, "date")
        .agg(
            F.max(F.when(F.col("ticker") == a, F.col("ret"))).alias("_a"),
            F.max(F.when(F.col("ticker") == b, F.col("ret"))).alias("_b"),
        )
    )
    return with_halo(calendar(returns).join(both, [*by, "date"], "left"), "idx", ROLL_CHUNK, overlap)


def rolling_corr(returns: DataFrame, a: str, b: str, window: int = 26) -> DataFrame:
    """Plain correlation of two tickers over ``window`` dates."""
    by = universe_keys(returns)
    frame = W.partitionBy(*by, "_chunk").orderBy("idx").rangeBetween(-(window - 1), 0)
    both = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(1))
    corr = F.when(F.count(both).over(frame) == window, F.corr("_a", "_b").over(frame))
    return _pair(returns, a, b, window - 1).withColumn("corr", corr).where("_chunk = _own").select(*by, "date", "corr")


def rolling_corr_ref(returns: DataFrame, a: str, b: str, window: int = 26) -> DataFrame:
    """Two-pass form: the rolling mean of products of residuals, each residual against its own date's rolling mean,
    over the product of the two rolling sds (ddof 1)."""
    by = universe_keys(returns)
    frame = W.partitionBy(*by, "_chunk").orderBy("idx").rangeBetween(-(window - 1), 0)

    def full(name: str, value):
        return F.when(F.count(name).over(frame) == window, value)

    first = _pair(returns, a, b, 2 * (window - 1))
    for c in ("_a", "_b"):
        first = first.withColumn(c + "_res", F.col(c) - full(c, F.avg(c).over(frame)))
        first = first.withColumn(c + "_sd", full(c, F.stddev_samp(c).over(frame)))
    second = first.withColumn("_prod", F.col("_a_res") * F.col("_b_res"))
    corr = F.try_divide(full("_prod", F.avg("_prod").over(frame)), F.col("_a_sd") * F.col("_b_sd"))
    return second.withColumn("corr", corr).where("_chunk = _own").select(*by, "date", "corr")


# --- statistics of loss and return series ----------------------------------------------------------------------

def cvar_estimate(series: DataFrame, alpha: float = 0.95, *, value: str = "ret", by: list[str] | None = None) -> DataFrame:
    """Mean of the returns at or below the (1 - alpha) quantile, per group."""
    by = ["portfolio_id"] if by is None else by
    return quantiles_with_tails(series, by, value, {"var": 1.0 - alpha}, upper=False).withColumnRenamed("var_tail", "cvar")


def loss_var_es(
    losses: DataFrame, alphas: tuple[float, ...] = (0.95, 0.99), *, value: str = "loss", by: list[str] | None = None
) -> DataFrame:
    """Value at risk (loss quantile) and expected shortfall (mean of losses at or above it) for several levels."""
    by = by or []
    names = {f"_var{i}": a for i, a in enumerate(alphas)}
    wide = quantiles_with_tails(losses, by, value, names)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(a)).alias("alpha"),
                F.col(n).alias("var"),
                F.col(n + "_tail").alias("es"),
            )
            for n, a in names.items()
        ]
    )
    return wide.select(*by, F.inline(rows))


def loss_histogram(losses: DataFrame, bins: int = 60, *, value: str = "loss", by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the smallest and the largest loss, empty ones too, with the share of observations in each."""
    by = by or []
    x = F.col(value)
    clean = losses.where(x.isNotNull())
    span = grouped(clean, by, F.min(x).alias("_min"), F.max(x).alias("_max"), F.count(x).alias("_n"))
    width = (F.col("_max") - F.col("_min")) / bins
    bin_ = F.least(F.coalesce(F.floor(F.try_divide(x - F.col("_min"), width)), F.lit(0)), F.lit(bins - 1))
    counts = attach(clean, span, by).groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.where(F.col("_n") > 0).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_min") + F.col("bin") * width).alias("left_edge"),
        (F.col("_min") + (F.col("bin") + 1) * width).alias("right_edge"),
        n.alias("n"),
        (n / F.col("_n")).alias("probability"),
    )


def drawdown(equity: DataFrame, *, value: str = "equity", by: list[str] | None = None) -> DataFrame:
    """Fall from the running peak; 0 while the peak is not positive. One row per run and date."""
    by = ["run_id"] if by is None else by
    peak = F.col("_peak")
    dd = F.when((peak > 0) & F.col(value).isNotNull(), F.col(value) / peak - 1.0).otherwise(F.lit(0.0))
    return running(equity, by, F.col(value), "max", "_peak").withColumn("drawdown", dd).drop("_peak")
