"""Resampling, returns, and change of frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.calendar import arrival_order, bucket_label, period_end
from ..functions.numeric import period_return
from ..schema import attach, one_of, require, universe_keys
from .panel import canonicalize, spine, with_previous
from .quality import infer_return_kind, infer_return_kind_by_series


def resample_last(prices: DataFrame, every: str = "1w") -> DataFrame:
    """Last price per ticker and window (left, right], labelled with the right edge.

    With a ``seq`` column the last ingested of several rows with the same stamp wins. One hash aggregate with
    fixed-width buffers and map-side combine: raw ticks are neither sorted nor shuffled row by row.
    """
    require(prices, "date", "ticker", "price")
    by = universe_keys(prices)
    ticks = canonicalize(
        prices.select(*by, "date", "ticker", "price", *(["seq"] if "seq" in prices.columns else []))
    )
    order = arrival_order(F.col("date"), F.col("seq")) if "seq" in ticks.columns else F.col("date")
    return (
        ticks.groupBy(*by, "ticker", bucket_label(F.col("date"), every).alias("label"))
        .agg(F.max_by("price", order).alias("price"))
        .select(*by, F.col("label").alias("date"), "ticker", "price")
    )


def returns_from_prices(
    prices: DataFrame, *, freq: str = "1w", kind: str = "log", drop_first: bool = True
) -> DataFrame:
    """Returns between consecutive windows. The lag runs on resampled rows, one per ticker and window."""
    by = universe_keys(prices)
    px = resample_last(prices, freq)
    before = F.lag("price").over(W.partitionBy(*by, "ticker").orderBy("date"))
    out = px.select(*by, "date", "ticker", period_return(F.col("price"), before, kind).alias("ret"))
    return out.where(F.col("ret").isNotNull()) if drop_first else out


def returns_on_grid(prices: DataFrame, kind: str = "log") -> DataFrame:
    """Returns against the previous row of the panel, without resampling.

    A return exists where the ticker has prices on both that date and the previous date of the whole panel, so the
    grid itself is not needed: each date is joined with its predecessor.
    """
    require(prices, "date", "ticker", "price")
    by = universe_keys(prices)
    days = with_previous(prices).select(*by, "date", "_prev_date")
    now = prices.select(*by, "date", "ticker", "price").join(days, [*by, "date"])
    earlier = prices.select(*by, F.col("date").alias("_prev_date"), "ticker", F.col("price").alias("_before"))
    pairs = now.join(earlier, [*by, "_prev_date", "ticker"])
    ret = period_return(F.col("price"), F.col("_before"), kind)
    return pairs.select(*by, "date", "ticker", ret.alias("ret")).where(F.col("ret").isNotNull())


def _compound(kind: str | None):
    log_ret = F.sum("ret")
    simple_ret = F.product(1.0 + F.col("ret")) - 1.0
    if kind is None:
        return [log_ret.alias("_log"), simple_ret.alias("_simple")]
    return [(log_ret if kind == "log" else simple_ret).alias("ret")]


def _choose_kind(agg: DataFrame, kind: str | None, kinds: DataFrame, by: list[str]) -> DataFrame:
    if kind is not None:
        return agg
    picked = attach(agg, kinds, by)
    ret = F.when(F.col("kind") == "log", F.col("_log")).otherwise(F.col("_simple"))
    return picked.withColumn("ret", ret).drop("_log", "_simple", "kind")


def returns_to_frequency(returns: DataFrame, *, freq: str, kind: str | None = None) -> DataFrame:
    """Compound returns per window: sums for log, products for simple; windows without a value give 0."""
    if kind is not None:
        one_of(kind, ("log", "simple"), "kind")
    by = universe_keys(returns)
    agg = returns.groupBy(*by, "ticker", bucket_label(F.col("date"), freq).alias("label")).agg(*_compound(kind))
    agg = agg.withColumnRenamed("label", "date")
    agg = _choose_kind(agg, kind, infer_return_kind(returns).drop("n_obs"), by)
    cells = spine(agg).join(agg, [*by, "date", "ticker"], "left")
    return cells.select(*by, "date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def returns_to_frequency_null(returns: DataFrame, freq: str, kind: str | None = None) -> DataFrame:
    """As above, but labelled with the period's last day and without rows for empty windows."""
    by = universe_keys(returns)
    agg = returns.groupBy(*by, "ticker", period_end(F.col("date"), freq).alias("label")).agg(*_compound(kind))
    agg = _choose_kind(agg.withColumnRenamed("label", "date"), kind, infer_return_kind_by_series(returns), by)
    return agg.select(*by, "date", "ticker", "ret").where(F.col("ret").isNotNull())


def rebalance_dates(returns: DataFrame, freq: str = "1mo") -> DataFrame:
    """Last observed date of every window."""
    by = universe_keys(returns)
    return (
        returns.groupBy(*by, bucket_label(F.col("date"), freq).alias("_label"))
        .agg(F.max("date").alias("rb_date"))
        .select(*by, "rb_date")
    )


def to_simple(returns: DataFrame, kind: str = "log") -> DataFrame:
    """Log returns as simple returns; simple returns pass through."""
    one_of(kind, ("log", "simple"), "kind")
    return returns if kind == "simple" else returns.withColumn("ret", F.exp("ret") - 1.0)
