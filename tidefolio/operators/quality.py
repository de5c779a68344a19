"""Data-quality reports over long prices and returns. Missing cells are counted from totals; no grid is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.calendar import elapsed_days
from ..functions.numeric import per_year
from ..schema import attach, grouped, require, universe_keys
from .panel import date_totals, with_previous

SEQ_CHUNKS = 64  # a power of two: chunks when following a series in ingest order


def price_validation(prices: DataFrame) -> DataFrame:
    """One row: exact duplicates, backward time steps in ingest order (``seq``), and prices at or below zero.

    A series is followed chunk by chunk of ``seq``; chunk borders are compared through one summary row per chunk,
    so a ticker with most of the rows is still spread over many tasks. Chunks end at approximate quantiles of ``seq``,
    whatever its scale, so they hold about equally many rows and are ``SEQ_CHUNKS`` at most.
    """
    require(prices, "date", "ticker", "price", "seq")
    copies = prices.groupBy("date", "ticker", "price").agg(F.count(F.lit(1)).alias("_copies"))
    per_key = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum(F.when(F.col("price") <= 0, F.col("_copies"))), F.lit(0)).alias("n_nonpositive"),
    )
    ends = prices.agg(
        F.percentile_approx("seq", [k / SEQ_CHUNKS for k in range(1, SEQ_CHUNKS)], 100 * SEQ_CHUNKS).alias("_ends")
    )
    # The number of ends below a value, by halving the sorted list.
    chunk, step = F.lit(0), SEQ_CHUNKS // 2
    while step:
        chunk = chunk + F.when(F.get("_ends", chunk + (step - 1)) < F.col("seq"), step).otherwise(0)
        step //= 2
    chunked = attach(prices.select("ticker", "date", "seq"), ends, []).select("ticker", "date", "seq", chunk.alias("_chunk"))
    inside = W.partitionBy("ticker", "_chunk").orderBy("seq")
    steps = chunked.withColumn("_back", (F.col("date") < F.lag("date").over(inside)).cast("bigint"))
    borders = chunked.groupBy("ticker", "_chunk").agg(
        F.min_by("date", "seq").alias("_first"), F.max_by("date", "seq").alias("_last")
    )
    across = W.partitionBy("ticker").orderBy("_chunk")
    jumps = borders.withColumn("_back", (F.col("_first") < F.lag("_last").over(across)).cast("bigint"))
    backward = (
        steps.select("_back")
        .unionByName(jumps.select("_back"))
        .agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("backward_steps"))
    )
    return attach(per_key, backward, [])


def price_coverage(prices: DataFrame) -> DataFrame:
    """Rows, missing and valid prices, and the effective period per ticker."""
    require(prices, "date", "ticker", "price")
    return prices.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("price").isNull()).alias("n_na"),
        F.count("price").alias("n_valid"),
        F.min("date").alias("start_eff"),
        F.max("date").alias("end_eff"),
    )


def return_coverage(returns: DataFrame, col: str = "ret") -> DataFrame:
    """Per ticker: observed and missing dates of the panel, coverage, and whether its two ends are missing."""
    by = universe_keys(returns)
    seen_at = F.when(F.col(col).isNotNull(), F.col("date"))
    per_ticker = returns.groupBy(*by, "ticker").agg(
        F.count(col).alias("n_obs"), F.min(seen_at).alias("_first_obs"), F.max(seen_at).alias("_last_obs")
    )
    return attach(per_ticker, date_totals(returns), by).select(
        *by,
        "ticker",
        "n_obs",
        (F.col("n_dates") - F.col("n_obs")).alias("n_na"),
        "n_dates",
        (F.col("n_obs") / F.col("n_dates") * 100.0).alias("coverage_pct"),
        (~F.col("_first_obs").eqNullSafe(F.col("first_date"))).alias("start_missing"),
        (~F.col("_last_obs").eqNullSafe(F.col("last_date"))).alias("end_missing"),
    )


def coverage_full(ret_coverage: DataFrame, price_cov: DataFrame) -> DataFrame:
    return ret_coverage.join(price_cov.select("ticker", "start_eff", "end_eff"), "ticker", "left")


def excluded_tickers(price_cov: DataFrame, ret_cov: DataFrame, min_obs: int = 2) -> DataFrame:
    """Tickers too thin in prices or in returns, sorted."""
    thin_prices = price_cov.where(F.col("n_valid") < min_obs).select("ticker")
    thin_returns = ret_cov.where(F.col("n_obs") < min_obs).select("ticker")
    return thin_prices.union(thin_returns).distinct().orderBy("ticker")


def effective_ranges(prices: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return prices.groupBy("ticker").agg(
        day(F.min("date")).alias("start_eff"), day(F.max("date")).alias("end_eff"), F.count(F.lit(1)).alias("n_rows")
    )


def dataset_stats(prices: DataFrame) -> DataFrame:
    """One row: rows, distinct dates, distinct tickers, missing prices (pre-aggregated per cell, then per axis)."""
    rows = prices.agg(
        F.count(F.lit(1)).alias("n_rows_prices"), F.count_if(F.col("price").isNull()).alias("missing_prices")
    )
    dates = prices.select("date").distinct().agg(F.count("date").alias("n_unique_dates"))
    names = prices.select("ticker").distinct().agg(F.count("ticker").alias("n_tickers"))
    return attach(attach(rows, dates, []), names, []).select(
        "n_rows_prices", "n_unique_dates", "n_tickers", "missing_prices"
    )


def universe_snapshot(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_obs")).orderBy(F.desc("n_obs"), "ticker")


def gaps_report(prices: DataFrame, threshold_days: int = 3) -> DataFrame:
    """Longest gap in whole days and the gaps above the threshold, per ticker.

    Ticks are first folded into (first, last) per ticker and day: gaps inside a day count zero days, so the fold loses
    nothing, and the window that follows sees at most one row per calendar day whatever the tick volume.
    """
    daily = prices.groupBy("ticker", F.to_date("date").alias("_day")).agg(
        F.min("date").alias("_open"), F.max("date").alias("_close")
    )
    previous = F.lag("_close").over(W.partitionBy("ticker").orderBy("_day"))
    gaps = daily.withColumn("_gap", elapsed_days(F.col("_open"), previous))
    wide = F.col("_gap") > threshold_days
    return (
        gaps.groupBy("ticker")
        .agg(
            F.coalesce(F.max("_gap"), F.lit(0)).alias("max_gap_days"),
            F.count_if(wide).alias("n_gaps_gt_thr"),
            F.min(F.when(wide, F.col("_open"))).alias("first_gap"),
            F.max(F.when(wide, F.col("_open"))).alias("last_gap"),
        )
        .orderBy(F.desc("max_gap_days"), F.desc("n_gaps_gt_thr"))
    )


def missing_report(returns: DataFrame, col: str = "ret") -> DataFrame:
    by = universe_keys(returns)
    cov = return_coverage(returns, col)
    return cov.select(
        *by,
        "ticker",
        F.col("n_na").alias("missing_rows"),
        (F.col("n_na") / F.col("n_dates") * 100.0).alias("missing_pct"),
        F.col("end_missing").alias("ends_missing"),
    )


def top_abs_moves(returns: DataFrame, k: int = 5, col: str = "ret") -> DataFrame:
    """The k largest distinct |moves| per ticker, ties kept.

    ``dense_rank() <= k`` becomes a WindowGroupLimit that trims every map partition before the shuffle.
    """
    keys = [*universe_keys(returns), "ticker"]
    moves = returns.where(F.col(col).isNotNull()).withColumn("abs_ret", F.abs(col))
    order = W.partitionBy(*keys).orderBy(F.desc("abs_ret"))
    return moves.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select(
        *keys, "date", F.col(col).alias("ret"), "abs_ret", "rank"
    )


def _median_below(x: Column, bound: float) -> Column:
    """Whether the median of ``x`` is below ``bound``, from counts and the two values next to the bound."""
    n, below = F.count(x), F.count_if(x < bound)
    middle = (F.max(F.when(x < bound, x)) + F.min(F.when(x >= bound, x))) / 2
    return F.when(2 * below > n, F.lit(True)).when(2 * below == n, middle < bound).otherwise(F.lit(False))


def infer_return_kind(returns: DataFrame, sample_tickers: int | None = None, col: str = "ret") -> DataFrame:
    """'log' if some value is at or below -1, else by whether the median |r| is below 0.3, over all tickers; a caller who
    names ``sample_tickers`` gets the answer for the first ones by name."""
    by = universe_keys(returns)
    data = returns
    if sample_tickers is not None:
        names = returns.select(*by, "ticker").distinct()
        place = F.row_number().over(W.partitionBy(*by).orderBy("ticker"))
        first = names.withColumn("_place", place).where(F.col("_place") <= max(1, sample_tickers))
        data = returns.join(first.select(*by, "ticker"), [*by, "ticker"], "left_semi")
    x = F.col(col)
    facts = grouped(
        data,
        by,
        F.count(x).alias("n_obs"),
        F.coalesce(F.bool_or(x <= -1.0), F.lit(False)).alias("_impossible"),
        _median_below(F.abs(x), 0.3).alias("_small"),
    )
    small = F.coalesce("_small", F.lit(False))
    kind = F.when(F.col("_impossible") | ~small, F.lit("log")).otherwise(F.lit("simple"))
    return facts.select(*by, "n_obs", kind.alias("kind"))


def infer_return_kind_by_series(returns: DataFrame, col: str = "ret") -> DataFrame:
    """Stricter reading over all tickers: 'log' if any value <= -1 or any ticker's median |r| exceeds 0.25."""
    by = universe_keys(returns)
    size = F.abs(F.col(col))
    n, at_most = F.count(size), F.count_if(size <= 0.25)
    middle = (F.max(F.when(size <= 0.25, size)) + F.min(F.when(size > 0.25, size))) / 2
    above = F.when(2 * at_most > n, F.lit(False)).when(2 * at_most == n, middle > 0.25).otherwise(F.lit(True))
    series = returns.groupBy(*by, "ticker").agg(
        F.coalesce(F.bool_or(F.col(col) <= -1.0), F.lit(False)).alias("_impossible"),
        F.when(n > 0, above).otherwise(F.lit(False)).alias("_large"),
    )
    facts = grouped(series, by, F.bool_or(F.col("_impossible") | F.col("_large")).alias("_log"))
    return facts.select(*by, F.when(F.col("_log"), F.lit("log")).otherwise(F.lit("simple")).alias("kind"))


def infer_periodicity(returns: DataFrame) -> DataFrame:
    """Periods per year from the median step between distinct dates (252, 52 or 12)."""
    by = universe_keys(returns)
    steps = with_previous(returns).withColumn("_step", elapsed_days(F.col("date"), F.col("_prev_date")))
    # Few distinct whole-day steps exist, so the exact percentile keeps a tiny map.
    facts = grouped(steps, by, F.median("_step").alias("median_days"))
    return facts.select(*by, "median_days", per_year(F.col("median_days")).alias("per_year"))
