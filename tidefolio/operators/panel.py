"""Cleaning and reshaping of long panels (date, ticker, value), optionally per universe_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.calendar import month_number
from ..functions.numeric import finite
from ..schema import attach, grouped, one_of, require, universe_keys

FILL_POLICIES = ("drop", "mean", "none")


# --- canonical form -------------------------------------------------------------------------------------------

def canonicalize(df: DataFrame, *, date: str = "date", ticker: str = "ticker", value: str = "price") -> DataFrame:
    """Cast to timestamp / string / double; what does not parse becomes NULL. Other columns are kept."""
    require(df, date, ticker, value)
    rest = [c for c in df.columns if c not in (date, ticker, value)]
    return df.select(
        F.col(date).try_cast("timestamp_ntz").alias(date),
        F.col(ticker).cast("string").alias(ticker),
        F.col(value).try_cast("double").alias(value),
        *rest,
    )


def normalize_tickers(df: DataFrame, col: str = "ticker") -> DataFrame:
    """Trimmed, upper-case, distinct, sorted ticker list without empty names."""
    require(df, col)
    name = F.upper(F.trim(F.col(col).cast("string")))
    return df.select(name.alias(col)).where(F.col(col) != "").distinct().orderBy(col)


def drop_nulls(df: DataFrame, col: str = "price") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def dedupe_keep_last(df: DataFrame, keys: tuple[str, ...] = ("date", "ticker"), order_col: str = "seq") -> DataFrame:
    """One row per key, the one with the greatest ``order_col``.

    An aggregate, not a window: copies of one key collapse on the map side, so a hot key never meets in one task.
    """
    require(df, *keys, order_col)
    values = [c for c in df.columns if c not in (*keys, order_col)]
    picks = [F.max_by(F.col(c), F.col(order_col)).alias(c) for c in values]
    return df.groupBy(*keys).agg(*picks, F.max(order_col).alias(order_col)).select(*df.columns)


def finite_or_null(df: DataFrame, col: str = "ret") -> DataFrame:
    return df.withColumn(col, finite(F.col(col)))


def drop_empty_series(df: DataFrame, col: str = "ret") -> DataFrame:
    """Remove tickers without a single value."""
    keys = [*universe_keys(df), "ticker"]
    alive = df.groupBy(*keys).agg(F.count(col).alias("_n")).where("_n > 0").select(*keys)
    return df.join(alive, keys, "left_semi")


def drop_constant_series(df: DataFrame, col: str = "ret", eps: float = 1e-14) -> DataFrame:
    """Remove tickers whose standard deviation is missing, not finite, or at most ``eps``."""
    keys = [*universe_keys(df), "ticker"]
    sd = finite(F.stddev_samp(col))
    moving = df.groupBy(*keys).agg(sd.alias("_sd")).where(F.col("_sd") > eps).select(*keys)
    return df.join(moving, keys, "left_semi")


# --- calendar and grid ----------------------------------------------------------------------------------------

def calendar(panel: DataFrame) -> DataFrame:
    """Distinct dates per universe with position ``idx`` (from 1) and ``n_dates``.

    Positions are counted inside each calendar day and shifted by the days before. The one window that is not split
    runs over calendar days, so intraday stamps never meet in a single task.
    """
    by = universe_keys(panel)
    stamps = panel.select(*by, "date").distinct().withColumn("_day", F.to_date("date"))
    whole = W.partitionBy(*by)
    before = F.sum("_count").over(whole.orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    per_day = (
        stamps.groupBy(*by, "_day")
        .agg(F.count(F.lit(1)).alias("_count"))
        .select(
            *by,
            "_day",
            F.coalesce(before, F.lit(0)).alias("_before"),
            F.sum("_count").over(whole).alias("n_dates"),
        )
    )
    inside = F.row_number().over(W.partitionBy(*by, "_day").orderBy("date"))
    return stamps.withColumn("_inside", inside).join(per_day, [*by, "_day"]).select(
        *by, "date", (F.col("_before") + F.col("_inside")).alias("idx"), "n_dates"
    )


def with_previous(panel: DataFrame) -> DataFrame:
    """Distinct dates per universe with the date before (``_prev_date``, NULL for the first), joined by position."""
    by = universe_keys(panel)
    days = calendar(panel).select(*by, "idx", "date")
    return days.join(days.select(*by, (F.col("idx") + 1).alias("idx"), F.col("date").alias("_prev_date")), [*by, "idx"], "left")


def running(df: DataFrame, by: list[str], value: Column, how: str, out: str) -> DataFrame:
    """Adds ``out``: the product, maximum or last value (not NULL) of ``value`` over all rows of ``by`` up to this one's date.

    Runs inside each calendar month and over one row per month, so a long run is not one task.
    """
    make = {"product": F.product, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    both = {"product": lambda a, b: a * b, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}[how]
    cut = df.withColumn("_month", F.date_trunc("month", "date")).withColumn("_value", value)
    inside = W.partitionBy(*by, "_month").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*by).orderBy("_month").rowsBetween(W.unboundedPreceding, -1)
    total = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("date"))) if how == "last" else make("_value")
    months = cut.groupBy(*by, "_month").agg(total.alias("_total")).select(*by, "_month", make("_total").over(earlier).alias("_earlier"))
    own = cut.withColumn("_own", make("_value").over(inside))
    value_here = F.coalesce(both(F.col("_earlier"), F.col("_own")), F.col("_own"), F.col("_earlier"))
    return own.join(months, [*by, "_month"]).withColumn(out, value_here).drop("_month", "_value", "_own", "_earlier")


def date_totals(panel: DataFrame) -> DataFrame:
    by = universe_keys(panel)
    return grouped(
        panel.select(*by, "date").distinct(),
        by,
        F.count(F.lit(1)).alias("n_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def ticker_totals(panel: DataFrame) -> DataFrame:
    by = universe_keys(panel)
    return grouped(panel.select(*by, "ticker").distinct(), by, F.count(F.lit(1)).alias("n_tickers"))


def spine(panel: DataFrame) -> DataFrame:
    """Every (date, ticker) cell of the grid.

    Each ticker is spread over the months of the calendar and then equi-joined with the dates of that month,
    so the grid grows by a keyed join (skew-splittable by AQE) and nothing is collected.
    """
    by = universe_keys(panel)
    days = panel.select(*by, "date").distinct().withColumn("_month", month_number(F.col("date")))
    span = grouped(days, by, F.min("_month").alias("_from"), F.max("_month").alias("_to"))
    months = attach(panel.select(*by, "ticker").distinct(), span, by).select(
        *by, "ticker", F.explode(F.sequence("_from", "_to")).alias("_month")
    )
    return months.join(days, [*by, "_month"]).select(*by, "date", "ticker")


def with_halo(df: DataFrame, idx: str, size: int, overlap: int) -> DataFrame:
    """Cut a series into chunks of ``size`` positions; rows needed by the next chunk are repeated there.

    Window frames that reach back ``overlap`` rows can then run per (key, ``_chunk``): a hot series is spread over
    many tasks. Keep ``_chunk = _own`` afterwards.
    """
    size = max(size, overlap)
    own = F.floor((F.col(idx) - 1) / size)
    offset = (F.col(idx) - 1) % size
    homes = F.when(offset >= size - overlap, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(homes))


# --- missing cells --------------------------------------------------------------------------------------------

def complete_rows_only(returns: DataFrame, col: str = "ret") -> DataFrame:
    """Keep the dates on which every ticker has a value."""
    by = universe_keys(returns)
    per_date = returns.groupBy(*by, "date").agg(F.count(col).alias("_n"))
    full = attach(per_date, ticker_totals(returns), by).where("_n = n_tickers").select(*by, "date")
    return returns.join(full, [*by, "date"], "left_semi")


def impute_mean(returns: DataFrame, col: str = "ret") -> DataFrame:
    """Dense grid with missing cells set to the ticker's mean."""
    by = universe_keys(returns)
    keys = [*by, "ticker"]
    means = returns.groupBy(*keys).agg(F.avg(col).alias("_mean"))
    cells = spine(returns).join(returns.select(*by, "date", "ticker", col), [*by, "date", "ticker"], "left")
    return cells.join(means, keys).select(*by, "date", "ticker", F.coalesce(col, "_mean").alias(col))


def reject_nulls(returns: DataFrame, col: str = "ret") -> DataFrame:
    """Pass a dense panel through; a missing cell fails the job that reads it."""
    by = universe_keys(returns)
    cells = grouped(returns, by, F.count(col).alias("_cells"))
    size = attach(attach(cells, ticker_totals(returns), by), date_totals(returns), by)
    checked = size.select(
        *by,
        F.when(F.col("_cells") == F.col("n_tickers") * F.col("n_dates"), F.lit(True))
        .otherwise(F.raise_error(F.lit("missing cells with fill policy 'none'")).cast("boolean"))
        .alias("_dense"),
    )
    return attach(returns, checked, by).where("_dense").drop("_dense")


def apply_fill_policy(returns: DataFrame, policy: str, col: str = "ret") -> DataFrame:
    one_of(policy, FILL_POLICIES, "fill policy")
    clean = finite_or_null(returns, col)
    if policy == "drop":
        return complete_rows_only(clean, col)
    return impute_mean(clean, col) if policy == "mean" else reject_nulls(clean, col)


def fill_policy_report(returns: DataFrame, policy: str, col: str = "ret") -> DataFrame:
    """Effect of a policy, one row per ticker: dropped dates, imputed shares, or number of missing cells."""
    one_of(policy, FILL_POLICIES, "fill policy")
    by = universe_keys(returns)
    clean = finite_or_null(returns, col)
    dates = date_totals(clean)
    per_ticker = attach(clean.groupBy(*by, "ticker").agg(F.count(col).alias("n_obs")), dates, by).withColumn(
        "n_na", F.col("n_dates") - F.col("n_obs")
    )
    if policy == "drop":
        full = complete_rows_only(clean, col).select(*by, "date").distinct()
        kept = grouped(full, by, F.count(F.lit(1)).alias("_kept"))
        dropped = F.col("n_dates") - F.coalesce(F.col("_kept"), F.lit(0))
        joined = per_ticker.join(kept, by, "left") if by else attach(per_ticker, kept, by)
        return joined.select(
            *by, F.lit(policy).alias("policy"), "ticker", dropped.alias("rows_dropped"), F.lit(0.0).alias("imputed_pct")
        )
    whole = grouped(
        per_ticker, by, F.sum("n_na").alias("n_na_total"), F.sum("n_dates").alias("_cells")
    )
    out = attach(per_ticker.drop("_cells"), whole, by)
    if policy == "mean":
        return out.select(
            *by,
            F.lit(policy).alias("policy"),
            "ticker",
            (F.col("n_na") / F.col("n_dates") * 100.0).alias("imputed_pct"),
            (F.col("n_na_total") / F.col("_cells") * 100.0).alias("total_imputed_pct"),
        )
    return out.select(
        *by, F.lit(policy).alias("policy"), "ticker", "n_na", "n_na_total", (F.col("n_na_total") > 0).alias("warning")
    )


# --- shape ----------------------------------------------------------------------------------------------------

def long_to_wide(
    df: DataFrame, value_col: str, *, tickers: list[str] | None = None, index: str = "date", columns: str = "ticker"
) -> DataFrame:
    """One column per ticker, sorted by ``index``; name the ``tickers`` to spare Spark the pass that finds them."""
    require(df, index, columns, value_col)
    pivoted = df.groupBy(index).pivot(columns, tickers) if tickers is not None else df.groupBy(index).pivot(columns)
    return pivoted.agg(F.first(value_col)).orderBy(index)


def wide_to_long(df: DataFrame, value_name: str, index: str = "date") -> DataFrame:
    """Back to (index, ticker, value); empty cells stay as NULL rows."""
    require(df, index)
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in df.columns if c != index]
    plain = df.select(index, *values)
    return plain.unpivot(index, [f"`{c}`" for c in df.columns if c != index], "ticker", value_name)


def onehot_exposure(universe: DataFrame, meta: DataFrame, cols: tuple[str, ...] = ("sector", "country")) -> DataFrame:
    """Long one-hot exposures (factor 'column:VALUE', ticker, 1.0); names are matched without regard to case."""
    require(universe, "ticker")
    require(meta, "ticker")
    cols = tuple(c for c in cols if c in meta.columns)
    names = universe.select("ticker", F.upper("ticker").alias("_key")).distinct()
    one_meta = meta.groupBy(F.upper("ticker").alias("_key")).agg(
        *[F.max(F.upper(F.col(c).cast("string"))).alias(c) for c in cols]
    )
    labels = one_meta.unpivot("_key", list(cols), "_col", "_value").where(F.col("_value").isNotNull())
    return names.join(labels, "_key").select(
        F.concat_ws(":", "_col", "_value").alias("factor"), "ticker", F.lit(1.0).alias("exposure")
    )


def apply_universe(df: DataFrame, coverage: DataFrame, min_obs: int = 2, count_col: str = "n_valid") -> DataFrame:
    """Keep the tickers the coverage table shows with at least ``min_obs`` values."""
    return df.join(coverage.where(F.col(count_col) >= min_obs).select("ticker"), "ticker", "left_semi")
