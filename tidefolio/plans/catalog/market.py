"""Queries for sources, cleaning, data quality, returns and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import panel, quality, returns as R, stats
from ...session import hand_off, shared_folder
from ...sources import artifacts, prices as src
from ...functions.numeric import annualize, ewma_default_lambda
from .. import derive as D
from ..registry import query, sql, tidy
from . import ctes as C


# --- sources ----------------------------------------------------------------------------------------------------



@query(
    "load_prices_long",
    sql(
        [],
        """SELECT date, upper(ticker) AS ticker, arg_max(price, seq) AS price FROM (
             SELECT ts AS date, event_type AS ticker, value AS price, event_id AS seq FROM events
             WHERE ts >= TIMESTAMP '2024-01-02' AND value IS NOT NULL) GROUP BY ALL""",
        dates=["date"], floats=["price"], plain=["ticker"],
    ),
)
def load_prices_long(spark, d):
    return tidy(
        src.load_prices_long(
            spark, f"{d}/events.parquet", start="2024-01-02", date="ts", ticker="event_type", price="value",
            seq="event_id",
        )
    )


@query(
    "load_prices_wide",
    sql(
        [],
        """SELECT date, max(price) FILTER (ticker = 'CLICK') AS CLICK, max(price) FILTER (ticker = 'ERROR') AS ERROR,
                  max(price) FILTER (ticker = 'PURCHASE') AS PURCHASE, max(price) FILTER (ticker = 'SIGNUP') AS SIGNUP,
                  max(price) FILTER (ticker = 'VIEW') AS VIEW
           FROM (SELECT ts AS date, upper(event_type) AS ticker, arg_max(value, event_id) AS price FROM events GROUP BY ALL)
           GROUP BY date""",
        dates=["date"], floats=["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"],
    ),
)
def load_prices_wide(spark, d):
    return tidy(
        src.load_prices_wide(
            spark, f"{d}/events.parquet", date="ts", ticker="event_type", price="value", seq="event_id",
        )
    )


@query(
    "normalize_tickers",
    sql([], "SELECT DISTINCT upper(trim(p_type)) AS ticker FROM part WHERE trim(p_type) <> ''", plain=["ticker"]),
)
def normalize_tickers(spark, d):
    return panel.normalize_tickers(D.table(spark, d, "part").select(F.col("p_type").alias("ticker")))


@query(
    "artifact_roundtrip",
    sql([C.BRAND, C.MONTH, C.RET], "SELECT date, ticker, ret FROM ret", dates=["date"], floats=["ret"], plain=["ticker"]),
)
def artifact_roundtrip(spark, d):
    root, cfg = shared_folder(spark), {"data": d, "freq": "1mo", "kind": "log"}
    artifacts.write_artifact(D.brand_returns(spark, d), root, "returns_long", cfg)
    return tidy(artifacts.read_artifact(spark, root, "returns_long", cfg))


@query(
    "export_csv",
    sql([C.HOLD], "SELECT portfolio_id, ticker, weight FROM hold", floats=["weight"], plain=["portfolio_id", "ticker"]),
)
def export_csv(spark, d):
    folder = artifacts.artifact_path(shared_folder(spark), "weights_csv", {"data": d})
    artifacts.export(D.customer_holdings(spark, d), folder, "csv")
    schema = "portfolio_id string, ticker string, weight double"
    return tidy(spark.read.option("header", True).schema(schema).csv(folder))


@query(
    "load_asset_meta",
    sql([C.META], "SELECT * FROM meta", plain=["ticker", "sector", "country"]),
)
def load_asset_meta(spark, d):
    folder = artifacts.artifact_path(shared_folder(spark), "asset_meta", {"data": d})
    artifacts.export(D.asset_meta(spark, d), folder, "csv")
    return src.load_asset_meta(spark, folder)


@query(
    "write_metadata",
    sql(
        [C.BRAND],
        """SELECT count(*) AS n_rows_prices, count(DISTINCT date) AS n_unique_dates, count(DISTINCT ticker) AS n_tickers,
                  count(*) FILTER (price IS NULL) AS missing_prices, 16 AS fingerprint_length FROM brand""",
        ints=["n_rows_prices", "n_unique_dates", "n_tickers", "missing_prices", "fingerprint_length"],
    ),
)
def write_metadata(spark, d):
    root, cfg = shared_folder(spark), {"data": d, "table": "brand_prices"}
    artifacts.write_metadata(quality.dataset_stats(D.brand_prices(spark, d)), root, "data_meta", cfg)
    meta = artifacts.read_metadata(spark, root, "data_meta", cfg)
    return tidy(meta.withColumn("fingerprint_length", F.length("fingerprint")).drop("fingerprint"))


# --- cleaning and shape -----------------------------------------------------------------------------------------

@query(
    "canonicalize",
    sql(
        [],
        """SELECT o_orderdate AS date, CAST(o_orderpriority AS VARCHAR) AS ticker,
                  TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price FROM orders""",
        dates=["date"], floats=["price"], plain=["ticker"],
    ),
)
def canonicalize(spark, d):
    raw = D.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("o_orderpriority").alias("ticker"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    return tidy(panel.canonicalize(raw))


@query(
    "drop_nulls",
    sql([C.TICKS], "SELECT * FROM ticks WHERE price IS NOT NULL", dates=["date"], floats=["price"], ints=["seq"], plain=["ticker"]),
)
def drop_nulls(spark, d):
    return tidy(panel.drop_nulls(D.event_ticks(spark, d), "price"))


@query(
    "dedupe_keep_last",
    sql(
        [C.TICKS],
        """SELECT date, ticker, price, seq FROM (
             SELECT date_trunc('hour', date) AS date, ticker, price, seq,
                    row_number() OVER (PARTITION BY date_trunc('hour', date), ticker ORDER BY seq DESC) AS rn FROM ticks)
           WHERE rn = 1""",
        dates=["date"], floats=["price"], ints=["seq"], plain=["ticker"],
    ),
)
def dedupe_keep_last(spark, d):
    hourly = D.event_ticks(spark, d).withColumn("date", F.date_trunc("hour", "date").cast("timestamp_ntz"))
    return tidy(panel.dedupe_keep_last(hourly))


MAYBE = f"""maybe AS (
  SELECT date, ticker, CASE WHEN price <= 5 THEN NULL WHEN price >= 100 THEN 'inf'::DOUBLE
                            WHEN price BETWEEN 50 AND 60 THEN 'nan'::DOUBLE ELSE price END AS ret FROM ticks)"""


def _maybe(spark, d):
    """Event values with holes, infinities and NaN."""
    p = F.col("price")
    return D.event_ticks(spark, d).select(
        "date",
        "ticker",
        F.when(p <= 5, None)
        .when(p >= 100, F.lit(float("inf")))
        .when(p.between(50, 60), F.lit(float("nan")))
        .otherwise(p)
        .alias("ret"),
    )


@query(
    "finite_or_null",
    sql(
        [C.TICKS, MAYBE],
        "SELECT date, ticker, CASE WHEN isnan(ret) OR isinf(ret) THEN NULL ELSE ret END AS ret FROM maybe",
        dates=["date"], floats=["ret"], plain=["ticker"],
    ),
)
def finite_or_null(spark, d):
    return tidy(panel.finite_or_null(_maybe(spark, d)))


def _event_daily_with_holes(spark, d):
    """User activity: mean value per user and day, NULL for days whose mean is 20 or more."""
    return (
        D.table(spark, d, "events")
        .groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), F.col("user_id").cast("string").alias("ticker"))
        .agg(F.avg("value").alias("v"))
        .select("date", "ticker", F.when(F.col("v") < 20, F.col("v")).alias("ret"))
    )


ACT = """act AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS date, CAST(user_id AS VARCHAR) AS ticker,
         CASE WHEN avg(value) < 20 THEN avg(value) END AS ret FROM events GROUP BY 1, 2)"""


@query(
    "drop_empty_series",
    sql(
        [ACT], "SELECT * FROM act WHERE ticker IN (SELECT ticker FROM act WHERE ret IS NOT NULL)",
        dates=["date"], floats=["ret"], plain=["ticker"],
    ),
)
def drop_empty_series(spark, d):
    return tidy(panel.drop_empty_series(_event_daily_with_holes(spark, d)))


@query(
    "drop_constant_series",
    sql(
        [ACT],
        """SELECT * FROM act WHERE ticker IN (
             SELECT ticker FROM act GROUP BY ticker HAVING count(ret) > 1 AND stddev_samp(ret) > 1e-14)""",
        dates=["date"], floats=["ret"], plain=["ticker"],
    ),
)
def drop_constant_series(spark, d):
    return tidy(panel.drop_constant_series(_event_daily_with_holes(spark, d)))


@query(
    "complete_rows_only",
    sql([C.BRAND, C.MONTH, C.RET, C.FULL], "SELECT * FROM full_ret", dates=["date"], floats=["ret"], plain=["ticker"]),
)
def complete_rows_only(spark, d):
    return tidy(panel.complete_rows_only(D.brand_returns(spark, d)))


@query(
    "impute_mean",
    sql([C.BRAND, C.WEEK, C.RET_WEEK, C.FILLED], "SELECT * FROM filled", dates=["date"], floats=["ret"], plain=["ticker"]),
)
def impute_mean(spark, d):
    return tidy(panel.impute_mean(D.brand_returns(spark, d, "1w")))


@query(
    "reject_nulls",
    sql([C.BRAND, C.MONTH, C.RET, C.FULL], "SELECT * FROM full_ret", dates=["date"], floats=["ret"], plain=["ticker"]),
)
def reject_nulls(spark, d):
    dense = panel.complete_rows_only(D.brand_returns(spark, d))
    return tidy(panel.apply_fill_policy(dense, "none"))


@query(
    "fill_report_drop",
    sql(
        [C.BRAND, C.MONTH, C.RET, C.FULL],
        """SELECT DISTINCT 'drop' AS policy, ticker,
             (SELECT count(DISTINCT date) FROM ret) - (SELECT count(DISTINCT date) FROM full_ret) AS rows_dropped,
             0.0 AS imputed_pct FROM ret""",
        ints=["rows_dropped"], floats=["imputed_pct"], plain=["policy", "ticker"],
    ),
)
def fill_report_drop(spark, d):
    return tidy(panel.fill_policy_report(D.brand_returns(spark, d), "drop"))


@query(
    "fill_report_mean",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK],
        """SELECT 'mean' AS policy, ticker, 100.0 * (t - n) / t AS imputed_pct,
                  100.0 * sum(t - n) OVER () / sum(t) OVER () AS total_imputed_pct
           FROM (SELECT ticker, count(ret) AS n, (SELECT count(DISTINCT date) FROM ret) AS t FROM ret GROUP BY ticker)""",
        floats=["imputed_pct", "total_imputed_pct"], plain=["policy", "ticker"],
    ),
)
def fill_report_mean(spark, d):
    return tidy(panel.fill_policy_report(D.brand_returns(spark, d, "1w"), "mean"))


@query(
    "fill_report_none",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK],
        """SELECT 'none' AS policy, ticker, t - n AS n_na, sum(t - n) OVER () AS n_na_total,
                  sum(t - n) OVER () > 0 AS warning
           FROM (SELECT ticker, count(ret) AS n, (SELECT count(DISTINCT date) FROM ret) AS t FROM ret GROUP BY ticker)""",
        ints=["n_na", "n_na_total"], plain=["policy", "ticker", "warning"],
    ),
)
def fill_report_none(spark, d):
    return tidy(panel.fill_policy_report(D.brand_returns(spark, d, "1w"), "none"))




@query(
    "long_to_wide",
    sql(
        [],
        """SELECT o_orderdate AS date, """
        + ", ".join(
            f"sum(o_totalprice) FILTER (o_orderstatus = '{s}') AS {s}" for s in ("F", "O", "P")
        )
        + " FROM orders GROUP BY 1",
        dates=["date"], floats=["F", "O", "P"], digits=2,
    ),
)
def long_to_wide(spark, d):
    daily = (
        D.table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("ticker"))
        .agg(F.sum("o_totalprice").alias("price"))
    )
    return tidy(panel.long_to_wide(daily, "price"), 2)


@query(
    "wide_to_long",
    sql(
        [],
        """SELECT o_orderdate AS date, s.ticker, sum(o_totalprice) FILTER (o_orderstatus = s.ticker) AS price
           FROM orders CROSS JOIN (SELECT DISTINCT o_orderstatus AS ticker FROM orders) s GROUP BY 1, 2""",
        dates=["date"], floats=["price"], plain=["ticker"], digits=2,
    ),
)
def wide_to_long(spark, d):
    daily = (
        D.table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("ticker"))
        .agg(F.sum("o_totalprice").alias("price"))
    )
    return tidy(panel.wide_to_long(panel.long_to_wide(daily, "price"), "price"), 2)


@query(
    "onehot_exposure",
    sql(
        [C.META],
        """SELECT 'sector:' || upper(sector) AS factor, ticker, 1.0 AS exposure FROM meta WHERE sector IS NOT NULL
           UNION ALL SELECT 'country:' || upper(country), ticker, 1.0 FROM meta WHERE country IS NOT NULL""",
        floats=["exposure"], plain=["factor", "ticker"],
    ),
)
def onehot_exposure(spark, d):
    universe = D.supplier_prices(spark, d).select("ticker").distinct()
    return tidy(panel.onehot_exposure(universe, D.asset_meta(spark, d)))


@query(
    "apply_universe",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET],
        """SELECT * FROM sret WHERE ticker IN (
             SELECT ticker FROM supp GROUP BY ticker HAVING count(price) >= 530)""",
        dates=["date"], floats=["ret"], plain=["ticker"],
    ),
)
def apply_universe(spark, d):
    prices = D.supplier_prices(spark, d)
    returns = R.returns_from_prices(prices, freq="1mo")
    return tidy(panel.apply_universe(returns, quality.price_coverage(prices), min_obs=530))


# --- data quality -----------------------------------------------------------------------------------------------

@query(
    "price_validation",
    sql(
        [C.TICKS],
        """SELECT count(*) AS n_rows,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, ticker, price FROM ticks)) AS n_duplicates,
             count(*) FILTER (price <= 0) AS n_nonpositive, count(*) FILTER (date < prev) AS backward_steps
           FROM (SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY seq) AS prev FROM ticks)""",
        ints=["n_rows", "n_duplicates", "n_nonpositive", "backward_steps"],
    ),
)
def price_validation(spark, d):
    return tidy(quality.price_validation(D.event_ticks(spark, d)))


@query(
    "price_validation_shuffled_feed",
    sql(
        ["feed AS (SELECT o_orderdate AS date, o_orderpriority AS ticker, o_totalprice AS price, o_orderkey AS seq FROM orders)"],
        """SELECT count(*) AS n_rows,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, ticker, price FROM feed)) AS n_duplicates,
             count(*) FILTER (price <= 0) AS n_nonpositive, count(*) FILTER (date < prev) AS backward_steps
           FROM (SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY seq) AS prev FROM feed)""",
        ints=["n_rows", "n_duplicates", "n_nonpositive", "backward_steps"],
    ),
)
def price_validation_shuffled_feed(spark, d):
    feed = D.table(spark, d, "orders").select(
        F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("ticker"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("seq"),
    )
    return tidy(quality.price_validation(feed))


@query(
    "price_coverage",
    sql(
        [C.SUPP],
        """SELECT ticker, count(*) AS n_rows, count(*) FILTER (price IS NULL) AS n_na, count(price) AS n_valid,
                  min(date) AS start_eff, max(date) AS end_eff FROM supp GROUP BY ticker""",
        dates=["start_eff", "end_eff"], ints=["n_rows", "n_na", "n_valid"], plain=["ticker"],
    ),
)
def price_coverage(spark, d):
    return tidy(quality.price_coverage(D.supplier_prices(spark, d)))


RET_COV = """SELECT ticker, count(ret) AS n_obs, t.n - count(ret) AS n_na, t.n AS n_dates, 100.0 * count(ret) / t.n AS coverage_pct,
       coalesce(min(date) FILTER (ret IS NOT NULL) <> t.lo, TRUE) AS start_missing,
       coalesce(max(date) FILTER (ret IS NOT NULL) <> t.hi, TRUE) AS end_missing
FROM sret, (SELECT count(DISTINCT date) AS n, min(date) AS lo, max(date) AS hi FROM sret) t
GROUP BY ticker, t.n, t.lo, t.hi"""


@query(
    "return_coverage",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET], RET_COV,
        floats=["coverage_pct"], ints=["n_obs", "n_na", "n_dates"], plain=["ticker", "start_missing", "end_missing"],
    ),
)
def return_coverage(spark, d):
    return tidy(quality.return_coverage(D.supplier_returns(spark, d)))


@query(
    "coverage_full",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET, f"rc AS ({RET_COV})"],
        """SELECT rc.*, p.start_eff, p.end_eff FROM rc
           LEFT JOIN (SELECT ticker, min(date) AS start_eff, max(date) AS end_eff FROM supp GROUP BY ticker) p USING (ticker)""",
        dates=["start_eff", "end_eff"], floats=["coverage_pct"], ints=["n_obs", "n_na", "n_dates"],
        plain=["ticker", "start_missing", "end_missing"],
    ),
)
def coverage_full(spark, d):
    prices = D.supplier_prices(spark, d)
    returns = R.returns_from_prices(prices, freq="1mo")
    return tidy(quality.coverage_full(quality.return_coverage(returns), quality.price_coverage(prices)))


@query(
    "excluded_tickers",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET],
        """SELECT ticker FROM supp GROUP BY ticker HAVING count(price) < 70
           UNION SELECT ticker FROM sret GROUP BY ticker HAVING count(ret) < 70""",
        plain=["ticker"],
    ),
)
def excluded_tickers(spark, d):
    prices = D.supplier_prices(spark, d)
    returns = R.returns_from_prices(prices, freq="1mo")
    return quality.excluded_tickers(quality.price_coverage(prices), quality.return_coverage(returns), min_obs=70)


@query(
    "effective_ranges",
    sql(
        [C.SUPP], "SELECT ticker, min(date) AS start_eff, max(date) AS end_eff, count(*) AS n_rows FROM supp GROUP BY ticker",
        dates=["start_eff", "end_eff"], ints=["n_rows"], plain=["ticker"],
    ),
)
def effective_ranges(spark, d):
    return tidy(quality.effective_ranges(D.supplier_prices(spark, d)))


@query(
    "dataset_stats",
    sql(
        [C.SUPP],
        """SELECT count(*) AS n_rows_prices, count(DISTINCT date) AS n_unique_dates, count(DISTINCT ticker) AS n_tickers,
                  count(*) FILTER (price IS NULL) AS missing_prices FROM supp""",
        ints=["n_rows_prices", "n_unique_dates", "n_tickers", "missing_prices"],
    ),
)
def dataset_stats(spark, d):
    return tidy(quality.dataset_stats(D.supplier_prices(spark, d)))


@query(
    "universe_snapshot",
    sql([C.SUPP], "SELECT ticker, count(*) AS n_obs FROM supp GROUP BY ticker", ints=["n_obs"], plain=["ticker"]),
)
def universe_snapshot(spark, d):
    return tidy(quality.universe_snapshot(D.supplier_prices(spark, d)))


def _gaps_sql(cte: str, name: str, threshold: int) -> str:
    return sql(
        [cte],
        f"""SELECT ticker, coalesce(max(gap), 0) AS max_gap_days, count(*) FILTER (gap > {threshold}) AS n_gaps_gt_thr,
                   min(date) FILTER (gap > {threshold}) AS first_gap, max(date) FILTER (gap > {threshold}) AS last_gap
            FROM (SELECT *, floor(epoch_us(date) / 86400e6 - epoch_us(lag(date) OVER (PARTITION BY ticker ORDER BY date)) / 86400e6)::BIGINT AS gap
                  FROM {name}) GROUP BY ticker""",
        dates=["first_gap", "last_gap"], ints=["max_gap_days", "n_gaps_gt_thr"], plain=["ticker"],
    )


@query("gaps_report", _gaps_sql(C.SUPP, "supp", 3))
def gaps_report(spark, d):
    return tidy(quality.gaps_report(D.supplier_prices(spark, d)))


@query(
    "gaps_report_ticks",
    _gaps_sql(
        "users AS (SELECT ts AS date, CAST(user_id AS VARCHAR) AS ticker, value AS price FROM events)", "users", 1
    ),
)
def gaps_report_ticks(spark, d):
    ticks = D.table(spark, d, "events").select(
        F.col("ts").alias("date"), F.col("user_id").cast("string").alias("ticker"), F.col("value").alias("price")
    )
    return tidy(quality.gaps_report(ticks, threshold_days=1))


@query(
    "missing_report",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET, f"rc AS ({RET_COV})"],
        "SELECT ticker, n_na AS missing_rows, 100.0 * n_na / n_dates AS missing_pct, end_missing AS ends_missing FROM rc",
        floats=["missing_pct"], ints=["missing_rows"], plain=["ticker", "ends_missing"],
    ),
)
def missing_report(spark, d):
    return tidy(quality.missing_report(D.supplier_returns(spark, d)))


@query(
    "top_abs_moves",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET],
        """SELECT * FROM (SELECT ticker, date, ret, abs(ret) AS abs_ret,
             dense_rank() OVER (PARTITION BY ticker ORDER BY abs(ret) DESC) AS rank FROM sret) WHERE rank <= 5""",
        dates=["date"], floats=["ret", "abs_ret"], ints=["rank"], plain=["ticker"],
    ),
)
def top_abs_moves(spark, d):
    return tidy(quality.top_abs_moves(D.supplier_returns(spark, d), k=5))


@query(
    "infer_return_kind",
    sql(
        [C.BRAND, C.MONTH, C.RET],
        """SELECT count(ret) AS n_obs, CASE WHEN min(ret) <= -1 THEN 'log' WHEN median(abs(ret)) < 0.3 THEN 'simple' ELSE 'log' END AS kind
           FROM ret""",
        ints=["n_obs"], plain=["kind"],
    ),
)
def infer_return_kind(spark, d):
    return quality.infer_return_kind(D.brand_returns(spark, d))


@query(
    "infer_return_kind_by_series",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET],
        """SELECT CASE WHEN bool_or(lo <= -1 OR med > 0.25) THEN 'log' ELSE 'simple' END AS kind
           FROM (SELECT min(ret) AS lo, median(abs(ret)) AS med FROM sret GROUP BY ticker)""",
        plain=["kind"],
    ),
)
def infer_return_kind_by_series(spark, d):
    return quality.infer_return_kind_by_series(D.supplier_returns(spark, d))


@query(
    "infer_periodicity",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK],
        """SELECT med AS median_days, CASE WHEN med IS NULL OR med <= 3 THEN 252 WHEN med <= 9 THEN 52 ELSE 12 END AS per_year,
                  CASE WHEN med IS NULL OR med <= 3 THEN 0.94 WHEN med <= 9 THEN 0.8 ELSE 0.6 END AS ewma_lambda
           FROM (SELECT median(gap) AS med FROM (
             SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM (SELECT DISTINCT date FROM ret)))""",
        floats=["median_days", "ewma_lambda"], ints=["per_year"],
    ),
)
def infer_periodicity(spark, d):
    facts = quality.infer_periodicity(D.brand_returns(spark, d, "1w"))
    return tidy(facts.withColumn("ewma_lambda", ewma_default_lambda(F.col("per_year"))))


# --- resampling and returns -------------------------------------------------------------------------------------

def _resample_sql(unit: str, step: str) -> str:
    return sql(
        [C.TICKS, C.resampled("px", "ticks", unit, step)], "SELECT * FROM px",
        dates=["date"], floats=["price"], plain=["ticker"],
    )


@query("resample_last_1d", _resample_sql("day", "1 DAY"))
def resample_last_1d(spark, d):
    return tidy(R.resample_last(D.event_ticks(spark, d), "1d"))


@query("resample_last_1w", _resample_sql("week", "7 DAYS"))
def resample_last_1w(spark, d):
    return tidy(R.resample_last(D.event_ticks(spark, d), "1w"))


@query("resample_last_1mo", _resample_sql("month", "1 MONTH"))
def resample_last_1mo(spark, d):
    return tidy(R.resample_last(D.event_ticks(spark, d), "1mo"))


@query(
    "resample_last_3mo",
    sql(
        [C.BRAND, C.resampled("px", "brand", "quarter", "3 MONTHS")], "SELECT * FROM px",
        dates=["date"], floats=["price"], plain=["ticker"],
    ),
)
def resample_last_3mo(spark, d):
    return tidy(R.resample_last(D.brand_prices(spark, d), "3mo"))


RET_COLS = dict(dates=["date"], floats=["ret"], plain=["ticker"])


@query("returns_log", sql([C.BRAND, C.WEEK, C.RET_WEEK], "SELECT * FROM ret", **RET_COLS))
def returns_log(spark, d):
    return tidy(R.returns_from_prices(D.brand_prices(spark, d), freq="1w", kind="log"))


@query("returns_simple", sql([C.BRAND, C.WEEK, C.RET_WEEK_SIMPLE], "SELECT * FROM ret", **RET_COLS))
def returns_simple(spark, d):
    return tidy(R.returns_from_prices(D.brand_prices(spark, d), freq="1w", kind="simple"))


@query("returns_log_supplier", sql([C.SUPP, C.SUPP_MONTH, C.SUPP_RET], "SELECT * FROM sret", **RET_COLS))
def returns_log_supplier(spark, d):
    return tidy(R.returns_from_prices(D.supplier_prices(spark, d), freq="1mo", kind="log"))


@query(
    "returns_on_grid",
    sql(
        [C.BRAND],
        """SELECT a.date, a.ticker, ln(a.price / b.price) AS ret FROM brand a
           JOIN (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM brand)) c ON a.date = c.date
           JOIN brand b ON b.date = c.prev AND b.ticker = a.ticker""",
        **RET_COLS,
    ),
)
def returns_on_grid(spark, d):
    return tidy(R.returns_on_grid(D.brand_prices(spark, d), "log"))


def _to_freq_sql(ret_cte: str, expr: str) -> str:
    return sql(
        [C.BRAND, C.WEEK, ret_cte],
        f"""SELECT g.date, t.ticker, coalesce(a.ret, 0) AS ret
            FROM (SELECT DISTINCT date_trunc('month', date - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS date FROM ret) g
            CROSS JOIN (SELECT DISTINCT ticker FROM ret) t
            LEFT JOIN (SELECT date_trunc('month', date - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS date, ticker, {expr} AS ret
                       FROM ret GROUP BY 1, 2) a ON a.date = g.date AND a.ticker = t.ticker""",
        **RET_COLS,
    )


@query("returns_to_frequency_log", _to_freq_sql(C.RET_WEEK, "sum(ret)"))
def returns_to_frequency_log(spark, d):
    return tidy(R.returns_to_frequency(D.brand_returns(spark, d, "1w"), freq="1mo", kind="log"))


@query("returns_to_frequency_simple", _to_freq_sql(C.RET_WEEK_SIMPLE, "product(1 + ret) - 1"))
def returns_to_frequency_simple(spark, d):
    return tidy(R.returns_to_frequency(D.brand_returns(spark, d, "1w", "simple"), freq="1mo", kind="simple"))


@query(
    "returns_to_frequency_inferred",
    _to_freq_sql(
        C.RET_WEEK,
        """CASE WHEN (SELECT min(ret) <= -1 OR NOT median(abs(ret)) < 0.3 FROM ret)
                THEN sum(ret) ELSE product(1 + ret) - 1 END""",
    ),
)
def returns_to_frequency_inferred(spark, d):
    return tidy(R.returns_to_frequency(D.brand_returns(spark, d, "1w"), freq="1mo"))


@query(
    "returns_to_frequency_null",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK],
        """SELECT last_day(date)::TIMESTAMP AS date, ticker,
             CASE WHEN (SELECT bool_or(lo <= -1 OR med > 0.25) FROM
                          (SELECT min(ret) AS lo, median(abs(ret)) AS med FROM ret GROUP BY ticker))
                  THEN sum(ret) ELSE product(1 + ret) - 1 END AS ret FROM ret GROUP BY 1, 2""",
        **RET_COLS,
    ),
)
def returns_to_frequency_null(spark, d):
    return tidy(R.returns_to_frequency_null(D.brand_returns(spark, d, "1w"), "1mo"))


@query(
    "annualize",
    sql(
        [C.BRAND, C.MONTH, C.RET],
        "SELECT ticker, 12 * avg(ret) AS mean_annual, sqrt(12) * stddev_samp(ret) AS vol_annual FROM ret GROUP BY ticker",
        floats=["mean_annual", "vol_annual"], plain=["ticker"],
    ),
)
def annualize_stats(spark, d):
    base = D.brand_returns(spark, d).groupBy("ticker").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return tidy(
        base.select(
            "ticker",
            annualize(F.col("m"), 12).alias("mean_annual"),
            annualize(F.col("s"), 12, 0.5).alias("vol_annual"),
        )
    )


@query(
    "rebalance_dates",
    sql(
        [C.BRAND],
        """SELECT max(date) AS rb_date FROM brand
           GROUP BY date_trunc('month', date - INTERVAL 1 MICROSECOND)""",
        dates=["rb_date"],
    ),
)
def rebalance_dates(spark, d):
    return tidy(R.rebalance_dates(D.brand_prices(spark, d), "1mo"))


# --- statistics -------------------------------------------------------------------------------------------------

@query(
    "winsorize",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET,
         "ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret) - 1 AS rk, count(*) OVER (PARTITION BY ticker) - 1 AS m FROM sret)",
         """q AS (SELECT ticker, max(ret) FILTER (rk = floor(0.05 * m + 0.5)) AS lo,
                         max(ret) FILTER (rk = floor((1 - 0.05) * m + 0.5)) AS hi FROM ranked GROUP BY ticker)"""],
        "SELECT date, ticker, least(greatest(ret, lo), hi) AS ret_w FROM sret JOIN q USING (ticker)",
        dates=["date"], floats=["ret_w"], plain=["ticker"],
    ),
)
def winsorize(spark, d):
    return tidy(stats.winsorize(hand_off(D.supplier_returns(spark, d), "returns"), q=0.05))


@query(
    "winsorize_linear",
    sql(
        [C.SUPP, C.SUPP_MONTH, C.SUPP_RET,
         "q AS (SELECT ticker, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM sret GROUP BY ticker)"],
        "SELECT date, ticker, least(greatest(ret, lo), hi) AS ret_w FROM sret JOIN q USING (ticker)",
        dates=["date"], floats=["ret_w"], plain=["ticker"],
    ),
)
def winsorize_linear(spark, d):
    return tidy(stats.winsorize_linear(hand_off(D.supplier_returns(spark, d), "returns"), q=0.01))


SUMMARY = """SELECT ticker, mean, std, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt,
       CASE WHEN std > 0 THEN (mean - 0.001) / std END AS sharpe, n_obs, 100.0 * (t - n_obs) / t AS missing_pct
FROM (SELECT ticker, any_value(m) AS mean, stddev_samp(ret) AS std, avg((ret - m) ** 2) AS m2, avg((ret - m) ** 3) AS m3,
             avg((ret - m) ** 4) AS m4, count(ret) AS n_obs, (SELECT count(DISTINCT date) FROM ret) AS t
      FROM (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS m FROM ret) GROUP BY ticker)"""


@query(
    "summary_stats",
    sql(
        [C.BRAND, C.MONTH, C.RET], SUMMARY,
        floats=["mean", "std", "skew", "kurt", "sharpe", "missing_pct"], ints=["n_obs"], plain=["ticker"],
    ),
)
def summary_stats(spark, d):
    return tidy(stats.summary_stats(D.brand_returns(spark, d), risk_free=0.001))


ROLLED = """grid AS (
  SELECT c.date, t.ticker, r.ret FROM (SELECT DISTINCT date FROM ret) c CROSS JOIN (SELECT DISTINCT ticker FROM ret) t
  LEFT JOIN ret r ON r.date = c.date AND r.ticker = t.ticker)"""


@query(
    "rolling_vol",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK, ROLLED],
        """SELECT date, ticker, CASE WHEN n = 26 THEN v END AS vol FROM (
             SELECT date, ticker, ret, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS v FROM grid
             WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
           WHERE ret IS NOT NULL""",
        dates=["date"], floats=["vol"], plain=["ticker"],
    ),
)
def rolling_vol(spark, d):
    return tidy(stats.rolling_vol(D.brand_returns(spark, d, "1w"), 26))


PAIR = """pair AS (
  SELECT d.date, max(ret) FILTER (ticker = 'Brand#11') AS a, max(ret) FILTER (ticker = 'Brand#12') AS b
  FROM (SELECT DISTINCT date FROM ret) d LEFT JOIN ret USING (date) GROUP BY 1)"""


@query(
    "rolling_corr",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK, PAIR],
        """SELECT date, CASE WHEN n = 26 THEN c END AS corr FROM (
             SELECT date, count(a + b) OVER w AS n, corr(a, b) OVER w AS c FROM pair
             WINDOW w AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))""",
        dates=["date"], floats=["corr"],
    ),
)
def rolling_corr(spark, d):
    return tidy(stats.rolling_corr(D.brand_returns(spark, d, "1w"), "Brand#11", "Brand#12", 26))


@query(
    "rolling_corr_ref",
    sql(
        [C.BRAND, C.WEEK, C.RET_WEEK, PAIR,
         """res AS (SELECT date, CASE WHEN count(a) OVER w = 26 THEN a - avg(a) OVER w END AS ra,
                           CASE WHEN count(b) OVER w = 26 THEN b - avg(b) OVER w END AS rb,
                           CASE WHEN count(a) OVER w = 26 THEN stddev_samp(a) OVER w END AS sa,
                           CASE WHEN count(b) OVER w = 26 THEN stddev_samp(b) OVER w END AS sb
                    FROM pair WINDOW w AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))"""],
        """SELECT date, CASE WHEN count(ra * rb) OVER w = 26 THEN avg(ra * rb) OVER w END / (sa * sb) AS corr FROM res
           WINDOW w AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""",
        dates=["date"], floats=["corr"],
    ),
)
def rolling_corr_ref(spark, d):
    return tidy(stats.rolling_corr_ref(D.brand_returns(spark, d, "1w"), "Brand#11", "Brand#12", 26))
