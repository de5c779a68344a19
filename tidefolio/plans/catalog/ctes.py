"""Common table expressions of the comparison SQL."""

BRAND = """brand AS (
  SELECT l_shipdate AS date, p_brand AS ticker, avg(l_extendedprice / l_quantity) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
SUPP = """supp AS (
  SELECT l_shipdate AS date, CAST(l_suppkey AS VARCHAR) AS ticker, avg(l_extendedprice / l_quantity) AS price
  FROM lineitem GROUP BY 1, 2)"""
TICKS = """ticks AS (
  SELECT ts AS date, event_type AS ticker, value AS price, event_id AS seq FROM events)"""


def resampled(name: str, source: str, unit: str, step: str) -> str:
    return f"""{name} AS (
  SELECT date_trunc('{unit}', date - INTERVAL 1 MICROSECOND) + INTERVAL {step} AS date, ticker,
         arg_max(price, date) AS price
  FROM {source} GROUP BY 1, 2)"""


def returns(name: str, source: str, expr: str = "ln(price / prev)") -> str:
    return f"""{name} AS (
  SELECT date, ticker, {expr} AS ret
  FROM (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM {source})
  WHERE prev IS NOT NULL)"""


MONTH = resampled("month_px", "brand", "month", "1 MONTH")
WEEK = resampled("week_px", "brand", "week", "7 DAYS")
RET = returns("ret", "month_px")
RET_SIMPLE = returns("ret", "month_px", "price / prev - 1")
RET_WEEK = returns("ret", "week_px")
RET_WEEK_SIMPLE = returns("ret", "week_px", "price / prev - 1")
SUPP_MONTH = resampled("supp_px", "supp", "month", "1 MONTH")
SUPP_RET = returns("sret", "supp_px")

# Dates on which all tickers have a return.
FULL = """full_ret AS (
  SELECT * FROM ret WHERE date IN (
    SELECT date FROM ret GROUP BY date
    HAVING count(ret) = (SELECT count(DISTINCT ticker) FROM ret)))"""
# Dense grid with the ticker's mean in missing cells.
FILLED = """filled AS (
  SELECT d.date, t.ticker, coalesce(r.ret, t.m) AS ret
  FROM (SELECT DISTINCT date FROM ret) d
  CROSS JOIN (SELECT ticker, avg(ret) AS m FROM ret GROUP BY ticker) t
  LEFT JOIN ret r ON r.date = d.date AND r.ticker = t.ticker)"""

HOLD = """hold AS (
  SELECT portfolio_id, ticker, amount / sum(amount) OVER (PARTITION BY portfolio_id) AS weight
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS portfolio_id, p_brand AS ticker, sum(l_extendedprice) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY 1, 2))"""
SEG = """seg AS (
  SELECT portfolio_id, ticker, amount / sum(amount) OVER (PARTITION BY portfolio_id) AS weight
  FROM (SELECT c_mktsegment AS portfolio_id, p_brand AS ticker, sum(l_extendedprice) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2))"""
BENCH = """bench AS (
  SELECT p_brand AS ticker, sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem) AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
META = """meta AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector, n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# Sample covariance of the complete monthly returns, in full (i, j) form.
CENTRED = """centred AS (
  SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM full_ret)"""
SAMPLE = """sigma AS (
  SELECT a.ticker AS i, b.ticker AS j,
         sum(a.x * b.x) / ((SELECT count(DISTINCT date) FROM centred) - 1) AS value
  FROM centred a JOIN centred b ON a.date = b.date GROUP BY 1, 2)"""
MU = """mu AS (SELECT ticker, avg(ret) AS mu FROM full_ret GROUP BY ticker)"""
RISK = [BRAND, MONTH, RET, FULL, CENTRED, SAMPLE, MU]
VIEWS = """tops AS (
  SELECT portfolio_id, arg_max(ticker, (weight, ticker)) AS top, max(weight) AS wt,
         arg_min(ticker, (weight, ticker)) AS low, min(weight) AS wl FROM hold GROUP BY 1),
views AS (
  SELECT portfolio_id, 1 AS view_id, top AS long, NULL AS short, wt / 10 AS q, 0.5 AS conf FROM tops
  UNION ALL
  SELECT portfolio_id, 2, top, low, (wt - wl) / 20, greatest(wl, 0.25) FROM tops WHERE top <> low),
picks AS (
  SELECT portfolio_id, view_id, long AS ticker, 1.0::DOUBLE AS coef, q, conf FROM views
  UNION ALL SELECT portfolio_id, view_id, short, -1.0::DOUBLE, q, conf FROM views WHERE short IS NOT NULL)"""
CORR = """corr AS (
  SELECT s.i, s.j, least(greatest(s.value / sqrt(a.value) / sqrt(b.value), -1), 1) AS value
  FROM sigma s JOIN sigma a ON a.i = s.i AND a.j = s.i JOIN sigma b ON b.i = s.j AND b.j = s.j)"""
BRAND_META = """bmeta AS (
  SELECT DISTINCT p_brand AS ticker, 'm' || substr(p_brand, 7, 1) AS sector, 's' || substr(p_brand, 8, 1) AS country FROM part),
expo AS (
  SELECT 'sector:' || upper(sector) AS factor, ticker, 1.0::DOUBLE AS exposure FROM bmeta
  UNION ALL SELECT 'country:' || upper(country), ticker, 1.0 FROM bmeta)"""
# Customers' weights against the spending benchmark, every ticker of either side.
ACTIVE = """active AS (
  SELECT p.portfolio_id, t.ticker, coalesce(h.weight, 0) AS weight, coalesce(b.weight, 0) AS bench,
         coalesce(h.weight, 0) - coalesce(b.weight, 0) AS v
  FROM (SELECT DISTINCT portfolio_id FROM hold) p
  CROSS JOIN (SELECT ticker FROM bench UNION SELECT ticker FROM hold) t
  LEFT JOIN hold h ON h.portfolio_id = p.portfolio_id AND h.ticker = t.ticker
  LEFT JOIN bench b ON b.ticker = t.ticker)"""
PORT_RET = """port AS (
  SELECT portfolio_id, date, sum(weight * ret) AS ret FROM hold JOIN ret USING (ticker) GROUP BY 1, 2)"""
SEG_RET = """seg_px AS (
  SELECT universe_id, date_trunc('quarter', date - INTERVAL 1 MICROSECOND) + INTERVAL 3 MONTHS AS date, ticker, arg_max(price, date) AS price
  FROM (SELECT c_mktsegment AS universe_id, l_shipdate AS date, p_brand AS ticker, avg(l_extendedprice / l_quantity) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
uret AS (
  SELECT universe_id, date, ticker, ln(price / prev) AS ret
  FROM (SELECT *, lag(price) OVER (PARTITION BY universe_id, ticker ORDER BY date) AS prev FROM seg_px) WHERE prev IS NOT NULL),
ufull AS (
  SELECT * FROM uret WHERE (universe_id, date) IN (
    SELECT (universe_id, date) FROM uret JOIN (SELECT universe_id, count(DISTINCT ticker) AS n FROM uret GROUP BY 1) USING (universe_id)
    GROUP BY universe_id, date, n HAVING count(ret) = n)),
ucentred AS (
  SELECT universe_id, date, ticker, ret - avg(ret) OVER (PARTITION BY universe_id, ticker) AS x FROM ufull),
usigma AS (
  SELECT a.universe_id, a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / (any_value(t.n) - 1) AS value
  FROM ucentred a JOIN ucentred b ON a.universe_id = b.universe_id AND a.date = b.date
  JOIN (SELECT universe_id, count(DISTINCT date) AS n FROM ucentred GROUP BY 1) t ON t.universe_id = a.universe_id
  GROUP BY 1, 2, 3)"""
SEG_RET_MONTH = SEG_RET.split(",\nufull")[0].replace("'quarter'", "'month'").replace("3 MONTHS", "1 MONTH")
