"""Analytics over weight tables (portfolio_id, ticker, weight) for many portfolios at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import finite
from ..schema import attach, grouped, require, universe_keys
from ..session import Store, busy_partitions, lazily
from .covariance import pack_matrix, unpack

PID = "portfolio_id"
GAP = 1e-12


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Return of each portfolio on each date (missing returns earn 0)."""
    by = _universe(weights, returns)
    table = returns.select(*by, "ticker", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return _sum_products(_lists(weights, by), table, by, "date", "ret")


BLOCK = 512  # portfolios multiplied with the matrix at a time
PART_ROWS, PART_KEYS, PART_CELLS = 1 << 20, 1 << 13, 1 << 22  # of a table of returns or exposures that meet a block at a time


def _universe(weights: DataFrame, *market: DataFrame) -> list[str]:
    """The universe key, if any: portfolios name theirs and meet only the covariances, means or returns that belong to it."""
    by = sorted({c for df in (weights, *market) for c in universe_keys(df)})
    for c in by:
        if any(c not in df.columns for df in (weights, *market)):
            raise ValueError(f"several universes: weights and market data all need {c}")
    return by


def _lists(weights: DataFrame, by: list[str], bench: DataFrame | None = None) -> DataFrame:
    """Each portfolio's entries in three lists: ``tickers``, ``values`` (NULL as 0) and whether a value is ``given``.

    A benchmark shared by all portfolios follows with its weights taken off, so that a sum over the list is an active one.
    """
    require(weights, PID, "ticker", "weight")

    def entries(sign: float) -> Column:
        value = F.coalesce(F.lit(sign) * F.col("weight"), F.lit(0.0))
        return F.collect_list(F.struct("ticker", value.alias("value"), F.col("weight").isNotNull().alias("given")))

    held = weights.where(F.col("ticker").isNotNull()) if bench is None else weights
    rows = held.groupBy(*by, PID).agg(entries(1.0).alias("_list"))
    if bench is not None:
        own = [c for c in by if c in bench.columns]
        shared = grouped(bench, own, entries(-1.0).alias("_shared"))
        rows = rows.join(shared, own, "left") if own else attach(rows, shared, own)
        rows = rows.withColumn("_list", F.concat("_list", F.coalesce("_shared", F.array())))
        rows = rows.withColumn("_list", F.filter("_list", lambda e: e["ticker"].isNotNull()))
    e = F.col("_list")
    return rows.select(*by, PID, e["ticker"].alias("tickers"), e["value"].alias("values"), e["given"].alias("given"))


def _sum_products(lists: DataFrame, table: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Sum of weight times ``value`` per portfolio and ``key`` (a date, a factor) of the ``table`` (ticker, key, value).

    There is a row where any entry of the portfolio's list meets one of the table, NULL where no product has both sides.
    Portfolios travel as lists and the table once per block of them, so nothing is made per portfolio, ticker and key. A
    large table is cut by its keys, all rows of a key together.
    """
    per_block = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int")
    blocks = grouped(lists, by, per_block.alias("_blocks"))
    keys, names = F.approx_count_distinct(key), F.approx_count_distinct("ticker")
    most = F.greatest(F.count(F.lit(1)) / PART_ROWS, keys / PART_KEYS, keys * names / PART_CELLS)
    per_part = F.greatest(F.ceil(most), F.lit(1)).cast("int")
    parts = grouped(table, by, per_part.alias("_parts"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    tasks = attach(attach(lists, blocks, by), parts, by).select(
        *by, every("_parts").alias("_part"), F.pmod(F.xxhash64(PID), F.col("_blocks")).cast("int").alias("_block"), PID, "tickers", "values", "given"
    )
    cells = attach(attach(table.where(F.col("ticker").isNotNull()), parts, by), blocks, by).select(
        *by, F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"), every("_blocks").alias("_block"),
        "ticker", F.col(key).alias("_key"), F.coalesce(F.col(value), F.lit(0.0)).alias("_x"), F.col(value).isNotNull().alias("_known"),
    )
    # Fresh names, so that weights derived from the same table do not clash with it.
    cells = cells.select(*[F.col(c).alias(c) for c in cells.columns])

    def run(group: Tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in (*by, PID, key, value, "_nan")}
        place, names = pd.factorize(np.concatenate(left["tickers"].to_list()).astype(object)) if len(left) else ([], [])
        at = pd.Index(names).get_indexer(right["ticker"]) if len(names) else np.full(len(right), -1)
        right, at = right[at >= 0], at[at >= 0]
        if len(right):
            when, dates = pd.factorize(right["_key"], use_na_sentinel=False)
            known = right["_known"].to_numpy(dtype=bool)
            there, filled = np.zeros((2, len(names), len(dates)))
            there[at, when], filled[at[known], when[known]] = 1.0, 1.0
            # Rows of the same ticker and key add up.
            x = np.bincount(at * len(dates) + when, right["_x"].to_numpy(dtype=float), there.size).reshape(there.shape)
            who = np.repeat(np.arange(len(left)), left["tickers"].map(len))
            given = np.concatenate(left["given"].to_list()).astype(bool)
            weight = np.concatenate(left["values"].to_list()).astype(float)
            held, own, w = np.zeros((3, len(left), len(names)))
            held[who, place], own[who[given], place[given]] = 1.0, 1.0
            np.add.at(w, (who, place), weight)
            if np.isfinite(x).all() and np.isfinite(w).all():
                sums = w @ x
            else:  # infinite times what is not there must not count
                sums = np.zeros((len(left), len(dates)))
                with np.errstate(invalid="ignore"):
                    for k in range(len(names)):
                        meet = (own[:, k, None] > 0) & (filled[k] > 0)
                        sums += np.where(meet, w[:, k, None] * x[k], 0.0)
            rows, cols = np.nonzero(held @ there)
            some = (own @ filled)[rows, cols] > 0
            found = sums[rows, cols]
            out = {c: group[k] for k, c in enumerate(by)}
            out |= {PID: left[PID].to_numpy()[rows], key: dates.take(cols), value: np.where(some, found, np.nan), "_nan": some & np.isnan(found)}
        return pd.DataFrame(out)

    n, keys = busy_partitions(lists), [*by, "_part", "_block"]
    left, right = tasks.repartition(n, *keys).groupBy(*keys), cells.repartition(n, *keys).groupBy(*keys)
    kinds = {f.name: f.dataType.simpleString() for f in (*table.schema.fields, *lists.schema.fields)}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, PID, key)), f"`{value}` double", "_nan boolean"])
    sums = left.cogroup(right).applyInPandas(run, schema)
    # A NaN reaches Spark as NULL.
    return sums.select(*by, PID, key, F.when(F.col("_nan"), float("nan")).otherwise(F.col(value)).alias(value))


def _by_blocks(
    weights: DataFrame, sigma: DataFrame, value: str, make: Callable, schema: str, portfolios: DataFrame | None = None
) -> DataFrame:
    """Rows that ``make(ids, names, W, held, S)`` gives for each block of portfolios: their dense weights over the universe,
    which of them are held, and the covariance matrix.

    Portfolios travel as lists of what they hold and the packed matrix once per block, so nothing is made per pair of
    tickers. ``portfolios``, where given, has the same portfolios and is cheaper to count than ``weights``.
    """
    by = _universe(weights, sigma)
    lists = weights.groupBy(*by, PID).agg(F.collect_list("ticker").alias("tickers"), F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).alias("values"))
    count = F.greatest(F.ceil(F.approx_count_distinct(PID) / BLOCK), F.lit(1)).cast("long").alias("_blocks")
    blocks = grouped(weights if portfolios is None else portfolios, by, count)
    tasks = attach(lists, blocks, by).withColumn("_block", F.pmod(F.xxhash64(PID), F.col("_blocks"))).drop("_blocks")
    market = attach(pack_matrix(sigma), blocks, by).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    )
    market = market.select(*[F.col(c).alias(c) for c in (*by, "_block")], "names", "cells")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return make(np.array([], dtype=object), np.array([], dtype=object), np.zeros((0, 0)), np.zeros((0, 0), bool), np.zeros((0, 0)))
        names = np.asarray(right["names"].iloc[0], dtype=object)
        matrix = unpack(right["cells"].iloc[0], names)
        sizes = left["tickers"].map(len).to_numpy()
        tickers = np.concatenate(left["tickers"].to_list()) if sizes.sum() else np.array([], dtype=object)
        values = np.concatenate(left["values"].to_list()).astype(float) if sizes.sum() else np.zeros(0)
        at = np.minimum(np.searchsorted(names, tickers), len(names) - 1)
        known = names[at] == tickers
        rows = np.repeat(np.arange(len(left)), sizes)[known]
        dense, held = np.zeros((len(left), len(names))), np.zeros((len(left), len(names)), dtype=bool)
        np.add.at(dense, (rows, at[known]), values[known])
        held[rows, at[known]] = True
        return make(left[PID].to_numpy(dtype=object), names, dense, held, matrix)

    def named(key: Tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = run(left, right)
        for k, c in enumerate(by):
            out.insert(k, c, key[k])
        return out

    n, keys = busy_partitions(weights), [*by, "_block"]
    left, right = tasks.repartition(n, *keys).groupBy(*keys), market.repartition(n, *keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(named, "".join(f"{c} string, " for c in by) + schema)


def _variances(weights: DataFrame, sigma: DataFrame, value: str = "weight") -> DataFrame:
    """(portfolio_id, _var) of portfolios with at least one priced ticker."""

    def make(ids, names, w, held, s) -> pd.DataFrame:
        some = held.any(axis=1)
        return pd.DataFrame({PID: ids[some], "_var": np.einsum("ij,ij->i", w[some] @ s, w[some]) if len(ids) else []})

    return _by_blocks(weights, sigma, value, make, "portfolio_id string, _var double")


def sigma_times(weights: DataFrame, sigma: DataFrame, value: str = "weight", portfolios: DataFrame | None = None) -> DataFrame:
    """(Sigma w) as ``_sw`` per portfolio and ticker of the universe, next to the ticker's own weight ``_w``.

    Products are made for blocks of portfolios at a time. Tickers without covariance carry no risk and drop out;
    ``unpriced_share`` says how much that is.
    """

    def make(ids, names, w, held, s) -> pd.DataFrame:
        some = held.any(axis=1)
        ids, w, held = ids[some], w[some], held[some]
        own = np.where(held, w, np.nan)
        return pd.DataFrame(
            {PID: np.repeat(ids, len(names)), "ticker": np.tile(names, len(ids)), "_sw": (w @ s).ravel() if len(ids) else [], "_w": own.ravel()}
        )

    out = _by_blocks(weights, sigma, value, make, "portfolio_id string, ticker string, _sw double, _w double", portfolios)
    return out.withColumn("_w", F.nanvl("_w", F.lit(None).cast("double")))


def unpriced_share(weights: DataFrame, sigma: DataFrame, value: str = "weight") -> DataFrame:
    """Per portfolio, the part of its absolute weights in tickers without a covariance, which carry no risk here."""
    return _priced_sums(weights, sigma, None, "_gain", value).drop("_gain")


def _priced_sums(weights: DataFrame, sigma: DataFrame, mu: DataFrame | None, gain: str, value: str = "weight") -> DataFrame:
    """Per portfolio: the sum of weight times mean over its priced tickers, and the unpriced share."""
    by = _universe(weights, sigma) if mu is None else _universe(weights, sigma, mu)
    priced = sigma.where(F.col("i") == F.col("j")).select(*by, F.col("i").alias("ticker"), F.lit(True).alias("_priced"))
    if mu is not None:
        priced = priced.join(mu.select(*by, "ticker", "mu"), [*by, "ticker"], "left")
    else:
        priced = priced.withColumn("mu", F.lit(0.0))
    w = F.coalesce(F.col(value), F.lit(0.0))
    without = F.sum(F.when(F.col("_priced").isNull(), F.abs(w)).otherwise(0.0))
    return (
        weights.select(*by, PID, "ticker", F.col(value)).join(priced, [*by, "ticker"], "left").groupBy(*by, PID)
        .agg(
            F.sum(w * F.coalesce("mu", F.lit(0.0))).alias(gain),
            F.coalesce(F.try_divide(without, F.sum(F.abs(w))), F.lit(0.0)).alias("unpriced"),
        )
    )


def _root(variance: Column) -> Column:
    """Square root of a variance that rounding may have put below 0; NULL stays NULL."""
    return F.when(variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0))))


def active_weights(weights: DataFrame, bench: DataFrame) -> DataFrame:
    """Weight, benchmark weight and their difference for every ticker held by either.

    A benchmark without portfolio_id applies to all portfolios: its (ticker, weight) list, one entry per ticker of
    the universe, is read as a scalar and unfolded per portfolio.
    """
    require(weights, PID, "ticker", "weight")
    by = universe_keys(weights)
    own = [c for c in by if c in bench.columns]
    if PID in bench.columns:
        if own != by:
            raise ValueError("a benchmark per portfolio needs the universe too")
        held = weights.select(*by, PID, "ticker", "weight", F.lit(0.0).alias("bench"))
        both = held.unionByName(bench.select(*by, PID, "ticker", F.lit(0.0).alias("weight"), F.col("weight").alias("bench")))
    else:
        # Weights are shuffled once, by portfolio: the sums below find the rows of a portfolio together.
        mine = F.collect_list(F.struct("ticker", "weight", F.lit(0.0).alias("bench")))
        listed = grouped(
            bench, own, F.collect_list(F.struct("ticker", F.lit(0.0).alias("weight"), F.col("weight").alias("bench"))).alias("_list")
        )
        lists = weights.groupBy(*by, PID).agg(mine.alias("_mine"))
        lists = lists.join(listed, own, "left") if own else attach(lists, listed, own)
        both = lists.select(*by, PID, F.inline(F.concat("_mine", F.coalesce("_list", F.array()))))
    sums = both.groupBy(*by, PID, "ticker").agg(F.sum("weight").alias("weight"), F.sum("bench").alias("bench"))
    return sums.withColumn("active", F.col("weight") - F.col("bench"))


def portfolio_stats(weights: DataFrame, mu: DataFrame, sigma: DataFrame, rf: float = 0.0) -> DataFrame:
    """Expected return, risk, Sharpe ratio (NULL where the risk vanishes) and the unpriced share of every portfolio.

    A portfolio without any priced ticker is kept, with NULL for what needs a covariance.
    """
    who = [*_universe(weights, sigma, mu), PID]
    both = _priced_sums(weights, sigma, mu, "mu_p").join(_variances(weights, sigma), who, "left")
    risk = _root(F.col("_var"))
    rows = both.select(*who, F.when(F.col("_var").isNotNull(), F.col("mu_p")).alias("mu_p"), risk.alias("sigma_p"), "unpriced")
    sharpe = F.when(F.col("sigma_p") > GAP, (F.col("mu_p") - rf) / F.col("sigma_p"))
    return rows.select(*who, "mu_p", "sigma_p", sharpe.alias("sharpe"), "unpriced")


def portfolio_stats_from_returns(weights: DataFrame, returns: DataFrame, rf: float = 0.0) -> DataFrame:
    """Same from the portfolios' own return series; no matrix is needed."""
    rows = portfolio_returns(weights, returns).groupBy(*_universe(weights, returns), PID).agg(
        F.avg("ret").alias("mu_p"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sigma_p")
    )
    return rows.withColumn("sharpe", F.when(F.col("sigma_p") > GAP, (F.col("mu_p") - rf) / F.col("sigma_p")))


def gini(df: DataFrame, value: str = "weight", group: str = PID) -> DataFrame:
    """Concentration of |value| per group; 0 where the sum is not positive."""
    x = F.abs(F.col(value))
    order = W.partitionBy(group).orderBy(x).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.where(F.col(value).isNotNull()).select(group, x.alias("_x"), F.sum(x).over(order).alias("_cum"))
    n, total = F.count("_x"), F.sum("_x")
    return rows.groupBy(group).agg(
        F.when(total > 0, (n + 1 - 2 * F.sum("_cum") / total) / n).otherwise(F.lit(0.0)).alias("gini")
    )


def risk_contributions(
    weights: DataFrame, sigma: DataFrame, normalize: bool = False
) -> DataFrame:
    """w_i (Sigma w)_i, or its share of the portfolio variance."""
    held = sigma_times(weights, sigma).where(F.col("_w").isNotNull())
    rows = held.select(*universe_keys(sigma), PID, "ticker", (F.col("_w") * F.col("_sw")).alias("rc"))
    return _as_shares(rows) if normalize else rows


def risk_contributions_from_returns(weights: DataFrame, returns: DataFrame, normalize: bool = False) -> DataFrame:
    """w_i cov(r_i, r_p): rows grow with tickers times dates, not with the square of tickers."""
    by = _universe(weights, returns)
    held = weights.join(returns.select(*by, "date", "ticker", "ret"), [*by, "ticker"])
    rows = (
        held.join(portfolio_returns(weights, returns).withColumnRenamed("ret", "_rp"), [*by, PID, "date"])
        .groupBy(*by, PID, "ticker")
        .agg((F.first("weight") * F.covar_samp("ret", "_rp")).alias("rc"))
    )
    return _as_shares(rows) if normalize else rows


def _as_shares(rows: DataFrame) -> DataFrame:
    total = F.sum("rc").over(W.partitionBy(*universe_keys(rows), PID))
    scale = F.when(F.abs(total) > 1e-16, total).otherwise(F.lit(1.0))
    return rows.withColumn("rc", F.col("rc") / scale)


def _distance(active: DataFrame, lam: float) -> DataFrame:
    v = F.col("active")
    return active.groupBy(*universe_keys(active), PID).agg(
        F.sum(F.abs(v)).alias("l1"),
        F.sqrt(F.sum(v * v)).alias("l2"),
        (lam * F.sum(F.abs(v))).alias("l1_penalty"),
        (0.5 * lam * F.sum(v * v)).alias("l2_penalty"),
    )


def _beside(weights: DataFrame, bench: DataFrame) -> Tuple[DataFrame, DataFrame, list[str]]:
    """Held tickers with the shared benchmark's weight in ``bench`` (NULL where it holds none), the benchmark with a row per
    ticker, and its universe key: nothing is made for tickers that a portfolio does not hold."""
    require(weights, PID, "ticker", "weight")
    by = universe_keys(weights)
    own = [c for c in by if c in bench.columns]
    shared = bench.groupBy(*own, "ticker").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("bench"))
    held = weights.groupBy(*by, PID, "ticker").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    return held.join(shared, [*own, "ticker"], "left"), shared, own


def turnover(weights: DataFrame, ref: DataFrame, lam: float = 1.0) -> DataFrame:
    """L1 and L2 distance to the reference weights, and the penalties lam*L1 and lam/2*L2^2.

    Of reference weights shared by all portfolios only those of held tickers are met one by one; the others are what is left
    of their totals.
    """
    if PID in ref.columns:
        return _distance(active_weights(weights, ref), lam)
    rows, shared, own = _beside(weights, ref)
    who = [*universe_keys(weights), PID]
    b = F.col("bench")
    off = F.col("weight") - F.coalesce(b, F.lit(0.0))
    met = rows.groupBy(*who).agg(
        F.sum(F.abs(off)).alias("_off1"), F.sum(off * off).alias("_off2"),
        F.sum(F.abs(b)).alias("_met1"), F.sum(b * b).alias("_met2"), F.count(b).alias("_met"),
    )
    totals = grouped(shared, own, F.sum(F.abs(b)).alias("_all1"), F.sum(b * b).alias("_all2"), F.count(b).alias("_all"))
    both = met.join(totals, own, "left") if own else attach(met, totals, own)

    def rest(k: int) -> Column:
        # Exactly nothing where every ticker was met.
        left = F.greatest(F.col(f"_all{k}") - F.coalesce(F.col(f"_met{k}"), F.lit(0.0)), F.lit(0.0))
        return F.when(F.col("_met") < F.col("_all"), left).otherwise(0.0)

    l1, square = F.col("_off1") + rest(1), F.col("_off2") + rest(2)
    return both.select(
        *who, l1.alias("l1"), F.sqrt(square).alias("l2"), (lam * l1).alias("l1_penalty"), (0.5 * lam * square).alias("l2_penalty")
    )


def _tracking(active: DataFrame, sigma: DataFrame, mu: DataFrame | None) -> DataFrame:
    """te, active_ret where ``mu`` is given, and unpriced; NULL where nothing of a portfolio is priced."""
    who = [*_universe(active, sigma), PID]
    both = _priced_sums(active, sigma, mu, "active_ret", "active").join(_variances(active, sigma, "active"), who, "left")
    te = _root(F.col("_var")).alias("te")
    gain = [F.when(F.col("_var").isNotNull(), F.col("active_ret")).alias("active_ret")] if mu is not None else []
    return both.select(*who, te, *gain, "unpriced")


def tracking_error(
    weights: DataFrame, bench: DataFrame, sigma: DataFrame, mu: DataFrame | None = None, store: Store = lazily
) -> DataFrame:
    """Root of the active variance, the active expected return where ``mu`` is given, and the unpriced share of the active
    weights; a portfolio without any priced ticker is kept, with NULL for what needs a covariance."""
    return _tracking(store(active_weights(weights, bench), "active"), sigma, mu)


def tracking_error_from_returns(weights: DataFrame, bench: DataFrame, returns: DataFrame) -> DataFrame:
    """Standard deviation of the active return series."""
    by = _universe(weights, returns)
    if PID in bench.columns:
        active = active_weights(weights, bench).select(*by, PID, "ticker", F.col("active").alias("weight"))
        series = portfolio_returns(active, returns)
    else:
        table = returns.select(*by, "ticker", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
        series = _sum_products(_lists(weights, by, bench), table, by, "date", "ret")
    return series.groupBy(*by, PID).agg(F.stddev_samp("ret").alias("te"))


def _exposure(active: DataFrame, exposures: DataFrame, lb: float | None, ub: float | None) -> DataFrame:
    who, by = [*universe_keys(active), PID], [c for c in universe_keys(active) if c in exposures.columns]
    rows = (
        active.join(exposures.select(*by, "factor", "ticker", "exposure"), [*by, "ticker"])
        .groupBy(*who, "factor")
        .agg(F.sum(F.col("active") * F.col("exposure")).alias("exposure"))
    )
    return _outside(rows, who, lb, ub)


def _outside(rows: DataFrame, who: list[str], lb: float | None, ub: float | None) -> DataFrame:
    above = F.greatest(F.col("exposure") - ub, F.lit(0.0)) if ub is not None else F.lit(0.0)
    below = F.greatest(F.lit(lb) - F.col("exposure"), F.lit(0.0)) if lb is not None else F.lit(0.0)
    return rows.select(
        *who,
        "factor",
        "exposure",
        above.alias("above"),
        below.alias("below"),
        (0.5 * (above * above + below * below)).alias("penalty"),
    )


def active_exposure(
    weights: DataFrame, bench: DataFrame, exposures: DataFrame, lb: float | None = None, ub: float | None = None
) -> DataFrame:
    """Active exposure per factor, its excess over the bounds, and half the squared excess.

    Portfolios with their active weights against a shared benchmark meet the exposures in blocks.
    """
    if PID in bench.columns:
        return _exposure(active_weights(weights, bench), exposures, lb, ub)
    keys = universe_keys(weights)
    who = [*keys, PID]
    by = [c for c in keys if c in exposures.columns]
    if by == keys:
        lists, table = _lists(weights, keys, bench), exposures.select(*by, "factor", "ticker", "exposure")
        return _outside(_sum_products(lists, table, keys, "factor", "exposure"), who, lb, ub)
    return _exposure(active_weights(weights, bench), exposures, lb, ub)


def te_objective(
    weights: DataFrame,
    bench: DataFrame,
    sigma: DataFrame,
    mu: DataFrame,
    *,
    gamma: float,
    lam_l2: float = 0.0,
    ref: DataFrame | None = None,
    exposures: DataFrame | None = None,
    lb: float | None = None,
    ub: float | None = None,
    rho: float = 0.0,
    store: Store = lazily,
) -> DataFrame:
    """Half active variance - gamma * active return + lam/2 |w - ref|^2 + rho * exposure penalty, with its parts.

    All parts read the same active weights; ``store`` keeps them from being computed once per part.
    """
    active = store(active_weights(weights, bench), "active")
    out = _tracking(active, sigma, mu).withColumn("te2", F.col("te") * F.col("te"))
    away = active if ref is None else active_weights(weights, ref)
    who = [*_universe(active, sigma), PID]
    out = out.join(_distance(away, lam_l2).select(*who, F.col("l2_penalty").alias("reg")), who, "left")
    if exposures is not None and rho > 0:
        penalty = _exposure(active, exposures, lb, ub).groupBy(*who).agg(F.sum("penalty").alias("expo_pen"))
        out = out.join(penalty, who, "left").withColumn("expo_pen", F.coalesce("expo_pen", F.lit(0.0)))
    else:
        out = out.withColumn("expo_pen", F.lit(0.0))
    loss = 0.5 * F.col("te2") - gamma * F.col("active_ret") + F.col("reg") + rho * F.col("expo_pen")
    return out.select(*who, "te", "te2", "active_ret", "reg", "expo_pen", loss.alias("loss"))


# --- checks -------------------------------------------------------------------------------------------------------

def box_feasible(n: Column, w_min: Column | float, w_max: Column | float) -> Column:
    lo = w_min if isinstance(w_min, Column) else F.lit(float(w_min))
    hi = w_max if isinstance(w_max, Column) else F.lit(float(w_max))
    return (n * lo <= 1.0) & (n * hi >= 1.0) & (lo <= hi)


def box_check(weights: DataFrame, w_min: float, w_max: float) -> DataFrame:
    """Per portfolio: whether the box admits weights that sum to 1, and the box widened to contain 1/n."""
    n = F.count(F.lit(1))
    return weights.groupBy(PID).agg(
        n.alias("n"),
        box_feasible(n, w_min, w_max).alias("feasible"),
        F.least(F.lit(float(w_min)), 1.0 / n).alias("w_min"),
        F.greatest(F.lit(float(w_max)), 1.0 / n).alias("w_max"),
    )


def validate_weights(weights: DataFrame, w_min: float = 0.0, w_max: float = 1.0, tol: float = 1e-8) -> DataFrame:
    w = F.col("weight")
    bad = finite(w).isNull()
    inside = (w >= w_min - tol) & (w <= w_max + tol)
    return weights.groupBy(PID).agg(
        (F.count_if(bad) == 0).alias("all_finite"),
        F.coalesce(F.abs(F.sum(finite(w)) - 1.0) < tol, F.lit(False)).alias("sums_to_one"),
        (F.count_if(~inside | bad) == 0).alias("in_box"),
    )


# --- tables behind the charts ---------------------------------------------------------------------------------------

def correlation_edges(corr: DataFrame, threshold: float = 0.3) -> DataFrame:
    rho = F.col("value")
    return corr.where((F.col("i") < F.col("j")) & (F.abs(rho) >= threshold)).select(
        "i",
        "j",
        rho.alias("rho"),
        F.when(rho >= 0, F.lit(1)).otherwise(F.lit(-1)).alias("sign"),
        (1.0 + 3.0 * F.abs(rho)).alias("width"),
    )


def correlation_degree(corr: DataFrame, threshold: float = 0.3) -> DataFrame:
    strong = F.count_if((F.abs(F.col("value")) >= threshold) & (F.col("i") != F.col("j")))
    return corr.groupBy(F.col("i").alias("ticker")).agg(strong.alias("degree"))


def top_n(df: DataFrame, value: str, n: int, group: str | None = PID, tie: str = "ticker") -> DataFrame:
    """The n largest rows per group (``row_number() <= n`` trims each map partition before the shuffle)."""
    order = W.partitionBy(*([group] if group else [])).orderBy(F.desc_nulls_last(value), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_paths(weights: DataFrame, n: int = 20, by: str = "gamma") -> DataFrame:
    """Weight paths of the n tickers with the highest peak, with log10 of the swept parameter."""
    peaks = weights.groupBy("ticker").agg(F.max("weight").alias("peak"))
    best = peaks.orderBy(F.desc("peak"), "ticker").limit(n)
    return weights.join(best, "ticker").withColumn("log10_" + by, F.log10(by))


def frontier_points(points: DataFrame, risk: str = "risk", ret: str = "ret") -> DataFrame:
    """Finite (risk, return) points by rising risk."""
    keep = finite(F.col(risk)).isNotNull() & finite(F.col(ret)).isNotNull()
    return points.where(keep).orderBy(risk, ret)


# --- building weight tables -----------------------------------------------------------------------------------------

def benchmark_weights(universe: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Equal weights over the universe, or the custom ones cleaned and normalised (equal where their sum is not positive)."""
    names = universe.select("ticker").distinct()
    size = names.agg(F.count(F.lit(1)).alias("_n"))
    if custom is None:
        return attach(names, size, []).select("ticker", (1.0 / F.col("_n")).alias("weight"))
    raw = names.join(custom.select("ticker", finite(F.col("weight")).alias("_w")), "ticker", "left")
    facts = raw.agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_total"))
    share = F.when(F.col("_total") > 0, F.coalesce("_w", F.lit(0.0)) / F.col("_total")).otherwise(1.0 / F.col("_n"))
    return attach(raw, facts, []).select("ticker", share.alias("weight"))


def stack_weights(*tables: DataFrame) -> DataFrame:
    """Union of weight tables with non-finite weights set to 0."""
    if not tables:
        raise ValueError("no weight tables to stack")
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out.withColumn("weight", F.coalesce(finite(F.col("weight")), F.lit(0.0)))
