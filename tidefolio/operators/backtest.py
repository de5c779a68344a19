"""Rebalanced backtests: lookback windows, allocation, turnover, carried weights and equity, for many universes at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..schema import attach, grouped, require, universe_keys
from ..session import Store, busy_partitions, lazily
from .panel import calendar, running, spine, ticker_totals
from .returns import rebalance_dates, to_simple
from .solvers import GAP, INFEASIBLE, NOT_CONVERGED, OK, Market, feasible_rows, least_cvar, optimise
from .stats import drawdown
from .window_moments import LEAST_DATES, pack_windows, pairwise_moments, repaired, unpack_window, window_moments

Allocator = Callable[..., np.ndarray]
NO_DATA = "no_data"


class Inputs(NamedTuple):
    """What a solver allocator may use besides the window: its tickers, and a benchmark and factor exposures in their order."""

    names: np.ndarray
    bench: np.ndarray | None = None
    exposures: np.ndarray | None = None


class Backtest(NamedTuple):
    equity: DataFrame
    weights: DataFrame
    turnover: DataFrame


# --- windows ------------------------------------------------------------------------------------------------------

def rebalance_points(returns: DataFrame, freq: str, lookback: int) -> DataFrame:
    """Rebalance dates with at least ``lookback`` dates before them, and their calendar position."""
    by = universe_keys(returns)
    placed = rebalance_dates(returns, freq).join(
        calendar(returns).select(*by, F.col("date").alias("rb_date"), F.col("idx").alias("rb_idx")), [*by, "rb_date"]
    )
    return placed.where(F.col("rb_idx") > lookback)


def lookback_windows(returns: DataFrame, *, freq: str = "1mo", lookback: int = 252) -> DataFrame:
    """(rb_date, date) pairs: the ``lookback`` dates before each rebalance date.

    The positions of a window are generated and equi-joined, so no range join is needed.
    """
    by = universe_keys(returns)
    days = calendar(returns).select(*by, "idx", "date")
    reach = F.sequence(F.col("rb_idx") - lookback, F.col("rb_idx") - 1)
    positions = rebalance_points(returns, freq, lookback).select(*by, "rb_date", F.explode(reach).alias("idx"))
    return positions.join(days, [*by, "idx"]).select(*by, "rb_date", "date")


# --- allocation ---------------------------------------------------------------------------------------------------

def _equal(returns: DataFrame, freq: str, lookback: int) -> DataFrame:
    """1/N at every rebalance date."""
    by = universe_keys(returns)
    points = rebalance_points(returns, freq, lookback).select(*by, "rb_date")
    listed = grouped(returns.select(*by, "ticker").distinct(), by, F.collect_list("ticker").alias("_names"))
    return attach(points, listed, by).select(
        *by, "rb_date", F.explode("_names").alias("ticker"), (1.0 / F.size("_names")).alias("weight")
    )


def _inverse_variance(returns: DataFrame, freq: str, lookback: int) -> DataFrame:
    """Weights in proportion to 1 / variance over the window, 0 for a ticker with fewer than two returns in it."""
    by = universe_keys(returns)
    windows = lookback_windows(returns, freq=freq, lookback=lookback)
    risk = (
        windows.join(returns.select(*by, "date", "ticker", "ret"), [*by, "date"])
        .groupBy(*by, "rb_date", "ticker")
        .agg(F.coalesce(1.0 / F.greatest(F.var_samp("ret"), F.lit(1e-16)), F.lit(0.0)).alias("weight"))
    )
    return risk


def _by_window(
    returns: DataFrame, freq: str, lookback: int, allocator: Allocator, bench: DataFrame | None, exposures: DataFrame | None
) -> DataFrame:
    """Weights from a function of the window's (dates x tickers) array: a caller's own, or tail risk with its ``Inputs``.

    Each date becomes one row with the vector of its returns; a window collects ``lookback`` such rows, so a group's
    size is lookback x tickers. The windows are spread by an explicit partition number before they are collected:
    AQE would merge these byte-small but compute-heavy partitions, and a repartition after the aggregate is dropped.
    """
    by = universe_keys(returns)
    n = busy_partitions(returns)
    cells = spine(returns).join(returns.select(*by, "date", "ticker", "ret"), [*by, "date", "ticker"], "left")
    names = grouped(returns.select(*by, "ticker").distinct(), by, F.array_sort(F.collect_list("ticker")).alias("names"))
    vectors = (
        cells.groupBy(*by, "date")
        .agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("_v"))
        .select(*by, "date", F.col("_v")["ret"].alias("_v"))
    )
    windows = (
        lookback_windows(returns, freq=freq, lookback=lookback)
        .join(vectors, [*by, "date"])
        .repartition(n, *by, "rb_date")
        .groupBy(*by, "rb_date")
        .agg(F.array_sort(F.collect_list(F.struct("date", "_v"))).alias("_w"))
        .select(*by, "rb_date", F.flatten(F.col("_w")["_v"]).alias("cells"))
    )
    packed = _with_inputs(attach(windows, names, by), bench, exposures)
    solver = getattr(allocator, "on_dates", None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                tickers = np.asarray(row["names"], dtype=object)
                window = np.asarray(row["cells"], dtype=float).reshape(-1, len(tickers))
                answer = (allocator(window), OK, np.nan) if solver is None else solver(window, _inputs(row, tickers))
                yield _answer(row, by, tickers, *answer)

    return packed.mapInPandas(run, _answer_schema(by))


def _with_inputs(packed: DataFrame, bench: DataFrame | None, exposures: DataFrame | None) -> DataFrame:
    """A benchmark and exposures, lists of one universe's tickers, on every window."""
    if bench is not None:
        listed = bench.agg(F.collect_list("ticker").alias("bench_ticker"), F.collect_list("weight").alias("bench_weight"))
        packed = attach(packed, listed, [])
    if exposures is not None:
        entry = F.array_sort(F.collect_list(F.struct("factor", "ticker", "exposure")))
        listed = exposures.agg(entry.alias("_x")).select(*[F.col("_x")[c].alias(f"expo_{c}") for c in ("factor", "ticker", "exposure")])
        packed = attach(packed, listed, [])
    return packed


def _inputs(row: dict, names: np.ndarray) -> Inputs:
    place = {t: k for k, t in enumerate(names)}
    bench = exposures = None
    if "bench_ticker" in row:
        bench = np.zeros(len(names))
        for t, w in zip(row["bench_ticker"], row["bench_weight"]):
            if t in place:
                bench[place[t]] += w
    if "expo_factor" in row:
        factors, at = np.unique(np.asarray(row["expo_factor"], dtype=object), return_inverse=True)
        exposures = np.zeros((len(factors), len(names)))
        for f, t, v in zip(at, row["expo_ticker"], row["expo_exposure"]):
            if t in place:
                exposures[f, place[t]] = v
    return Inputs(names, bench, exposures)


def _solve_windows(
    returns: DataFrame, freq: str, lookback: int, allocator: Allocator, bench: DataFrame | None, exposures: DataFrame | None
) -> DataFrame:
    """Weights, status and residual from the moments of each window; see ``window_moments``."""
    by = universe_keys(returns)
    points = rebalance_points(returns, freq, lookback).withColumn("lookback", F.lit(lookback))
    packed = _with_inputs(pack_windows(window_moments(returns, points)), bench, exposures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                names = np.asarray(row["names"], dtype=object)
                mu, sigma, seen = unpack_window(row["names"], row["_centres"], row["_lines"])
                yield _answer(row, by, names, *allocator.solve(mu, sigma, seen, _inputs(row, names)))

    return packed.mapInPandas(run, _answer_schema(by))


def _answer_schema(by: list[str]) -> str:
    fields = "".join(f"{c} string, " for c in by)
    return f"{fields}rb_date timestamp_ntz, ticker string, weight double, status string, residual double"


def _answer(row: dict, by: list[str], names: np.ndarray, weights: np.ndarray, status: str, residual: float) -> pd.DataFrame:
    out = pd.DataFrame({"rb_date": row["rb_date"], "ticker": names, "weight": weights, "status": status, "residual": residual})
    for k, c in enumerate(by):
        out.insert(k, c, row[c])
    return out


def solver_allocator(
    method: str,
    *,
    gamma: float = 10.0,
    lam: float = 0.0,
    w_min: float = 0.0,
    w_max: float = 1.0,
    lb: float | None = None,
    ub: float | None = None,
    rho: float = 0.0,
    alpha: float = 0.95,
    **options,
) -> Allocator:
    """An allocator that runs one of the construction methods on the moments of each window, or 'cvar' on its dates.

    Benchmark (the reference too, equal weights by default) and factor exposures, which ``rho`` holds between ``lb`` and
    ``ub``, are those given to ``rebalance_weights`` or ``backtest``. Moments are taken pair by pair over the dates that have
    both returns, and ``repaired``. Tickers with fewer than two returns in a window are left out of its problem and get weight 0; a window
    without any other has equal weights and the status 'no_data'.
    """
    one = lambda x: np.full((1, 1), float(x))

    def solve(mu: np.ndarray, sigma: np.ndarray, seen: np.ndarray, inputs: Inputs | None) -> tuple[np.ndarray, str, float]:
        live = np.diag(seen) >= LEAST_DATES
        n = int(live.sum())
        if not n:
            return np.full(len(mu), 1.0 / len(mu)), NO_DATA, np.nan
        market = Market(np.arange(n), repaired(sigma[np.ix_(live, live)], seen[np.ix_(live, live)]), mu[live])
        bench = np.full(len(mu), 1.0 / n) if inputs is None or inputs.bench is None else inputs.bench
        bench = bench[live]
        if inputs is not None and inputs.exposures is not None:
            market.exposures, market.lb, market.ub = inputs.exposures[:, live], lb, ub
        found, status, residual = optimise(
            market, method, gamma=one(gamma), lam=one(lam), lo=one(w_min), hi=one(w_max), rho=one(rho),
            bench=bench[None, :], ref=bench[None, :], **options,
        )
        w = np.zeros(len(mu))
        w[live] = found[0]
        return w, str(status[0]), float(residual[0])

    def on_dates(window: np.ndarray, inputs: Inputs | None) -> tuple[np.ndarray, str, float]:
        n = window.shape[1]
        equal = np.full(n, 1.0 / n)
        if not feasible_rows(n, one(w_min), one(w_max))[0]:
            return equal, INFEASIBLE, np.nan
        bench = equal if inputs is None or inputs.bench is None else inputs.bench
        w, gap = least_cvar(np.nan_to_num(window), alpha, lam, bench, w_min, w_max)
        return w, OK if gap <= GAP else NOT_CONVERGED, gap

    def allocate(window: np.ndarray, inputs: Inputs | None = None) -> np.ndarray:
        return (on_dates(window, inputs) if method == "cvar" else solve(*pairwise_moments(window), inputs))[0]

    allocate.takes_inputs = True
    allocate.on_dates = on_dates
    if method != "cvar":
        allocate.solve = solve
    return allocate


def rebalance_weights(
    returns: DataFrame,
    *,
    freq: str = "1mo",
    lookback: int = 252,
    allocator: str | Allocator = "equal",
    bench: DataFrame | None = None,
    exposures: DataFrame | None = None,
) -> DataFrame:
    """Weights summing to 1 per rebalance date: 'equal', 'inverse_variance', or any function of a window.

    ``bench`` (ticker, weight) and ``exposures`` (factor, ticker, exposure) reach solver allocators, whose weights come with
    the ``status`` and ``residual`` of their window.
    """
    by = universe_keys(returns)
    extra = ["status", "residual"] if getattr(allocator, "takes_inputs", False) else []
    if hasattr(allocator, "solve"):
        raw = _solve_windows(returns, freq, lookback, allocator, bench, exposures)
    elif callable(allocator):
        raw = _by_window(returns, freq, lookback, allocator, bench, exposures)
    elif allocator in ("equal", "inverse_variance"):
        raw = (_equal if allocator == "equal" else _inverse_variance)(returns, freq, lookback)
    else:
        raise ValueError("allocator must be 'equal', 'inverse_variance' or a function")
    total = F.greatest(F.sum("weight").over(W.partitionBy(*by, "rb_date")), F.lit(1e-12))
    return raw.select(*by, "rb_date", "ticker", (F.col("weight") / total).alias("weight"), *extra)


# --- turnover, carried weights, equity ----------------------------------------------------------------------------

def rebalance_turnover_cost(weights: DataFrame, cost_bps: float = 0.0, universe: DataFrame | None = None) -> DataFrame:
    """Turnover against the previous rebalance and its linear cost.

    Each weight counts as bought at its own rebalance and as sold at the next one; the sum per rebalance and ticker is
    what is traded, so a ticker that leaves is sold and one that returns is bought from zero. Before the first rebalance
    every ticker of ``universe`` (default: every ticker that ever has a weight) holds 1/N.
    """
    by = universe_keys(weights)
    names = (weights if universe is None else universe).select(*by, "ticker").distinct()
    size = grouped(names, by, F.count(F.lit(1)).alias("_n"))
    dates = weights.select(*by, "rb_date").distinct()
    following = dates.withColumn("_next", F.lead("rb_date").over(W.partitionBy(*by).orderBy("rb_date")))
    bought = weights.select(*by, "rb_date", "ticker", "weight")
    sold = weights.join(following, [*by, "rb_date"]).where(F.col("_next").isNotNull())
    sold = sold.select(*by, F.col("_next").alias("rb_date"), "ticker", (-F.col("weight")).alias("weight"))
    first = attach(attach(names, size, by), grouped(dates, by, F.min("rb_date").alias("rb_date")), by)
    first = first.where(F.col("rb_date").isNotNull()).select(*by, "rb_date", "ticker", (-1.0 / F.col("_n")).alias("weight"))
    traded = bought.unionByName(sold).unionByName(first).groupBy(*by, "rb_date", "ticker").agg(F.sum("weight").alias("_d"))
    return (
        traded.groupBy(*by, "rb_date")
        .agg(F.sum(F.abs("_d")).alias("turnover"))
        .withColumn("cost", F.col("turnover") * (cost_bps / 10_000.0))
    )


def weights_asof(returns: DataFrame, weights: DataFrame, lookback: int) -> DataFrame:
    """Weight in force on every date after the lookback: the latest rebalance up to and including that date.

    The as-of match is made once per date on the calendar; weights are then fetched with an equi-join.
    """
    by = universe_keys(returns)
    days = calendar(returns).where(F.col("idx") > lookback).select(*by, "date")
    marks = weights.select(*by, "rb_date").distinct()
    marked = days.join(marks.withColumn("date", F.col("rb_date")), [*by, "date"], "left")
    current = running(marked.withColumnRenamed("rb_date", "_mark"), by, F.col("_mark"), "last", "rb_date").drop("_mark")
    size = ticker_totals(returns)
    cells = returns.select(*by, "date", "ticker", "ret").join(current, [*by, "date"])
    held = cells.join(weights.select(*by, "rb_date", "ticker", "weight"), [*by, "rb_date", "ticker"], "left")
    return attach(held, size, by).select(
        *by,
        "date",
        "ticker",
        "rb_date",
        "ret",
        # Before the first rebalance every ticker holds 1/N.
        F.when(F.col("rb_date").isNull(), 1.0 / F.col("n_tickers")).otherwise(F.coalesce("weight", F.lit(0.0))).alias(
            "weight"
        ),
    )


def equity_curve(held: DataFrame, costs: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Equity from carried weights: constant mix between rebalances, cost charged on the rebalance day only.

    ``te_proxy`` is the absolute active return of the day against a static benchmark.
    """
    by = universe_keys(held)
    r = F.coalesce("ret", F.lit(0.0))
    if bench is None:
        daily = held.groupBy(*by, "date").agg(F.sum(F.col("weight") * r).alias("port_ret"))
    else:
        require(bench, "ticker", "weight")
        against = bench.select("ticker", F.col("weight").alias("_b"))
        active = F.col("weight") - F.coalesce("_b", F.lit(0.0))
        daily = held.join(against, "ticker", "left").groupBy(*by, "date").agg(
            F.sum(F.col("weight") * r).alias("port_ret"), F.abs(F.sum(active * r)).alias("te_proxy")
        )
    charged = daily.join(costs.select(*by, F.col("rb_date").alias("date"), "cost"), [*by, "date"], "left")
    cost = F.coalesce("cost", F.lit(0.0))
    extra = ["te_proxy"] if bench is not None else []
    grown = running(charged.withColumn("cost", cost), by, 1.0 + F.col("port_ret") - F.col("cost"), "product", "equity")
    return grown.select(*by, "date", "port_ret", "cost", "equity", *extra)


def backtest(
    returns: DataFrame,
    *,
    lookback: int = 252,
    rebalance_freq: str = "1mo",
    cost_bps: float = 0.0,
    allocator: str | Allocator = "equal",
    bench: DataFrame | None = None,
    exposures: DataFrame | None = None,
    kind: str = "simple",
    store: Store = lazily,
) -> Backtest:
    """Equity (with drawdown), rebalance weights and turnover. Log returns are turned into simple ones to compound.

    A solver allocator runs against the same ``bench`` that the active return is measured against.
    """
    by = universe_keys(returns)
    weights = store(
        rebalance_weights(
            returns, freq=rebalance_freq, lookback=lookback, allocator=allocator, bench=bench, exposures=exposures
        ),
        "weights",
    )
    turnover = rebalance_turnover_cost(weights, cost_bps)
    held = weights_asof(to_simple(returns, kind), weights, lookback)
    equity = equity_curve(held, turnover, bench)
    return Backtest(drawdown(equity, by=by), weights, turnover)


def mean_turnover(turnover: DataFrame) -> DataFrame:
    return grouped(turnover, universe_keys(turnover), F.avg("turnover").alias("mean_turnover"))
