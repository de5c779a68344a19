"""Portfolio construction for many problems at once.

Problems are rows (portfolio_id and parameters). They are dealt into parts of bounded size per universe, so a
universe with most of the problems is spread over many tasks; the universe's packed covariance travels once per part,
not once per problem, and a part's problems are solved together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schema import attach, grouped, one_of, require, universe_keys
from ..session import Store, busy_partitions, lazily
from .covariance import pack_matrix, unpack
from .portfolio import PID, active_weights, portfolio_returns, portfolio_stats
from .projection import project_box_simplex
from .quantiles import exact_quantiles, quantiles_with_tails
from .solvers import Market, inverse_products, optimise

METHODS = ("mv_l2", "mv_l1", "min_te", "mean_te", "te_active", "risk_parity", "hrp", "group_caps")
PART = 128  # problems per part, more of them (up to PART_CELLS weights, four times as many) in small universes
PART_CELLS = 1 << 14
DEFAULTS = {"gamma": 1.0, "lam": 0.0, "w_min": 0.0, "w_max": 1.0, "rho": 0.0}


def _listed(df: DataFrame, by: list[str], prefix: str, *cols: str) -> DataFrame:
    """Columns of a small long table as parallel arrays, one row per group."""
    rows = grouped(df, by, F.array_sort(F.collect_list(F.struct(*cols))).alias("_l"))
    return rows.select(*by, *[F.col("_l")[c].alias(f"{prefix}_{c}") for c in cols])


def _with_lists(df: DataFrame, side: DataFrame, by: list[str], prefix: str, *cols: str) -> DataFrame:
    keys = [k for k in by if k in side.columns]
    packed = _listed(side, keys, prefix, *cols)
    return df.join(packed, keys, "left") if keys else attach(df, packed, [])


def _spread(names: np.ndarray, tickers, values) -> np.ndarray:
    """Values of a (ticker, value) list in the order of ``names``; tickers not listed count 0."""
    out = np.zeros(len(names))
    if tickers is not None:
        tickers = np.asarray(tickers, dtype=object)
        at = np.searchsorted(names, tickers)
        at = np.minimum(at, len(names) - 1)
        known = names[at] == tickers
        out[at[known]] = np.asarray(values, dtype=float)[known]
    return out


def _market(row) -> Market:
    names = np.asarray(row["names"], dtype=object)
    market = Market(names, unpack(row["cells"], names))
    if "mu_ticker" in row:
        market.mu = _spread(names, row["mu_ticker"], row["mu_mu"])
    if "cap_cap" in row:
        labels = np.asarray(row["cap_group"], dtype=object)
        market.caps = np.asarray(row["cap_cap"], dtype=float)
        market.members = np.zeros((len(labels), len(names)))
        for ticker, group in zip(row["member_ticker"], row["member_group"]):
            market.members[labels == group] += names == ticker
    if "expo_factor" in row:
        factors = np.asarray(row["expo_factor"], dtype=object)
        order, where = np.unique(factors, return_inverse=True)
        market.exposures = np.zeros((len(order), len(names)))
        at = np.searchsorted(names, np.asarray(row["expo_ticker"], dtype=object))
        known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == np.asarray(row["expo_ticker"], dtype=object))
        market.exposures[where[known], at[known]] = np.asarray(row["expo_exposure"], dtype=float)[known]
    return market


def solve(
    problems: DataFrame,
    sigma: DataFrame,
    mu: DataFrame | None = None,
    *,
    method: str,
    bench: DataFrame | None = None,
    ref: DataFrame | None = None,
    groups: DataFrame | None = None,
    caps: DataFrame | None = None,
    exposures: DataFrame | None = None,
    lb: float | None = None,
    ub: float | None = None,
    iters: int | None = None,
    linkage: str = "ward",
    part: int = PART,
    **defaults: float,
) -> DataFrame:
    """Weights (ticker, weight, status, residual) of every problem row, all columns of ``problems`` kept.

    Solvers run until a further step changes nothing beyond their tolerance; ``iters`` is the caller's own limit.
    ``status`` is 'ok', 'infeasible' (box and caps exclude each other; equal weights) or 'not_converged'.

    ``problems`` holds portfolio_id and any of gamma, lam, w_min, w_max, rho; parameters without a column come from
    ``defaults``. ``bench`` and ``ref`` are weight tables, per portfolio or common; a missing reference is the
    benchmark for active methods and equal weights otherwise. ``groups`` (ticker, group) with ``caps`` (group, cap)
    limit group sums; ``exposures`` (factor, ticker, exposure) with lb / ub are penalised by rho.
    """
    one_of(method, METHODS, "method")
    require(problems, PID)
    by = universe_keys(sigma)
    settings = {**DEFAULTS, **defaults}
    unknown = set(settings) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    if method == "group_caps" and (groups is None or caps is None):
        raise ValueError("group_caps needs groups and caps")

    market = pack_matrix(sigma)
    if mu is not None:
        market = _with_lists(market, mu, by, "mu", "ticker", "mu")
    if groups is not None and caps is not None:
        market = _with_lists(market, groups, by, "member", "ticker", "group")
        market = _with_lists(market, caps, by, "cap", "group", "cap")
    if exposures is not None:
        market = _with_lists(market, exposures, by, "expo", "factor", "ticker", "exposure")
    tasks = problems
    for label, table in (("bench", bench), ("ref", ref)):
        if table is None:
            continue
        if PID in table.columns:
            tasks = tasks.join(_listed(table, [PID], label, "ticker", "weight"), PID, "left")
        else:
            market = _with_lists(market, table, by, label, "ticker", "weight")

    keep = problems.columns
    sizes = grouped(sigma.where(F.col("i") == F.col("j")), by, F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_names"))
    counts = attach(grouped(problems, by, F.count(F.lit(1)).alias("_problems")), sizes.select(*[F.col(c).alias(c) for c in sizes.columns]), by)
    size = F.greatest(F.lit(part), F.least(F.lit(4 * part), F.floor(F.lit(PART_CELLS) / F.col("_names"))))
    counts = counts.select(*by, F.greatest(F.ceil(F.col("_problems") / size), F.lit(1)).cast("int").alias("_parts"))
    spread = F.pmod(F.xxhash64(*keep), F.col("_parts").cast("bigint")).cast("int")
    tasks = attach(tasks, counts, by).withColumn("_part", spread).drop("_parts")
    market = attach(market, counts, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # Fresh names, so that problems derived from the same table as sigma do not clash with it.
    market = market.select(*[F.col(c).alias(c) for c in market.columns if c != "_parts"])
    keys = [*by, "_part"]
    # An explicit partition number keeps AQE from merging these byte-small but compute-heavy partitions.
    n = busy_partitions(problems)
    left = tasks.repartition(n, *keys).groupBy(*keys)
    right = market.repartition(n, *keys).groupBy(*keys)
    active = method in ("min_te", "mean_te", "te_active")

    def run(left_pdf: pd.DataFrame, right_pdf: pd.DataFrame) -> pd.DataFrame:
        if left_pdf.empty or right_pdf.empty:
            empty = left_pdf[keep].iloc[:0]
            new = {"ticker": str, "weight": float, "status": str, "residual": float}
            return empty.assign(**{c: pd.Series(dtype=t) for c, t in new.items()})
        shared = right_pdf.iloc[0].to_dict()
        m = _market(shared)
        m.lb, m.ub = lb, ub
        rows, size = len(left_pdf), len(m.names)

        def column(name: str) -> np.ndarray:
            if name in left_pdf.columns:
                return left_pdf[name].to_numpy(dtype=float)[:, None]
            return np.full((rows, 1), float(settings[name]))

        def vectors(label: str) -> np.ndarray | None:
            if f"{label}_ticker" in left_pdf.columns:
                pairs = zip(left_pdf[f"{label}_ticker"], left_pdf[f"{label}_weight"])
                return np.array([_spread(m.names, t, v) for t, v in pairs])
            if f"{label}_ticker" in shared:
                one = _spread(m.names, shared[f"{label}_ticker"], shared[f"{label}_weight"])
                return np.tile(one, (rows, 1))
            return None

        equal = np.full((rows, size), 1.0 / size)
        base = vectors("bench")
        base = equal if base is None else base
        other = vectors("ref")
        other = (base if active else equal) if other is None else other
        weights, status, residual = optimise(
            m, method, gamma=column("gamma"), lam=column("lam"), lo=column("w_min"), hi=column("w_max"),
            rho=column("rho"), bench=base, ref=other, iters=iters, linkage=linkage,
        )
        out = left_pdf[keep].loc[np.repeat(left_pdf.index.to_numpy(), size)].reset_index(drop=True)
        out["ticker"] = np.tile(m.names, rows)
        out["weight"] = weights.ravel()
        out["status"] = np.repeat(status, size)
        out["residual"] = np.repeat(residual, size)
        return out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in problems.schema.fields)
    return left.cogroup(right).applyInPandas(run, f"{fields}, ticker string, weight double, status string, residual double")


def te_frontier_sweep(
    portfolios: DataFrame, sigma: DataFrame, mu: DataFrame, bench: DataFrame, gammas: list[float], **options
) -> DataFrame:
    """te_active for every portfolio and every gamma: gamma is one more key, so the sweep runs in parallel."""
    grid = portfolios.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    options = {"w_max": 0.1, **options}
    return solve(grid, sigma, mu, method="te_active", bench=bench, **options)


def geometric_grid(low: float = 0.01, high: float = 1000.0, points: int = 25) -> list[float]:
    return [float(g) for g in np.geomspace(low, high, points)]


# --- closed forms -------------------------------------------------------------------------------------------------

def closed_form_vectors(mu: DataFrame, sigma: DataFrame) -> DataFrame:
    """Per ticker: mu, S^-1 1 (``inv_one``) and S^-1 mu (``inv_mu``). The only dense step of the closed forms."""
    by = universe_keys(sigma)
    packed = _with_lists(pack_matrix(sigma), mu, by, "mu", "ticker", "mu")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                m = _market(row)
                inv_one, inv_mu = inverse_products(m.sigma, m.mu)
                part = pd.DataFrame({"ticker": m.names, "mu": m.mu, "inv_one": inv_one, "inv_mu": inv_mu})
                for k, c in enumerate(by):
                    part.insert(k, c, row[c])
                yield part

    fields = "".join(f"{c} string, " for c in by)
    return packed.mapInPandas(run, f"{fields}ticker string, mu double, inv_one double, inv_mu double")


def _conic(vectors: DataFrame) -> DataFrame:
    by = universe_keys(vectors)
    facts = grouped(
        vectors,
        by,
        F.count(F.lit(1)).alias("_n"),
        F.sum("inv_one").alias("_A"),
        F.sum("inv_mu").alias("_B"),
        F.sum(F.col("mu") * F.col("inv_mu")).alias("_C"),
        F.max("mu").alias("_best"),
        F.min("mu").alias("_worst"),
    )
    return facts.withColumn("_D", F.col("_A") * F.col("_C") - F.col("_B") * F.col("_B"))


def _or_size(x, n):
    return F.when(F.abs(x) > 1e-18, x).otherwise(n.cast("double"))


def markowitz_closed_form(mu: DataFrame, sigma: DataFrame, rf: float = 0.0, vectors: DataFrame | None = None) -> DataFrame:
    """Minimum-variance and tangency weights per ticker (shorts allowed)."""
    by = universe_keys(sigma)
    vectors = closed_form_vectors(mu, sigma) if vectors is None else vectors
    rows = attach(vectors, _conic(vectors), by)
    excess = F.col("inv_mu") - rf * F.col("inv_one")
    k = F.col("_B") - rf * F.col("_A")
    return rows.select(
        *by,
        "ticker",
        (F.col("inv_one") / _or_size(F.col("_A"), F.col("_n"))).alias("w_gmv"),
        (excess / _or_size(k, F.col("_n"))).alias("w_tan"),
    )


def frontier_range(mu: DataFrame) -> DataFrame:
    """Return range for a frontier: 10th to 90th percentile of mu, else its extremes, else [-0.1, 0.1]."""
    by = universe_keys(mu)
    cuts = exact_quantiles(mu, by, "mu", {"_lo": 0.1, "_hi": 0.9})
    ends = grouped(mu, by, F.min("mu").alias("_min"), F.max("mu").alias("_max"))
    both = attach(cuts, ends, by)
    narrow = F.coalesce(F.col("_lo") >= F.col("_hi"), F.lit(True))
    flat = F.coalesce(F.col("_min") >= F.col("_max"), F.lit(True))

    def pick(a: str, b: str, last: float):
        return F.when(~narrow, F.col(a)).when(~flat, F.col(b)).otherwise(F.lit(last))

    return both.select(*by, pick("_lo", "_min", -0.1).alias("r_min"), pick("_hi", "_max", 0.1).alias("r_max"))


def _grid(facts: DataFrame, r_min: float | None, r_max: float | None, npts: int, auto: bool) -> DataFrame:
    """Target returns per universe; with ``auto`` an invalid range is replaced by one around the minimum-variance
    return and the best mean, else open ends are the extremes of mu."""
    npts = max(2, int(npts))
    lo = F.lit(float(r_min)) if r_min is not None else F.col("_worst")
    hi = F.lit(float(r_max)) if r_max is not None else F.col("_best")
    if auto and (r_min is None or r_max is None or not r_min < r_max):
        gmv = F.col("_B") / _or_size(F.col("_A"), F.col("_n"))
        low, high = F.least(gmv, F.col("_best")), F.greatest(gmv, F.col("_best"))
        lo, hi = low + 0.1 * (high - low), low + 0.9 * (high - low)
        lo, hi = F.when(lo < hi, lo).otherwise(gmv * 0.8), F.when(lo < hi, hi).otherwise(gmv * 1.2)
    collapsed = F.abs("_D") < 1e-18
    points = facts.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_flat", collapsed)
    last = F.when(F.col("_flat"), F.lit(0)).otherwise(F.lit(npts - 1))
    return points.withColumn("point", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "target", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / float(npts - 1)
    )


def frontier_closed_form(
    mu: DataFrame,
    sigma: DataFrame,
    r_min: float | None = None,
    r_max: float | None = None,
    npts: int = 100,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Efficient frontier with shorts: risk^2 = (A R^2 - 2 B R + C) / D on a grid of returns R; a degenerate conic
    gives the minimum-variance point alone."""
    by = universe_keys(sigma)
    vectors = closed_form_vectors(mu, sigma) if vectors is None else vectors
    points = _grid(_conic(vectors), r_min, r_max, npts, auto=True)
    r, a, b, c = F.col("target"), F.col("_A"), F.col("_B"), F.col("_C")
    risk2 = F.when(F.col("_flat"), 1.0 / _or_size(a, F.col("_n"))).otherwise(
        F.try_divide(a * r * r - 2 * b * r + c, F.col("_D"))
    )
    ret = F.when(F.col("_flat"), b / _or_size(a, F.col("_n"))).otherwise(r)
    return points.select(*by, "point", F.sqrt(F.greatest(risk2, F.lit(0.0))).alias("risk"), ret.alias("ret"))


def frontier_box(
    mu: DataFrame,
    sigma: DataFrame,
    w_min: float,
    w_max: float,
    r_min: float | None = None,
    r_max: float | None = None,
    npts: int = 40,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Closed-form weights per target return, projected into the box, with the risk and return they then have."""
    by = universe_keys(sigma)
    vectors = closed_form_vectors(mu, sigma) if vectors is None else vectors
    points = _grid(_conic(vectors), r_min, r_max, npts, auto=False).drop("_n", "_best", "_worst")
    # Each universe has npts points: the rows are one weight per point and ticker.
    listed = grouped(points, by, F.collect_list(F.struct("point", "target", "_A", "_B", "_C", "_D", "_flat")).alias("_p"))
    rows = attach(vectors, listed, by).select(*by, "ticker", "inv_one", "inv_mu", F.inline("_p"))
    r = F.col("target")
    free = F.try_divide(F.col("_C") - F.col("_B") * r, F.col("_D")) * F.col("inv_one") + F.try_divide(
        F.col("_A") * r - F.col("_B"), F.col("_D")
    ) * F.col("inv_mu")
    start = F.when(F.col("_flat"), F.col("inv_one") / _or_size(F.col("_A"), F.lit(1))).otherwise(free)
    pid = F.concat_ws("/", *by, F.col("point").cast("string"))
    weights = project_box_simplex(
        rows.select(*by, pid.alias(PID), "point", "ticker", start.alias("weight")), w_min, w_max
    )
    held = weights.where(F.col("status") == "ok")
    if not by:
        stats = portfolio_stats(held, mu, sigma)
        place = held.select(PID, "point").distinct()
        return stats.join(place, PID).select("point", F.col("sigma_p").alias("risk"), F.col("mu_p").alias("ret"))
    cells = held.select(*by, PID, "point", F.col("ticker").alias("j"), F.col("weight").alias("_wj"))
    products = cells.join(sigma, [*by, "j"]).groupBy(*by, PID, "point", F.col("i").alias("ticker")).agg(
        F.sum(F.col("value") * F.col("_wj")).alias("_sw")
    )
    both = held.join(products, [*by, PID, "point", "ticker"]).join(mu, [*by, "ticker"])
    return both.groupBy(*by, "point").agg(
        F.sqrt(F.greatest(F.sum(F.col("weight") * F.col("_sw")), F.lit(0.0))).alias("risk"),
        F.sum(F.col("weight") * F.col("mu")).alias("ret"),
    )


# --- choosing by tail risk ----------------------------------------------------------------------------------------

def cvar_scores(
    candidates: DataFrame,
    returns: DataFrame,
    *,
    alpha: float = 0.95,
    lam_l1: float = 0.0,
    ref: DataFrame | None = None,
    store: Store = lazily,
) -> DataFrame:
    """CVaR of the losses of each candidate portfolio plus lam * L1 turnover against the reference."""
    losses = portfolio_returns(candidates, returns).select(PID, (-F.col("ret")).alias("loss"))
    losses = store(losses, "losses")  # read several times by the quantiles
    scores = quantiles_with_tails(losses, [PID], "loss", {"var": alpha}).withColumnRenamed("var_tail", "cvar")
    if ref is None or lam_l1 <= 0:
        return scores.withColumn("turnover", F.lit(0.0)).withColumn("score", F.col("cvar"))
    moved = active_weights(candidates, ref).groupBy(PID).agg(F.sum(F.abs("active")).alias("turnover"))
    return scores.join(moved, PID).withColumn("score", F.col("cvar") + lam_l1 * F.col("turnover"))


def cvar_select(candidates: DataFrame, returns: DataFrame, *, group: str, **options) -> DataFrame:
    """The candidate with the lowest score per group, with its weights."""
    owners = candidates.select(group, PID).distinct()
    best = (
        owners.join(cvar_scores(candidates.select(PID, "ticker", "weight"), returns, **options), PID)
        .groupBy(group)
        .agg(F.min(F.struct("score", PID)).alias("_best"))
        .select(group, F.col("_best." + PID).alias(PID), F.col("_best.score").alias("score"))
    )
    return candidates.join(best, [group, PID]).select(group, PID, "ticker", "weight", "score")
