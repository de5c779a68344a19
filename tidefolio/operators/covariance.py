"""Covariance estimators and matrix operators on long (i, j, value) tables.

Cross products are computed block by block. Each date becomes one vector, cut into blocks of BLOCK_TILES * TILE_NAMES
tickers or, where the dates of a wider one fit into memory, of several times as many; the dates of a pair of blocks meet in
the task that adds up their product, so its cells need no further shuffle. Task size is bounded by the blocks, not by the
number of dates or tickers, and no pair of observations is ever emitted as a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import attach, grouped, one_of, universe_keys
from ..session import Store, busy_partitions, lazily
from .panel import apply_fill_policy, calendar, date_totals
from .quality import infer_periodicity

TILE_DATES = 512
TILE_NAMES = 256
BLOCK_TILES = 4  # tiles beside each other in a block of cross products: fewer blocks, fewer copies of the panel
#: A block is widened while a side of a pair has at most so many cells and so many blocks lie beside each other, up to MOST_WIDE.
SIDE_CELLS, ENOUGH_BLOCKS, MOST_WIDE = 1 << 21, 14, 8
COV_METHODS = ("sample", "lw", "oas", "ewma")


# --- cross products ---------------------------------------------------------------------------------------------

def cross_products(panel: DataFrame, col: str = "x") -> DataFrame:
    """Sum over dates of x_i * x_j for i <= j, from a dense panel (date, ticker, x).

    The dates of a pair of blocks pass through one task, which keeps their product only and returns its cells. Each block
    travels once per block beside it, so wide panels take wide blocks: their dates are held and multiplied piece by piece.
    Just panels of more than ``TILE_DATES`` dates and more dates than tickers are dealt into chunks, whose partial products,
    at most as many as the panel has cells, are then summed.
    """
    by = universe_keys(panel)
    names = grouped(panel.select(*by, "ticker").distinct(), by, F.array_sort(F.collect_list("ticker")).alias("_names"))
    longest = F.greatest(F.lit(TILE_DATES), F.col("_N"))
    width = BLOCK_TILES * TILE_NAMES
    wanted = F.ceil(F.col("_N") / (ENOUGH_BLOCKS * width))
    fitting = F.floor(F.lit(SIDE_CELLS / width) / F.ceil(F.col("n_dates") / F.col("_chunks")))
    times = F.greatest(F.least(wanted, fitting, F.lit(MOST_WIDE)), F.lit(1))
    sizes = attach(date_totals(panel).select(*by, "n_dates"), names.select(*by, F.size("_names").alias("_N")), by)
    sizes = sizes.withColumn("_chunks", F.ceil(F.col("n_dates") / longest)).select(*by, "_chunks", (times * width).cast("int").alias("_width"))
    vectors = panel.groupBy(*by, "date").agg(F.array_sort(F.collect_list(F.struct("ticker", F.col(col).alias("x")))).alias("_v"))
    starts = F.sequence(F.lit(0), F.size("_x") - 1, F.col("_width"))
    cut = attach(vectors, sizes, by).select(
        *by, "_chunks", F.pmod(F.xxhash64("date"), F.col("_chunks")).alias("_chunk"), "date", "_width", F.col("_v")["x"].alias("_x")
    ).withColumn("_all", F.transform(starts, lambda b: F.slice("_x", b + 1, F.col("_width"))))
    keys = [*by, "_chunk", "_bi", "_bj"]
    id_fields = "".join(f"{c} string, " for c in by)

    def cells(key: Tuple[Any, ...], top: int, left: int, product: np.ndarray) -> pd.DataFrame:
        """The rows of a piece of the matrix whose first cell is (top, left)."""
        rows, cols = np.triu_indices(product.shape[0]) if top == left else np.indices(product.shape).reshape(2, -1)
        out = {c: key[k] for k, c in enumerate(by)}
        out |= {"_i": (rows + top).astype("int32"), "_j": (cols + left).astype("int32"), "_p": product[rows, cols]}
        return pd.DataFrame(out)

    def pieces(key: Tuple[Any, ...], wide: int, held: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray | None) -> Iterator[pd.DataFrame]:
        top, left = int(key[-2]) * wide, int(key[-1]) * wide
        if total is not None:
            yield cells(key, top, left, total)
            return
        lefts, rights = (np.concatenate(side) for side in zip(*held))
        for i in range(0, lefts.shape[1], width):
            # Below the diagonal there is nothing to return.
            for j in range(i if top == left else 0, rights.shape[1], width):
                yield cells(key, top + i, left + j, lefts[:, i : i + width].T @ rights[:, j : j + width])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a pair of blocks follow each other, in the order of their dates."""
        key, wide, held, total = None, width, [], None
        for pdf in batches:
            first = np.flatnonzero(pdf[keys].ne(pdf[keys].shift()).any(axis=1))
            for start, end in zip(first, [*first[1:], len(pdf)]):
                here = tuple(pdf[keys].iloc[start])
                if key is not None and here != key:
                    yield from pieces(key, wide, held, total)
                    held, total = [], None
                key, wide = here, int(pdf["_width"].iloc[start])
                left, right = (np.stack(list(pdf[c].iloc[start:end])) for c in ("_left", "_right"))
                if wide > width:
                    held.append((left, right))
                else:
                    total = left.T @ right + (0.0 if total is None else total)
        if key is not None:
            yield from pieces(key, wide, held, total)

    def multiplied(rows: DataFrame) -> DataFrame:
        lefts = rows.select(*by, "_chunk", "date", "_width", "_all", F.posexplode("_all").alias("_bi", "_left"))
        rest = F.slice("_all", F.col("_bi") + 1, F.size("_all"))
        pairs = lefts.select(*by, "_chunk", "date", "_width", "_bi", "_left", F.posexplode(rest).alias("_off", "_right"))
        pairs = pairs.withColumn("_bj", F.col("_bi") + F.col("_off")).select(*keys, "date", "_width", "_left", "_right")
        dealt = pairs.repartition(busy_partitions(panel), *keys).sortWithinPartitions(*keys, "date")
        return dealt.drop("date").mapInPandas(multiply, f"{id_fields}_i int, _j int, _p double")

    whole = multiplied(cut.where("_chunks = 1")).withColumnRenamed("_p", "value")
    parts = multiplied(cut.where("_chunks > 1")).groupBy(*by, "_i", "_j").agg(F.sum("_p").alias("value"))
    return attach(whole.unionByName(parts), names, by).select(
        *by,
        F.element_at("_names", F.col("_i") + 1).alias("i"),
        F.element_at("_names", F.col("_j") + 1).alias("j"),
        "value",
    )


def mirror(upper: DataFrame) -> DataFrame:
    """Both (i, j) and (j, i) from the half with i <= j."""
    by = universe_keys(upper)
    here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
    there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    sides = F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there))
    return upper.select(*by, F.explode(sides).alias("_c"), "value").select(*by, "_c.i", "_c.j", "value")


def _centred(panel: DataFrame) -> DataFrame:
    by = universe_keys(panel)
    means = panel.groupBy(*by, "ticker").agg(F.avg("ret").alias("_mean"))
    return panel.join(means, [*by, "ticker"]).select(*by, "date", "ticker", (F.col("ret") - F.col("_mean")).alias("x"))


# --- estimators -------------------------------------------------------------------------------------------------

def covariance(
    returns: DataFrame,
    *,
    method: str = "oas",
    ewma_lambda: float = 0.94,
    min_periods: int | None = None,
    annualize: bool = True,
    fill: str = "drop",
    psd: bool = False,
    store: Store = lazily,
) -> DataFrame:
    """Covariance as a full long matrix, by the named estimator for panels of any length.

    A caller who sets ``min_periods`` has shorter panels estimated as the sample covariance instead; the column
    ``estimator`` then says which one each universe got.

    The shrinkage intensities need only sums over the matrix and one sum per date, all plain aggregates.
    ``psd`` adds an eigenvalue clip, which runs as one dense problem per universe. ``store`` (e.g. ``hand_off``) is
    applied to the two intermediates that are read more than once: the filled panel and the cross products.
    """
    one_of(method, COV_METHODS, "method")
    by = universe_keys(returns)
    panel = store(apply_fill_policy(returns, fill), "panel")
    centred = _centred(panel)
    sizes = date_totals(panel).select(*by, F.col("n_dates").alias("_T"))
    least = 2 if min_periods is None else max(2, min_periods)
    enough = F.col("_T") >= least

    if method == "ewma":
        lam = float(ewma_lambda)
        age = F.col("n_dates") - F.col("idx")
        decay = F.lit(1.0 - lam) * F.pow(F.lit(lam), age.cast("double"))
        equal = F.try_divide(F.lit(1.0), (F.col("n_dates") - 1).cast("double"))
        weight = F.when(F.col("n_dates") >= least, decay).otherwise(F.coalesce(equal, F.lit(0.0)))
        scaled = centred.join(calendar(panel), [*by, "date"]).select(
            *by, "date", "ticker", (F.col("x") * F.sqrt(weight)).alias("x")
        )
        upper = cross_products(scaled)
    else:
        products = cross_products(centred)
        upper = attach(products if method == "sample" else store(products, "products"), sizes, by)
        sample = F.coalesce(F.try_divide(F.col("value"), (F.col("_T") - 1).cast("double")), F.lit(0.0))
        if method == "sample":
            upper = upper.withColumn("value", sample)
        else:
            pop = F.col("value") / F.col("_T")
            on_diag = F.col("i") == F.col("j")
            facts = grouped(
                upper,
                by,
                F.sum(F.when(on_diag, pop)).alias("_trace"),
                F.count_if(on_diag).alias("_N"),
                F.sum(pop * pop * F.when(on_diag, 1.0).otherwise(2.0)).alias("_sq"),
            )
            if method == "lw":
                per_date = centred.groupBy(*by, "date").agg(F.sum(F.col("x") * F.col("x")).alias("_r"))
                facts = attach(facts, grouped(per_date, by, F.sum(F.col("_r") * F.col("_r")).alias("_fourth")), by)
            upper = attach(upper, facts, by)
            shrinkage = _oas_intensity() if method == "oas" else _ledoit_wolf_intensity()
            target = F.when(on_diag, F.col("_trace") / F.col("_N")).otherwise(F.lit(0.0))
            shrunk = (1.0 - shrinkage) * pop + shrinkage * target
            upper = upper.withColumn("value", F.when(enough, shrunk).otherwise(sample))
    if annualize:
        upper = attach(upper, infer_periodicity(returns).select(*by, "per_year"), by).withColumn(
            "value", F.col("value") * F.col("per_year")
        )
    full = mirror(upper.select(*by, "i", "j", "value"))
    full = psd_clip(full, 1e-12) if psd else full
    if min_periods is None:
        return full
    used = sizes.select(*by, F.when(enough, F.lit(method)).otherwise(F.lit("sample")).alias("estimator"))
    return attach(full, used, by)


def _oas_intensity() -> Column:
    m = F.col("_trace") / F.col("_N")
    alpha = F.col("_sq") / (F.col("_N") * F.col("_N"))
    ratio = F.try_divide(alpha + m * m, (F.col("_T") + 1) * (alpha - m * m / F.col("_N")))
    return F.coalesce(F.least(ratio, F.lit(1.0)), F.lit(1.0))


def _ledoit_wolf_intensity() -> Column:
    n, t = F.col("_N"), F.col("_T")
    m = F.col("_trace") / n
    spread = (F.col("_sq") - 2 * m * F.col("_trace") + n * m * m) / n
    noise = F.least((F.col("_fourth") / t - F.col("_sq")) / (n * t), spread)
    return F.when(noise == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(noise, spread), F.lit(0.0)))


# --- elementwise matrix operators ---------------------------------------------------------------------------------

def _diagonal(sigma: DataFrame, name: str, alias: str) -> DataFrame:
    by = universe_keys(sigma)
    return sigma.where(F.col("i") == F.col("j")).select(*by, F.col("i").alias(name), F.col("value").alias(alias))


def correlation(sigma: DataFrame) -> DataFrame:
    """Correlations, zero variances guarded, clipped to [-1, 1]."""
    by = universe_keys(sigma)
    sd = lambda c: F.when(F.col(c) > 0, F.sqrt(F.col(c))).otherwise(F.lit(1e-16))
    both = sigma.join(_diagonal(sigma, "i", "_vi"), [*by, "i"]).join(_diagonal(sigma, "j", "_vj"), [*by, "j"])
    rho = F.least(F.greatest(F.col("value") / sd("_vi") / sd("_vj"), F.lit(-1.0)), F.lit(1.0))
    return both.select(*by, "i", "j", rho.alias("value"))


def ridge(sigma: DataFrame, eps: float) -> DataFrame:
    """Add eps to the diagonal; a non-positive eps changes nothing."""
    if eps <= 0:
        return sigma
    return sigma.withColumn("value", F.when(F.col("i") == F.col("j"), F.col("value") + eps).otherwise(F.col("value")))


def stress_scenario(sigma: DataFrame, vol_mult: float = 1.2, corr_mult: float = 0.5) -> DataFrame:
    """Scale volatilities and off-diagonal correlations; own correlation stays 1."""
    vol = F.lit(vol_mult * vol_mult)
    factor = F.when(F.col("i") == F.col("j"), vol).otherwise(vol * corr_mult)
    return sigma.withColumn("value", F.col("value") * factor)


def effective_rank(sigma: DataFrame) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squares, from trace and entries alone."""
    by = universe_keys(sigma)
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("value")))
    return grouped(sigma, by, (trace * trace / F.sum(F.col("value") * F.col("value"))).alias("effective_rank"))


# --- dense problems, one per universe -----------------------------------------------------------------------------

MOST_NAMES = 8192  # half a gigabyte of cells


def pack_matrix(sigma: DataFrame) -> DataFrame:
    """One row per universe: sorted ``names`` and the row-major ``cells`` of its matrix.

    First one array per matrix row, then one of those: no task holds names for every cell. More than ``MOST_NAMES`` names
    are an error, since their cells would not fit into a row.
    """
    by = universe_keys(sigma)
    lines = sigma.groupBy(*by, "i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("_l"))
    lines = lines.select(*by, "i", F.col("_l")["value"].alias("_row"))
    whole = grouped(lines, by, F.array_sort(F.collect_list(F.struct("i", "_row"))).alias("_m"))
    too_many = F.raise_error(F.lit(f"a universe has more than {MOST_NAMES} tickers")).cast("array<double>")
    cells = F.when(F.size("_m") <= MOST_NAMES, F.flatten(F.col("_m")["_row"])).otherwise(too_many)
    return whole.select(*by, F.col("_m")["i"].alias("names"), cells.alias("cells"))


def unpack(cells, names) -> np.ndarray:
    n = len(names)
    return np.asarray(cells, dtype=float).reshape(n, n)


def clean_psd(a: np.ndarray, eps: float) -> np.ndarray:
    """Nearest symmetric matrix with eigenvalues of at least eps (after zeroing what is not finite)."""
    a = np.where(np.isfinite(a), a, 0.0)
    a = (a + a.T) / 2
    a[np.diag_indices_from(a)] = np.maximum(np.diag(a), eps)
    lam, vec = np.linalg.eigh(a)
    b = (vec * np.maximum(lam, eps)) @ vec.T
    return (b + b.T) / 2


def _per_universe(sigma: DataFrame, transform) -> DataFrame:
    """Apply ``matrix -> matrix`` to each universe. The packed aggregate is already partitioned by universe."""
    by = universe_keys(sigma)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in pdf.to_dict("records"):
            names = np.asarray(row["names"], dtype=object)
            n = len(names)
            out = transform(unpack(row["cells"], names))
            part = pd.DataFrame({"i": np.repeat(names, n), "j": np.tile(names, n), "value": out.ravel()})
            for k, c in enumerate(by):
                part.insert(k, c, row[c])
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    fields = "".join(f"{c} string, " for c in by)
    return pack_matrix(sigma).groupBy(*by).applyInPandas(run, f"{fields}i string, j string, value double")


def psd_clip(sigma: DataFrame, eps: float = 1e-10) -> DataFrame:
    return _per_universe(sigma, lambda a: clean_psd(a, eps))


def cov_pca_factor(sigma: DataFrame, n_factors: int = 5) -> DataFrame:
    """Top principal components plus a diagonal of specific variances."""

    def factor_model(a: np.ndarray) -> np.ndarray:
        lam, vec = np.linalg.eigh((a + a.T) / 2)
        k = min(max(int(n_factors), 1), len(lam))
        top = vec[:, -k:]
        common = (top * np.maximum(lam[-k:], 0.0)) @ top.T
        common[np.diag_indices_from(common)] += np.maximum(np.diag(a) - np.diag(common), 1e-12)
        return common

    return _per_universe(sigma, factor_model)


def spectrum(sigma: DataFrame) -> DataFrame:
    """Eigenvalues in descending order (k from 1) with explained and cumulative shares of the positive part."""
    by = universe_keys(sigma)

    def eigenvalues(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in pdf.to_dict("records"):
            a = unpack(row["cells"], row["names"])
            lam = np.linalg.eigvalsh((a + a.T) / 2)[::-1]
            part = pd.DataFrame({"k": np.arange(1, len(lam) + 1, dtype="int64"), "eigenvalue": lam})
            for pos, c in enumerate(by):
                part.insert(pos, c, row[c])
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    fields = "".join(f"{c} string, " for c in by)
    values = pack_matrix(sigma).groupBy(*by).applyInPandas(eigenvalues, f"{fields}k long, eigenvalue double")
    part = F.greatest(F.col("eigenvalue"), F.lit(0.0))
    whole = W.partitionBy(*by)
    total = F.greatest(F.sum(part).over(whole), F.lit(1e-16))
    running = F.sum(part).over(whole.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    return values.select(
        *by, "k", "eigenvalue", (part / total).alias("explained"), (running / total).alias("cumulative")
    )


def spectrum_diagnostics(sigma: DataFrame) -> DataFrame:
    """Smallest and largest eigenvalue, condition number and effective rank, one row per universe."""
    by = universe_keys(sigma)
    lam = F.col("eigenvalue")
    return grouped(
        spectrum(sigma),
        by,
        F.min(lam).alias("lambda_min"),
        F.max(lam).alias("lambda_max"),
        (F.max(lam) / F.greatest(F.min(lam), F.lit(1e-16))).alias("condition"),
        (F.sum(lam) * F.sum(lam) / F.sum(lam * lam)).alias("effective_rank"),
    )
