"""Leading eigenpairs of a covariance and its factor model for universes whose matrix does not fit a task.

The covariance is never formed. Centred returns are stored as tiles of ``TILE_NAMES`` tickers by ``TILE_DATES`` dates; applied
to a few columns Q it is X'(XQ) / (T - 1), two sums over tiles. From a random block the method builds an orthonormal basis of
the block Krylov space: apply, take off what the basis holds already (twice), and orthonormalise by a tall-skinny QR whose
triangles are reduced within partitions and then once. Coefficients and triangles are small; they are all that reaches the
driver. Eigenpairs of the projected matrix are the answer when the last triangle bounds their residuals by ``TOL`` of the
largest eigenvalue, or when the basis holds all that the returns span. Bases and products are stored per ticker block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..schema import universe_keys
from ..session import busy_partitions, hand_off
from .covariance import TILE_DATES, TILE_NAMES
from .panel import apply_fill_policy, calendar

TOL = 1e-9
SPARE = 8  # columns beyond the wanted ones
MOST_STEPS = 60
RANK = 1e-11  # part of the largest column below which a direction is rounding


class Leading(NamedTuple):
    """``eigenvalues`` (k, eigenvalue, explained, residual), ``loadings`` (ticker, k, loading), ``specific`` (ticker, variance,
    specific): covariance = loadings * eigenvalues * loadings' + diag(specific)."""

    eigenvalues: DataFrame
    loadings: DataFrame
    specific: DataFrame


def _array(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, columns)


def _each(df: DataFrame, one: Callable[[dict], tuple], schema: str) -> DataFrame:
    """A row from each row, a few tiles at a time."""
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = [one(row) for row in batch.slice(at, 16).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _sums(df: DataFrame, key: str, other: str) -> DataFrame:
    """(key, m): the arrays ``m`` of a key added up, first in groups of 64 ``other``."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m) for m in pdf["m"])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "m": [total.tobytes()]})

    schema = f"{key} int, m binary"
    part = df.withColumn("_g", F.floor(F.col(other) / 64)).groupBy(key, "_g").applyInPandas(add, schema)
    return part.groupBy(key).applyInPandas(add, schema)


def _reduced(df: DataFrame, one: Callable[[dict], np.ndarray], both: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """``both`` folded over ``one`` of all rows: a small array per partition, then one of those."""

    def fold(batches: Iterator[pa.RecordBatch], first: Callable[[dict], np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                for row in batch.slice(at, 16).to_pylist():
                    new = first(row)
                    held = new if held is None else both(held, new)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(held).tobytes()], pa.binary())], names=["m"])

    parts = df.mapInArrow(lambda b: fold(b, one), "m binary")
    whole = parts.repartition(1).mapInArrow(lambda b: fold(b, lambda row: _array(row["m"], columns)), "m binary").first()
    return np.zeros((0, columns)) if whole is None else _array(whole["m"], columns)


def leading_factors(returns: DataFrame, k: int = 5, *, fill: str = "drop", seed: int = 0) -> Leading:
    """The ``k`` largest eigenpairs of the sample covariance of one universe, and what they leave of each variance."""
    if universe_keys(returns):
        raise ValueError("one universe at a time; for many small ones use spectrum and cov_pca_factor")
    panel = apply_fill_policy(returns, fill).select("date", "ticker", "ret")
    facts = panel.groupBy("ticker").agg(F.avg("ret").alias("_mean"), F.var_samp("ret").alias("variance"))
    # Positions of the tickers by blocks of a hash, so that no task orders all of them.
    n = max(facts.count(), 1)
    groups = -(-n // TILE_NAMES)
    place = F.row_number().over(W.partitionBy("_block").orderBy("ticker")) - 1
    names = facts.withColumn("_block", F.pmod(F.xxhash64("ticker"), F.lit(groups)).cast("int")).withColumn("_pos", place)
    names = hand_off(names, "leading-names")
    dates = calendar(panel)
    days = panel.select("date").distinct().count()
    cells = panel.join(names, "ticker").join(dates.select("date", "idx"), "date").select(
        "_block", F.floor((F.col("idx") - 1) / TILE_DATES).cast("int").alias("_chunk"), "_pos",
        ((F.col("idx") - 1) % TILE_DATES).cast("int").alias("_t"), (F.col("ret") - F.col("_mean")).alias("x"),
    )
    sizes = names.groupBy("_block").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    lists = cells.groupBy("_block", "_chunk").agg(*[F.collect_list(c).alias(c) for c in ("_pos", "_t", "x")]).join(sizes, "_block")

    def tile(row: dict) -> tuple:
        x = np.zeros((min(TILE_DATES, days - row["_chunk"] * TILE_DATES), row["_n"]))
        x[row["_t"], row["_pos"]] = row["x"]
        return row["_block"], row["_chunk"], row["_n"], x.tobytes()

    parts = busy_partitions(returns)
    tiles = hand_off(_each(lists.repartition(parts, "_block", "_chunk"), tile, "_block int, _chunk int, _n int, x binary"), "leading-tiles")
    scale = 1.0 / max(days - 1, 1)
    width = min(k + SPARE, n, max(days - 1, 1))

    def applied(basis: DataFrame, b: int) -> DataFrame:
        """(_block, m): the covariance times a basis block of ``b`` columns."""
        down = _each(tiles.join(basis, "_block"), lambda r: (r["_chunk"], r["_block"], (_array(r["x"], r["_n"]) @ _array(r["m"], b)).tobytes()),
                     "_chunk int, _block int, m binary")
        by_date = hand_off(_sums(down, "_chunk", "_block"), "leading-dates")
        up = _each(tiles.join(by_date, "_chunk"), lambda r: (r["_block"], r["_chunk"], (scale * _array(r["x"], r["_n"]).T @ _array(r["m"], b)).tobytes()),
                   "_block int, _chunk int, m binary")
        return hand_off(_sums(up, "_block", "_chunk"), "leading-product")

    def orthonormal(y: DataFrame, b: int, size: float) -> tuple[DataFrame | None, np.ndarray]:
        """Q and R with y = Q R, without directions that are rounding only beside ``size``; twice, as one division by R loses
        digits."""
        whole = np.eye(b)
        for unit in (size, 1.0):
            r = _reduced(y, lambda row: np.linalg.qr(_array(row["m"], b))[1], lambda u, v: np.linalg.qr(np.vstack([u, v]))[1], b)
            _, s, v = np.linalg.svd(r)
            keep = s > max(RANK * unit, 1e-300)
            rank = int(keep.sum())
            if not rank:
                return None, np.zeros((0, b))
            divide = v[keep].T / s[keep]
            y = hand_off(_each(y, lambda row, a=divide, w=b: (row["_block"], (_array(row["m"], w) @ a).tobytes()), "_block int, m binary"), "leading-basis")
            whole, b = (v[keep] * s[keep][:, None]) @ whole, rank
        return y, whole

    def start(row: dict) -> tuple:
        return row["_block"], np.random.default_rng([seed, row["_block"]]).normal(size=(row["_n"], width)).tobytes()

    trace = float(names.agg(F.coalesce(F.sum("variance"), F.lit(0.0)).alias("t")).first().t)
    basis, widths, (q, tail) = None, [], orthonormal(_each(sizes, start, "_block int, m binary"), width, 1.0)
    b = len(tail)
    projected = np.zeros((0, 0))
    for step in range(MOST_STEPS):
        if q is None:
            break
        held = q.withColumn("step", F.lit(step))
        basis = held if basis is None else basis.unionByName(held)
        widths.append(b)
        m = sum(widths)
        stacked = basis.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("step", "m"))).alias("all"))
        columns = list(widths)

        def side(row: dict, columns=columns) -> np.ndarray:
            return np.hstack([_array(x["m"], w) for x, w in zip(row["all"], columns)])

        y, coefficients = applied(q, b), np.zeros((m, b))
        for _ in range(2):
            joined = stacked.join(y, "_block")
            c = _reduced(joined, lambda row, w=b: side(row).T @ _array(row["m"], w), np.add, b)
            coefficients += c
            y = hand_off(
                _each(joined, lambda row, c=c, w=b: (row["_block"], (_array(row["m"], w) - side(row) @ c).tobytes()), "_block int, m binary"), "leading-rest"
            )
        grown = np.zeros((m, m))
        grown[: m - b, : m - b] = projected
        grown[:, m - b :] = coefficients
        grown[m - b :, :] = coefficients.T
        projected = grown
        lam, vec = np.linalg.eigh(projected)
        best = np.argsort(lam)[::-1][:k]
        q, tail = orthonormal(y, b, trace)  # the largest eigenvalue is at most the trace
        residual = np.linalg.norm(tail @ vec[m - b :, best], axis=0) if len(tail) else np.zeros(len(best))
        if len(best) == min(k, n) and (residual <= TOL * max(lam[best[0]], 1e-300)).all():
            break
        b = len(tail)
    spark = returns.sparkSession
    if basis is None:
        lam, vec, best, residual, columns = np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0), []
    rows = [(p + 1, float(max(lam[j], 0.0)), float(max(lam[j], 0.0) / trace) if trace > 0 else 0.0, float(r)) for p, (j, r) in enumerate(zip(best, residual))]
    eigenvalues = spark.createDataFrame(rows, "k int, eigenvalue double, explained double, residual double")
    if basis is None:
        return Leading(eigenvalues, names.select("ticker", F.lit(0).alias("k"), F.lit(0.0).alias("loading")).limit(0), names.select("ticker", "variance", F.col("variance").alias("specific")))
    turn = vec[:, best]

    def load(row: dict) -> tuple:
        v = np.hstack([_array(x["m"], w) for x, w in zip(row["all"], columns)]) @ turn
        return row["_block"], [list(map(float, line)) for line in v]

    stacked = basis.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("step", "m"))).alias("all"))
    lines = _each(stacked, load, "_block int, lines array<array<double>>").select("_block", F.posexplode("lines").alias("_pos", "line"))
    placed = hand_off(names.join(lines, ["_block", "_pos"]).select("ticker", "variance", "line"), "leading-loadings")
    loadings = placed.select("ticker", F.posexplode("line").alias("k", "loading")).select("ticker", (F.col("k") + 1).alias("k"), "loading")
    values = F.array(*[F.lit(r[1]) for r in rows])
    common = F.aggregate(F.zip_with("line", values, lambda v, x: v * v * x), F.lit(0.0), lambda a, x: a + x)
    return Leading(eigenvalues, loadings, placed.select("ticker", "variance", F.greatest(F.col("variance") - common, F.lit(1e-12)).alias("specific")))
