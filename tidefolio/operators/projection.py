"""Euclidean projection of weights onto {sum = 1, w_min <= w <= w_max}, for all portfolios in one pass over their rows.

Subtracting a shift theta and clipping gives a sum that falls piecewise linearly in theta, with a knot at v - w_max
and one at v - w_min for every weight. Running sums over the sorted knots give the clipped sum at each of them; the
last knot with a sum of at least 1 starts the segment where the sum crosses 1, and theta is solved there exactly.
Everything runs in one shuffle by portfolio: sorted rows pass by in Arrow batches, whose portfolios are settled together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.numeric import finite

TOL = 1e-12


def _bound(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def project_box_simplex(
    v: DataFrame,
    w_min: Column | float | str = 0.0,
    w_max: Column | float | str = 1.0,
    *,
    group: tuple[str, ...] = ("portfolio_id",),
) -> DataFrame:
    """Projected ``weight`` per row with ``status`` 'ok', or a NULL weight and 'infeasible' where the box cannot sum
    to 1. Bounds may be numbers or columns that are constant within a portfolio."""
    keys = list(group)
    rest = [c for c in v.columns if c != "weight"]
    rows = v.withColumn("_lo", _bound(w_min).cast("double")).withColumn("_hi", _bound(w_max).cast("double")).select(
        *rest, F.col("weight").cast("double").alias("weight"), "_lo", "_hi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a portfolio follow each other; those of the last one of a batch wait for the next batch."""
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            last = waiting[-1].slice(waiting[-1].num_rows - 1) if waiting else None
            joined = here if last is None else pa.concat_tables([last, here])
            starts = _group_starts(joined, keys) - (0 if last is None else 1)
            starts = starts[starts >= 0] if last is not None else starts[1:]
            if len(starts):
                yield from _projected(pa.concat_tables([*waiting, here.slice(0, starts[-1])]), keys, rest)
                waiting = []
            waiting.append(here.slice(starts[-1] if len(starts) else 0))
        if waiting:
            yield from _projected(pa.concat_tables(waiting), keys, rest)

    fields = [v.schema[c] for c in rest]
    schema = T.StructType([*fields, T.StructField("weight", T.DoubleType()), T.StructField("status", T.StringType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the keys differ from those of the row before; NULLs are equal."""
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        new[1:] = False
        for c in keys:
            code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _projected(table: pa.Table, keys: list[str], rest: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of whole portfolios with their projected weights and status."""
    starts = _group_starts(table, keys)
    sizes = np.diff([*starts, table.num_rows])
    given = ~table.column("weight").is_null().to_numpy()
    w, lo, hi = (table.column(c).to_numpy() for c in ("weight", "_lo", "_hi"))
    w = np.where(given, w, 0.0)
    shift = np.empty(len(starts))
    # Portfolios of about the same size are settled together.
    classes = np.frexp(sizes)[1]
    for k in np.unique(classes):
        some = np.flatnonzero(classes == k)
        at = starts[some, None] + np.arange(sizes[some].max())
        inside = at < (starts + sizes)[some, None]
        at = np.where(inside, at, 0)
        shift[some] = _shifts(w[at], lo[at], hi[at], inside & given[at], sizes[some])
    n = np.repeat(sizes, sizes)
    with np.errstate(invalid="ignore"):
        moved = w - np.repeat(shift, sizes)
        feasible = (n * lo - 1.0 <= TOL) & (1.0 - n * hi <= TOL)
        # NaN counts as the largest number, NULL as none.
        out = np.where(np.isnan(moved), hi, np.minimum(np.maximum(moved, lo), hi))
    out = np.where(given, out, np.minimum(lo, hi))
    columns = [*(table.column(c) for c in rest), pa.array(out, mask=~feasible), pa.array(np.where(feasible, "ok", "infeasible"))]
    yield from pa.table(columns, names=[*rest, "weight", "status"]).combine_chunks().to_batches()


def _shifts(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, there: np.ndarray, n: np.ndarray) -> np.ndarray:
    """theta for each row of ``w``: where its sum of ``n`` clipped weights crosses 1, among the weights that are ``there``."""
    with np.errstate(invalid="ignore"):
        knots = np.concatenate([np.where(there, w - hi, np.inf), np.where(there, w - lo, np.inf)], axis=1)
        real = np.concatenate([there, there], axis=1)
        turns = np.where(real, np.repeat([-1.0, 1.0], w.shape[1]), 0.0)
        most = np.where(there.any(axis=1), np.where(real, knots, -np.inf).max(axis=1), np.nan)
        order = np.argsort(knots, axis=1, kind="stable")
        at, turns, real = (np.take_along_axis(x, order, axis=1) for x in (knots, turns, real))
        top = np.take_along_axis(np.concatenate([hi, hi], axis=1), order, axis=1)
        finite = np.where(real, at, 0.0)
        slope = np.cumsum(turns, axis=1)
        total = n[:, None] * top + slope * finite - np.cumsum(turns * finite, axis=1)
        # Equal knots turn together: the slope beyond them is that of the last one.
        over = real & (total >= 1.0)
        last = np.where(over.any(axis=1), over.shape[1] - 1 - over[:, ::-1].argmax(axis=1), 0)[:, None]
        knot = np.take_along_axis(at, last, axis=1)
        last = np.maximum(last, ((at <= knot) & real).sum(axis=1, keepdims=True) - 1)
        run, total = np.take_along_axis(slope, last, axis=1)[:, 0], np.take_along_axis(total, last, axis=1)[:, 0]
        knot = knot[:, 0]
        theta = knot + np.divide(total - 1.0, -run, out=np.zeros_like(total), where=run < 0)
    # A weight that is not finite puts the crossing at the largest knot.
    odd = (there & ~np.isfinite(w)).any(axis=1) | ~there.any(axis=1)
    return np.where(odd, most, theta)


def safe_project(
    v: DataFrame,
    w_min: Column | float | str = 0.0,
    w_max: Column | float | str = 1.0,
    *,
    group: tuple[str, ...] = ("portfolio_id",),
) -> DataFrame:
    """Projection that always answers: non-finite weights count as 0, infeasible boxes give equal weights, and the
    result is renormalised."""
    clean = v.withColumn("weight", F.coalesce(finite(F.col("weight")), F.lit(0.0)))
    done = project_box_simplex(clean, w_min, w_max, group=group)
    whole = W.partitionBy(*group)
    total = F.sum("weight").over(whole)
    weight = F.when(total > TOL, F.col("weight") / total).otherwise(1.0 / F.count(F.lit(1)).over(whole))
    return done.withColumn("weight", weight)


def topk_project(
    weights: DataFrame,
    k: int | None,
    w_min: Column | float | str = 0.0,
    w_max: Column | float | str = 1.0,
    *,
    group: tuple[str, ...] = ("portfolio_id",),
) -> DataFrame:
    """Keep the k largest weights of each portfolio, set the others to 0, and project. No or non-positive k keeps all."""
    if k is not None and k > 0:
        place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("weight"), "ticker"))
        kept = F.when(F.col("_place") <= k, F.col("weight")).otherwise(F.lit(0.0))
        weights = weights.withColumn("_place", place).withColumn("weight", kept).drop("_place")
    return project_box_simplex(weights, w_min, w_max, group=group)
