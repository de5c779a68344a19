"""Means and covariances of many overlapping lookback windows, from prefix sums of cross-product tiles.

The starts and ends of all windows cut the calendar into segments (about two per rebalance). Per segment, chunk of dates and
pair of ticker blocks one task multiplies the observed returns and the masks that say which are observed: for every pair
the sum of products, both sums and the number of dates on which both have a return. Sums of a segment are added up along the
calendar for each tile row, and a window is the difference of the prefix at its end and the prefix at its start. So a return
is multiplied once, however many windows hold it, no window carries its own dates, and a missing cell takes one date
from the pairs it belongs to and nothing else.

Returns are centred on the ticker's mean over all dates first, which keeps the differences of prefixes exact to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import finite
from ..schema import attach, grouped, universe_keys
from ..session import busy_partitions
from .covariance import MOST_NAMES, TILE_DATES, TILE_NAMES
from .panel import calendar

#: Dates on which a ticker, or both of a pair, must have a return.
LEAST_DATES = 2
#: Least eigenvalue of the correlations of a window whose pairs were seen on different dates.
FLOOR = 1e-3


def pairwise_moments(window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and number of dates per pair of one (dates x tickers) array, each pair over the dates that have both."""
    held = np.isfinite(window)
    x, m = np.where(held, window, 0.0), held.astype(float)
    centre = x.sum(axis=0) / np.maximum(m.sum(axis=0), 1.0)
    x = np.where(held, x - centre, 0.0)
    mean, sigma = _from_sums(x.T @ x, x.T @ m, m.T @ x, m.T @ m)
    seen = m.T @ m
    return np.where(np.diag(seen) > 0, centre + np.diag(mean), 0.0), sigma, seen


def _from_sums(products: np.ndarray, left: np.ndarray, right: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the left side and covariance per pair; 0 where too few dates have both."""
    n = np.maximum(seen, 1.0)
    enough = seen >= LEAST_DATES
    sigma = np.where(enough, (products - left * right / n) / np.maximum(seen - 1.0, 1.0), 0.0)
    return left / n, sigma


def repaired(sigma: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A covariance made positive definite where its pairs were estimated on different dates, which can contradict each other.

    All correlations shrink by the one factor that lifts their least eigenvalue to ``FLOOR``; variances stay. A window
    whose pairs all have the same dates, or whose correlations are above the floor, is left as it is.
    """
    if (seen == seen.flat[0]).all():
        return sigma
    sd = np.sqrt(np.diag(sigma))
    sd = np.where(sd > 0, sd, 1.0)
    low = np.linalg.eigvalsh(sigma / sd[:, None] / sd[None, :] + np.diag(np.diag(sigma) <= 0))[0]
    shrunk = sigma * (1.0 - max(0.0, (FLOOR - low) / (1.0 - low)))
    shrunk[np.diag_indices_from(shrunk)] = np.diag(sigma)
    return shrunk


def window_moments(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per window and ticker block: (rb_date, block, names, mu, seen, sigma).

    ``windows`` has (rb_date, rb_idx, lookback): the ``lookback`` calendar positions before ``rb_idx``. ``sigma`` holds the
    rows of the block's tickers against the tickers of this and all later blocks; ``pack_windows`` puts a window together.
    """
    by = universe_keys(returns)
    n = busy_partitions(returns)
    spans = windows.select(*by, "rb_date", (F.col("rb_idx") - F.col("lookback")).alias("_from"), F.col("rb_idx").alias("_to"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("_from", "_to")))))
    # Lists over the rebalance dates and over the tickers of a universe.
    cuts = grouped(spans, by, ends.alias("_cuts"), F.array_sort(F.collect_list(F.struct("rb_date", "_from", "_to"))).alias("_windows"))
    seen = returns.select(*by, "date", "ticker", finite(F.col("ret")).alias("ret")).where(F.col("ret").isNotNull())
    centres = seen.groupBy(*by, "ticker").agg(F.avg("ret").alias("_centre"))
    listed = grouped(centres, by, F.array_sort(F.collect_list(F.struct("ticker", "_centre"))).alias("_t"))
    too_many = F.raise_error(F.lit(f"a universe has more than {MOST_NAMES} tickers")).cast("int")
    size = F.when(F.size("_t") <= MOST_NAMES, F.size("_t")).otherwise(too_many)
    places = listed.withColumn("_n", size).select(*by, "_n", F.posexplode("_t").alias("_pos", "_c")).select(
        *by, "_n", "_pos", F.col("_c.ticker").alias("ticker"), F.col("_c._centre").alias("_centre")
    )
    days = attach(calendar(returns).select(*by, "date", "idx"), cuts.drop("_windows"), by)
    segment = F.size(F.filter("_cuts", lambda c: c <= F.col("idx")))
    days = days.withColumn("_seg", segment).where((F.col("_seg") > 0) & (F.col("_seg") < F.size("_cuts")))
    cells = seen.join(days.select(*by, "date", "idx", "_seg"), [*by, "date"]).join(places, [*by, "ticker"])
    block = F.floor(F.col("_pos") / TILE_NAMES).cast("int")
    tiles = (
        cells.groupBy(*by, "_seg", F.floor(F.col("idx") / TILE_DATES).alias("_chunk"), block.alias("_block"), "_n")
        .agg(F.collect_list("idx").alias("idx"), F.collect_list("_pos").alias("pos"), F.collect_list(F.col("ret") - F.col("_centre")).alias("x"))
    )
    others = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / TILE_NAMES).cast("int"))
    pairs = tiles.withColumn("_other", F.explode(others)).select(
        *by, "_seg", "_chunk", "_n", F.least("_block", "_other").alias("_bi"), F.greatest("_block", "_other").alias("_bj"), "_block", "idx", "pos", "x"
    )
    id_fields = "".join(f"{c} string, " for c in by)

    def multiply(key: Tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        seg, _, size, bi, bj = (int(k) for k in key[len(by) :])
        dates = np.unique(np.concatenate(pdf["idx"].to_list()))
        dense = {}
        for b in {bi, bj}:
            dense[b] = np.zeros((2, len(dates), min(TILE_NAMES, size - b * TILE_NAMES)))
        for b, idx, pos, x in zip(pdf["_block"], pdf["idx"], pdf["pos"], pdf["x"]):
            at = np.searchsorted(dates, idx), np.asarray(pos) - b * TILE_NAMES
            dense[b][0][at], dense[b][1][at] = x, 1.0
        (x, m), (y, k) = dense[bi], dense[bj]
        sums = np.stack([x.T @ y, x.T @ k, m.T @ y, m.T @ k], axis=1)
        out: dict[str, Any] = {c: key[p] for p, c in enumerate(by)}
        out |= {"_seg": seg, "_line": np.arange(sums.shape[0]) + bi * TILE_NAMES, "_bj": bj, "_sums": [s.tobytes() for s in sums]}
        return pd.DataFrame(out)

    partial = pairs.repartition(n, *by, "_seg", "_chunk", "_bi", "_bj").groupBy(*by, "_seg", "_chunk", "_n", "_bi", "_bj")
    sums = partial.applyInPandas(multiply, f"{id_fields}_seg int, _line int, _bj int, _sums binary")
    lines = attach(sums, cuts, by).select(*by, "_line", "_bj", "_seg", "_sums", "_cuts", "_windows")
    key = [*by, "_line", "_bj"]
    names = [*by, "rb_date", "_line", "_bj", "_sums"]

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Along each tile row, prefixes that an open window still needs, and the windows that end."""
        state: _Prefix | None = None
        for batch in batches:
            out: list[tuple] = []
            for row in _rows(batch):
                who = tuple(row[c] for c in key)
                if state is None or state.who != who:
                    out += state.finish() if state else []
                    state = _Prefix(who, row["_cuts"], row["_windows"])
                out += state.add(row["_seg"], np.frombuffer(row["_sums"]))
            if out:
                yield _table(out, names, schema)
        if state is not None and (out := state.finish()):
            yield _table(out, names, schema)

    dates = pa.timestamp("us")
    schema = pa.schema([*[(c, pa.string()) for c in by], ("rb_date", dates), ("_line", pa.int32()), ("_bj", pa.int32()), ("_sums", pa.binary())])
    moved = lines.repartition(n, *key).sortWithinPartitions(*key, "_seg").mapInArrow(
        differences, f"{id_fields}rb_date timestamp_ntz, _line int, _bj int, _sums binary"
    )
    return attach(moved, listed.select(*by, F.col("_t")["ticker"].alias("names"), F.col("_t")["_centre"].alias("_centres")), by)


class _Prefix:
    """Running sums of one tile row over the segments."""

    def __init__(self, who: tuple, cuts: list[int], windows: list[dict]):
        self.who, self.at, self.total = who, 1, None
        place = {c: k for k, c in enumerate(cuts, start=1)}
        self.opens = {place[w["_from"]] for w in windows}
        self.ends: dict[int, list] = {}
        for w in windows:
            self.ends.setdefault(place[w["_to"]], []).append((place[w["_from"]], w["rb_date"]))
        self.last = len(cuts)
        self.held: dict[int, np.ndarray] = {}

    def _reach(self, segment: int) -> list[tuple]:
        """The windows that end before ``segment`` begins or where it begins."""
        out = []
        while self.at <= segment:
            for start, rb_date in self.ends.get(self.at, ()):
                sums = self.total - self.held[start]
                out.append((*self.who[:-2], rb_date, self.who[-2], self.who[-1], sums.tobytes()))
            if self.at in self.opens:
                self.held[self.at] = self.total.copy()
            needed = {s for k, ends in self.ends.items() if k > self.at for s, _ in ends}
            self.held = {k: v for k, v in self.held.items() if k in needed}
            self.at += 1
        return out

    def add(self, segment: int, sums: np.ndarray) -> list[tuple]:
        if self.total is None:
            self.total = np.zeros_like(sums)
        out = self._reach(segment)
        self.total = self.total + sums
        return out

    def finish(self) -> list[tuple]:
        return self._reach(self.last)


def _rows(batch: pa.RecordBatch, some: int = 256) -> Iterator[dict]:
    for at in range(0, batch.num_rows, some):
        yield from batch.slice(at, some).to_pylist()


def _table(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)


def pack_windows(moments: DataFrame) -> DataFrame:
    """One row per window: ``names``, ``_centres`` and the tile rows of its sums, bounded by the square of the tickers."""
    by = universe_keys(moments)
    return (
        moments.repartition(busy_partitions(moments), *by, "rb_date")
        .groupBy(*by, "rb_date")
        .agg(F.first("names").alias("names"), F.first("_centres").alias("_centres"), F.collect_list(F.struct("_line", "_bj", "_sums")).alias("_lines"))
    )


def unpack_window(names: list, centres: np.ndarray, lines: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and number of dates per pair of one packed window."""
    n = len(names)
    mean, sigma, seen = np.zeros(n), np.zeros((n, n)), np.zeros((n, n))
    for line in lines:
        i, first = line["_line"], line["_bj"] * TILE_NAMES
        products, left, right, both = np.frombuffer(line["_sums"]).reshape(4, -1)
        last = first + len(both)
        both = np.rint(both)
        means, sigma[i, first:last] = _from_sums(products, left, right, both)
        seen[i, first:last] = both
        if first <= i < last:
            mean[i] = means[i - first] + (centres[i] if both[i - first] > 0 else 0.0)
    upper = np.triu(np.ones((n, n), bool))
    return mean, np.where(upper, sigma, sigma.T), np.where(upper, seen, seen.T)
