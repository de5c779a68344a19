"""Least CVaR over a universe's dates by cutting planes, for many portfolios and universes at once.

CVaR is the least over v of v plus the mean excess of the loss over v, divided by 1 - alpha. The dates of a universe are dealt
into ``BLOCKS`` blocks, and the excess of each block is a convex function of the weights and v. In each round Spark
evaluates it at the trial points of every open problem: a task holds one chunk of dates and the points, and returns tail
sums per block, which are added up along the chunks. Each sum is a cut: a plane below that block's excess that touches it at
the trial point. A problem's master program has its weights, v and one excess per block as unknowns and its cuts as
constraints, whatever the number of dates; its value is a lower bound, the best trial point an upper one, and the problem is
done when both agree. As the excess of a block is made of finitely many planes, that happens after finitely many rounds.

Nothing of a problem reaches the driver but the number of problems that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import finite
from ..schema import attach, grouped, require, universe_keys
from ..session import busy_partitions, hand_off
from .covariance import MOST_NAMES, TILE_DATES
from .panel import calendar
from .solvers import GAP, INFEASIBLE, NOT_CONVERGED, OK, feasible_rows, project_rows, tail_cuts, tail_master

PID = "portfolio_id"
BLOCKS = 64
MOST_ROUNDS = 200
OPEN = "open"
#: Loss levels of the first trial points, in standard deviations of all returns.
FIRST_LEVELS = (0.0, 1.0, 2.0)

_STATE = (
    "size int, dates long, unit double, floor double, lam double, lo double, hi double, ref array<double>,"
    " points array<double>, cuts array<double>, best double, best_w array<double>, bound double, status string"
)


def _dense(names: list, tickers: list | None, values: list | None) -> np.ndarray:
    out = np.full(len(names), 1.0 / len(names))
    if tickers is not None:
        place = {t: k for k, t in enumerate(names)}
        out[:] = 0.0
        for t, x in zip(tickers, values):
            if t in place and x is not None:
                out[place[t]] += x
    return out


def _boxed(w: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return project_rows(w[None, :], np.array([[lo]]), np.array([[hi]]))[0]


def _begin(row: dict) -> dict:
    """The first state of a problem: trial points at the reference, cut to the box. Returns are counted in their deviation."""
    n, lo, hi = len(row["names"]), row["lo"], row["hi"]
    unit = row["unit"] or 1.0
    ref = _dense(row["names"], row.get("ref_ticker"), row.get("ref_weight"))
    ok = bool(feasible_rows(n, np.array([[lo]]), np.array([[hi]]))[0])
    start = _boxed(ref, lo, hi) if ok else np.full(n, 1.0 / n)
    reach = 1.0 if lo >= 0 else n * max(abs(lo), abs(hi))
    return {
        "size": n, "dates": row["dates"], "unit": unit, "floor": -(row["most"] or 0.0) / unit * reach, "lam": row["lam"] / unit,
        "lo": lo, "hi": hi, "ref": ref, "points": np.concatenate([np.append(start, v) for v in FIRST_LEVELS]), "cuts": [],
        "best": float("inf"), "best_w": start, "bound": float("-inf"), "status": OPEN if ok else INFEASIBLE,
    }


def _advance(state: dict, sums: np.ndarray) -> dict:
    """The state after the cuts of a round: ``sums`` has rows (point, block, value, n, g)."""
    n = state["size"]
    points = np.asarray(state["points"], dtype=float).reshape(-1, n + 1)
    ref, best_w = np.asarray(state["ref"]), np.asarray(state["best_w"])
    best, level = state["best"], None
    for k, point in enumerate(points):
        w, v = point[:-1], point[-1]
        value = v + sums[sums[:, 0] == k, 2].sum() + state["lam"] * np.abs(w - ref).sum()
        if value < best:
            best, best_w, level = value, w, v
    fresh = np.delete(sums[sums[:, 3] > 0], (0, 2), axis=1)
    cuts = np.unique(np.concatenate([np.asarray(state["cuts"], dtype=float).reshape(-1, n + 2), fresh]), axis=0)
    w, v, bound = tail_master(cuts, BLOCKS, state["lam"], ref, state["lo"], state["hi"], state["floor"])
    w = _boxed(w, state["lo"], state["hi"])
    bound = max(bound, state["bound"])
    level = v if level is None else level
    done = (best - bound) / (1.0 + abs(best)) <= GAP
    trial = np.concatenate([np.append(w, v), np.append((w + best_w) / 2, (v + level) / 2)])
    return state | {
        "points": trial, "cuts": cuts.ravel(), "best": best, "best_w": best_w, "bound": bound, "status": OK if done else OPEN
    }


def _mapped(df: DataFrame, one, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = [one(row) for row in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist([{c: o[c] for c in arrow.names} for o in out], schema=arrow)

    kinds = df.sparkSession.createDataFrame([], schema).schema
    return df.mapInArrow(run, schema)


def _tail_sums(open_: DataFrame, chunks: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, _id, sums): per open problem the rows (point, block, value, n, g) over all dates."""
    n = busy_partitions(chunks)
    # New names for columns that meet ``chunks`` itself again below.
    places = chunks.select(*[F.col(c).alias(c) for c in (*by, "_chunk")])
    probes = open_.select(*by, "_id", "dates", "unit", "points")
    probes = probes.join(places, by) if by else attach(probes, places.agg(F.collect_list("_chunk").alias("_all")), []).withColumn(
        "_chunk", F.explode("_all")
    ).drop("_all")
    fields = "".join(f"{c} string, " for c in by)

    def evaluate(key: Tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            row = right.iloc[0]
            dates, at = np.unique(row["idx"], return_inverse=True)
            x = np.zeros((len(dates), int(row["_n"])))
            x[at, row["pos"]] = row["x"]
            block = dates % BLOCKS
            parts = [(b, x[block == b]) for b in np.unique(block)]
            for who, total, unit, points in zip(left["_id"], left["dates"], left["unit"], left["points"]):
                for k, point in enumerate(np.asarray(points, dtype=float).reshape(-1, x.shape[1] + 1)):
                    for b, rows in parts:
                        sums = tail_cuts(rows / unit, point[:-1], point[-1], share / total)
                        if sums[1] > 0:
                            out.append((*key[: len(by)], who, k, int(b), sums.tobytes()))
        return pd.DataFrame(out, columns=[*by, "_id", "_point", "_block", "_sums"])

    keys = [*by, "_chunk"]
    tiles = (
        probes.repartition(n, *keys).groupBy(*keys).cogroup(chunks.repartition(n, *keys).groupBy(*keys))
        .applyInPandas(evaluate, f"{fields}_id long, _point int, _block int, _sums binary")
    )
    schema = pa.schema([*[(c, pa.string()) for c in by], ("_id", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, held = None, {}

        def out():
            flat = np.concatenate([np.concatenate((place, sums)) for place, sums in held.items()])
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*who, flat)))], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    owner = (*[row[c] for c in by], row["_id"])
                    if owner != who:
                        if who is not None:
                            yield out()
                        who, held = owner, {}
                    place, sums = (float(row["_point"]), float(row["_block"])), np.frombuffer(row["_sums"])
                    held[place] = held[place] + sums if place in held else sums
        if who is not None:
            yield out()

    whose = [*by, "_id"]
    return tiles.repartition(n, *whose).sortWithinPartitions(*whose).mapInArrow(add, f"{fields}_id long, sums array<double>")


def cvar_minimise(
    problems: DataFrame, returns: DataFrame, *, alpha: float = 0.95, ref: DataFrame | None = None, rounds: int = MOST_ROUNDS, **defaults: float
) -> DataFrame:
    """Weights (ticker, weight, status, residual) with the least CVaR of the loss plus lam * L1 turnover, per problem row.

    ``problems`` holds portfolio_id and any of lam, w_min, w_max, and universe_id where ``returns`` has it; ``ref`` is a
    weight table, per portfolio or common, equal weights by default. Scenarios are the dates of ``returns`` (a missing return
    earns 0). ``residual`` is the relative gap between the answer and the bound below every answer; a problem that is open
    after ``rounds`` is 'not_converged', one whose box admits no weights 'infeasible'.
    """
    require(problems, PID)
    by = universe_keys(returns)
    settings = {"lam": 0.0, "w_min": 0.0, "w_max": 1.0, **defaults}
    if set(settings) != {"lam", "w_min", "w_max"}:
        raise ValueError(f"unknown parameters: {sorted(set(settings) - {'lam', 'w_min', 'w_max'})}")
    seen = returns.select(*by, "date", "ticker", finite(F.col("ret")).alias("ret"))
    value = F.coalesce("ret", F.lit(0.0))
    facts = grouped(
        seen, by, F.array_sort(F.collect_set("ticker")).alias("names"), F.stddev_pop(value).alias("unit"), F.max(F.abs(value)).alias("most")
    )
    days = calendar(returns)
    size = F.when(F.size("names") <= MOST_NAMES, F.size("names")).otherwise(
        F.raise_error(F.lit(f"a universe has more than {MOST_NAMES} tickers")).cast("int")
    )
    facts = hand_off(facts.withColumn("_n", size), "tail-facts")
    places = facts.select(*by, "_n", F.posexplode("names").alias("_pos", "ticker"))
    cells = seen.where(F.col("ret").isNotNull()).join(days.select(*by, "date", "idx"), [*by, "date"]).join(places, [*by, "ticker"])
    chunks = cells.groupBy(*by, F.floor(F.col("idx") / TILE_DATES).alias("_chunk"), "_n").agg(
        F.collect_list("idx").alias("idx"), F.collect_list("_pos").alias("pos"), F.collect_list("ret").alias("x")
    )
    chunks = hand_off(chunks, "tail-chunks")
    totals = grouped(days, by, F.max("n_dates").alias("dates"))
    tasks = attach(attach(problems.withColumn("_id", F.monotonically_increasing_id()), facts, by), totals, by)
    if ref is not None:
        keys = [c for c in (PID, *by) if c in ref.columns]
        listed = grouped(ref, keys, F.collect_list("ticker").alias("ref_ticker"), F.collect_list("weight").alias("ref_weight"))
        tasks = tasks.join(listed, keys, "left") if keys else attach(tasks, listed, [])
    number = lambda c: (F.col(c) if c in problems.columns else F.lit(settings[c])).cast("double")
    keep = problems.columns
    tasks = tasks.where(F.size("names") > 0).select(
        "_id", *keep, "names", "unit", "most", "dates", number("lam").alias("_lam"), number("w_min").alias("lo"), number("w_max").alias("hi"),
        *(["ref_ticker", "ref_weight"] if ref is not None else []),
    )
    # The problems' own columns wait in a table of their own; a state has the keys and what changes.
    tasks = hand_off(tasks, "tail-problems")
    inputs = tasks.drop(*[c for c in keep if c not in by]).withColumnRenamed("_lam", "lam")
    fields = "".join(f"{c} string, " for c in by)
    schema = f"{fields}_id long, {_STATE}"
    state = hand_off(_mapped(inputs, lambda row: {**{c: row[c] for c in (*by, "_id")}, **_begin(row)}, schema), "tail-state")
    for _ in range(rounds):
        open_ = state.where(F.col("status") == OPEN)
        if open_.isEmpty():
            break
        sums = _tail_sums(open_, chunks, by, 1.0 / (1.0 - alpha))

        def step(row: dict) -> dict:
            new = np.asarray(row["sums"] or [], dtype=float).reshape(-1, row["size"] + 4)
            return row | _advance({c: x for c, x in row.items() if c != "sums"}, new)

        moved = _mapped(open_.join(sums, [*by, "_id"], "left"), step, schema)
        state = hand_off(state.where(F.col("status") != OPEN).unionByName(moved), "tail-state")
    gap = (F.col("best") - F.col("bound")) / (1.0 + F.abs("best"))
    status = F.when(F.col("status") == OPEN, NOT_CONVERGED).otherwise(F.col("status"))
    residual = F.when(status != INFEASIBLE, gap)
    solved = state.select("_id", F.col("best_w").alias("_w"), status.alias("status"), residual.alias("residual"))
    rows = tasks.select("_id", *keep, "names").join(solved, "_id")
    pairs = F.inline(F.arrays_zip(F.col("names").alias("ticker"), F.col("_w").alias("weight")))
    return rows.select(*keep, pairs, "status", "residual").select(*keep, "ticker", "weight", "status", "residual")
