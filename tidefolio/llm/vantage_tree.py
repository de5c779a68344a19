"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality with a factor.

Each node has a vantage point and splits its other points at the median distance to it; a child knows the smallest and
largest of these distances. For a query at distance d from the vantage point, no point of a child with range [lo, hi] is
nearer than max(d - hi, lo - d, 0). A child is left out if ``factor`` times that bound is beyond the kth distance so far:
factor 1 is exact, larger ones leave out more. Nodes wait in a heap by their smallest bound over a block of queries; the
limits of the home shard are shared with all others (see ``vector_cells``). Every row is indexed.

Distances are taken from the original components in double precision. Within a leaf a matrix product only screens pairs,
with room for its rounding; those near enough are measured exactly.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component, and rows without id, take
no part; vectors of different lengths are not compared; a query's own row is left out by its id, so rows that share the id
are no candidates of each other, and each of them is a query of its own; ties go to the smaller vec_id; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidefolio.llm.vector_cells import Kept, finite, nearest
from tidefolio.session import hand_off

EVERY = 100
K = 10
FACTOR = 2.0
LEAF = 128
SLICE = 1 << 15


@dataclass
class Tree:
    """Nodes in arrays; ``point`` is the row of the vantage point (-1 in a leaf), ``near`` and ``far`` bound the distances
    of a node's points to the parent's vantage point."""

    ids: np.ndarray
    rows: np.ndarray
    start: list[int]
    stop: list[int]
    child: list[int]
    point: list[int]
    near: list[float]
    far: list[float]


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=-1))


def build(ids: np.ndarray, rows: np.ndarray) -> Tree:
    rows = rows.astype(np.float64)
    order = np.arange(len(ids))
    tree = Tree(ids, rows, [0], [len(ids)], [0], [-1], [0.0], [np.inf])
    node = 0
    while node < len(tree.start):
        lo, hi = tree.start[node], tree.stop[node]
        own = order[lo:hi]
        if len(own) > LEAF:
            # The point farthest from the first one spreads the others well; it stays in front of its node's rows.
            first = distances(rows[own], rows[own[0]])
            at = int(first.argmax())
            own[[0, at]] = own[[at, 0]]
            away = distances(rows[own[1:]], rows[own[0]])
            if away.max() > 0:
                half = len(away) // 2
                split = np.argpartition(away, half)
                own[1:] = own[1:][split]
                away = away[split]
                order[lo:hi] = own
                tree.point[node], tree.child[node] = lo, len(tree.start)
                tree.start += [lo + 1, lo + 1 + half]
                tree.stop += [lo + 1 + half, hi]
                tree.child += [0, 0]
                tree.point += [-1, -1]
                tree.near += [float(away[:half].min()), float(away[half:].min())]
                tree.far += [float(away[:half].max()), float(away[half:].max())]
        node += 1
    tree.ids, tree.rows = ids[order], rows[order]
    return tree


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, limit: np.ndarray | None, factor: float):
    """Nearest points of a block of queries in one shard."""
    points = queries.astype(np.float64)
    kept = Kept(len(points), k, None if limit is None else limit[: len(points)])
    squares, own_squares = (tree.rows**2).sum(axis=1), (points**2).sum(axis=1)

    def look(some: np.ndarray, lo: int, hi: int) -> None:
        for begin in range(lo, hi, 4 * LEAF):
            end = min(begin + 4 * LEAF, hi)
            both = own_squares[some][:, None] + squares[begin:end][None, :]
            rough = both - 2 * (points[some] @ tree.rows[begin:end].T)
            worst = kept.worst()[some][:, None]
            near = (rough <= worst * worst * (1 + 1e-9) + 1e-9 * both) & (query_ids[some][:, None] != tree.ids[begin:end][None, :])
            at, place = np.nonzero(near)
            place += begin
            at = some[at]
            exact = [distances(points[at[i : i + SLICE]], tree.rows[place[i : i + SLICE]]) for i in range(0, len(at), SLICE)]
            if exact:
                exact = np.concatenate(exact)
                close = exact <= kept.worst()[at]
                kept.add(at[close], exact[close], tree.ids[place[close]])

    heap = [(0.0, 0, np.zeros(len(points)))]
    while heap:
        _, node, low = heapq.heappop(heap)
        some = np.nonzero(factor * low <= kept.worst())[0]
        if not len(some):
            continue
        if tree.point[node] < 0:
            look(some, tree.start[node], tree.stop[node])
            continue
        look(some, tree.point[node], tree.point[node] + 1)
        away = distances(points[some], tree.rows[tree.point[node]])
        for c in (tree.child[node], tree.child[node] + 1):
            # A bound that is too large by rounding must not cost an exact result.
            gap = np.maximum(away - tree.far[c], tree.near[c] - away) - 1e-9 * (1 + away)
            below = np.full(len(points), np.inf)
            below[some] = np.maximum(low[some], gap)
            open_to = factor * below[some] <= kept.worst()[some]
            if open_to.any():
                heapq.heappush(heap, (float(below[some][open_to].min()), c, below))
    return kept.results()


def neighbours(
    df: DataFrame, *, id_col: str = "vec_id", vec: str = "embedding", k: int = K, every: int = EVERY, factor: float = FACTOR, shard_rows: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id ``every`` divides; score is the distance."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec}`").cast("array<double>").alias("vec"))
    some = F.exists("vec", lambda x: x != 0)
    whole = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vec")) & some)
    vectors = hand_off(whole.withColumn("dim", F.size("vec")), "vantage-vectors")
    queries = vectors.filter(F.col("vec_id") % every == 0)
    return nearest(vectors, queries, k, build, partial(search, factor=factor), "double", False, shard_rows)
