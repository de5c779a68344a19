"""Exact top-k search by inner product: a ball tree per shard, branch and bound by the inner-product upper bound.

Components become integers, floor(256 x), so scores are exact. A ball with centre c and radius r bounds q.x by
q.c + |q| r. The nodes of a shard's tree wait in a heap by their largest bound over the queries of a block; a popped node
is looked at only by those queries whose bound still reaches their kth score (equal scores count while the ball holds a
smaller id than the kth), and leaves update the kth scores that the next nodes are held against. The limits of the home
shard are shared with all others (see ``vector_cells``).

Defined cases: vectors that are null, empty, or hold a null or non-finite component, and rows without id, take no part;
products are exact whatever the size of the components: where they may pass 64 bits they are made of Python's integers; a
score that a long cannot hold is held at its end, and components of 2**54 and more at that size; vectors of different
lengths are not compared; a query's own row is left out by its id, so rows that share the id are no candidates of each
other, and each of them is a query of its own; ties go to the smaller vec_id; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.llm.vector_cells import Kept, finite, nearest
from tidefolio.session import hand_off

SCALE = 256
EVERY = 50
K = 5
LEAF = 128
#: Largest scaled component, and largest score that is told apart.
MOST = 1 << 62
MOST_SCORE = (1 << 63) - 2
#: Sums below these are exact in double precision and in 64 bits.
EXACT, EXACT_LONG = 1 << 53, 1 << 63


@dataclass
class Tree:
    """Nodes in arrays: rows [start, stop) of the shard, centre, radius, smallest id, first child (0 for a leaf)."""

    ids: np.ndarray
    rows: np.ndarray
    start: list[int]
    stop: list[int]
    child: list[int]
    centre: np.ndarray
    radius: np.ndarray
    least_id: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray) -> Tree:
    """Splits at the median along the line through two far points."""
    order = np.arange(len(ids))
    points = rows.astype(np.float64)
    start, stop, child, centres, radii, least = [0], [len(ids)], [0], [], [], []
    node = 0
    while node < len(start):
        own = order[start[node] : stop[node]]
        part = points[own]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(float(away.max()))
        least.append(int(ids[own].min()))
        if len(own) > LEAF and away.max() > 0:
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            half = len(own) // 2
            split = np.argpartition(part @ (other - one), half)
            order[start[node] : stop[node]] = own[split]
            child[node] = len(start)
            middle = start[node] + half
            start += [start[node], middle]
            stop += [middle, stop[node]]
            child += [0, 0]
        node += 1
    return Tree(ids[order], rows[order], start, stop, child, np.array(centres), np.array(radii), np.array(least))


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, limit: np.ndarray | None):
    """Best inner products of a block of queries in one shard; scores are kept negated, so that smaller is better."""
    points = queries.astype(np.float64)
    norms = np.sqrt((points**2).sum(axis=1))
    kept = Kept(len(queries), k, None if limit is None else -limit[: len(queries)], np.int64)
    values = tree.rows.astype(np.float64)
    most_asked = np.abs(queries).max(axis=1, initial=0)

    def products(some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        rows = tree.rows[lo:hi]
        largest = int(most_asked[some].max()) * int(np.abs(rows).max(initial=0)) * rows.shape[1]
        if largest < EXACT:
            return (points[some] @ values[lo:hi].T).astype(np.int64)
        if largest < EXACT_LONG:
            return queries[some] @ rows.T
        wide = queries[some].astype(object) @ rows.T.astype(object)
        return np.clip(wide, -MOST_SCORE, MOST_SCORE).astype(np.int64)

    def bounds(node: int) -> np.ndarray:
        upper = points @ tree.centre[node] + norms * tree.radius[node]
        room = 1e-9 * (1 + np.abs(upper) + norms * np.abs(tree.centre[node]).max())
        return np.minimum(-np.floor(upper + room), float(MOST_SCORE))

    def alive(node: int, low: np.ndarray) -> np.ndarray:
        worst = kept.worst()
        return np.nonzero((low < worst) | ((low == worst) & (tree.least_id[node] < kept.worst_id())))[0]

    heap = [(0.0, 0, bounds(0))]
    while heap:
        _, node, low = heapq.heappop(heap)
        some = alive(node, low)
        if not len(some):
            continue
        if tree.child[node]:
            for c in (tree.child[node], tree.child[node] + 1):
                below = bounds(c)
                open_to = alive(c, below)
                if len(open_to):
                    heapq.heappush(heap, (float(below[open_to].min()), c, below))
            continue
        # Leaves of equal vectors may be long: take them in slices.
        for lo in range(tree.start[node], tree.stop[node], 4 * LEAF):
            hi = min(lo + 4 * LEAF, tree.stop[node])
            score = -products(some, lo, hi)
            own = query_ids[some][:, None] == tree.ids[lo:hi][None, :]
            better = (score <= kept.worst()[some][:, None]) & ~own
            at, place = np.nonzero(better)
            kept.add(some[at], score[at, place], tree.ids[lo:hi][place])
    at, ids, score = kept.results()
    return at, ids, -score


def quantized(vec: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vec, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("long"))


def top_k(
    df: DataFrame, *, id_col: str = "vec_id", vec: str = "embedding", k: int = K, every: int = EVERY, shard_rows: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of every row whose id ``every`` divides."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec}`").alias("raw"))
    whole = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("raw")))
    vectors = hand_off(whole.select("vec_id", quantized(F.col("raw")).alias("vec"), F.size("raw").alias("dim")), "ball-vectors")
    queries = vectors.filter(F.col("vec_id") % every == 0)
    return nearest(vectors, queries, k, build, search, "long", True, shard_rows)
