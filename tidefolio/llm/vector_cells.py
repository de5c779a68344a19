"""Queries against all vectors in blocks: one tree per shard of vectors, one packed block per group of queries.

A cell is a (shard, query block) pair. Every block first visits one shard, its home; the kth best result there is each
query's first limit and travels with the block to all other shards, so their trees are cut by it from the start. Shards
and blocks hold a fixed number of rows, dealt by a hash of the row's place in a stored table, so equal or repeated vectors
spread evenly; a cell's memory does not grow with the data. Vectors of different lengths never meet.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidefolio.session import hand_off

SHARD_ROWS = 8192
BLOCK_ROWS = 1024


def finite(vec: Column) -> Column:
    """Not null, not empty and all components finite."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(whole, F.lit(False))


def _row(dim: pa.Scalar, **others) -> pa.Table:
    """A table of one row."""
    arrays = {n: pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.array([v.as_py()], pa.int64()) for n, v in others.items()}
    return pa.table({"dim": pa.array([dim.as_py()], pa.int32()), **arrays})


def _pack(name: str, group_rows: int, vectors: DataFrame, make: Callable) -> DataFrame:
    """(dim, ``name``, blob): rows dealt to groups of about ``group_rows``, the fields of the object made of each as one blob."""
    sizes = vectors.groupBy("dim").agg((F.floor((F.count("*") - 1) / group_rows) + 1).alias("groups"))
    sizes = hand_off(sizes, f"{name}-sizes")
    dealt = vectors.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())).join(sizes, "dim")
    keyed = dealt.withColumn(name, F.pmod("_at", "groups")).select("dim", name, "vec_id", "vec")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        flat = np.concatenate([c.flatten().to_numpy() for c in rows.column("vec").chunks])
        blob = pickle.dumps(vars(make(ids, flat.reshape(len(ids), -1))), protocol=5)
        return _row(dim=key[0], **{name: key[1]}, blob=blob)

    packed = keyed.groupBy("dim", name).applyInArrow(build, f"dim int, {name} long, blob binary")
    return hand_off(packed, f"{name}-blobs").join(sizes, "dim")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    make_tree: Callable,
    search: Callable,
    score_type: str,
    best_last: bool,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best, ties to the smaller vec_id.

    ``search(tree, ids, block, k, limit)`` gives (row of block, vec_id, score) arrays: at most k per query, none worse
    than ``limit`` (a score per query, or None). Scores are better if larger when ``best_last``.
    """
    trees = _pack("shard", shard_rows, vectors, make_tree).withColumnRenamed("blob", "tree").withColumnRenamed("groups", "shards")
    blocks = _pack("block", block_rows, queries, lambda ids, rows: SimpleNamespace(ids=ids, rows=rows)).withColumnRenamed("groups", "blocks")
    kind, number = (pa.int64(), np.int64) if score_type == "long" else (pa.float64(), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, shard, block, tree, blob, limit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                asked = SimpleNamespace(**pickle.loads(blob))
                ids, rows = asked.ids, asked.rows
                bound = None if limit is None else np.frombuffer(limit, number)
                at, found, score = search(SimpleNamespace(**pickle.loads(tree)), ids, rows, k, bound)
                n = len(at)
                arrays = [pa.array([x] * n, t) for x, t in ((dim, pa.int32()), (shard, pa.int64()), (block, pa.int64()))]
                arrays += [pa.array(at, pa.int32()), pa.array(ids[at], pa.int64()), pa.array(found, pa.int64()), pa.array(score, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["dim", "shard", "block", "at", "query_id", "vec_id", "score"])

    schema = f"dim int, shard long, block long, at int, query_id long, vec_id long, score {score_type}"
    cells = ["dim", "shard", "block"]
    shards = trees.select("dim", "shards").distinct()
    # First round: each block in its home shard.
    home = blocks.join(shards, "dim").withColumn("shard", F.pmod("block", "shards")).select(*cells, "blob")
    first = home.join(trees.select("dim", "shard", "tree"), ["dim", "shard"])
    first = first.select(*cells, "tree", "blob", F.lit(None).cast("binary").alias("limit")).mapInArrow(run, schema)
    first = hand_off(first, "cells-home")
    # The kth score of each query as the limit of its block; a block's rows are bounded.
    worst = (F.min if best_last else F.max)("score")
    kth = first.groupBy("dim", "block", "at").agg(F.count("*").alias("n"), worst.alias("limit")).filter(F.col("n") >= k)

    def pack_limits(key: tuple, rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        size = max(block_rows * 4, int(at.max(initial=-1)) + 1)
        out = np.full(size, -worst_of(number) if best_last else worst_of(number), number)
        out[at] = rows.column("limit").to_numpy()
        return _row(dim=key[0], block=key[1], limit=out.tobytes())

    limits = kth.select("dim", "block", "at", "limit").groupBy("dim", "block").applyInArrow(pack_limits, "dim int, block long, limit binary")
    # Second round: every other cell. Both sides are repeated for the cells they are part of.
    armed = blocks.join(limits, ["dim", "block"], "left").join(shards, "dim")
    asked = armed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    asked = asked.filter(F.col("shard") != F.pmod("block", "shards")).select(*cells, "blob", "limit")
    counted = blocks.select("dim", "blocks").distinct()
    held = trees.join(counted, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    second = asked.join(held.select(*cells, "tree"), cells).select(*cells, "tree", "blob", "limit").mapInArrow(run, schema)
    found = first.union(second)
    best = F.col("score").desc() if best_last else F.col("score").asc()
    # A query row is (dim, block, at): rows that share an id are queries of their own.
    ranked = W.partitionBy("dim", "block", "at").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (score, id) of each ``at``."""
    order = np.lexsort((ids, score, at))
    sorted_at = at[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_at[1:] != sorted_at[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def worst_of(kind: type):
    """A score that no result has: infinity, or the largest integer."""
    return np.inf if kind is np.float64 else np.iinfo(np.int64).max


class Kept:
    """The k smallest (score, id) pairs of every query so far, scores as doubles or as integers; fewer than k are filled with
    the worst score."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None, kind: type = np.float64):
        self.k, self.none = k, worst_of(kind)
        self.score = np.full((n, k), self.none, kind)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.limit = np.full(n, self.none, kind) if limit is None else limit

    def worst(self) -> np.ndarray:
        """The score that a further result must not exceed."""
        return np.minimum(self.score[:, -1], self.limit)

    def worst_id(self) -> np.ndarray:
        """The id that a further result of the worst score must not exceed."""
        return np.where(self.score[:, -1] <= self.limit, self.ids[:, -1], np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        rows = np.unique(at)
        place = np.searchsorted(rows, at)
        old = np.repeat(np.arange(len(rows)), self.k)
        all_at = np.concatenate([old, place])
        all_score = np.concatenate([self.score[rows].ravel(), score])
        all_ids = np.concatenate([self.ids[rows].ravel(), ids])
        best = best_of(all_at, all_score, all_ids, self.k)
        self.score[rows] = all_score[best].reshape(len(rows), self.k)
        self.ids[rows] = all_ids[best].reshape(len(rows), self.k)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = self.score != self.none
        at = np.nonzero(there)[0]
        return at.astype(np.int32), self.ids[there], self.score[there]
