"""Top-k and nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefolio.llm import ball_tree as B, vantage_tree as V


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumn("dim", F.lit("clash")).withColumn("rank", F.lit(1))


def odd_rows():
    return [(1000, None), (1050, [None] * 8), (1100, [float("nan")] + [0.0] * 7), (1150, [math.inf] * 8), (1200, []), (None, [0.5] * 8), (1250, [0.1, 0.2]), (1301, [0.3, 0.1])]


def vectors(n=900, d=8, seed=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, d)).astype(np.float32)
    out[100:400] = out[100]  # one very common vector: ties by the hundred
    out[7] = 0
    return out


def usable(rows, zero_out=False):
    keep = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and not (zero_out and not any(v)):
            keep[i] = np.array(v, np.float32)
    return keep


def best(keep, query, k, score):
    others = [(score(keep[query], v), i) for i, v in keep.items() if i != query and len(v) == len(keep[query])]
    return sorted(others)[:k]


@pytest.mark.parametrize("shard_rows", [8192, 200])
def test_exact_top_k(spark, shard_rows):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors())] + odd_rows()
    got = {}
    for r in B.top_k(table(spark, rows), shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    keep = usable(rows)
    quantized = lambda v: [math.floor(256 * float(x)) for x in v]
    score = lambda a, b: -sum(x * y for x, y in zip(quantized(a), quantized(b)))
    assert set(got) == {i for i in keep if i % 50 == 0}
    for q, found in got.items():
        want = [(rank, -s, i) for rank, (s, i) in enumerate(best(keep, q, 5, score), 1)]
        assert sorted(found) == want


@pytest.mark.parametrize("shard_rows", [8192, 200])
def test_neighbours_are_exact_at_factor_one_and_near_that_else(spark, shard_rows):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(seed=1))] + odd_rows()
    keep = usable(rows, zero_out=True)
    distance = lambda a, b: float(np.sqrt(((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum()))
    for factor in (1.0, V.FACTOR):
        got = {}
        for r in V.neighbours(table(spark, rows), factor=factor, shard_rows=shard_rows).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        assert set(got) == {i for i in keep if i % 100 == 0}
        hits = total = 0
        for q, found in got.items():
            want = best(keep, q, 10, distance)
            if factor == 1.0:
                assert [(s, i) for _, s, i in sorted(found)] == want
            for _, s, i in found:
                assert s == distance(keep[q], keep[i])
            hits, total = hits + len({i for _, _, i in found} & {i for _, i in want}), total + len(want)
        assert hits >= 0.9 * total


def test_large_components_and_few_candidates(spark):
    rows = [(0, [1e30, -1e30]), (50, [1e30, 1e30]), (3, [0.5, 0.25])]
    got = B.top_k(table(spark, rows)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 50), (0, 3), (50, 0), (50, 3)}
    scores = {(r.query_id, r.vec_id): r.score for r in got}
    assert scores[0, 50] == 0 and scores[50, 3] == B.MOST_SCORE
    assert V.neighbours(table(spark, rows)).count() == 2
    # Beyond a long every score is the end of its range, and no candidate is lost.
    far = [(0, [1e30, 1e30]), (50, [-1e30, -1e30]), (3, [1e30, 0.0])]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in B.top_k(table(spark, far)).collect()}
    assert got == {(0, 1, 3, B.MOST_SCORE), (0, 2, 50, -B.MOST_SCORE), (50, 1, 0, -B.MOST_SCORE), (50, 2, 3, -B.MOST_SCORE)}


@pytest.mark.parametrize("shard_rows", [8192, 40])
@pytest.mark.parametrize("sizes", [(1e-3, 1e3, 1e6, 1e9), (2e6, 3e6), (5e5,), (3e9, 1.0)])
def test_products_of_any_size_are_exact(spark, shard_rows, sizes):
    rng = np.random.default_rng(len(sizes))
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4) * rng.choice(sizes))]) for i in range(300)]
    rows += [(7 * i, rows[i][1]) for i in range(43, 60)] + [(1000, rows[0][1]), (1001, rows[0][1])]
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    got = {}
    for r in B.top_k(table(spark, rows), shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, set()).add((r["rank"], r.score, r.vec_id))
    for q, v in scaled:
        if q % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in scaled if i != q)[:5]
            held = {(rank, max(-B.MOST_SCORE, min(B.MOST_SCORE, -s)), i) for rank, (s, i) in enumerate(others, 1)}
            if all(-s < B.MOST_SCORE for s, _ in others):  # scores that a long holds
                assert held <= got[q]


def test_repeated_rows_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in B.top_k(table(spark, rows)).collect()]
    assert got == [(0, 1, 1), (0, 1, 1)]
    assert len(V.neighbours(table(spark, rows)).collect()) == 2
    assert B.top_k(table(spark, [])).count() == 0 and V.neighbours(table(spark, [])).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in V.neighbours(df, factor=1.0).collect()}
    found = {(r.query_id, r.vec_id) for r in V.neighbours(df).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
