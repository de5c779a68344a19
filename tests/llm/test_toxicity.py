"""The index against brute force, scores against held-out labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefolio.llm import toxicity as X


def test_block_max_index_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        f = rng.choice(40, size=rng.integers(1, 6), replace=False)
        w = rng.integers(1, 4, len(f)) / 1.0
        vectors.append({int(a): float(b) for a, b in zip(f, w / np.sqrt((w**2).sum()))})
    vectors[50:250] = [vectors[50]] * 200
    index = X.BlockMaxIndex(vectors)
    for q in vectors[::23] + [{99: 1.0}, {}]:
        want = [(-s, i) for i, v in enumerate(vectors) if (s := sum(w * v.get(f, 0.0) for f, w in sorted(q.items()))) > 0]
        want = sorted(want)[:15]
        at, score = index.top(q, 15)
        assert np.allclose(score, [-s for s, _ in want])
        # Equal sums may differ in the last bit; clear winners must be the same rows.
        assert len(at) == len(want) and len(set(at)) == len(at)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    plain = ["the", "of", "river", "stone", "green", "walk", "quiet", "table", "open", "late"]
    bad = ["vilest", "vilething", "vileness", "wretch", "wretched"]
    docs, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.15)
        words = list(rng.choice(plain, 40))
        if toxic:
            words[3:6] = list(rng.choice(bad, 3))
        docs.append((i, " ".join(words), "en", "s", 1))
        if i % 3 != 2:
            labels.append((i, 1, toxic))
    docs += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (None, "vilest wretch vileness", "en", "s", 0), (5, "late " * 30_000, "en", "s", 0)]
    labels += [(2000, 1, None), (None, 1, 1), (4, 0, 0), (9_999_999, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumn("toxic", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, world):
    docs, labels = world
    scored = X.score_documents(docs, labels)
    assert scored.count() == docs.count()
    rows = {r.doc_id: r for r in scored.collect() if r.doc_id != 5}
    truth = {r.doc_id: r.toxic for r in labels.filter("toxic is not null and doc_id is not null and doc_id < 1500").collect()}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1 and i != 5]
    assert sum((rows[i].score >= X.THRESHOLD) == bool(truth[i]) for i in out) >= 0.98 * len(out)
    assert rows[None].score >= X.THRESHOLD and rows[2000].score == rows[2001].score < 0.2
    assert all(0 <= r.score <= 1 for r in rows.values())
    learned = {r.doc_id for r in labels.filter(~X.held_out(F.col("doc_id"))).collect()}
    assert all(set(r.evidence) <= learned for r in rows.values())


def test_scores_do_not_depend_on_held_out_labels(spark, world):
    docs, labels = world
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(((r.doc_id, r.score) for r in X.score_documents(docs, labels).collect()), key=str)
    assert a == sorted(((r.doc_id, r.score) for r in X.score_documents(docs, flipped).collect()), key=str)


def test_the_fold_is_that_of_the_id_as_text(spark):
    got = {r.id: r.h for r in spark.range(300).select("id", X.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}


def test_dropping_keeps_columns_and_clean_rows(spark, world):
    docs, labels = world
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in X.score_documents(docs, labels).collect() if r.doc_id != 5}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert left - {5} == {i for i, s in scores.items() if s < X.THRESHOLD}


def test_without_labels_or_documents(spark, world):
    docs, labels = world
    none = X.score_documents(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0}
    assert X.score_documents(docs.limit(0), labels).count() == 0 and X.drop_toxic(docs.limit(0), labels).count() == 0
